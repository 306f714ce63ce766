"""Readers. Ingested tables are strings with a dense _row_index; typed loads keep their types."""
from __future__ import annotations

import csv
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nullness import INGEST_TOKENS
from ..operators.joins import shifted
from ..operators.profile import ROW, q

#: Extensions by format.
FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "xlsx": "excel", "xlsm": "excel", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "pq": "parquet"}
SNIFF_BYTES, SNIFF_CHARS, ADVISORY_ROWS = 100_000, 4096, 1000


def detect_format(path: str) -> str:
    ext = PurePosixPath(path).suffix.lower().lstrip(".")
    if ext not in FORMATS:
        raise ValueError(f"unsupported extension: {ext or path}")
    return FORMATS[ext]


def head_bytes(spark: SparkSession, path: str, n: int = SNIFF_BYTES) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = min(n, store.getFileStatus(at).getLen())
    stream = store.open(at)
    try:
        return bytes(stream.readNBytes(int(size)))
    finally:
        stream.close()


def detect_encoding(head: bytes) -> str:
    """By byte-order mark, else UTF-8 if the head decodes (a cut last character aside), else a single-byte one (Windows-1252)."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "UTF-8"
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 3:
            return "ISO-8859-1"
    return "UTF-8"


def sniff_delimiter(text: str) -> str:
    """One of , ; tab | by the csv module's sniffer; comma if it can't tell."""
    try:
        return csv.Sniffer().sniff(text[:SNIFF_CHARS], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def unique_names(names: list[str]) -> list[str]:
    """Repeated names as a, a.1, a.2."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}.{k}" if k else n)
    return out


def with_row_index(df: DataFrame) -> DataFrame:
    """_row_index: dense from 0 in file order, by numbers inside files (or the reader's partitions) shifted by those before."""
    try:
        local = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    except AnalysisException:  # text sources have no row positions: the reader's own order
        ident = F.monotonically_increasing_id()
        local = df.withColumns({"_f": F.shiftright(ident, 33), "_r": ident.bitwiseAND(F.lit((1 << 33) - 1))})
    return shifted(local, local, "_f", "_r", ROW, first=0)


def strings(df: DataFrame, tokens: tuple[str, ...] = INGEST_TOKENS) -> DataFrame:
    """All data columns as strings, null tokens as null; nested cells as JSON."""
    def one(c: str):
        nested = isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))
        s = F.to_json(q(c)) if nested else q(c).cast("string")
        return F.when(~s.isin(*tokens), s).alias(c) if tokens else s.alias(c)

    return df.select(*[q(c) if c == ROW else one(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """Header row, detected encoding and delimiter, quotes doubled, lines inside quotes, repeated headers renamed."""
    head = head_bytes(spark, path)
    encoding = detect_encoding(head)
    text = head.decode({"UTF-8": "utf-8-sig", "UTF-16": "utf-16"}.get(encoding, "cp1252"), "replace")
    sep = sniff_delimiter(text)
    first = next(csv.reader(text.splitlines(keepends=True), delimiter=sep), [])
    names = unique_names(first)
    reader = spark.read.options(header=True, sep=sep, encoding=encoding, quote='"', escape='"', multiLine=True, enforceSchema=True)
    if typed:
        return reader.option("inferSchema", True).csv(path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = reader.schema(schema).csv(path)
    if encoding == "ISO-8859-1":  # as Windows-1252: what lies in the C1 range are its signs
        pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
        old, new = ("".join(x) for x in zip(*[p for p in pairs if p[1]], strict=True))
        df = df.select(*[F.translate(q(c), old, new).alias(c) for c in names])
    return df


def read_json(spark: SparkSession, path: str, flatten: bool = False, typed: bool = False) -> DataFrame:
    """A JSON array (.json) or JSON lines; flatten gives fields of structs as a.b, one level."""
    df = spark.read.options(multiLine=path.lower().endswith(".json"), primitivesAsString=not typed).json(path)
    if not flatten:
        return df
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            out += [F.col(f"`{f.name}`.`{x.name}`").alias(f"{f.name}.{x.name}") for x in f.dataType]
        else:
            out.append(q(f.name))
    return df.select(*out)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, as strings."""
    from .excel import ExcelSource

    spark.dataSource.register(ExcelSource)
    return spark.read.format("tidelake_excel").option("path", path).load()


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """Any supported file as a string table with _row_index. An empty table is refused."""
    kind = detect_format(path)
    if kind == "parquet":
        df = with_row_index(spark.read.parquet(path))
    else:
        df = with_row_index({"csv": read_csv, "json": read_json, "excel": read_excel}[kind](spark, path))
    df = strings(df)
    if df.limit(1).isEmpty():
        raise ValueError("the table has no rows")
    return df


def load(spark: SparkSession, path: str) -> DataFrame:
    """Typed load by extension."""
    kind = detect_format(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return read_csv(spark, path, typed=True)
    return read_json(spark, path, typed=True) if kind == "json" else read_excel(spark, path)


def advisory_schema(spark: SparkSession, path: str) -> dict[str, str]:
    """{column: type} inferred from the first rows, for display only."""
    df = load(spark, path).limit(ADVISORY_ROWS)
    return {f.name: f.dataType.simpleString() for f in df.schema}


def check_upload(name: str | None, size: int, most_mb: int = 100) -> None:
    """A name is needed and the size bounded."""
    if not name:
        raise ValueError("a file name is needed")
    if size > most_mb * 1024 * 1024:
        raise ValueError(f"the file is larger than {most_mb} MB")


def preview(df: DataFrame, limit: int = 1000) -> DataFrame:
    """The first rows that aren't blank in every column."""
    some = F.lit(False)
    for c in df.columns:
        if c != ROW:
            some = some | (F.coalesce(F.trim(q(c).cast("string")), F.lit("")) != "")
    out = df.where(some)
    return (out.orderBy(ROW) if ROW in df.columns else out).limit(limit)
