"""Sinks: folders written in parallel, and single-file downloads."""
from __future__ import annotations

import json
import math
from datetime import date, datetime, time
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import ROW
from .excel import write_excel


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """df without _row_index as parquet, csv, json (lines) or orc, one file a partition."""
    out = df.drop(ROW)
    if fmt == "csv":
        out.write.mode(mode).csv(path, header=True, quote='"', escape='"')
    else:
        out.write.mode(mode).format(fmt).save(path)


def write_ordered(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """write_table in row order: files are ranges of the row index, in order of their names, written in parallel."""
    rows = df.repartitionByRange(ROW).sortWithinPartitions(ROW) if ROW in df.columns else df
    write_table(rows, path, fmt, mode)


def download(df: DataFrame, path: str, fmt: str, most_rows: int = 1_000_000) -> str:
    """One local file: csv (UTF-8 with byte-order mark), xlsx, json (records) or parquet. Rows stream through the driver in order, so a table of
    over most_rows is refused; write_ordered writes those."""
    if fmt not in ("csv", "xlsx", "json", "parquet"):
        raise ValueError(f"unsupported download format: {fmt}")
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"over {most_rows} rows: write them as a folder with write_ordered")
    ordered = df.orderBy(ROW).drop(ROW) if ROW in df.columns else df
    if fmt == "xlsx":
        write_excel(ordered, path)
    elif fmt == "parquet":
        ordered.coalesce(1).write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        import csv

        with open(path, "w", encoding="utf-8-sig", newline="") as f:
            w = csv.writer(f)
            w.writerow(ordered.columns)
            for r in ordered.toLocalIterator():
                w.writerow(["" if v is None else v for v in r])
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write("[")
            for i, r in enumerate(ordered.toLocalIterator()):
                f.write(("," if i else "") + "\n" + json.dumps(json_safe(r.asDict(recursive=True)), ensure_ascii=False, indent=2))
            f.write("\n]\n")
    return path


def json_safe(v: Any) -> Any:
    """A cell as JSON holds it: temporals as ISO, numbers that aren't finite as null, nested values likewise."""
    if isinstance(v, dict):
        return {str(k): json_safe(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set)):
        return [json_safe(x) for x in v]
    if isinstance(v, (datetime, date, time)):
        return v.isoformat()
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    return v


def preview_rows(df: DataFrame, limit: int = 100) -> dict:
    """The first rows (1 to 1000) as JSON records, with counts."""
    n = max(1, min(1000, limit))
    rows = (df.orderBy(ROW) if ROW in df.columns else df).drop(ROW).limit(n).collect()
    return {"columns": [c for c in df.columns if c != ROW], "rows": [json_safe(r.asDict(recursive=True)) for r in rows], "total_rows": df.count(), "shown": len(rows)}


def json_column(df: DataFrame) -> DataFrame:
    """_row_index and each row as a JSON string, in the JVM."""
    return df.select(*[c for c in (ROW,) if c in df.columns], F.to_json(F.struct(*[c for c in df.columns if c != ROW])).alias("json"))
