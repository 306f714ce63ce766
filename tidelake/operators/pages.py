"""A table sorted once, whose pages are then read from the few files that hold them, however deep they lie.

The rows are parted by ranges of the sort key (ties by row index, so a value that a third of the rows have is parted too) and written in order,
some ROWS_A_PART a file. A directory says for each file how many rows stand before it. A page asks the directory, which has a row for each file,
and reads the files that overlap it; a filtered grid counts its rows once for each file, without sorting again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import mixed_order
from .profile import ROW, q

#: Rows that a file holds, about.
ROWS_A_PART = 1 << 20
PART, AT = "_grid_part", "_grid_at"


def _directory(counts: DataFrame) -> DataFrame:
    """counts(part, file, start, n) with first, the rows before each file. One row a file, so the running sum may stand in one task."""
    before = Window.partitionBy(F.lit(0)).orderBy("part", "start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


class SortedGrid:
    """Pages of the sorted rows under path, of those that `where` keeps if there is one."""

    def __init__(self, spark: SparkSession, path: str, directory: DataFrame | None = None, where: Column | None = None):
        self.spark, self.path, self.where = spark, path.rstrip("/"), where
        self.rows = spark.read.parquet(f"{self.path}/rows")
        self.directory = directory if directory is not None else spark.read.parquet(f"{self.path}/directory")

    @classmethod
    def build(cls, df: DataFrame, path: str, sort: str, descending: bool = False, rows_a_part: int = ROWS_A_PART) -> SortedGrid:
        """Sorts df (with its row index) under a new path. An empty table has no pages; nulls stand last both ways."""
        path, keys = path.rstrip("/"), [*mixed_order(q(sort), descending), F.col(ROW).asc()]
        parts = max(1, -(-df.count() // rows_a_part))
        rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its task
        rows.withColumns({PART: F.spark_partition_id(), AT: place}).write.parquet(f"{path}/rows")
        spark = df.sparkSession
        counts = spark.read.parquet(f"{path}/rows").groupBy(F.col(PART).alias("part"), F.col("_metadata.file_path").alias("file")).agg(F.min(AT).alias("start"), F.count(F.lit(1)).alias("n"))
        _directory(counts).coalesce(1).write.parquet(f"{path}/directory")
        return cls(spark, path)

    def filtered(self, where: Column) -> SortedGrid:
        """The grid of the rows that hold `where` (a value that doesn't change from read to read); one pass counts them."""
        both = where if self.where is None else self.where & where
        kept = self.rows.where(both).groupBy(F.col(PART).alias("part"), F.col("_metadata.file_path").alias("file")).agg(F.min(AT).alias("start"), F.count(F.lit(1)).alias("n"))
        return SortedGrid(self.spark, self.path, _directory(kept).cache(), both)

    def size(self) -> int:
        return self.directory.agg(F.sum("n")).first()[0] or 0

    def files(self, skip: int, size: int) -> list:
        """The directory's rows that overlap a page: some size / ROWS_A_PART and two."""
        return self.directory.where((F.col("first") < skip + size) & (F.col("first") + F.col("n") > skip)).orderBy("first").collect()

    def page(self, skip: int = 0, size: int = 100) -> DataFrame:
        """Rows skip .. skip + size - 1 of the order, in it."""
        found = self.files(skip, size) if size > 0 else []
        if not found:
            return self.rows.drop(PART, AT).limit(0)
        rows = self.spark.read.schema(self.rows.schema).parquet(*[r["file"] for r in found])
        rows = rows if self.where is None else rows.where(self.where)
        return rows.orderBy(PART, AT).offset(skip - found[0]["first"]).limit(size).drop(PART, AT)
