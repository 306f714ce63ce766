"""Structured Streaming forms of ingest, deduplication and quality metrics."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.nullness import is_disguised
from ..operators.profile import q
from ..plans.lineage import LineageStore
from ..sources.readers import strings


def ingest_stream(spark: SparkSession, folder: str, schema: StructType, store: LineageStore, session: str, checkpoint: str, fmt: str = "parquet"):
    """Each batch of new files becomes the session's next version. Runs over what is there and stops."""
    rows = spark.readStream.format(fmt).schema(schema).load(folder)

    def publish(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            store.append(session, strings(batch), "stream", f"batch {n}")

    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(rows: DataFrame, keys: list[str], time_col: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key while its watermark lasts; state is bounded by it."""
    return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def window_quality(rows: DataFrame, time_col: str, columns: list[str], size: str, slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Per window: n, and null rates and placeholder counts of columns."""
    sums = []
    for c in columns:
        sums += [F.avg(q(c).isNull().cast("int")).alias(f"{c}_null_rate"), F.count_if(is_disguised(q(c))).alias(f"{c}_disguised")]
    w = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    return rows.withWatermark(time_col, late).groupBy(w, *(by or [])).agg(F.count(F.lit(1)).alias("n"), *sums)


def session_quality(rows: DataFrame, time_col: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Per session of each key: n rows."""
    return rows.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), *by).agg(F.count(F.lit(1)).alias("n"))


class _MostComplete(StatefulProcessor):
    """Gives a key's row again whenever a more complete one arrives."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "nulls int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.best.get()[0] if self.best.exists() else None
        for pdf in rows:
            nulls = pdf[self.columns].isna().sum(axis=1)
            at = nulls.idxmin()
            if best is None or int(nulls[at]) < best:
                best = int(nulls[at])
                self.best.update((best,))
                yield pdf.loc[[at]]

    def close(self) -> None:
        pass


def most_complete_stream(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Updates of each key's most complete row. Needs the RocksDB state store."""
    return rows.groupBy(*keys).transformWithStateInPandas(_MostComplete(columns), rows.schema, outputMode="Update", timeMode="None")
