import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelake.streaming import streams as S


def test_most_complete_stream(spark, tmp_path):
    pdf = pd.DataFrame({"k": [1, 1, 2], "a": [None, "x", "y"], "b": ["p", "q", None]})
    spark.createDataFrame(pdf).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = S.most_complete_stream(rows, ["k"], ["a", "b"]).writeStream.format("memory").queryName("best").outputMode("update").option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception as e:  # the box may lack what the state server needs
            if "ModuleNotFound" in str(e) or "protobuf" in str(e):
                pytest.skip("stateful Python processing isn't available here")
            raise
        assert {(r.k, r.a, r.b) for r in spark.sql("SELECT * FROM best").collect()} == {(1, "x", "q"), (2, "y", None)}
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_session_windows(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 02:00:00")], "u int, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = S.session_quality(rows, "t", "10 minutes", ["u"]).writeStream.format("memory").queryName("sessions").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.sql("SELECT n FROM sessions").collect()) == [1, 2]
