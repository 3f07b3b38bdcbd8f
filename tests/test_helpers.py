"""Orderings, size-checked joins and windowed counts."""

from lakewright.operators import relational
from lakewright.streaming import windows

DATA = "/root/testdata/sf0.001"


def test_order_and_join(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "a int, b int")
    assert [r["a"] for r in relational.order_nulls_last(df, "-b").collect()] == [3, 2, 1]
    assert [r["a"] for r in relational.order_nulls_last(df, "b").collect()] == [2, 3, 1]
    assert relational.join_small(df, df.select("a"), "a").count() == relational.join_small(df, df.select("a"), "a", most=0).count() == 3


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/events.parquet")
    table.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    query = windows.windowed_counts(stream, late="60 days").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, windows.windowed_counts(table).collect()))
