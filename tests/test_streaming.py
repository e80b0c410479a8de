"""Filters and projections on a stream."""

from docquire.streaming import watch


def test_watch(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "_id long, s string").write.parquet(at)
    stream = spark.readStream.schema("_id long, s string").parquet(at)
    query = watch(stream, {"s": {"$ne": "a"}}, ["s"]).writeStream.format("memory").queryName("watched").start()
    try:
        query.processAllAvailable()
        assert sorted((r["s"] or "", r["_id"]) for r in spark.table("watched").collect()) == [("", 3), ("b", 2)]
    finally:
        query.stop()
