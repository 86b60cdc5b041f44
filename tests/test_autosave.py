from rasterloom.streaming import autosave as A


def test_run_to_table(spark, tmp_path):
    """Finished bursts lie in files, not in the driver."""
    e = spark.createDataFrame([("a", 0, "p"), ("a", 1, "q"), ("a", 100, "r"), ("b", 5000, "s")], "key string, s long, state string").selectExpr("key", "timestamp_seconds(s) ts", "state")
    for part in (e.where("key = 'a'"), e.where("key = 'b'")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    out = A.run_to_table(stream, "bursts", f"{tmp_path}/check")
    assert sorted((r.key, r.n, r["last"]) for r in out.collect()) == [("a", 1, "r"), ("a", 2, "q")]
    assert out.inputFiles() and spark.table("bursts").count() == 2
