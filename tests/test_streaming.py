"""Streams fed in several micro-batches end with the batch result."""

from pyspark.sql import functions as F

from featpipe.streaming import streams

SF = "/root/testdata/sf0.001"


def _split_events(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    d = str(tmp_path / "events_in")
    # three files, so a one-file trigger makes three micro-batches
    e.withColumn("_part", F.col("event_id") % 3).repartition(3, "_part").drop("_part") \
        .write.mode("overwrite").parquet(d)
    return e, d


def test_windowed_metrics_over_batches(spark, tmp_path):
    e, d = _split_events(spark, tmp_path)
    out, counts = streams.windowed_metrics(spark, d, e.schema, "ts", ["event_type"],
                                           [F.count("*").alias("n"), F.sum("value").alias("total")], str(tmp_path / "w"),
                                           "1 day", "30 days", files_per_trigger=1)
    assert counts["late_rows"] == 0 and counts["rows"] == e.count()
    got = sorted((str(r.window_start)[:10], r.event_type, r.n, round(r.total, 6)) for r in out.collect())
    exp = e.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"))
    want = sorted((str(r.d)[:10], r.event_type, r.n, round(r.total, 6)) for r in exp.collect())
    assert got == want


def test_latest_per_key_over_batches(spark, tmp_path):
    e, d = _split_events(spark, tmp_path)
    out = streams.latest_per_key_stream(spark, d, e.schema, "user_id", "event_id", "event_type", str(tmp_path / "l"),
                                        files_per_trigger=1)
    got = sorted(tuple(r) for r in out.select("user_id", "event_type", "event_id").collect())
    exp = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"),
                                   F.max("event_id").alias("event_id"))
    assert got == sorted(tuple(r) for r in exp.select("user_id", "event_type", "event_id").collect())


def test_stream_scoring_uses_batch_state(spark, tmp_path):
    from featpipe.operators import features as FE

    e, d = _split_events(spark, tmp_path)
    st = FE.fit_standard_scaler(e, ["value"])
    out = streams.transform_stream(spark, d, e.schema,
                                   lambda df: df.select("event_id", FE.standard_scale(st, "value").alias("z")), str(tmp_path / "s"))
    z = out.agg(F.avg("z").alias("m"), F.count("*").alias("n")).first()
    assert z["n"] == e.count() and abs(z["m"]) < 1e-9


def test_restart_resumes_and_late_rows_are_counted(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "job")
    schema = "id long, ts timestamp, k string"

    def put(rows):
        spark.createDataFrame(rows, "id long, ts string, k string").select(
            "id", F.col("ts").cast("timestamp").alias("ts"), "k").coalesce(1).write.mode("append").parquet(src)

    from pyspark.sql.types import StructType

    st = StructType.fromDDL(schema)
    put([(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-10 00:00:00", "a")])
    run = lambda: streams.windowed_metrics(spark, src, st, "ts", ["k"], [F.count("*").alias("n")], base, "1 day", "1 day")
    out, counts = run()
    assert counts["rows"] == 2 and sorted(r.n for r in out.collect()) == [1, 1]
    put([(3, "2024-01-10 05:00:00", "a"), (4, "2024-01-02 00:00:00", "a")])  # the second one is long past
    out, counts = run()  # started again: reads the new file only, goes on with the old state
    assert counts["rows"] == 2 and counts["late_rows"] == 1
    assert sorted((str(r.window_start)[:10], r.n) for r in out.collect()) == [("2024-01-01", 1), ("2024-01-10", 2)]


def test_batches_write_runs_that_merge_by_levels(spark, tmp_path):
    path, schema = str(tmp_path / "runs"), "k string, v long"
    write, want = streams._fold_batches(path, ["k"], fan=2), {}

    def rows(i):
        return [("hot", i), (None, -i), (f"k{i % 3}", 10 * i)]

    def got():
        from pyspark.sql.types import StructType

        return {r.k: r.v for r in streams._folded(spark, path, ["k"], StructType.fromDDL(schema)).collect()}

    for i in range(7):
        write(spark.createDataFrame(rows(i), schema).coalesce(1), i)
        want.update(dict(rows(i)))
        if i == 5:  # replayed after a failure
            write(spark.createDataFrame(rows(i), schema).coalesce(1), i)
    assert got() == want
    assert streams._current(streams._runs(spark, path)) == [(0, 3), (4, 5), (6, 6)]
    assert spark.read.parquet(f"{path}/run=6-6").count() == 3  # a batch's run holds its own rows only
