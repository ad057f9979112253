import datetime

import pytest
from pyspark.sql import functions as F

from tarn.streaming import pipelines as S

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


@pytest.fixture()
def events(spark, tmp_path):
    folder = str(tmp_path / "in")

    def put(rows):
        spark.createDataFrame(rows, "ts timestamp, k string, v int").coalesce(1).write.mode("append").parquet(folder)

    put([(at(0), "a", 1), (at(1), "a", 2), (at(6), "b", 3)])
    return folder, put, spark.read.parquet(folder).schema


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows_equal_batch(spark, events):
    folder, _, schema = events
    out = drain(S.tumbling(S.source(spark, folder, schema), "ts", "5 minutes", ["k"], [F.sum("v").alias("s")], "0 seconds"), "tumbling", "complete")
    batch = spark.read.parquet(folder).groupBy(F.window("ts", "5 minutes").alias("w"), "k").agg(F.sum("v").alias("s")).select(F.col("w.start"), "k", "s")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
    slid = drain(S.sliding(S.source(spark, folder, schema), "ts", "10 minutes", "5 minutes", [], [F.count("v").alias("n")], "0 seconds"), "sliding", "complete")
    assert sum(r.n for r in slid.collect()) == 6
    ses = drain(S.sessions(S.source(spark, folder, schema), "ts", "2 minutes", ["k"], [F.count("v").alias("n")], "0 seconds"), "sessions", "complete")
    assert sorted((r.k, r.n) for r in ses.collect()) == [("a", 2), ("b", 1)]


def test_late_rows_are_dropped(spark, events, tmp_path):
    folder, put, schema = events
    df = S.tumbling(S.source(spark, folder, schema, 1), "ts", "5 minutes", [], [F.count("v").alias("n")], "1 minute")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for rows in (None, [(at(60), "c", 1)], [(at(2), "late", 1)], [(at(120), "d", 1)]):
        if rows:
            put(rows)
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)
    got = {r.bucket: r.n for r in spark.read.parquet(out).collect()}
    assert got[at(0)] == 2 and got[at(5)] == 1


def test_deduplication(spark, events):
    folder, _, schema = events
    out = drain(S.distinct_within(S.source(spark, folder, schema), "ts", ["k"], "1 hour"), "dedup")
    assert sorted(r.k for r in out.collect()) == ["a", "b"]


def test_distinct_counts(spark, events):
    folder, _, schema = events
    out = drain(S.distinct_counts(S.source(spark, folder, schema), ["k"]), "distinct", "complete")
    assert sorted(map(tuple, out.collect())) == [("k", "a", 2), ("k", "b", 1)]


def test_grouped_alerts(spark, events):
    folder, put, schema = events
    put([(at(i), "a", 0) for i in (2, 3)])
    out = drain(S.grouped_alerts(S.source(spark, folder, schema, 10), "ts", "k", "30 minutes", 2), "alerts")
    assert [(r.k, r.n, r.reason) for r in out.filter("k = 'a'").collect()] == [("a", 2, "size"), ("a", 2, "size")]


def test_realtime_pipeline(spark, events, tmp_path):
    folder, _, schema = events
    nodes = [S.Node("v > 1", lambda d: d.withColumn("v", F.col("v") * 10)), S.Node("k = 'a'", None, "only_a"), S.Node(None, None, "all")]
    S.realtime(S.source(spark, folder, schema), nodes, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.v for r in spark.read.parquet(str(tmp_path / "out/only_a")).collect()] == [20]
    assert spark.read.parquet(str(tmp_path / "out/all")).count() == 2


def test_backfill_is_idempotent(spark, tmp_path):
    for _ in range(2):
        n = S.derived(spark, lambda a, b: spark.createDataFrame([(a, b)], "a long, b long"), str(tmp_path / "d"), 0, 180_000_000, 60_000_000)
    assert n == 3 and spark.read.parquet(str(tmp_path / "d")).count() == 3
    with pytest.raises(ValueError):
        S.derived(spark, None, "", 0, 1, 1)


def test_join_of_streams_with_one_time_name(spark, events):
    folder, _, schema = events
    left, right = S.source(spark, folder, schema), S.source(spark, folder, schema)
    out = drain(S.join_streams(left, right, ["k"], "ts", "ts", "2 minutes"), "joined")
    assert sorted((r.k, r.v, r.right_v) for r in out.collect()) == [("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", 2, 2), ("b", 3, 3)]


def test_service_graph_over_batches(spark, tmp_path):
    from tarn.operators import traces

    folder, out, check = (str(tmp_path / x) for x in ("spans", "out", "check"))
    schema = "ts timestamp, trace_id string, span_id string, reference_parent_span_id string, service_name string, span_status string, start_time long, end_time long"

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = S.source(spark, folder, spark.read.parquet(folder).schema, 1)
        S.service_graph_batches(stream, out, check, "ts", "10 minutes").trigger(availableNow=True).start().awaitTermination(120)

    put((at(0), "t", "1", "", "web", "OK", 0, 9))
    run()
    put((at(1), "t", "2", "1", "db", "ERROR", 1, 5))  # its parent came in an earlier batch
    run()
    for m in (60, 120):
        put((at(m), "x", str(m), "", "clock", "OK", 0, 1))
        run()
    got = {(r.client, r.server): (r.total_requests, r.failed_requests) for r in traces.edge_totals(spark.read.parquet(out)).collect()}
    assert got[("web", "db")] == (1, 1) and got[(None, "web")] == (1, 0) and (None, "db") not in got
