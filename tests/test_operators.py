import json

import pytest
from pyspark.sql import functions as F

from tarn.operators import jobs, relational, traces
from tarn.sources import ingest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_match_one_join(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, 10, "old"), (1, 20, "new"), (None, 5, "null")], "k int, _timestamp long, v string")
    assert rows(relational.match_one_join(left, right, ["k"])) == [(1, 20, "new")]
    assert len(rows(relational.match_one_join(left, right.limit(0), ["k"], "left"))) == 3


def test_enrichment_is_broadcast_by_size(spark):
    df, lookup = spark.range(10), spark.range(3).withColumn("name", F.lit("x"))
    small = relational.enrich(df, lookup, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in small
    assert relational.enrich(df, lookup, ["id"], limit=0).filter("name = 'x'").count() == 3


def test_groups_frame(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 5), ("a", 9)], "p string, o int")
    assert rows(relational.groups_frame(df, ["p"], "o", F.count(F.lit(1)), 1, 0, "n")) == [("a", 1, 2), ("a", 1, 2), ("a", 5, 3), ("a", 9, 2)]


def test_sampling(spark):
    df = spark.range(10_000).withColumn("_timestamp", F.col("id") * 1000)
    a = relational.sample_by_hash(df, 0.1, ["id"])
    assert 800 < a.count() < 1200 and rows(a) == rows(relational.sample_by_hash(df.repartition(7), 0.1, ["id"]))
    parts = relational.sample_stratified(df, 0.2, "_timestamp", 4).groupBy(F.floor(F.col("id") / 2500)).count().collect()
    assert len(parts) == 4 and all(300 < r["count"] < 700 for r in parts)
    assert relational.sample_rows(df, 0.5).count() < 10_000


def spans(spark):
    return spark.createDataFrame(
        [("t", "1", "", "web", "get", "2", "OK", 0, 100), ("t", "2", "1", "web", "inner", "1", "OK", 5, 90), ("t", "3", "2", "db", "select", "2", "ERROR", 10, 50), ("t", "4", "9", "db", "lost", "2", "OK", 20, 30)],
        "trace_id string, span_id string, reference_parent_span_id string, service_name string, operation_name string, span_kind string, span_status string, start_time long, end_time long",
    )


def test_service_graph(spark):
    edges = traces.service_edges(spans(spark), exact=True)
    got = {(r.client, r.server): (r.total_requests, r.failed_requests, r.p50) for r in edges.collect()}
    assert got == {(None, "web"): (1, 0, 100.0), ("web", "db"): (1, 1, 40.0), (None, "db"): (1, 0, 10.0)}
    assert rows(traces.service_nodes(edges)) == [("db", 2, 0, 1), ("web", 1, 1, 0)]


def test_trace_depths_and_costs(spark):
    spans(spark).createOrReplaceTempView("spans_view")
    assert {(r.span_id, r.depth) for r in traces.depths(spark, "spans_view").collect()} == {("1", 0), ("2", 1), ("3", 2)}
    prices = spark.createDataFrame([("m", 0, 1.0, 2.0), ("m", 1000, 10.0, 20.0)], "model string, from_tokens long, input_price double, output_price double")
    calls = spark.createDataFrame([("m", 500, 100), ("m", 2000, 100), ("other", 1, 1)], "model string, input_tokens long, output_tokens long")
    assert [r.cost for r in traces.token_costs(calls, prices).orderBy("input_tokens").collect()] == [None, pytest.approx(0.0007), pytest.approx(0.022)]


def test_downsample(spark):
    df = spark.createDataFrame([("s", 0, 1.0, "x"), ("s", 59_000_000, 3.0, "x"), ("s", 60_000_000, 5.0, "x")], "__hash__ string, _timestamp long, value double, job string")
    assert rows(jobs.downsample(df, "1 minute")) == [("s", 0, 2.0, "x"), ("s", 60_000_000, 5.0, "x")]
    assert {r.value for r in jobs.downsample(df, "1 minute", "last").collect()} == {3.0, 5.0}
    with pytest.raises(ValueError):
        jobs.downsample(df, "1 minute", "mode")


def test_partial_aggregates_with_sketch(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    a = jobs.partial_aggregate(df.filter("v < 500"), ["k"], "v", "v").unionByName(jobs.partial_aggregate(df.filter("v >= 500"), ["k"], "v", "v"))
    got = jobs.merge_aggregates(a, ["k"]).orderBy("k").collect()
    assert [(r["count"], r["min"], r["max"]) for r in got] == [(500, 0, 998), (500, 1, 999)]
    assert all(abs(r.distinct - 500) < 50 for r in got)


def test_patterns_and_row_functions(spark):
    logs = spark.createDataFrame([("user 1 from 10.0.0.1",), ("user 22 from 10.0.0.2",), ("down",), (None,)], "log string")
    assert [(r.pattern, r.num) for r in jobs.patterns(logs, "log").collect()] == [("user <num> from <ip>", 2), ("down", 1)]
    out = jobs.apply_rows(spark.range(4), lambda r: [{"n": len(r)}], "n long", whole=True)
    assert rows(out) == [(4,)]


def test_compaction(spark, tmp_path):
    jobs.compact(spark.range(100).withColumnRenamed("id", "_timestamp"), str(tmp_path / "c"), target_rows=50)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 100


def test_flatten(spark):
    df = ingest.from_json_text(spark, [{"A b": 1, "n": {"X": {"y": 2}}, "l": [1, 2], "_timestamp": 1_700_000_000}])
    r = df.first().asDict()
    assert r == {"a_b": 1, "n_x_y": 2, "l": "[1,2]", "_timestamp": 1_700_000_000_000_000}
    assert json.loads(ingest.from_json_text(spark, [{"n": {"X": {"y": 2}}}], max_level=2).first().n_x) == {"y": 2}
    with pytest.raises(ValueError):
        ingest.flatten(spark.createDataFrame([(1, 2)], "`a b` int, a_b int"))


def test_protocols(spark):
    lines = spark.createDataFrame([('{"time": 1.5, "host": "h", "event": {"m": 1}}',), ("bad",)], "value string")
    assert [(r._timestamp, r.log, r.stream) for r in ingest.hec(lines).collect()] == [(1_500_000, '{"m":1}', "default")]
    push = spark.createDataFrame([('{"streams":[{"stream":{"app":"x"},"values":[["1700000000000000000","hi"],["1700000001000000000","yo",{"k":"v"}]]}]}',)], "value string")
    got = ingest.loki(push).collect()
    assert [(r._timestamp, r.log, r.labels) for r in got][0] == (1_700_000_000_000_000, "hi", {"app": "x"})
    labels = spark.createDataFrame([('{a="x", b="y\\"z"}',)], "s string").select(ingest.parse_labels(F.col("s")).alias("m")).first().m
    assert labels == {"a": "x", "b": 'y"z'}
    body = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "web"}}]}, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "name": "op", "kind": 2, "startTimeUnixNano": "1000000", "endTimeUnixNano": "3000000", "attributes": [{"key": "n", "value": {"intValue": "5"}}], "status": {"code": 2}}]}]}]}
    s = ingest.otlp_spans(spark.createDataFrame([(json.dumps(body),)], "value string")).first()
    assert (s.service_name, s.operation_name, s.span_status, s.duration, s.attributes) == ("web", "op", "ERROR", 2000, {"n": "5"})
    assert spark.range(1).select(ingest.severity_text(F.lit(17)), ingest.severity_text(F.lit(0))).first()[:] == ("ERROR", "UNSPECIFIED")


def test_metrics(spark):
    m = ingest.metrics(spark, [{"__name__": "up", "__type__": "gauge", "job": "a", "value": 1, "_timestamp": 1_700_000_000_000}])
    r = m.first()
    assert (r.value, r.job, r._timestamp, len(r["__hash__"])) == (1.0, "a", 1_700_000_000_000_000, 16)
    with pytest.raises(ValueError):
        ingest.metrics(spark, [{}])


def test_write_and_read_stream(spark, tmp_path):
    df = spark.createDataFrame([(1_700_000_000_000_000, "a"), (1_700_003_600_000_000, "b")], "_timestamp long, log string")
    ingest.write_stream(df, str(tmp_path), "org", "logs", "app", bloom=["log"])
    ingest.write_stream(df.withColumn("extra", F.lit(1)), str(tmp_path), "org", "logs", "app")
    back = ingest.read_stream(spark, str(tmp_path), "org", "logs", "app")
    assert back.count() == 4 and "extra" in back.columns and back.filter("hr = '22'").count() == 2


def test_pages(spark, tmp_path):
    from tarn.catalog import Catalog
    from tarn.plans import pages
    from tarn.plans.search import Engine, Request

    catalog = Catalog(spark)
    catalog.register("logs_t", spark.range(100).selectExpr("id * 1000000 AS _timestamp", "id AS n", "id % 3 AS k"))
    e = Engine(catalog)
    r = Request("SELECT _timestamp, n FROM logs_t", 0, 100_000_000, size=25)
    got = [(c.start_us, c.n, round(c.progress, 2), [x.n for x in c.rows.collect()]) for c in pages.chunks(e, r, 10_000_000)]
    assert [g[:3] for g in got] == [(90_000_000, 10, 0.1), (80_000_000, 10, 0.2), (70_000_000, 5, 0.3)]
    assert [n for g in got for n in g[3]] == list(range(99, 74, -1))
    up = [x.n for c in pages.chunks(e, r, 10_000_000, ascending=True) for x in c.rows.collect()]
    assert up == list(range(25))
    rows, more = pages.truncated(e, r)
    assert rows.count() == 25 and more and not pages.truncated(e, Request(r.sql, 0, 20_000_000, size=25))[1]
    plan = pages.explain(e, Request("SELECT k, count(*) AS c FROM logs_t GROUP BY k"), analyze=True).collect()
    assert {x.phase for x in plan} == {0, 1} and any("Aggregate" in x.plan for x in plan)
    cache = pages.SliceCache(e, str(tmp_path / "cache"), 30_000_000)
    for _ in range(2):
        out = cache.aggregate("q", Request("SELECT k, n FROM logs_t", 5_000_000, 95_000_000), ["k"], "n", 60_000_000)
        assert sum(x["count"] for x in out.collect()) == 90
    assert cache.computed == 1
    work = pages.Jobs(e, str(tmp_path / "jobs"))
    good, bad = work.submit(r), work.submit(Request("SELECT _timestamp, raise_error('no') AS x FROM logs_t"))
    assert work.result(good, offset=5).count() == 20 and work.status(good) == "finished"
    with pytest.raises(Exception):
        work.result(bad)
    assert work.status(bad) == "failed"


def test_backfill(spark, tmp_path):
    from tarn.plans import pages

    cleared = []
    run = lambda done=None: list(pages.backfill(lambda a, b: spark.range(a // 60_000_000, b // 60_000_000), lambda a, b: cleared.append((a, b)), str(tmp_path / "b"), 0, 180_000_000, 60_000_000, done))
    assert [round(p, 2) for _, _, p in run()] == [0.33, 0.67, 1.0] and cleared == [(0, 180_000_000)]
    assert run(120_000_000)[0][0] == 120_000_000 and len(cleared) == 1
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "b")).collect()) == [0, 1, 2]


def test_conditions_and_qualify():
    from tarn.plans import conditions, sqltext

    assert conditions.where(None) == "true" and conditions.where([]) == "true"
    assert conditions.where({"column": "a.b", "operator": "=", "value": "it's"}) == "`a`.`b` = 'it\\'s'"
    assert conditions.where({"not": {"column": "a", "operator": "is null"}}) == "(NOT `a` IS NULL)"
    with pytest.raises(ValueError):
        conditions.where({"column": "a", "operator": "~", "value": 1})
    assert sqltext.qualify("SELECT 1 AS qualify_me FROM t") == "SELECT 1 AS qualify_me FROM t"


def test_conditions_quote_patterns(spark):
    from tarn.plans import conditions

    df = spark.createDataFrame([("50% off",), ("50 off",), ("a_b",), ("axb",)], "s string")
    found = lambda v: [r.s for r in df.filter(conditions.where({"column": "s", "operator": "contains", "value": v})).collect()]
    assert found("0%") == ["50% off"] and found("a_") == ["a_b"]


def test_as_of_and_interval_joins(spark):
    from tarn.operators import relational as R

    a = spark.createDataFrame([("x", 10, 1), ("x", 5, 2), ("y", 7, 3), (None, 9, 4)], "k string, t long, n int")
    b = spark.createDataFrame([("x", 5, "p"), ("x", 9, "q"), ("x", 11, "r"), ("z", 1, "s")], "k string, t long, v string")
    assert sorted((r.n, r.v) for r in R.as_of_join(a, b, ["k"], "t").collect()) == [(1, "q"), (2, "p"), (3, None), (4, None)]
    assert {r.n: r.v for r in R.as_of_join(a, b, ["k"], "t", tolerance=0).collect()} == {1: None, 2: "p", 3: None, 4: None}
    i = spark.createDataFrame([("x", 0, 10, "u"), ("x", 5, 100, "w"), ("x", 4, 4, "none")], "k string, low long, high long, w string")
    assert sorted((r.n, r.w) for r in R.interval_join(a, i, ["k"], "t", "low", "high", 3).collect()) == [(1, "w"), (2, "u"), (2, "w")]


def test_latest_with_maps_and_system_sampling(spark):
    from tarn.operators import relational as R

    df = spark.sql("SELECT id % 2 AS k, id AS _timestamp, map('a', id) AS m FROM range(10)")
    assert sorted((r.k, r.m["a"]) for r in R.latest(df, ["k"]).collect()) == [(0, 8), (1, 9)]
    parts = spark.range(0, 1000, 1, 50)
    drawn = {r.id // 20 for r in R.sample_system(parts, 0.3).collect()}
    assert 0 < len(drawn) < 50 and R.sample_system(parts, 0.3).count() == 20 * len(drawn)


def test_ingest_kinds(spark, tmp_path):
    import base64
    import json

    from tarn.sources import ingest

    b64 = lambda x: base64.b64encode(x.encode()).decode()
    lines = lambda *rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    got = ingest.pubsub(lines({"message": {"data": b64("hello"), "messageId": "7", "publishTime": "2024-01-01T00:00:00Z"}, "subscription": "s"}, {"other": 1})).collect()
    assert [(r.log, r.message_id, r._timestamp) for r in got] == [("hello", "7", 1704067200000000)]
    batch = {"logGroup": "g", "logStream": "s", "logEvents": [{"id": "1", "timestamp": 1704067200000, "message": "m1"}, {"id": "2", "timestamp": 1704067201000, "message": "m2"}]}
    rows = ingest.firehose(lines({"requestId": "r", "timestamp": 1704067200000, "records": [{"data": b64("plain")}, {"data": b64(json.dumps(batch))}]})).collect()
    assert sorted((r.log, r.log_group) for r in rows) == [("m1", "g"), ("m2", "g"), ("plain", None)]
    page = ingest.rum(lines({"type": "view", "date": 1704067200000, "session": {"id": "s1"}}), {"Env": "prod"}).first()
    assert (page.type, page.session_id, page.env, page._timestamp) == ("view", "s1", "prod", 1704067200000000)
    (tmp_path / "m.json").write_text('[\n {"a": 1,\n "_timestamp": 1704067200},\n {"a": 2, "_timestamp": 1704067201}\n]')
    multi = ingest.with_record_id(ingest.multi_line(spark, str(tmp_path / "m.json"))).orderBy("_record_id").collect()
    assert [r.a for r in multi] == [1, 2] and len({r._record_id for r in multi}) == 2
    samples = spark.createDataFrame([("up", "a", 1.0, 1704067200), (None, "a", 1.0, 1704067200), ("up", "a", None, 1704067200)], "__name__ string, job string, value double, _timestamp long")
    assert [(r.job, r.value) for r in ingest.metric_samples(samples).collect()] == [("a", 1.0)]
    ingest.export_json(samples.select("job", "_timestamp").limit(2), str(tmp_path / "out"))
    assert ingest.import_json(spark, str(tmp_path / "out"), samples.select("job", "_timestamp").schema, str(tmp_path / "root"), "org", "logs", "s") == 2
    assert ingest.read_stream(spark, str(tmp_path / "root"), "org", "logs", "s").count() == 2


def test_cipher_functions(spark):
    q = spark.sql("SELECT decrypt(encrypt('text', 'k'), 'k') AS a, decrypt(encrypt('text', 'k'), 'other') AS b, decrypt('plain', 'k') AS c, encrypt('text', 'k') = encrypt('text', 'k') AS same").first()
    assert (q.a, q.b, q.c, q.same) == ("text", None, None, False)
