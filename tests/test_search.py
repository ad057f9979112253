import pytest
from pyspark.sql import types as T

from tarn import catalog as C
from tarn.plans import sqltext as q
from tarn.plans.search import Engine, Request


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(1_700_000_000_000_000 + i * 60_000_000, f"Message {i} from host", "error" if i % 3 else "info", i) for i in range(30)]
    catalog = C.Catalog(spark)
    catalog.register("app", spark.createDataFrame(rows, "_timestamp long, log string, level string, n int"))
    catalog.register("app", spark.createDataFrame([(1, 2.0)], "_timestamp long, value double"), kind="metrics")
    return Engine(catalog)


def test_rewrites():
    assert q.total_hits("SELECT a, b FROM t WHERE x = 1 GROUP BY a ORDER BY b LIMIT 3") == "SELECT count(*) AS num FROM t WHERE x = 1"
    assert q.total_hits("SELECT DISTINCT a FROM t ORDER BY a LIMIT 3") == "SELECT count(*) AS num FROM (SELECT DISTINCT a FROM t) AS t"
    assert q.total_hits("SELECT a FROM t UNION SELECT b FROM u") == "SELECT count(*) AS num FROM (SELECT a FROM t UNION SELECT b FROM u) AS t"
    assert q.add_columns("SELECT a FROM t", ["_timestamp"]) == "SELECT _timestamp, a FROM t"
    assert q.add_columns("SELECT * FROM t", ["_timestamp"]) == "SELECT * FROM t"
    assert q.add_columns("SELECT count(*) FROM t", ["_timestamp"]) == "SELECT count(*) FROM t"
    assert q.add_filters("SELECT * FROM t WHERE a = 1 OR b = 2", {"k": "it's"}) == r"SELECT * FROM t WHERE (a = 1 OR b = 2) AND k = 'it\'s'"
    assert q.where_of("SELECT * FROM t JOIN u ON t.a = u.a WHERE x = 1") is None and q.where_of("SELECT * FROM t WHERE x = 1") == "x = 1"
    assert q.partition_equalities("SELECT * FROM t WHERE a = 'x' AND b IN ('y', 'z')") == {"a": ["x"], "b": ["y", "z"]}
    assert q.partition_equalities("SELECT * FROM t WHERE a = 'x' OR b = 'y'") == {}


def test_placeholders_respect_quotes_and_negation():
    assert q.drop_placeholders("SELECT '__all__' AS x FROM t WHERE a = '__all__' AND b <> '__all__' AND c NOT IN ('__all__') AND d LIKE '%__all__%'") == "SELECT '__all__' AS x FROM t WHERE true AND false AND false AND true"
    assert q.expand_custom("SELECT * FROM t WHERE a = 'x::__custom' AND b IN ('y::__custom')") == "SELECT * FROM t WHERE str_match(a, 'x') AND str_match(b, 'y')"


def test_calls_in_strings_and_comments_stay():
    sql = "SELECT 'histogram(x)' AS a -- histogram(y)\nFROM t"
    assert q.rewrite_calls(sql, {"histogram": lambda a: "!"}) == sql
    assert q.rewrite_calls("SELECT f(g(1, 2), '(')", {"g": lambda a: "+".join(a)}) == "SELECT f(1+ 2, '(')".replace("1+ 2", "1+2")


def test_default_order_and_limit(engine):
    rows = engine.search(Request("SELECT _timestamp, n FROM app", size=3)).collect()
    assert [r.n for r in rows] == [29, 28, 27]
    assert engine.search(Request("SELECT n FROM app ORDER BY n LIMIT 2")).collect()[0].n == 0
    assert engine.search(Request("SELECT count(*) AS c FROM app")).first().c == 30


def test_time_range_is_half_open(engine):
    start = 1_700_000_000_000_000
    assert engine.total_hits(Request("SELECT * FROM app", start, start + 60_000_000)).first().num == 1


def test_time_range_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id AS _timestamp", "id AS n", "CAST(id AS STRING) AS s").write.parquet(str(tmp_path / "t"))
    c = C.Catalog(spark)
    c.register("t", str(tmp_path / "t"))
    plan = Engine(c).plan(Request("SELECT n FROM t", 10, 20))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_timestamp,10)" in plan and "ReadSchema: struct<_timestamp:bigint,n:bigint>" in plan


def test_full_text(engine):
    assert engine.total_hits(Request("SELECT * FROM app WHERE match_all('MESSAGE 7')")).first().num == 1
    assert engine.total_hits(Request("SELECT * FROM app WHERE fuzzy_match_all('mesage', 1)")).first().num == 30
    with pytest.raises(ValueError):
        engine.plan(Request("WITH a AS (SELECT 1) SELECT * FROM app WHERE match_all('x')"))


def test_kinds_and_unknown_streams(engine):
    assert engine.plan(Request("SELECT value FROM metrics.app")).first().value == 2.0
    with pytest.raises(KeyError):
        engine.catalog.get("nothing")


def test_histogram_and_values(engine):
    assert sum(r.num for r in engine.histogram(Request("SELECT * FROM app WHERE level = 'info'", interval="10 minutes")).collect()) == 10
    values = engine.field_values(engine.catalog.get("app"), ["level"]).collect()
    assert [(r.value, r.num) for r in values] == [("error", 20), ("info", 10)]
    assert engine.breakdown_field(engine.catalog.get("app")) == "level"


def test_bounds(engine):
    for bad in (Request("SELECT * FROM app", size=100_001), Request("SELECT * FROM app", offset=-1)):
        with pytest.raises(ValueError):
            engine.search(bad)


def test_schema_merging(spark):
    a = spark.createDataFrame([(1, "x")], "n int, a string")
    b = spark.createDataFrame([(2.5, True)], "n double, b boolean")
    out = C.union_streams([a, b])
    assert out.columns == ["a", "b", "n"] and out.schema["n"].dataType == T.DoubleType()
    assert sorted(r.n for r in out.collect()) == [1.0, 2.5]


def test_lineage(spark):
    from tarn.plans.lineage import lineage

    spark.createDataFrame([(1, 2, "x")], "a int, b int, c string").createOrReplaceTempView("lin")
    df = spark.sql("SELECT total + 1 AS up, c, 5 AS five FROM (SELECT c, sum(a * b) AS total FROM lin GROUP BY c)")
    assert lineage(df) == {"up": {"a", "b"}, "c": {"c"}, "five": set()}
    assert lineage(spark.sql("SELECT a AS x FROM lin UNION ALL SELECT b FROM lin"))["x"] == {"a", "b"}


def test_relations():
    assert q.relations("SELECT a.x, b.y FROM a, b AS c JOIN d ON f(a.x, 1) = 2 WHERE x IN (SELECT y, z FROM e, metrics.f) ORDER BY p, q") == ["a", "b", "d", "e", "metrics.f"]
    assert q.with_relations("WITH RECURSIVE t AS (SELECT 1) SELECT * FROM t, app", {"app": "v"}) == "WITH RECURSIVE `app` AS (SELECT * FROM `v`), t AS (SELECT 1) SELECT * FROM t, app"


def test_requests_of_one_session_do_not_meet(engine):
    start = 1_700_000_000_000_000
    first = engine.plan(Request("SELECT count(*) AS c FROM app", start, start + 60_000_000))
    second = engine.plan(Request("WITH x AS (SELECT n FROM app) SELECT a.n FROM x a, app b WHERE a.n = b.n AND a.n < 3 ORDER BY a.n DESC"))
    assert first.first().c == 1 and [r.n for r in second.collect()] == [2, 1, 0]
    shadowed = engine.plan(Request("WITH app AS (SELECT n + 100 AS n FROM app) SELECT min(n) AS n FROM app"))
    assert shadowed.first().n == 100
    assert not [t for t in engine.spark.catalog.listTables() if t.name == "app" or t.name.startswith("request_")]


def test_record_id_beside_plain_rows(engine):
    sql = "SELECT log FROM app"
    assert engine.plan(Request(sql, record_id="n")).columns == ["n", "log"]
    assert engine.plan(Request(sql, record_id="nothing")).columns == ["log"]
    assert engine.plan(Request("SELECT count(*) AS c FROM app", record_id="n")).columns == ["c"]
