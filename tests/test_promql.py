import math

import pytest

from tarn.promql import parser as P
from tarn.promql.evaluator import Evaluator, align

M = 60_000_000


@pytest.fixture(scope="module")
def ev(spark):
    rows = [("a", "n1", i * M, float(v)) for i, v in enumerate([0, 10, 20, 5, 15, 25])] + [("b", "n1", i * M, 1.0) for i in range(6)]
    m = spark.createDataFrame(rows, "job string, node string, _timestamp long, value double")
    le = spark.createDataFrame([("x", le, 5 * M, c) for le, c in [("0.1", 1.0), ("0.5", 5.0), ("1", 8.0), ("+Inf", 10.0)]], "job string, le string, _timestamp long, value double")
    nan = spark.createDataFrame([("x", 4 * M, math.nan), ("x", 5 * M, 3.0)], "job string, _timestamp long, value double")
    return Evaluator(spark, {"m": m, "h": le, "q": nan}, 300_000, 300_000, 60_000)


CASES = [
    ("m", {"a": 25.0, "b": 1.0}), ("m offset 1m", {"a": 15.0, "b": 1.0}), ("m{job='a'}", {"a": 25.0}), ("m{job!='a'}", {"b": 1.0}), ("m{job=~'a|c'}", {"a": 25.0}), ("m{nothing='x'}", {"a": 25.0, "b": 1.0}),
    ("rate(m[5m])", {"a": 0.15, "b": 0.0}), ("increase(m[5m])", {"a": 45.0, "b": 0.0}), ("delta(m[5m])", {"a": 25.0, "b": 0.0}), ("irate(m[5m])", {"a": 1 / 6, "b": 0.0}), ("idelta(m[5m])", {"a": 10.0, "b": 0.0}),
    ("resets(m[5m])", {"a": 1.0, "b": 0.0}), ("changes(m[5m])", {"a": 5.0, "b": 0.0}), ("deriv(m[5m])", {"a": 0.0595238, "b": 0.0}), ("predict_linear(m[5m], 60)", {"a": 25.0, "b": 1.0}),
    ("holt_winters(m[5m], 0.5, 0.5)", {"a": 22.65625, "b": 1.0}), ("quantile_over_time(0.5, m[5m])", {"a": 12.5, "b": 1.0}), ("quantile_over_time(2, m[5m])", {"a": math.inf, "b": math.inf}),
    ("max_over_time(m[5m:1m])", {"a": 25.0, "b": 1.0}), ("max_over_time(q[5m])", {"x": 3.0}), ("stddev_over_time(m{job='b'}[5m])", {"b": 0.0}),
    ("topk(1, m)", {"a": 25.0}), ("bottomk(1, m)", {"b": 1.0}), ("topk(0, m)", {}), ("m > 10", {"a": 25.0}), ("m > bool 10", {"a": 1.0, "b": 0.0}), ("m / on(job) m", {"a": 1.0, "b": 1.0}),
    ("m{job='a'} + ignoring(job) group_left m{job='b'}", {"a": 26.0}), ("m and m{job='a'}", {"a": 25.0}), ("m unless m{job='a'}", {"b": 1.0}), ("m{job='a'} or m", {"a": 25.0, "b": 1.0}),
    ("m / 0", {"a": math.inf, "b": math.inf}), ("-m", {"a": -25.0, "b": -1.0}), ("clamp_max(m, 2)", {"a": 2.0, "b": 1.0}), ("clamp(m, 2, 3)", {"a": 3.0, "b": 2.0}), ("sgn(m - 25)", {"a": 0.0, "b": -1.0}), ("round(m / 2)", {"a": 13.0, "b": 1.0}),
    ("histogram_quantile(0.5, h)", {"x": 0.5}), ("histogram_quantile(0.9, h)", {"x": 1.0}), ("timestamp(m)", {"a": 300.0, "b": 300.0}), ("abs(m)", {"a": 25.0, "b": 1.0}), ("absent(m{job='z'})", {"z": 1.0}), ("absent(m)", {}),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_by_job(ev, text, expected):
    got = {r["job"]: r["value"] for r in ev.query(text).collect()}
    assert got == pytest.approx(expected, abs=1e-6)


SCALARS = [("sum(m)", 26.0), ("avg(m)", 13.0), ("count(m)", 2.0), ("group(m)", 1.0), ("stddev(m)", 12.0), ("stdvar(m)", 144.0), ("quantile(0.5, m)", 13.0), ("1 + 2 * 3", 7.0), ("2 ^ 3 ^ 2", 512.0), ("10 % 4", 2.0), ("time()", 300.0), ("vector(4)", 4.0), ("scalar(m{job='a'}) * 2", 50.0), ("hour()", 0.0), ("minute()", 5.0), ("year()", 1970.0), ("scalar(m)", math.nan)]


@pytest.mark.parametrize(("text", "expected"), SCALARS)
def test_single_values(ev, text, expected):
    assert [r["value"] for r in ev.query(text).collect()] == pytest.approx([expected], nan_ok=True)


def test_labels(ev):
    assert {(r.x, r.value) for r in ev.query("label_replace(m, 'x', 'v-$1', 'job', '(.*)')").collect()} == {("v-a", 25.0), ("v-b", 1.0)}
    assert {r.x for r in ev.query("label_join(m, 'x', '-', 'node', 'job')").collect()} == {"n1-a", "n1-b"}
    assert {(r.v, r.value) for r in ev.query("count_values('v', m)").collect()} == {("25", 1.0), ("1", 1.0)}
    assert ev.query("sum by (node) (m)").columns == ["node", "ts", "value"]
    assert ev.query("sum without (node) (m)").columns == ["job", "ts", "value"]


def test_range_grid_and_lookback(spark):
    m = spark.createDataFrame([("a", 0, 1.0), ("a", 60 * M, 2.0)], "job string, _timestamp long, value double")
    rows = Evaluator(spark, {"m": m}, 0, 3_900_000, 300_000).query("m").collect()
    assert sorted((r.ts // M, r.value) for r in rows) == [(0, 1.0), (5, 1.0), (60, 2.0), (65, 2.0)]


def test_plans_have_no_range_join(ev):
    plan = ev.query("sum by (node) (rate(m[5m]))")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


@pytest.mark.parametrize("text", ["m[5m]", "sum(", "m{a}", "rate(m)", "nope(m)", "1 == 2", "unknown", "m{a='1'", "m[5x]"])
def test_errors(ev, text):
    with pytest.raises(P.PromQLError):
        ev.query(text).collect()


def test_parsing():
    node = P.parse("sum by (a) (rate(x{b=~'c.*', d!=\"e\"}[1h30m] offset 5m)) / 2")
    inner = node.left.expr.args[0]
    assert (inner.range_ms, inner.offset_ms, inner.matchers) == (5_400_000, 300_000, [("b", "=~", "c.*"), ("d", "!=", "e")])
    assert P.parse("a + b * c ^ 2").right.right.op == "^"
    assert align(7, 3_600_007, 17_000)[2] == 15_000


def test_exemplars_of_the_selectors_within_the_range(spark):
    e = "array<struct<_timestamp:long,value:double,labels:map<string,string>>>"
    rows = [("a", M, 1.0, [(M, 0.5, {"trace_id": "t1"}), (9 * M, 0.7, {"trace_id": "late"})]), ("b", M, 1.0, [(2 * M, 0.6, {"trace_id": "t2"})]), ("c", M, 1.0, None)]
    m = spark.createDataFrame(rows, f"job string, _timestamp long, value double, exemplars {e}")
    ev = Evaluator(spark, {"m": m, "plain": m.drop("exemplars")}, 0, 300_000, 60_000)
    got = {(r.series["job"], r.ts, r.labels["trace_id"]) for r in ev.exemplars("sum(rate(m[5m])) / on() m{job!='z'} + plain").collect()}
    assert got == {("a", M, "t1"), ("b", 2 * M, "t2")}
    assert {r.series["job"] for r in ev.exemplars("m{job='b'}").collect()} == {"b"} and not ev.exemplars("plain").collect()
    assert ev.query("m{job='a'}").columns == ["job", "ts", "value"]


# A sample, then 1e16 and -1e16: in the order of time the first is rounded to an even number, in the order of the rows it is not.
IN_ORDER = [("({} ^ 2 + 3) % 7", 2.5, 0.0), ("ceil({})", 2.5, 2.0), ("floor({})", 3.7, 4.0), ("round({})", 2.5, 2.0)]


@pytest.mark.parametrize(("text", "first", "expected"), IN_ORDER)
def test_sum_over_time_adds_in_the_order_of_time(spark, text, first, expected):
    rows = [("x", 3 * M, -1e16), ("x", 2 * M, 1e16), ("x", M, first)]
    m = spark.createDataFrame(rows, "job string, _timestamp long, value double").coalesce(1)
    out = Evaluator(spark, {"m": m}, 300_000, 300_000, 60_000).query(text.format("sum_over_time(m[5m])")).collect()
    assert [r["value"] for r in out] == [expected]
