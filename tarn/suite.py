"""Queries over the driver's tables, one or more per operator, each with its SQL statement where SQL has one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.catalog import Catalog
from tarn.functions import registry
from tarn.functions.regex import regexp_match, regexp_match_to_fields
from tarn.operators import jobs, relational, traces
from tarn.plans import conditions, pages
from tarn.plans.search import Engine, Request
from tarn.promql.evaluator import Evaluator
from tarn.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The driver's tables as streams; events and orders have a time."""
    registry.register(spark)
    catalog = Catalog(spark)
    for t in TABLES:
        time = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}.get(t)
        text = {"documents": ["text"], "pages": ["html"], "conversations": ["text"], "events": ["event_type", "props"]}.get(t)
        catalog.register(t, f"{sf_dir}/{t}.parquet", time_column=time, text_columns=text)
    return Engine(catalog)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the engine's SQL; ``oracle`` where the statement differs."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).plan(Request(text))
    SQL[name] = oracle or text


def _frame(name: str, oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return register


# Buckets of time -----------------------------------------------------------

_ORIGIN = "TIMESTAMP '2001-01-01 00:00:00'"
_sql(
    "histogram_events",
    "SELECT histogram(ts, '1 hour') AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    f"SELECT time_bucket(INTERVAL '1 hour', ts, {_ORIGIN}) AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
)
_sql(
    "histogram_week",
    "SELECT histogram(ts, '7 days') AS bucket, count(*) AS n FROM events GROUP BY 1",
    f"SELECT time_bucket(INTERVAL '7 days', ts, {_ORIGIN}) AS bucket, count(*) AS n FROM events GROUP BY 1",
)
_sql(
    "histogram_five_hours",
    "SELECT histogram(ts, '5 hours') AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    f"SELECT time_bucket(INTERVAL '5 hours', ts, {_ORIGIN}) AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
_sql(
    "date_bin",
    "SELECT date_bin(INTERVAL '15 minutes', ts) AS bucket, max(value) AS top FROM events GROUP BY 1",
    f"SELECT time_bucket(INTERVAL '15 minutes', ts, {_ORIGIN}) AS bucket, max(value) AS top FROM events GROUP BY 1",
)


@_frame("histogram_of_query", f"SELECT time_bucket(INTERVAL '1 day', ts, {_ORIGIN}) AS key, event_type AS breakdown, count(*) AS num FROM events WHERE value > 50 GROUP BY 1, 2")
def _(spark, sf_dir):
    return engine(spark, sf_dir).histogram(Request("SELECT event_id FROM events WHERE value > 50", interval="1 day"), "event_type")


@_frame("histogram_of_streams", f"SELECT key, sum(num)::BIGINT AS num FROM (SELECT time_bucket(INTERVAL '1 day', ts, {_ORIGIN}) AS key, count(*) AS num FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT time_bucket(INTERVAL '1 day', ts, {_ORIGIN}), count(*) FROM events WHERE value < 10 GROUP BY 1) GROUP BY 1")
def _(spark, sf_dir):
    e = engine(spark, sf_dir)
    return e.multi_histogram([Request(f"SELECT * FROM events WHERE {w}", interval="1 day") for w in ("event_type = 'click'", "value < 10")])


_RANGE = (1704326400000000, 1704931200000000)  # 2024-01-04 to 2024-01-11


@_frame("time_range_scan", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-11'")
def _(spark, sf_dir):
    return engine(spark, sf_dir).plan(Request("SELECT event_id, event_type FROM events", *_RANGE))


@_frame("total_hits", "SELECT count(*) AS num FROM events WHERE event_type = 'error'")
def _(spark, sf_dir):
    return engine(spark, sf_dir).total_hits(Request("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n LIMIT 3"))


@_frame("total_hits_distinct", "SELECT count(*) AS num FROM (SELECT DISTINCT user_id, event_type FROM events)")
def _(spark, sf_dir):
    return engine(spark, sf_dir).total_hits(Request("SELECT DISTINCT user_id, event_type FROM events"))


@_frame("search_newest_first", "SELECT ts, event_id, value FROM events WHERE event_type = 'view' ORDER BY ts DESC LIMIT 50")
def _(spark, sf_dir):
    return engine(spark, sf_dir).search(Request("SELECT event_id, value FROM events WHERE event_type = 'view'", size=50, add_time_column=True))


@_frame("search_offset", "SELECT ts, event_id FROM events ORDER BY ts DESC LIMIT 20 OFFSET 100")
def _(spark, sf_dir):
    return engine(spark, sf_dir).search(Request("SELECT ts, event_id FROM events", size=20, offset=100))


@_frame("search_around", "(SELECT event_id, ts FROM events WHERE ts <= TIMESTAMP '2024-01-10' ORDER BY ts DESC LIMIT 10) UNION ALL (SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-10' ORDER BY ts LIMIT 10)")
def _(spark, sf_dir):
    e = engine(spark, sf_dir)
    return e.around(e.catalog.get("events"), 1704844800000000, 20).select("event_id", "ts")


@_frame("field_values", "(SELECT 'event_type' AS field, event_type AS value, count(*) AS num FROM events GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) UNION ALL (SELECT 'user_id', user_id::VARCHAR, count(*) FROM events GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)")
def _(spark, sf_dir):
    e = engine(spark, sf_dir)
    return e.field_values(e.catalog.get("events"), ["event_type", "user_id"], 5)


@_frame("cardinality", "SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type, count(DISTINCT props) AS props FROM events")
def _(spark, sf_dir):
    e = engine(spark, sf_dir)
    return e.cardinality(e.catalog.get("events"), ["user_id", "event_type", "props"], exact=True)


@_frame("cardinality_estimate", "SELECT event_type, count(DISTINCT user_id) > 0 AS close FROM events GROUP BY event_type")
def _(spark, sf_dir):
    """Whether the sketch is within a tenth of the exact count."""
    return engine(spark, sf_dir).plan(Request("SELECT event_type, abs(approx_distinct(user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS close FROM events GROUP BY event_type"))


# Predicates and rewrites ----------------------------------------------------

_sql("placeholder_all", "SELECT event_type, count(*) AS n FROM events WHERE event_type = '__all__' AND value >= 10 GROUP BY 1", "SELECT event_type, count(*) AS n FROM events WHERE value >= 10 GROUP BY 1")
_sql("placeholder_in", "SELECT count(*) AS n FROM events WHERE event_type IN ('click', '__all__') AND user_id < 50", "SELECT count(*) AS n FROM events WHERE user_id < 50")
_sql("custom_value", "SELECT event_type, count(*) AS n FROM events WHERE event_type = 'i::__custom' GROUP BY 1", "SELECT event_type, count(*) AS n FROM events WHERE contains(event_type, 'i') GROUP BY 1")
_sql("comparison_filters", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 10 AND l_discount >= 0.05 AND l_returnflag IN ('A', 'R') AND l_shipdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 10 AND l_discount >= 0.05 AND l_returnflag IN ('A', 'R') AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00'")
_sql("like_filters", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%' AND p_type NOT LIKE 'ECO%' AND p_brand ILIKE 'brand#1%'")
_sql("null_handling", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS class FROM customer WHERE c_mktsegment IS NOT NULL")
_sql("try_cast", "SELECT event_id, try_cast(substr(event_type, 1, 2) AS INT) AS bad, CAST(CAST(value AS STRING) AS DOUBLE) AS again FROM events", "SELECT event_id, try_cast(substr(event_type, 1, 2) AS INTEGER) AS bad, CAST(CAST(value AS VARCHAR) AS DOUBLE) AS again FROM events")
_sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_sql("time_range", "SELECT count(*) AS n FROM events WHERE time_range(unix_micros(CAST(ts AS TIMESTAMP)), '2024-01-05 00:00:00', '2024-01-06 12:00:00')", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06 12:00:00'")
_sql("date_format", "SELECT event_id, date_format(unix_micros(CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S', '+08:00') AS local FROM events", "SELECT event_id, strftime(ts + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS local FROM events")
_sql("date_parts", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, count(*) AS n FROM orders GROUP BY 1, 2, 3", "SELECT year(o_orderdate)::BIGINT AS y, quarter(o_orderdate)::BIGINT AS q, date_trunc('month', o_orderdate)::TIMESTAMP AS m, count(*) AS n FROM orders GROUP BY 1, 2, 3")
_sql("interval_arithmetic", "SELECT event_id, ts + INTERVAL '90' MINUTE AS later FROM events", "SELECT event_id, ts + INTERVAL 90 MINUTE AS later FROM events")

# Text ------------------------------------------------------------------------

_sql("match_all", "SELECT doc_id FROM documents WHERE match_all('LICENSE')", "SELECT doc_id FROM documents WHERE contains(lower(text), lower('LICENSE'))")
_sql("match_all_count", "SELECT lang, count(*) AS n FROM documents WHERE match_all_raw_ignore_case('contact') OR match_all('license') GROUP BY lang", "SELECT lang, count(*) AS n FROM documents WHERE contains(lower(text), 'contact') OR contains(lower(text), 'license') GROUP BY lang")
_sql("str_match", "SELECT doc_id, str_match(text, 'the') AS a, str_match_ignore_case(text, 'The') AS b, match_field(lang, 'e') AS c FROM documents", "SELECT doc_id, contains(text, 'the') AS a, contains(lower(text), 'the') AS b, contains(lang, 'e') AS c FROM documents")
_sql("re_match", r"SELECT doc_id, re_match(text, '[0-9]{4}') AS digits, re_not_match(text, '^The') AS other FROM documents", r"SELECT doc_id, regexp_matches(text, '[0-9]{4}') AS digits, NOT regexp_matches(text, '^The') AS other FROM documents")
_sql("re_matches", r"SELECT page_id, re_matches(html, 'href=\"(/[A-Za-z]+)\"') AS links FROM pages", r"""SELECT page_id, CASE WHEN len(l) > 0 THEN l END AS links FROM (SELECT page_id, regexp_extract_all(html, 'href="(/[A-Za-z]+)"', 1) AS l FROM pages)""")
_sql("fuzzy_match", "SELECT doc_id FROM documents WHERE fuzzy_match(text, 'licensd', 1)", r"SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: length(t) BETWEEN 2 AND 64 AND levenshtein(t, 'licensd') <= 1)) > 0")
_sql("fuzzy_match_all", "SELECT conv_id, turn FROM conversations WHERE fuzzy_match_all('theer', 1)", r"SELECT conv_id, turn FROM conversations WHERE len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: length(t) BETWEEN 2 AND 64 AND levenshtein(t, 'theer') <= 1)) > 0")
_sql(
    "string_functions",
    "SELECT c_custkey, upper(c_mktsegment) AS u, initcap(c_mktsegment) AS i, strpos(c_name, '#') AS p, CAST(length(c_name) AS BIGINT) AS n, reverse(c_name) AS r, lpad(CAST(c_custkey AS STRING), 8, '0') AS l, substr_index(c_name, '#', 1) AS s, starts_with(c_name, 'Cust') AS w, repeat('ab', 2) AS x, translate(c_name, '#0', '-o') AS t, concat_ws('|', c_name, c_mktsegment) AS c, to_hex(c_custkey) AS h, md5(c_name) AS m, sha256(c_name) AS d FROM customer",
    "SELECT c_custkey, upper(c_mktsegment) AS u, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS i, strpos(c_name, '#')::INTEGER AS p, length(c_name)::BIGINT AS n, reverse(c_name) AS r, lpad(c_custkey::VARCHAR, 8, '0') AS l, split_part(c_name, '#', 1) AS s, starts_with(c_name, 'Cust') AS w, repeat('ab', 2) AS x, translate(c_name, '#0', '-o') AS t, concat_ws('|', c_name, c_mktsegment) AS c, lower(printf('%x', c_custkey)) AS h, md5(c_name) AS m, sha256(c_name) AS d FROM customer",
)
_sql(
    "math_functions",
    "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_tax) AS BIGINT) AS c, round(sqrt(l_quantity), 6) AS s, CAST(l_orderkey % 7 AS BIGINT) AS m, gcd(l_orderkey, l_partkey) AS g, signum(l_discount - 0.05) AS z, round(power(l_tax, 2), 8) AS p, greatest(l_tax, l_discount) AS hi, least(l_tax, l_discount) AS lo FROM lineitem",
    "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, floor(l_extendedprice)::BIGINT AS f, ceil(l_tax)::BIGINT AS c, round(sqrt(l_quantity), 6) AS s, (l_orderkey % 7)::BIGINT AS m, gcd(l_orderkey, l_partkey)::BIGINT AS g, sign(l_discount - 0.05)::DOUBLE AS z, round(power(l_tax, 2), 8) AS p, greatest(l_tax, l_discount) AS hi, least(l_tax, l_discount) AS lo FROM lineitem",
)


@_frame("regexp_match_to_fields", r"SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#0*(\d+)', 1) AS word, regexp_extract(c_name, '([A-Za-z]+)#0*(\d+)', 2) AS num FROM customer")
def _(spark, sf_dir):
    f = regexp_match_to_fields(F.col("c_name"), r"(?<word>[A-Za-z]+)#0*(?<num>\d+)")
    return table(spark, sf_dir, "customer").select("c_custkey", f.alias("f")).select("c_custkey", "f.word", "f.num")


@_frame("regexp_match", r"SELECT c_custkey, regexp_extract(c_name, '(\w+)#(\d+)', 2) AS num FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", regexp_match(F.col("c_name"), r"(\w+)#(\d+)")[1].alias("num"))


@_frame("log_patterns", r"SELECT pattern, num, example, num * 1.0 / sum(num) OVER () AS share FROM (SELECT regexp_replace(props, '[-+]?\b\d+(?:\.\d+)?', '<num>', 'g') AS pattern, count(*) AS num, min(props) AS example FROM events GROUP BY 1)")
def _(spark, sf_dir):
    return jobs.patterns(table(spark, sf_dir, "events"), "props", size=None)


# JSON ------------------------------------------------------------------------

_JSON = "concat('[', user_id, ',', user_id % 7, ',\"', event_type, '\"]')"
_NUMBERS = "concat('[', user_id, ',', event_id % 13, ',', user_id % 7, ']')"
_D_JSON = "('[' || user_id || ',' || user_id % 7 || ',\"' || event_type || '\"]')"
_sql("spath", "SELECT event_id, spath(props, 'k') AS k, json_get_int(props, 'k') AS n, json_contains(props, 'k') AS has FROM events", "SELECT event_id, props ->> '$.k' AS k, (props ->> '$.k')::BIGINT AS n, true AS has FROM events")
_sql("arrjoin", f"SELECT event_id, arrjoin({_JSON}, '|') AS j, arrcount({_JSON}) AS n, arrcount(event_type) AS zero FROM events", "SELECT event_id, user_id || '|' || user_id % 7 || '|' || event_type AS j, 3::BIGINT AS n, 0::BIGINT AS zero FROM events")
_sql("arrsort", f"SELECT event_id, arrsort({_NUMBERS}) AS up, arr_descending({_NUMBERS}) AS down FROM events", "SELECT event_id, '[' || array_to_string(list_sort([user_id, event_id % 13, user_id % 7]), ',') || ']' AS up, '[' || array_to_string(list_reverse_sort([user_id, event_id % 13, user_id % 7]), ',') || ']' AS down FROM events")
_sql("arrindex", f"SELECT event_id, arrindex({_NUMBERS}, 1, 5) AS tail, arrindex({_NUMBERS}, 5, 9) AS none FROM events", "SELECT event_id, '[' || event_id % 13 || ',' || user_id % 7 || ']' AS tail, '[]' AS none FROM events")
_sql("arrzip", f"SELECT event_id, arrzip({_NUMBERS}, '[\"a\",\"b\"]', ':') AS z FROM events", "SELECT event_id, '[\"' || user_id || ':a\",\"' || event_id % 13 || ':b\"]' AS z FROM events")
_sql("cast_to_arr", f"SELECT event_id, e FROM (SELECT event_id, cast_to_arr({_JSON}) AS a FROM events) LATERAL VIEW explode(a) x AS e", "SELECT event_id, unnest([user_id::VARCHAR, (user_id % 7)::VARCHAR, event_type]) AS e FROM events")
_sql("array_strings", "SELECT event_id, to_array_string(string_to_array_v2(concat(event_type, ',;', user_id), ',;')) AS s FROM events", "SELECT event_id, '[\"' || event_type || '\",\"' || user_id || '\"]' AS s FROM events")
_sql("unnest", "SELECT source, t, count(*) AS n FROM (SELECT source, explode(array(lang, 'any')) AS t FROM documents) GROUP BY 1, 2", "SELECT source, t, count(*) AS n FROM (SELECT source, unnest([lang, 'any']) AS t FROM documents) GROUP BY 1, 2")
_sql("array_functions", "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, array_max(embedding) AS hi, embedding[0] AS first FROM embeddings", "SELECT vec_id, len(embedding)::BIGINT AS n, list_max(embedding) AS hi, embedding[1] AS first FROM embeddings")

# Joins -----------------------------------------------------------------------

_sql("inner_join", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_sql("left_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_sql("right_join", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
_sql("full_join", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey + 1000")
_sql("semi_join_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_sql("semi_join_exists", "SELECT count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
_sql("anti_join", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
_sql("not_in", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
_sql("theta_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
_sql("comma_join", "SELECT n_name, count(*) AS suppliers FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY n_name")
_sql("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("five_way_join", "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_sql("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
_sql("correlated_subquery", "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")


@_frame("match_one_join", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1) ON c_custkey = o_custkey")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_totalprice")
    out = relational.match_one_join(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], time_column="o_orderdate")
    return out.select("c_custkey", "o_orderkey", "o_totalprice")


@_frame("enrichment_join", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return relational.enrich(table(spark, sf_dir, "supplier"), nations, ["s_nationkey"]).select("s_suppkey", "n_name")


@_frame("deduplicate", "SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, sf_dir):
    return relational.deduplicate(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts")


# Aggregates ------------------------------------------------------------------

_sql(
    "pricing_summary",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
_sql("statistics", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(variance(l_quantity), 6) AS var, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS cov, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1")
_sql("distinct_aggregates", "SELECT l_shipdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00' AS late, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1", "SELECT l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AS late, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1")
_sql("filter_aggregates", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, round(sum(value) FILTER (WHERE user_id < 100), 2) AS low_users FROM events GROUP BY 1")
_sql("having", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 70")
_sql("first_last", "SELECT user_id, min_by(event_id, ts) AS first_id, max_by(event_id, ts) AS last_id FROM events GROUP BY user_id", "SELECT user_id, arg_min(event_id, ts) AS first_id, arg_max(event_id, ts) AS last_id FROM events GROUP BY user_id")
_sql("array_agg_distinct", "SELECT user_id, array_join(array_sort(collect_set(event_type)), ',') AS kinds FROM events GROUP BY user_id", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id")
_sql("percentiles", "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95, round(median(value), 6) AS m FROM events GROUP BY 1")
_sql("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
_sql("rollup", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
_sql("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("boolean_aggregates", "SELECT user_id, bool_and(value > 0) AS every_, bool_or(value > 99) AS some_, bit_xor(event_id) AS x FROM events GROUP BY user_id")
_sql("top_k", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")


@_frame("summary_percentile", "SELECT event_type, round(quantile_cont(v, 0.9), 6) AS p90 FROM (SELECT event_type, user_id % 50 AS v FROM events) GROUP BY 1")
def _(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 50).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("event_type").agg(F.round(relational.summary_percentile("v", "n", 0.9), 6).alias("p90"))


@_frame("partial_aggregates", "SELECT event_type, count(value) AS count, round(sum(value), 2) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM events GROUP BY 1")
def _(spark, sf_dir):
    states = jobs.partial_aggregate(table(spark, sf_dir, "events"), [F.to_date("ts").alias("day"), "event_type"], "value")
    return jobs.merge_aggregates(states, ["event_type"]).select("event_type", "count", F.round("sum", 2).alias("sum"), "min", "max", F.round("avg", 6).alias("avg"))


@_frame("distinct_values", "SELECT field, value, min(ts) AS ts, count(*) AS count FROM (SELECT 'event_type' AS field, event_type AS value, ts FROM events UNION ALL SELECT 'user_id', user_id::VARCHAR, ts FROM events) GROUP BY 1, 2")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    parts = jobs.distinct_values(e.filter(day <= 15), ["event_type", "user_id"], "ts").unionByName(jobs.distinct_values(e.filter(day > 15), ["event_type", "user_id"], "ts"))
    return jobs.merge_distinct(parts, "ts")


@_frame("downsample", "SELECT event_type, (978307200000000 + floor((epoch_us(ts) - 978307200000000) / 3600000000)::BIGINT * 3600000000)::BIGINT AS _timestamp, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("_timestamp"), "value")
    return jobs.downsample(m, "1 hour", "avg", series=["event_type"]).withColumn("value", F.round("value", 6))


# Windows ---------------------------------------------------------------------

_W = "PARTITION BY user_id ORDER BY ts, event_id"
_sql("window_ranking", f"SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY event_type ORDER BY user_id) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS BIGINT) AS dr, CAST(ntile(4) OVER ({_W}) AS BIGINT) AS nt, round(percent_rank() OVER (PARTITION BY event_type ORDER BY user_id), 6) AS pr, round(cume_dist() OVER (PARTITION BY event_type ORDER BY user_id), 6) AS cd FROM events")
_sql("window_analytic", f"SELECT event_id, lag(value) OVER ({_W}) AS prev, lead(event_type, 2) OVER ({_W}) AS next2, first_value(value) OVER ({_W}) AS f, last_value(value) OVER ({_W}) AS l, nth_value(value, 2) OVER ({_W}) AS n2 FROM events")
_sql("window_frames", f"SELECT event_id, round(avg(value) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW), 2) AS near, count(*) OVER (PARTITION BY user_id) AS n FROM events")


@_frame("window_groups", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return relational.groups_frame(e, ["event_type"], "user_id", F.count(F.lit(1)), 1, 1, "n").select("event_id", "n")


_sql("latest_by_cte", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n <= 2")

# Set operations and CTEs -----------------------------------------------------

_sql("union_all", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
_sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql("except", "SELECT p_size AS k FROM part EXCEPT SELECT l_linenumber FROM lineitem")
_sql("cte_chain", "WITH a AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), b AS (SELECT n, count(*) AS users FROM a GROUP BY n) SELECT n, users, round(CAST(users AS DOUBLE) * 100 / (SELECT count(*) FROM a), 4) AS share FROM b", "WITH a AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), b AS (SELECT n, count(*) AS users FROM a GROUP BY n) SELECT n, users, round(users * 100.0::DOUBLE / (SELECT count(*) FROM a), 4) AS share FROM b")
_sql("recursive_cte", "WITH RECURSIVE t(n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 20) SELECT n, s FROM t")
_sql("generate_series", "SELECT explode(sequence(1, 10)) AS n", "SELECT unnest(range(1, 11))::INTEGER AS n")
_sql("derived_table", "SELECT c_mktsegment, max(n) AS most FROM (SELECT c_mktsegment, c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) t GROUP BY 1")

# Traces ----------------------------------------------------------------------


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traces: a turn is a span, its parent the turn before, its service the role."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    start = F.col("conv_id") * 1_000_000 + F.col("turn") * 1000
    return c.select(
        F.col("conv_id").cast("string").alias("trace_id"), F.concat_ws("-", "conv_id", "turn").alias("span_id"),
        F.when(F.col("turn") > 0, F.concat_ws("-", "conv_id", F.col("turn") - 1)).otherwise("").alias("reference_parent_span_id"),
        F.col("role").alias("service_name"), F.lit("turn").alias("operation_name"), F.lit("2").alias("span_kind"),
        F.when(F.char_length("text") > 800, "ERROR").otherwise("OK").alias("span_status"), start.alias("start_time"), (start + F.char_length("text")).alias("end_time"),
    )


_D_SPANS = """WITH s AS (
    SELECT conv_id::VARCHAR AS trace_id, conv_id || '-' || turn AS span_id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) ELSE '' END AS parent, min(role) AS service,
        CASE WHEN length(min(text)) > 800 THEN 'ERROR' ELSE 'OK' END AS status, conv_id * 1000000 + turn * 1000 AS start_time, conv_id * 1000000 + turn * 1000 + length(min(text)) AS end_time
    FROM conversations GROUP BY conv_id, turn)"""


@_frame("service_graph", _D_SPANS + """ SELECT p.service AS client, s.service AS server, count(*) AS total_requests, count(*) FILTER (WHERE s.status = 'ERROR') AS failed_requests,
    round(quantile_cont((s.end_time - s.start_time)::DOUBLE, 0.5), 6) AS p50, round(quantile_cont((s.end_time - s.start_time)::DOUBLE, 0.95), 6) AS p95, round(quantile_cont((s.end_time - s.start_time)::DOUBLE, 0.99), 6) AS p99
    FROM s LEFT JOIN s p ON s.trace_id = p.trace_id AND s.parent = p.span_id WHERE p.service IS NULL OR p.service <> s.service GROUP BY 1, 2""")
def _(spark, sf_dir):
    edges = traces.service_edges(_spans(spark, sf_dir), exact=True)
    return edges.select("client", "server", "total_requests", "failed_requests", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@_frame("trace_list", _D_SPANS + " SELECT trace_id, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS spans, count(*) FILTER (WHERE status = 'ERROR') AS errors, array_to_string(list_sort(list(DISTINCT service)), ',') AS services FROM s GROUP BY 1")
def _(spark, sf_dir):
    return traces.trace_list(_spans(spark, sf_dir)).withColumn("services", F.array_join("services", ","))


@_frame("trace_index", _D_SPANS + " SELECT min(start_time) AS _timestamp, 'chat' AS stream_name, service AS service_name, trace_id FROM s GROUP BY service, trace_id")
def _(spark, sf_dir):
    return traces.trace_index(_spans(spark, sf_dir), "chat")


@_frame("trace_dag", _D_SPANS + " SELECT s.span_id, s.parent AS reference_parent_span_id, s.service AS service_name, p.service AS parent_service FROM s LEFT JOIN s p ON s.trace_id = p.trace_id AND s.parent = p.span_id WHERE s.trace_id = '1'")
def _(spark, sf_dir):
    return traces.trace_dag(_spans(spark, sf_dir), "1").select("span_id", "reference_parent_span_id", "service_name", "parent_service")


# PromQL ----------------------------------------------------------------------

_STEP = 21600000  # six hours, from the multiple below the first event to that above the last
_BOUNDS = (10, 25, 50, 100)


def _promql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    m = events.groupBy(us.alias("_timestamp"), "event_type", F.col("user_id").cast("string").alias("user")).agg(F.max("value").alias("value"))
    # A day's events by upper bound of their value, as a sample at the day's end.
    day = (F.floor(us / 86_400_000_000) + 1) * 86_400_000_000
    counts = [F.sum(F.when(F.col("value") <= b, 1.0).otherwise(0.0)).alias(str(b)) for b in _BOUNDS]
    buckets = events.groupBy(day.cast("long").alias("_timestamp"), "event_type").agg(*counts, F.count(F.lit(1)).cast("double").alias("+Inf"))
    buckets = buckets.unpivot(["_timestamp", "event_type"], [F.col(f"`{c}`") for c in (*map(str, _BOUNDS), "+Inf")], "le", "value")
    first, last = events.agg(F.min("ts"), F.max("ts")).select(*[F.unix_micros(F.col(c).cast("timestamp")) for c in ("min(ts)", "max(ts)")]).first()
    start, end = ((first or 0) // (_STEP * 1000) * _STEP, -(-(last or 0) // (_STEP * 1000)) * _STEP)
    return Evaluator(spark, {"event_value": m, "event_bucket": buckets}, start, end, _STEP).query(text)


_GRID = f"""WITH m AS (SELECT epoch_us(ts) AS t, event_type, user_id::VARCHAR AS "user", max(value) AS v FROM events GROUP BY 1, 2, 3),
    g AS (SELECT unnest(range((SELECT min(t) // {_STEP}000 FROM m), (SELECT (max(t) + {_STEP}000 - 1) // {_STEP}000 FROM m) + 1)) * {_STEP}000 AS ts),
    w AS (SELECT event_type, "user", g.ts, t, v, lag(v) OVER o AS pv, lag(t) OVER o AS pt, row_number() OVER (PARTITION BY event_type, "user", g.ts ORDER BY t DESC) AS r
        FROM g JOIN m ON m.t BETWEEN g.ts - 24 * 3600000000 AND g.ts WINDOW o AS (PARTITION BY event_type, "user", g.ts ORDER BY t))"""


def _metric(name: str, text: str, oracle: str | None = None, digits: int = 6) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _promql(spark, sf_dir, text)
        return out.withColumn("value", F.round("value", digits))

    QUERIES[name] = run
    if oracle:
        SQL[name] = f"{_GRID} {oracle}"


def _windowed(agg: str, hours: int, by: str = 'event_type, "user"') -> str:
    keys = f"{by}, " if by else ""
    return f"SELECT {keys}g.ts, {agg} AS v FROM g JOIN m ON m.t BETWEEN g.ts - {hours} * 3600000000 AND g.ts GROUP BY ALL"


_metric("promql_count_over_time", "sum by (event_type) (count_over_time(event_value[6h]))", f"SELECT event_type, ts, round(sum(v), 6)::DOUBLE AS value FROM ({_windowed('count(*)', 6)}) GROUP BY ALL")
_metric("promql_avg_over_time", "avg_over_time(event_value[1d])", f'SELECT event_type, "user", ts, round(v, 6) AS value FROM ({_windowed("avg(v)", 24)})')
_metric("promql_max_min", "max by (event_type) (max_over_time(event_value[12h])) - min by (event_type) (min_over_time(event_value[12h]))", f"SELECT event_type, ts, round(max(hi) - min(lo), 6) AS value FROM (SELECT event_type, g.ts, max(v) AS hi, min(v) AS lo FROM g JOIN m ON m.t BETWEEN g.ts - 12 * 3600000000 AND g.ts GROUP BY ALL) GROUP BY ALL")
_metric("promql_last", "count(last_over_time(event_value[6h]))", f"SELECT ts, count(*)::DOUBLE AS value FROM ({_windowed('max(v)', 6)}) GROUP BY ALL")
_metric("promql_topk", "topk by (event_type) (2, sum_over_time(event_value[1d]))", f'SELECT event_type, "user", ts, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY v DESC, "user") AS r FROM ({_windowed("sum(v)", 24)})) WHERE r <= 2')
_metric("promql_quantile", "quantile by (event_type) (0.9, sum_over_time(event_value[1d]))", f"SELECT event_type, ts, round(quantile_cont(v, 0.9), 6) AS value FROM ({_windowed('sum(v)', 24)}) GROUP BY ALL")
_metric("promql_matchers", "sum without (user) (sum_over_time(event_value{event_type=~'c.*|view', user!='7'}[6h])) > 100", f"SELECT * FROM (SELECT event_type, ts, round(sum(v), 6) AS value FROM ({_windowed('sum(v)', 6)}) WHERE regexp_full_match(event_type, 'c.*|view') AND \"user\" <> '7' GROUP BY ALL) WHERE value > 100")
_metric("promql_ratio", "sum by (event_type) (sum_over_time(event_value[1d])) / on () group_left sum(sum_over_time(event_value[1d]))", f"SELECT event_type, ts, round(sum(v) / sum(sum(v)) OVER (PARTITION BY ts), 6) AS value FROM ({_windowed('sum(v)', 24)}) GROUP BY event_type, ts")
_metric("promql_delta", "idelta(event_value[1d])", f"""SELECT event_type, "user", ts, round(v - pv, 6) AS value FROM (
    SELECT event_type, "user", g.ts, m.t, v, lag(v) OVER w AS pv, row_number() OVER (PARTITION BY event_type, "user", g.ts ORDER BY m.t DESC) AS r
    FROM g JOIN m ON m.t BETWEEN g.ts - 24 * 3600000000 AND g.ts WINDOW w AS (PARTITION BY event_type, "user", g.ts ORDER BY m.t)) WHERE r = 1 AND pv IS NOT NULL""")
_metric("promql_changes", "sum by (event_type) (changes(event_value[1d])) + sum by (event_type) (resets(event_value[1d]))", f"""SELECT event_type, ts, (sum(c) + sum(d))::DOUBLE AS value FROM (
    SELECT event_type, g.ts, CASE WHEN v <> pv THEN 1 ELSE 0 END AS c, CASE WHEN pv > v THEN 1 ELSE 0 END AS d FROM (SELECT *, lag(v) OVER (PARTITION BY event_type, "user" ORDER BY t) AS pv0, lag(t) OVER (PARTITION BY event_type, "user" ORDER BY t) AS pt FROM m) x
    JOIN g ON x.t BETWEEN g.ts - 24 * 3600000000 AND g.ts, LATERAL (SELECT CASE WHEN x.pt >= g.ts - 24 * 3600000000 THEN x.pv0 END AS pv)) GROUP BY ALL""")
_DAY = 'SELECT event_type, "user", ts, {value} AS value FROM w GROUP BY ALL {having}'
_SUMS = 'd AS (SELECT event_type, "user", ts, sum(v) AS x FROM w GROUP BY ALL)'


def _per_day(name: str, text: str, value: str, having: str = "") -> None:
    """A function over a day's samples of each series."""
    _metric(name, text, _DAY.format(value=f"round({value}, 6)", having=having))


def _mapped(name: str, text: str, value: str, where: str = "") -> None:
    """A function of each value x of sum_over_time over a day."""
    _metric(name, text, f', {_SUMS} SELECT event_type, "user", ts, round({value}, 6)::DOUBLE AS value FROM d {where}')


_per_day("promql_stddev_over_time", "stddev_over_time(event_value[1d])", "stddev_pop(v)")
_per_day("promql_stdvar_over_time", "stdvar_over_time(event_value[1d])", "var_pop(v)")
_per_day("promql_quantile_over_time", "quantile_over_time(0.25, event_value[1d])", "quantile_cont(v, 0.25)")
_per_day("promql_present_over_time", "present_over_time(event_value[1d])", "1.0::DOUBLE")
_per_day("promql_min_over_time", "min_over_time(event_value[1d])", "min(v)")
_per_day("promql_deriv", "deriv(event_value[1d])", "CASE WHEN max(v) = min(v) THEN 0.0 ELSE regr_slope(v, (t - ts) / 1e6) END", "HAVING count(*) >= 2")
_per_day("promql_regression", "predict_linear(event_value[1d], 3600)", "CASE WHEN max(v) = min(v) THEN max(v) ELSE regr_intercept(v, (t - ts) / 1e6) + 3600 * regr_slope(v, (t - ts) / 1e6) END", "HAVING count(*) >= 2")
_metric("promql_irate", "irate(event_value[1d])", 'SELECT event_type, "user", ts, round((CASE WHEN v < pv THEN v ELSE v - pv END) / ((t - pt) / 1e6), 6) AS value FROM w WHERE r = 1 AND pv IS NOT NULL')


def _extrapolated_sql(counter: bool, per_second: bool) -> str:
    """The rule for windows that samples do not fill: on to an end that is near, else by half a mean distance."""
    return f"""SELECT event_type, "user", ts, round(delta * (sampled + CASE WHEN lead0 {"> z AND z IS NOT NULL" if counter else "IS NULL"} THEN {"z" if counter else "0"} ELSE lead0 END + tail) / sampled {"/ 86400" if per_second else ""}, 6) AS value FROM (
        SELECT *, CASE WHEN to_start >= 1.1 * mean THEN mean / 2 ELSE to_start END AS lead0, CASE WHEN to_end >= 1.1 * mean THEN mean / 2 ELSE to_end END AS tail,
            CASE WHEN delta > 0 AND first_v >= 0 THEN sampled * (first_v / delta) END AS z FROM (
        SELECT event_type, "user", ts, (max(t) - min(t))::DOUBLE AS sampled, (max(t) - min(t))::DOUBLE / (count(*) - 1) AS mean, (min(t) - (ts - 86400000000))::DOUBLE AS to_start, (ts - max(t))::DOUBLE AS to_end, arg_min(v, t) AS first_v,
            arg_max(v, t) - arg_min(v, t) + {"sum(CASE WHEN pv > v THEN pv ELSE 0 END)" if counter else "0"} AS delta
        FROM w GROUP BY event_type, "user", ts HAVING count(*) >= 2))"""


_metric("promql_rate", "rate(event_value[1d])", _extrapolated_sql(True, True))
_metric("promql_increase", "increase(event_value[1d])", _extrapolated_sql(True, False))
_metric("promql_extrapolated_delta", "delta(event_value[1d])", _extrapolated_sql(False, False))
_metric("promql_smoothing", "holt_winters(event_value[2d], 0.5, 0.5)")

_X = "sum_over_time(event_value[1d])"
for _f, _arg, _sql_f in [
    ("abs", f"{_X} - 50", "abs(x - 50)"), ("ceil", _X, "ceil(x)"), ("floor", _X, "floor(x)"), ("round", _X, "floor(x + 0.5)"), ("sgn", f"{_X} - 50", "sign(x - 50)"), ("exp", f"{_X} / 1000", "exp(x / 1000)"),
    ("sqrt", _X, "sqrt(x)"), ("ln", f"{_X} + 1", "ln(x + 1)"), ("log2", f"{_X} + 1", "log2(x + 1)"), ("log10", f"{_X} + 1", "log10(x + 1)"),
]:
    _mapped(f"promql_{_f}", f"{_f}({_arg})", _sql_f)
_mapped("promql_clamp", f"clamp({_X}, 20, 80)", "greatest(20, least(80, x))")
_mapped("promql_clamp_min", f"clamp_min({_X}, 20)", "greatest(20, x)")
_mapped("promql_clamp_max", f"clamp_max({_X}, 80)", "least(80, x)")
_mapped("promql_arithmetic", f"({_X} ^ 2 + 3) % 7", "(x * x + 3) % 7")
_mapped("promql_atan2", f"{_X} atan2 {_X} + 1 > 0", "atan2(x, x) + 1", "WHERE atan2(x, x) + 1 > 0")
_mapped("promql_unary", f"-{_X}", "-x")
_mapped("promql_sort", f"sort({_X})", "x")
_mapped("promql_sort_desc", f"sort_desc({_X})", "x")
_metric("promql_label_replace", f"label_replace({_X}, 'kind', '$1-x', 'event_type', '(.).*')", f""", {_SUMS} SELECT event_type, "user", ts, event_type[1] || '-x' AS kind, round(x, 6) AS value FROM d""")
_metric("promql_label_join", f"label_join({_X}, 'both', '/', 'user', 'event_type')", f""", {_SUMS} SELECT event_type, "user", ts, "user" || '/' || event_type AS "both", round(x, 6) AS value FROM d""")
_metric("promql_count_values", 'count_values by (event_type) ("n", count_over_time(event_value[1d]))', "SELECT event_type, n::VARCHAR AS n, ts, count(*)::DOUBLE AS value FROM (SELECT event_type, ts, count(*) AS n FROM w GROUP BY event_type, \"user\", ts) GROUP BY ALL")
for _f, _sql_f in [("avg", "avg(x)"), ("group", "1.0::DOUBLE"), ("stddev", "stddev_pop(x)"), ("stdvar", "var_pop(x)"), ("min", "min(x)"), ("max", "max(x)"), ("count", "count(*)::DOUBLE")]:
    _metric(f"promql_by_{_f}", f"{_f} by (event_type) ({_X})", f", {_SUMS} SELECT event_type, ts, round({_sql_f}, 6) AS value FROM d GROUP BY ALL")
_metric("promql_bottomk", f"bottomk by (event_type) (3, {_X})", f', {_SUMS} SELECT event_type, "user", ts, round(x, 6) AS value FROM d QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY x, "user") <= 3')

_COUNTS = "c AS (SELECT event_type, ts, count(*) FILTER (WHERE t >= ts - 6 * 3600000000) AS a, count(*) FILTER (WHERE t >= ts - 12 * 3600000000) AS b FROM w GROUP BY ALL)"
_A, _B = "sum by (event_type) (count_over_time(event_value[6h]))", "sum by (event_type) (count_over_time(event_value[12h]))"
_metric("promql_binary", f"{_A} > bool 3 and on (event_type) {_B} > 1", f", {_COUNTS} SELECT event_type, ts, (a > 3)::INT::DOUBLE AS value FROM c WHERE a > 0 AND b > 1")
_metric("promql_or", f"{_A} > 10 or {_B}", f", {_COUNTS} SELECT event_type, ts, (CASE WHEN a > 10 THEN a ELSE b END)::DOUBLE AS value FROM c WHERE b > 0")
_metric("promql_unless", f"{_B} unless {_A} > 10", f", {_COUNTS} SELECT event_type, ts, b::DOUBLE AS value FROM c WHERE b > 0 AND a <= 10")
_metric("promql_compare", f"{_A} == {_B}", f", {_COUNTS} SELECT event_type, ts, a::DOUBLE AS value FROM c WHERE a > 0 AND a = b")
_metric("promql_group_right", f"sum({_A}) / on () group_right {_A}", f", {_COUNTS} SELECT event_type, ts, round(sum(a) OVER (PARTITION BY ts) / a, 6) AS value FROM c WHERE a > 0")
_metric("promql_or_matchers", "sum by (event_type) (count_over_time(event_value{event_type='click' or event_type='view'}[6h]))", f", {_COUNTS} SELECT event_type, ts, a::DOUBLE AS value FROM c WHERE a > 0 AND event_type IN ('click', 'view')")
_metric("promql_instant", "event_value", """SELECT event_type, "user", ts, round(v, 6) AS value FROM w WHERE r = 1 AND t >= ts - 300000000""")
_metric("promql_timestamp", "timestamp(event_value)", """SELECT event_type, "user", ts, round(t / 1e6, 6) AS value FROM w WHERE r = 1 AND t >= ts - 300000000""")
_metric("promql_offset", "sum by (event_type) (sum_over_time(event_value[6h] offset 12h))", "SELECT event_type, g.ts, round(sum(v), 6) AS value FROM g JOIN m ON m.t BETWEEN g.ts - 18 * 3600000000 AND g.ts - 12 * 3600000000 GROUP BY ALL")
_metric("promql_at", "sum by (event_type) (sum_over_time(event_value[1d] @ 1704844800))", "SELECT event_type, g.ts, round(x, 6) AS value FROM g, (SELECT event_type, sum(v) AS x FROM m WHERE t BETWEEN 1704844800000000 - 86400000000 AND 1704844800000000 GROUP BY 1)")
_metric("promql_subquery", "max_over_time(sum by (event_type) (sum_over_time(event_value[6h]))[1d:6h])", "SELECT event_type, g.ts, round(max(x), 6) AS value FROM g JOIN (SELECT event_type, g.ts AS inner_ts, sum(v) AS x FROM g JOIN m ON m.t BETWEEN g.ts - 6 * 3600000000 AND g.ts GROUP BY ALL) ON inner_ts BETWEEN g.ts - 86400000000 AND g.ts GROUP BY ALL")
_metric("promql_absent", "absent(event_value{event_type='nothing'})", "SELECT 'nothing' AS event_type, ts, 1.0::DOUBLE AS value FROM g")
_metric("promql_absent_over_time", "absent_over_time(event_value{user='7'}[6h])", """SELECT '7' AS "user", ts, 1.0::DOUBLE AS value FROM g WHERE ts NOT IN (SELECT ts FROM w WHERE "user" = '7' AND t >= ts - 6 * 3600000000)""")
_metric("promql_time", "time() - 1", "SELECT ts, ts / 1e6 - 1 AS value FROM g")
_metric("promql_scalar", "vector(4) * scalar(count(count_over_time(event_value[1d])))", "SELECT g.ts, CASE WHEN n IS NULL THEN 'nan'::DOUBLE ELSE 4.0 * n END AS value FROM g LEFT JOIN (SELECT ts, count(DISTINCT (event_type, \"user\")) AS n FROM w GROUP BY 1) USING (ts)")
for _f, _part in [("minute", "minute"), ("hour", "hour"), ("day_of_week", "dow"), ("day_of_month", "day"), ("day_of_year", "doy"), ("month", "month"), ("year", "year")]:
    _metric(f"promql_{_f}", f"{_f}()", f"SELECT ts, extract('{_part}' FROM make_timestamp(ts))::DOUBLE AS value FROM g")
_metric("promql_days_in_month", "days_in_month()", "SELECT ts, extract('day' FROM last_day(make_timestamp(ts)))::DOUBLE AS value FROM g")
_HISTOGRAM = f"""SELECT event_type, g.ts, CASE WHEN le IS NULL THEN {_BOUNDS[-1]} ELSE low + (le - low) * (want - below) / (n - below) END AS x FROM (
    SELECT *, coalesce(lag(le) OVER o, 0) AS low, coalesce(lag(n) OVER o, 0) AS below, 0.9 * max(n) OVER (PARTITION BY event_type, t) AS want FROM (
        SELECT event_type, (epoch_us(ts) // 86400000000 + 1) * 86400000000 AS t, le, count(*) FILTER (WHERE le IS NULL OR value <= le) AS n FROM events, (SELECT unnest([{", ".join(map(str, _BOUNDS))}, NULL]) AS le) GROUP BY ALL)
    WINDOW o AS (PARTITION BY event_type, t ORDER BY le NULLS LAST)) b JOIN g ON b.t BETWEEN g.ts - 64800000000 AND g.ts WHERE n >= want QUALIFY row_number() OVER (PARTITION BY event_type, g.ts ORDER BY le NULLS LAST) = 1"""
_metric("promql_histogram_quantile", "histogram_quantile(0.9, last_over_time(event_bucket[18h]))", f"SELECT event_type, ts, round(x, 6)::DOUBLE AS value FROM ({_HISTOGRAM})")

# Transforms ------------------------------------------------------------------


@_frame("row_function", "SELECT event_id, upper(event_type) || '!' AS shout FROM events")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return jobs.apply_rows(rows, lambda r: [{"event_id": x["event_id"], "shout": x["event_type"].upper() + "!"} for x in r], "event_id long, shout string")


@_frame("sample_rows", "SELECT event_id, event_type FROM events WHERE ('0x' || left(md5('42/' || event_id), 8))::BIGINT % 1000000 < 100000")
def _(spark, sf_dir):
    return relational.sample_by_digest(table(spark, sf_dir, "events"), 0.1, ["event_id"]).select("event_id", "event_type")


@_frame("encryption", """SELECT c_custkey, c_name, 4 * ((length(c_name) + 28 + 2) // 3) AS sealed_length, true AS differs, true AS wrong_key_is_null, true AS plain_is_null, c_name AS from_path FROM customer""")
def _(spark, sf_dir):
    """Sealed texts have the length of nonce, text and tag in base 64, open with their key only, and in a JSON object too."""
    registry.register(spark)
    table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "encrypt(c_name, 'key one') AS s").createOrReplaceTempView("sealed_customer")
    return spark.sql("""SELECT c_custkey, decrypt(s, 'key one') AS c_name, CAST(char_length(s) AS BIGINT) AS sealed_length, s <> c_name AS differs, decrypt(s, 'key two') IS NULL AS wrong_key_is_null,
        decrypt(c_name, 'key one') IS NULL AS plain_is_null, decrypt_path(to_json(named_struct('a', named_struct('b', s))), 'a.b', 'key one') AS from_path FROM sealed_customer""")


@_frame("conditions", "SELECT event_id, event_type, value FROM events WHERE (event_type LIKE '%lic%' OR event_type NOT LIKE '%i%') AND value >= 10 AND user_id <> 3 AND event_type NOT IN ('error')")
def _(spark, sf_dir):
    tree = {"and": [{"or": [{"column": "event_type", "operator": "Contains", "value": "lic"}, {"column": "event_type", "operator": "NotContains", "value": "i"}]}, {"column": "value", "operator": ">=", "value": 10}, {"column": "user_id", "operator": "<>", "value": 3}, {"column": "event_type", "operator": "not in", "value": ["error"]}]}
    return engine(spark, sf_dir).plan(Request(f"SELECT event_id, event_type, value FROM events WHERE {conditions.where(tree)}"))


@_frame("qualify", "SELECT event_type, event_id, value FROM events WHERE user_id > 3 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 3 ORDER BY event_id")
def _(spark, sf_dir):
    return engine(spark, sf_dir).plan(Request("SELECT event_type, event_id, value FROM events WHERE user_id > 3 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 3 ORDER BY event_id"))


@_frame("as_of_join", "SELECT a.event_id, a.user_id, b.value AS last_click FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'purchase'")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    clicks = e.filter("event_type = 'click'").select("user_id", "t", F.col("value").alias("last_click"))
    return relational.as_of_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "t"), clicks, ["user_id"], "t").drop("t")


@_frame("interval_join", "SELECT a.event_id, b.event_id AS span_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts >= b.ts AND a.ts < b.ts + INTERVAL 6 HOUR WHERE a.event_type = 'purchase' AND b.event_type = 'click'")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("span_id"), F.col("t").alias("low"), (F.col("t") + 21_600_000_000).alias("high"))
    return relational.interval_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "t"), spans, ["user_id"], "t", "low", "high", 21_600_000_000).select("event_id", "span_id")


@_frame("cached_slices", "SELECT event_type, count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM events GROUP BY 1")
def _(spark, sf_dir):
    """From slices of ten days; those that the range cuts are aggregated afresh."""
    us = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    low, high = us.agg(F.min("t"), F.max("t")).first()
    cache = pages.SliceCache(engine(spark, sf_dir), f"{scratch_dir(spark)}/slices-{uuid.uuid4().hex}", 864_000_000_000)
    request = Request("SELECT event_type, value FROM events", low or 0, (high or 0) + 1)
    out = cache.aggregate("by_type", request, ["event_type"], "value", request.end_us)
    return out.select("event_type", "count", F.round("sum", 4).alias("sum"), "min", "max", F.round("avg", 6).alias("avg"))


@_frame("edge_history", _D_SPANS + """ SELECT p.service AS client, s.service AS server, s.start_time // 5000000 * 5000000 AS bucket_start, count(*) AS total_requests, count(*) FILTER (WHERE s.status = 'ERROR') AS failed_requests
    FROM s LEFT JOIN s p ON s.trace_id = p.trace_id AND s.parent = p.span_id WHERE p.service IS NULL OR p.service <> s.service GROUP BY ALL""")
def _(spark, sf_dir):
    return traces.edge_history(_spans(spark, sf_dir), 5_000_000).select("client", "server", "bucket_start", "total_requests", "failed_requests")


@_frame("duration_percentiles", _D_SPANS + " SELECT service AS service_name, count(*) AS spans, round(quantile_cont((end_time - start_time)::DOUBLE, 0.5), 6) AS p50, round(quantile_cont((end_time - start_time)::DOUBLE, 0.99), 6) AS p99 FROM s GROUP BY 1")
def _(spark, sf_dir):
    out = traces.duration_percentiles(_spans(spark, sf_dir), ["service_name"], (0.5, 0.99), exact=True)
    return out.select("service_name", "spans", *[F.round(c, 6).alias(c) for c in ("p50", "p99")])


@_frame("trace_list_by_user", _D_SPANS + " SELECT trace_id, min(service) AS \"user\", count(*) AS spans FROM s GROUP BY 1 HAVING min(service) = 'assistant'")
def _(spark, sf_dir):
    return traces.trace_list_by_user(_spans(spark, sf_dir), "service_name", "assistant").select("trace_id", "user", "spans")
