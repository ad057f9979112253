import datetime

import pytest
from pyspark.sql import functions as F

from tarn.functions import regex, timefn

CASES = [
    ("arrsort('[3,1,2]')", "[1,2,3]"), ("arrsort('[\"b\",\"a\"]')", '["a","b"]'), ("arrsort('[1,\"a\"]')", None), ("arrsort('bad')", None), ("arrsort('[]')", None), ("arrsort(NULL)", None),
    ("arr_descending('[3,1,2.5]')", "[3,2.5,1]"), ("arrsort('[true,false]')", "[false,true]"),
    ("arrjoin('[1,2.0,\"2.0\",null,{\"k\":[1]}]','|')", '1|2|2.0|null|{"k":[1]}'), ("arrjoin('{\"k\":1}','|')", None),
    ("arrcount('[1,2]')", 2), ("arrcount('bad')", 0), ("arrcount(NULL)", 0), ("arrcount('[]')", 0),
    ("arrindex('[1,2,3,4]',1,2)", "[2,3]"), ("arrindex('[1]',5,9)", "[]"), ("arrindex('[1,2,3]',1,99)", "[2,3]"),
    ("arrzip('[1,2,3]','[\"a\",\"b\"]',':')", '["1:a","2:b"]'), ("arrzip('[]','[1]',':')", None),
    ("cast_to_arr('[1,\"\",\"x\"]')", ["1", "x"]), ("cast_to_arr('[]')", None), ("to_array_string(array('a',null,'b'))", '["a","b"]'),
    ("string_to_array_v2('a,b;c',',;')", ["a", "b", "c"]), ("string_to_array_v2('abc',NULL)", ["a", "b", "c"]), ("string_to_array_v2('a b','')", ["a b"]), ("string_to_array_v2('a]b^c','^]')", ["a", "b", "c"]),
    ("spath('{\"a\":{\"b\":2}}','a.b')", "2"), ("spath('{\"a\":null}','a')", "null"), ("spath('{\"a\":1}','b')", None), ("spath('bad','a')", None),
    ("time_us(1700000000)", 1700000000000000), ("time_us(1700000000000)", 1700000000000000), ("time_us(1700000000000000000)", 1700000000000000),
    ("text_us('2022-10-03 00:00:00')", 1664755200000000), ("text_us('2022-10-03T00:00:00.000001Z')", 1664755200000001), ("text_us('Mon, 3 Oct 2022 00:00:00 +0000')", 1664755200000000), ("text_us('never')", None),
    ("time_range(5,'-1','-1')", True), ("time_range(NULL,'1','2')", None), ("bucket_us(1664841600000000,604800000000)", 1664755200000000),
    ("fuzzy_match('Hello World','wrld',1)", True), ("fuzzy_match('Hello','hallo',0)", False), ("fuzzy_match('x','x',0)", False), ("fuzzy_match(NULL,'a',1)", None),
    ("str_match('abc','B')", False), ("str_match_ignore_case('aBc','B')", True), ("re_match('abc','b.')", True), ("re_not_match(NULL,'b')", None),
    ("re_matches('a=1 b=2','(\\\\w)=(\\\\d)')", ["1", "2"]), ("re_matches('zz','\\\\d')", None), ("re_matches('x \"q\" y','\"[a-z]\"')", ["q"]),
    ("gcd(12,18)", 6), ("lcm(4,6)", 12), ("gcd(0,5)", 5), ("json_get_int('{\"k\":69}','k')", 69), ("json_length('[1,2]')", 2), ("json_contains('{\"k\":1}','z')", False),
]


@pytest.mark.parametrize("start", range(0, len(CASES), 20))
def test_sql_functions(spark, start):
    part = CASES[start : start + 20]
    row = spark.sql("SELECT " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(part))).first()
    assert [(e, row[i]) for i, (e, _) in enumerate(part)] == part


def test_functions_per_row(spark):
    rows = spark.range(3).selectExpr("arrsort(concat('[3,',id,']')) AS a", "arrindex('[1,2,3]', CAST(id AS INT), 2) AS i").collect()
    assert [(r.a, r.i) for r in rows] == [("[0,3]", "[1,2,3]"), ("[1,3]", "[2,3]"), ("[2,3]", "[3]")]


def test_regex_fields(spark):
    df = spark.createDataFrame([("k=1",), ("zz",), (None,)], "s string")
    got = df.select(regex.regexp_match_to_fields(F.col("s"), r"(?<key>\w)=(?<val>\d)").alias("f")).select("f.*").collect()
    assert [tuple(r) for r in got] == [("k", "1"), (None, None), (None, None)]
    with pytest.raises(ValueError):
        regex.check_pattern("(?=a)")


def test_intervals():
    assert timefn.interval_us("5 minutes") == 300_000_000
    assert timefn.interval_us("1 hour 30 m") == 5_400_000_000
    assert timefn.parse_milliseconds("1h30m") == 5_400_000 and timefn.parse_milliseconds("10") == 10_000
    for bad in ("5", "x", "", "5 parsecs"):
        with pytest.raises(ValueError):
            timefn.interval_us(bad)
    day = 86_400_000_000
    assert [timefn.auto_interval_us(1, 1 + n) // 1_000_000 for n in (60 * day, 6 * 3_600_000_000, 60_000_000)] == [86400, 3600, 10]
    assert timefn.java_pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"


def test_bucket_of_a_week(spark):
    us = int(datetime.datetime(2022, 10, 5, tzinfo=datetime.timezone.utc).timestamp() * 1e6)
    got = spark.range(1).select(timefn.bucket(F.lit(us), timefn.interval_us("7 days"))).first()[0]
    assert datetime.datetime.fromtimestamp(got / 1e6, datetime.timezone.utc).date() == datetime.date(2022, 10, 3)
