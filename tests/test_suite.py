"""Every registered query of the engine against its SQL statement, on the smallest tables."""

import os

import duckdb
import pytest

from tarn import suite

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in suite.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5)
    return [_plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, duck, name):
    df = suite.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in suite.SQL:
        return
    found = duck.execute(suite.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(repr([_plain(r[names.index(c)]) for c in sorted(names)]) for r in found.fetchall())
    assert sorted(repr([_plain(r[c]) for c in sorted(names)]) for r in rows) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_log_patterns_has_no_limit(spark, tmp_path):
    spark.createDataFrame([(f"event {'x' * (i + 1)} took {i} ms",) for i in range(150)], "props string").write.parquet(str(tmp_path / "events.parquet"))
    assert suite.QUERIES["log_patterns"](spark, str(tmp_path)).count() == 150
