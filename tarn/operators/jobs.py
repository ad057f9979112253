"""Maintenance jobs as batch plans: downsampling, distinct values, compaction, partial aggregates, patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import timefn

_AGGREGATES = {
    "avg": lambda v, t: F.avg(v), "sum": lambda v, t: F.sum(v), "min": lambda v, t: F.min(v), "max": lambda v, t: F.max(v), "count": lambda v, t: F.count(v).cast("double"),
    "first": lambda v, t: F.min_by(v, t), "last": lambda v, t: F.max_by(v, t),
}


def downsample(df: DataFrame, interval: str, how: str = "avg", time_column: str = "_timestamp", value_column: str = "value", series: Sequence[str] = ("__hash__",)) -> DataFrame:
    """One row per series and bucket; labels keep their largest value, which in a series is their only one."""
    if how not in _AGGREGATES:
        raise ValueError(f"unknown aggregate {how!r}")
    width = timefn.interval_us(interval)
    labels = [c for c in df.columns if c not in (time_column, value_column, *series)]
    bucket = timefn.bucket(F.col(time_column), width).alias("__bucket")
    value = _AGGREGATES[how](F.col(value_column), F.col(time_column)).alias(value_column)
    out = df.groupBy(*series, bucket).agg(value, *[F.max(c).alias(c) for c in labels])
    return out.withColumnRenamed("__bucket", time_column).select(*df.columns)


def distinct_values(df: DataFrame, fields: Sequence[str], time_column: str = "_timestamp") -> DataFrame:
    """(field, value, first time, count) for each value of the fields, from one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    rows = df.select(F.col(time_column).alias("t"), pairs).filter("p.value IS NOT NULL")
    return rows.groupBy("p.field", "p.value").agg(F.min("t").alias(time_column), F.count(F.lit(1)).alias("count"))


def merge_distinct(parts: DataFrame, time_column: str = "_timestamp") -> DataFrame:
    """Distinct-value rows of several flushes merged."""
    return parts.groupBy("field", "value").agg(F.min(time_column).alias(time_column), F.sum("count").alias("count"))


def partial_aggregate(df: DataFrame, keys: Sequence[Column | str], value: str, distinct: str | None = None) -> DataFrame:
    """Mergeable states of a time slice: count, sum, min, max, and a sketch of distinct values."""
    aggs = [F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")]
    if distinct:
        aggs.append(F.hll_sketch_agg(F.col(distinct)).alias("sketch"))
    return df.groupBy(*keys).agg(*aggs)


def merge_aggregates(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final values from the states of all slices."""
    aggs = [F.sum("n").alias("count"), F.sum("total").alias("sum"), F.min("least").alias("min"), F.max("most").alias("max")]
    if "sketch" in states.columns:
        aggs.append(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    return states.groupBy(*keys).agg(*aggs).withColumn("avg", F.try_divide(F.col("sum"), F.col("count")))


def compact(df: DataFrame, path: str, time_column: str = "_timestamp", partition_by: Sequence[str] = (), target_rows: int = 5_000_000) -> None:
    """Rewrite small files as time-ordered ones: ranges of time per file, newest first within."""
    rows = df.count()
    spread = df.repartitionByRange(max(1, -(-rows // target_rows)), *partition_by, F.col(time_column).desc())
    writer = spread.sortWithinPartitions(*partition_by, F.col(time_column).desc()).write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


#: What varies between messages of one template, most specific first.
MASKS = [
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<time>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<ip>"),
    (r"\b0x[0-9a-fA-F]+\b|\b[0-9a-fA-F]{16,}\b", "<hex>"),
    (r"[-+]?\b\d+(?:\.\d+)?", "<num>"),
]


def template(text: Column) -> Column:
    """A message with its varying parts masked."""
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(mask))
    return text


def patterns(df: DataFrame, text_column: str, size: int | None = 100) -> DataFrame:
    """The most frequent templates (all if size is None) with their count, share and an example."""
    counted = df.filter(F.col(text_column).isNotNull()).groupBy(template(F.col(text_column)).alias("pattern")).agg(F.count(F.lit(1)).alias("num"), F.min(text_column).alias("example"))
    total = counted.agg(F.sum("num").alias("__total"))
    # One row, so broadcast.
    shared = counted.join(F.broadcast(total)).withColumn("share", F.col("num") / F.col("__total")).drop("__total")
    ordered = shared.orderBy(F.desc("num"), "pattern")
    return ordered if size is None else ordered.limit(size)


def apply_rows(df: DataFrame, function, schema: str, whole: bool = False) -> DataFrame:
    """A user's function over result rows: per batch of rows, or over all rows of a bounded result at once.

    function takes and returns a list of dicts. With ``whole`` the result must
    fit one task, so it is meant for limited results.
    """

    def run(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame(function(f.to_dict("records")))

    if not whole:
        return df.mapInPandas(run, schema)

    columns = list(df.columns)

    def once(f):
        import pandas as pd

        return pd.DataFrame(function(f[columns].to_dict("records")))

    return df.withColumn("__all", F.lit(True)).groupBy("__all").applyInPandas(once, schema)
