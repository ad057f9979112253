"""Joins, de-duplication, sampling and window helpers that plain SQL does not give in one step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest estimated size at which a lookup table is broadcast.
BROADCAST_BYTES = 64 << 20


def latest(df: DataFrame, keys: Sequence[str], time_column: str = "_timestamp") -> DataFrame:
    """The newest row of each key; null keys are a key, and ties are settled by the other columns.

    An aggregate rather than a window: the largest row is found with a partial
    step before the shuffle, so a key with very many rows meets no one task.
    """
    rest = [c for c in df.columns if c not in keys and c != time_column]
    # Maps have no order, so they settle no tie: they are carried beside what does.
    plain = [c for c in rest if "map<" not in dict(df.dtypes)[c]]
    if len(plain) < len(rest):
        ordered = F.struct(F.col(time_column), *[F.col(c) for c in plain])
        best = df.groupBy(*keys).agg(F.max_by(F.struct(F.col(time_column), *[F.col(c) for c in rest]), ordered).alias("__row"))
    else:
        best = df.groupBy(*keys).agg(F.max(F.struct(F.col(time_column), *[F.col(c) for c in rest])).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col("__row").getField(c).alias(c) for c in df.columns])


def match_one_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", time_column: str = "_timestamp") -> DataFrame:
    """A join in which each left row meets at most one right row: the newest of its key."""
    return left.join(latest(right, on, time_column), list(on), how)


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size of a plan, from file sizes and selectivity rules."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def enrich(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a lookup table, broadcast where its estimated size allows, else shuffled with skew handling by AQE."""
    side = F.broadcast(lookup) if estimated_bytes(lookup) <= limit else lookup
    return df.join(side, list(on), how)


def deduplicate(df: DataFrame, keys: Sequence[str], time_column: str = "_timestamp") -> DataFrame:
    """The first row of each run of keys in (keys, time) descending order: the newest row of each key."""
    return latest(df, keys, time_column)


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], time_column: str, tolerance: int | None = None) -> DataFrame:
    """Each left row with the newest right row of its key at or before its time (long), not older than the tolerance.

    Both sides are one sorted sequence per key, in which the last right row is
    carried on: no range join. Right columns that the left side has are left out;
    of right rows at one time the largest by its other columns is taken.
    """
    extra = [c for c in right.columns if c not in left.columns]
    packed = right.groupBy(*on, time_column).agg(F.max(F.struct(F.col(time_column).alias("__t"), *extra)).alias("__right"))
    rows = left.select(*on, time_column, F.struct(*[F.col(c) for c in left.columns]).alias("__left")).withColumn("__right", F.lit(None).cast(packed.schema["__right"].dataType))
    both = rows.unionByName(packed.withColumn("__left", F.lit(None).cast(rows.schema["__left"].dataType)))
    # At one time the right row (0) comes first.
    order = Window.partitionBy(*on).orderBy(time_column, F.col("__left").isNotNull().cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("__met", F.last("__right", ignorenulls=True).over(order)).filter("__left IS NOT NULL")
    near = F.lit(True) if tolerance is None else F.col(time_column) - F.col("__met.__t") <= tolerance
    return met.select("__left.*", *[F.when(near, F.col("__met").getField(c)).alias(c) for c in extra])


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], time_column: str, start: str, end: str, width: int) -> DataFrame:
    """Left rows with the right rows of their key whose [start, end) holds their time (longs).

    Both sides meet on buckets of ``width``: a right row is copied into every
    bucket it touches, so width is best near the length of its intervals.
    """
    a = left.withColumn("__bucket", F.floor(F.col(time_column) / width))
    b = right.filter(F.col(end) > F.col(start)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    joined = a.join(b, [*on, "__bucket"])
    return joined.filter((F.col(time_column) >= F.col(start)) & (F.col(time_column) < F.col(end))).drop("__bucket")


def groups_frame(df: DataFrame, partition: Sequence[str], order: str, agg: Column, before: int, after: int, name: str) -> DataFrame:
    """An aggregate over a GROUPS frame: peers by ``order`` are numbered densely, and the frame ranges over the numbers."""
    dense = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    return dense.withColumn(name, agg.over(Window.partitionBy(*partition).orderBy("__peer").rangeBetween(-before, after))).drop("__peer")


def sample_rows(df: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Bernoulli sampling of rows."""
    return df.sample(withReplacement=False, fraction=ratio, seed=seed)


def sample_system(df: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Whole partitions of the scan, about the ratio of them: cheap, but rows that lie together are drawn together."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.spark_partition_id()), F.lit(1_000_000)) < int(ratio * 1_000_000))


def sample_by_hash(df: DataFrame, ratio: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows whose key hash falls below the ratio: the same rows in every run, whatever the partitioning."""
    share = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1_000_000))
    return df.filter(share < int(ratio * 1_000_000))


def sample_by_digest(df: DataFrame, ratio: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """As sample_by_hash, by the first 32 bits of an MD5 digest of seed and keys: other engines can draw the same rows."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return df.filter(F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("long") % 1_000_000 < int(ratio * 1_000_000))


def sample_stratified(df: DataFrame, ratio: float, time_column: str, strata: int, seed: int = 42) -> DataFrame:
    """The same share of each of ``strata`` equal parts of the time range."""
    t = F.col(time_column)
    us = t if dict(df.dtypes)[time_column] == "bigint" else F.unix_micros(t.cast("timestamp"))
    low, high = df.agg(F.min(us), F.max(us)).first()
    if low is None:
        return df
    width = max(1, (high - low) // strata + 1)
    part = F.floor((us - F.lit(low)) / F.lit(width)).cast("int")
    tagged = df.withColumn("__stratum", part)
    return tagged.sampleBy("__stratum", {i: ratio for i in range(strata)}, seed).drop("__stratum")


def summary_percentile(value: str, frequency: str, p: float) -> Column:
    """The exact percentile of values that come with their frequencies."""
    return F.percentile(F.col(value), F.lit(p), F.col(frequency))
