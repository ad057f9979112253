"""Connected components of a graph of long ids, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import Scratch

MAX_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for every id in ``edges`` (a, b): root is the least id reachable.

    Each round links the larger neighbours of a node to the least of its
    neighbours and itself, then the smaller ones likewise; edges never grow in
    number beyond a constant factor, no neighbourhood is gathered into one row,
    and rounds grow as the logarithm of the diameter. Rounds are written to the
    scratch folder, so lineage stays short and a lost executor costs one round.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges0")
    state = None
    for round_ in range(1, MAX_ROUNDS + 1):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.filter("u <> v").distinct(), f"large{round_}")
        # Now every edge goes down; a node's lower neighbours are linked to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.write(small, f"edges{round_}")
        before, state = state, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"large{round_}", f"edges{round_ - 1}")
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id")
    return roots.unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
