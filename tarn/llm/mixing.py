"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are first counted by membership pattern, the set of sources that
they belong to. Each pattern offers its words once at no cost, then again at a
cost that rises with every repetition (convex, so repetitions are taken in
order), and each source asks for its target. A min-cost flow over
pattern -> source edges decides how many words of each pattern every source
takes; only patterns and sources reach the driver. Documents then fill the
flow in a seeded order: whole repetitions for all, and the rest for those
first in the order, cut where the words taken come nearest to the flow.

Defined results: a null text has size 0; a null source is a source of its own,
after all others; repeated rows fill the flow one by one; documents of size 0
follow the same order and take 0 words; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import Scratch

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 17
#: Patterns and sources that the driver's flow handles; more raise an error rather than being dropped.
MAX_PATTERNS = 200_000


def word_count(text: Column) -> Column:
    r"""Maximal runs of characters other than \x20 and \x09-\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[int], max_repeats: int = MAX_REPEATS) -> list[float]:
    """The total shared by weight; a source stops at max_repeats times its size, the excess is shared anew."""
    free = set(range(len(sizes)))
    rest = sum(sizes)
    out = [0.0] * len(sizes)
    while free:
        w = sum(weights[i] for i in free)
        full = {i for i in free if rest * weights[i] > max_repeats * sizes[i] * w}
        if not full:
            for i in free:
                out[i] = rest * weights[i] / w
            break
        for i in full:
            out[i] = float(max_repeats * sizes[i])
        rest -= sum(max_repeats * sizes[i] for i in full)
        free -= full
    return out


def min_cost_flow(sizes: Sequence[int], members: Sequence[Sequence[int]], wanted: Sequence[int], repeats: int = MAX_REPEATS) -> list[int]:
    """Words that each pattern gives in all, at most ``repeats`` times its size.

    The n-th use of a word costs more than the one before (any increasing
    costs give the same flow), so levels of use open one after the other, and
    within a level augmenting paths send what sources still want. A path may
    move words that a pattern gave to one source over to another, so what an
    earlier, cheaper level sent is never undone: the cost stays least.
    """
    given = [0] * len(sizes)
    flow: list[dict[int, int]] = [{} for _ in sizes]  # pattern -> source -> words
    givers: list[set[int]] = [set() for _ in wanted]  # source -> patterns that give to it
    still = list(wanted)
    for level in range(1, repeats + 1):
        for start, size in enumerate(sizes):
            while given[start] < level * size:
                by_pattern: dict[int, int] = {}  # source -> the pattern that it was reached from
                by_source: dict[int, int] = {}  # pattern -> the source whose words it could move
                queue, goal = [start], None
                while queue and goal is None:
                    p = queue.pop(0)
                    for s in members[p]:
                        if s in by_pattern:
                            continue
                        by_pattern[s] = p
                        if still[s] > 0:
                            goal = s
                            break
                        for g in givers[s]:
                            if g != start and g not in by_source:
                                by_source[g] = s
                                queue.append(g)
                if goal is None:
                    break
                edges, s = [], goal  # (pattern, source it gives more, source it gives less or None)
                while True:
                    p = by_pattern[s]
                    edges.append((p, s, by_source.get(p)))
                    if p == start:
                        break
                    s = by_source[p]
                push = min([level * size - given[start], still[goal], *[flow[p][less] for p, _, less in edges if less is not None]])
                for p, more, less in edges:
                    flow[p][more] = flow[p].get(more, 0) + push
                    givers[more].add(p)
                    if less is not None:
                        flow[p][less] -= push
                        if not flow[p][less]:
                            del flow[p][less]
                            givers[less].discard(p)
                still[goal] -= push
                given[start] += push
    return given


def _encoded(source: Column) -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def mix(docs: DataFrame, members: Column, text_col: str = "text", id_col: str = "doc_id", weights: Sequence[int] = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = SEED):
    """(sized, sources): ``sized`` has pick (id, text hash), pattern, size, times; ``sources`` has source, source_size, target.

    ``members`` is an array of the sources of a document. Rows that agree in id
    and text agree in their place in the order and are taken together.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    text = F.col(f"`{text_col}`")
    text_key = F.coalesce(F.md5(text), F.lit(""))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text_key))
    sized = scratch.write(
        docs.select(F.array_sort(F.array_distinct(F.transform(members, _encoded))).alias("pattern"), word_count(text).alias("size"), order.alias("place"), F.col(f"`{id_col}`").alias("id")),
        "sized",
    )
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    rows.sort(key=lambda r: r["pattern"])
    names = sorted({s for r in rows for s in r["pattern"]}, key=lambda s: (s == "n", s))
    index = {s: i for i, s in enumerate(names)}
    members_of = [[index[s] for s in r["pattern"]] for r in rows]
    source_size = [0] * len(names)
    for r, own in zip(rows, members_of):
        for i in own:
            source_size[i] += r["size"]
    goal = targets(source_size, [weights[i % len(weights)] for i in range(len(names))], repeats)
    given = min_cost_flow([r["size"] for r in rows], members_of, [int(t + 0.5) for t in goal], repeats)
    plan = [(r["pattern"], *(divmod(g, r["size"]) if r["size"] else (1, 0))) for r, g in zip(rows, given)]
    flows = spark.createDataFrame(plan, "pattern array<string>, whole long, rest long")
    cut = _cuts(sized, flows)
    # Both tables have at most MAX_PATTERNS rows, so they can be broadcast.
    times = F.col("whole") + F.when((F.col("rest") > 0) & (F.col("place") <= F.col("cut")), 1).otherwise(0)
    placed = sized.join(F.broadcast(cut), "pattern", "left").select("id", "place", "pattern", "size", F.coalesce(times, F.lit(0)).cast("int").alias("times"))
    sources = spark.createDataFrame([(n, c, t) for n, c, t in zip(names, source_size, goal)], "source string, source_size long, target double")
    return placed, sources


def _cuts(sized: DataFrame, flows: DataFrame) -> DataFrame:
    """Per pattern the last place whose documents are taken once more.

    Place prefixes are summed level by level, so only documents within one of
    16^6 slices of a pattern are ever put in one sequence.
    """
    spark = sized.sparkSession
    edges = flows.select("pattern", "rest", F.lit(0).cast("long").alias("before"), F.lit("").alias("edge"))
    schema = "pattern array<string>, rest long, before long, edge string"
    for width in (3, 6):
        inside = sized.join(F.broadcast(edges), "pattern").filter((F.col("rest") > 0) & F.startswith("place", "edge"))
        sums = inside.groupBy("pattern", "rest", "before", F.substring("place", 1, width).alias("slice")).agg(F.sum("size").alias("size"))
        run = F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("slice"))
        sums = sums.withColumn("after", run).withColumn("until", F.col("after") - F.col("size"))
        found = sums.filter((F.col("until") <= F.col("rest")) & (F.col("after") > F.col("rest"))).groupBy("pattern", "rest").agg(F.min(F.struct("slice", "until")).alias("m"))
        edges = spark.createDataFrame(found.select("pattern", "rest", F.col("m.until").alias("before"), F.col("m.slice").alias("edge")).collect(), schema)
    inside = sized.join(F.broadcast(edges), "pattern").filter(F.startswith("place", "edge"))
    places = inside.groupBy("pattern", "rest", "before", "place").agg(F.sum("size").alias("size"))
    run = F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("place"))
    last = places.withColumn("after", run).filter(2 * F.col("after") - F.col("size") <= 2 * F.col("rest")).groupBy("pattern").agg(F.max("place").alias("last"))
    # A pattern without an edge takes everything or nothing; "g" follows every hexadecimal place.
    cut = flows.join(edges.select("pattern", "edge"), "pattern", "left").join(last, "pattern", "left")
    return cut.select("pattern", "whole", "rest", F.coalesce("last", "edge", F.lit("g")).alias("cut"))


def repeat_documents(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """docs mixed by one source column: a document that the mix uses n times is there n times."""
    placed, _ = mix(docs, F.array(F.col(f"`{source_col}`")), text_col, id_col, **options)
    once = placed.groupBy("id", "place", "pattern").agg(F.max("times").alias("times"))
    text_key = F.coalesce(F.md5(F.col(f"`{text_col}`")), F.lit(""))
    place = F.md5(F.concat_ws(":", F.lit(str(options.get("seed", SEED))), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text_key))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), place.alias("place"), F.array(_encoded(F.col(f"`{source_col}`"))).alias("pattern"))
    used = packed.join(once.filter("times > 0").select("place", "pattern", "times"), ["place", "pattern"])
    return used.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    placed, sources = mix(docs.select("doc_id", "text", "source"), F.array("source"))
    own = placed.withColumn("source", F.col("pattern")[0]).join(F.broadcast(sources), "source")
    return own.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix_sql(docs: str) -> str:
    """CTEs ending in ``mixed`` (the columns of docs, size, source_size, target, times)."""
    case = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return rf"""
WITH mix_docs AS (
    SELECT *, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size,
        md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS place
    FROM {docs}
), src AS (
    SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {case} END AS w
    FROM mix_docs GROUP BY source
), tried AS (
    SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
        coalesce(sum(source_size) OVER f, 0) AS less_size, coalesce(sum(w) OVER f, 0) AS less_w
    FROM src WINDOW f AS (ORDER BY source_size * 1.0 / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
    SELECT *, (total - {MAX_REPEATS} * less_size) * w > {MAX_REPEATS} * source_size * (all_w - less_w) AS full_ FROM tried
), aimed AS (
    SELECT source, source_size, CASE WHEN full_ THEN ({MAX_REPEATS} * source_size)::DOUBLE
        ELSE ((total - {MAX_REPEATS} * coalesce(sum(source_size) FILTER (WHERE full_) OVER (), 0)) * w)::DOUBLE
            / (sum(w) FILTER (WHERE NOT full_) OVER ())::DOUBLE END AS target
    FROM capped
), split_ AS (
    SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE floor(target + 0.5)::BIGINT // source_size END AS whole,
        CASE WHEN source_size = 0 THEN 0 ELSE floor(target + 0.5)::BIGINT % source_size END AS rest
    FROM aimed
), placed AS (
    SELECT d.*, s.source_size, s.target, s.whole, s.rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after_,
        sum(size) OVER (PARTITION BY d.source, place) AS own
    FROM mix_docs d JOIN split_ s ON d.source IS NOT DISTINCT FROM s.source
), mixed AS (
    SELECT *, whole + CASE WHEN rest > 0 AND 2 * after_ - own <= 2 * rest THEN 1 ELSE 0 END AS times FROM placed
)"""


SQL = mix_sql("documents") + "\nSELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken FROM mixed"
