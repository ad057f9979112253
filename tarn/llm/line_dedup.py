"""Line de-duplication with levelled sorted runs of line hashes; DataFrame functions only.

A run is a table of (h1, h2, holder, n): the 128-bit hash of a line's key, the
document that keeps the line, and its rows in the batch that first had it.
Runs are bucketed and sorted by the hash, so a new batch meets them in a merge
anti-join without moving them: keys the runs lack become the batch's own run,
keys they have go to a hit list. When a level holds FANOUT runs they are
merged into one run of the next level, bucket by bucket.

Batches are taken from the largest doc_id down, so a key's holder is known
when the key is first met.

Defined results: a null or empty text is one empty line; a null doc_id counts
as one document below every other; rows with one doc_id are one document, and
if that document holds a line all its rows keep it; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import Scratch, null_safe

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 3
FANOUT = 2
_WHITE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(_WHITE))
    # lower() is the fast form, and the same where every character is ASCII.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


class RunStore:
    """Runs of line hashes by level: tables of the session whose files lie in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark = spark
        self.scratch = Scratch(spark, "runs")
        self.saved: list[str] = []
        self.fanout = fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"line_run_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.serial = 0

    def _save(self, df: DataFrame) -> str:
        """Write df as a run: hash-partitioned, bucketed and sorted by key."""
        self.serial += 1
        name = f"{self.prefix}_{self.serial}"
        (
            df.repartition(self.buckets, *_KEY).write.format("parquet").option("compression", "zstd").option("path", self.scratch.path(name))
            .bucketBy(self.buckets, *_KEY).sortBy(*_KEY).saveAsTable(name)
        )
        self.saved.append(name)
        return name

    def discard(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)
        self.saved.remove(name)

    def stage(self, df: DataFrame) -> str:
        """A batch's keys in run layout, not yet part of any level."""
        return self._save(df)

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The batch's keys that no run has: a merge anti-join against each run in turn."""
        for name in self.names():
            batch = batch.join(self.spark.table(name).select(*_KEY).hint("merge"), _KEY, "left_anti")
        return batch

    def add(self, df: DataFrame) -> str:
        name = self._save(df)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        return name

    def compact(self) -> None:
        """Merge every full level into one run of the next."""
        level = 0
        while level < len(self.levels):
            runs = self.levels[level]
            if len(runs) >= self.fanout:
                merged = self._save(reduce(DataFrame.unionAll, [self.spark.table(n) for n in runs]))
                for n in runs:
                    self.discard(n)
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
            level += 1

    def drop(self) -> None:
        """Every table of the store, those of no level too."""
        for n in list(self.saved):
            self.discard(n)
        self.levels = []


def _batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Upper limits of doc_id ranges of about equal row counts."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] if batches > 1 else []
    return sorted(set(cuts or []))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, th, drops): the positions of the lines that a document loses, th the hash of its text.

    docs needs doc_id and text.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    bounds = _batch_bounds(docs, batches)
    batch_no = reduce(lambda acc, b: acc + F.when(F.col("doc_id") > b, 1).otherwise(0), bounds, F.lit(0)).alias("batch")
    lines = (
        docs.select("doc_id", F.xxhash64("text").alias("th"), batch_no, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("k", F.btrim("line", F.lit(_WHITE)))
        .filter(F.char_length("k") >= min_chars)
        .withColumn("k", line_key(F.col("k")))
        .select("doc_id", "th", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), F.col("k")).alias("h2"), "batch")
    )
    staged = scratch.write(lines, "lines", ["batch"])

    store = RunStore(spark)
    try:
        hits: list[str] = []
        for b in range(len(bounds), -1, -1):
            own = staged.filter(F.col("batch") == b).groupBy(*_KEY).agg(F.max("doc_id").alias("holder"), F.count(F.lit(1)).alias("n"))
            if not store.names():
                store.add(own)
                continue
            name = store.stage(own)
            keys = spark.table(name)
            own_run = store.add(store.fresh(keys))
            known = keys.join(spark.table(own_run).select(*_KEY).hint("merge"), _KEY, "left_anti")
            hits.append(store.stage(known.select(*_KEY, F.lit(None).cast(keys.schema["holder"].dataType).alias("holder"), "n")))
            store.discard(name)
            store.compact()

        # Rows bound documents from above: only keys with enough rows can be in enough documents.
        # Grouped by a struct: over a union of tables bucketed by the group's own columns, Spark 4.1 leaves out
        # the exchange and then reads the tables unbucketed, which gives partial sums as results.
        every = reduce(DataFrame.unionAll, [spark.table(n) for n in [*store.names(), *hits]])
        counted = every.groupBy(F.struct(*_KEY).alias("key")).agg(F.max("holder").alias("holder"), F.sum("n").alias("n")).select("key.*", "holder", "n")
        likely = scratch.write(counted.filter(F.col("n") >= min_docs).select(*_KEY, "holder"), "likely")
    finally:
        store.drop()
    rows = scratch.write(staged.select("doc_id", "th", "pos", *_KEY).join(likely, _KEY), "rows")
    scratch.drop("lines")
    often = rows.groupBy(*_KEY, "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    often = scratch.write(often.select(*_KEY), "often")
    lost = rows.join(often, _KEY).filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return lost.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with ``lines`` (its lines) and ``stay`` (positions of those that stay) beside a struct ``doc`` of its columns."""
    drops = dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs, batches)
    drops = drops.withColumnsRenamed({"doc_id": "__doc_id", "th": "__th"})
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"))
    joined = packed.join(drops, null_safe(packed, drops, [("__id", "__doc_id"), ("__text", "__th")]), "left")
    lines = joined.select("doc", F.split(F.coalesce(F.col("doc.text"), F.lit("")), "\n").alias("lines"), "drops")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    return lines.select("doc", "lines", F.when(F.col("drops").isNull(), every).otherwise(F.array_except(every, F.col("drops"))).alias("stay"))


def _kept_text() -> Column:
    return F.array_join(F.transform(F.col("stay"), lambda i: F.get(F.col("lines"), i)), "\n")


def filter_lines(docs: DataFrame, **options) -> DataFrame:
    """docs whose texts have lost their repeated lines; a text that lost none is as it was, null included.

    A column n_chars, where there is one, follows the new text.
    """
    out = dedup_lines(docs, **options)
    same = F.size("stay") == F.size("lines")
    text = F.when(same, F.col("doc.text")).otherwise(_kept_text())
    chars = F.when(same, F.col("doc.n_chars")).otherwise(F.char_length(_kept_text()).cast("long")) if "n_chars" in docs.columns else None
    new = {"text": text, "n_chars": chars}
    return out.select(*[(new[c] if new.get(c) is not None else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(
        F.col("doc.doc_id").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"),
        F.sha2(_kept_text(), 256).alias("kept_sha256"),
    )


def lines_sql(docs: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> str:
    """CTEs ending in ``kept_lines`` (rid, doc_id, n_lines, n_dropped, new_text)."""
    upper, lower = _UPPER, _UPPER.lower()
    return rf"""
WITH line_docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {docs}
), split_lines AS (
    SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
    FROM (SELECT rid, doc_id, string_split(t, chr(10)) AS ls FROM line_docs)
), keyed AS (
    SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{upper}', '{lower}') AS k FROM split_lines
), often AS (
    SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= {min_chars}
    GROUP BY k HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= {min_docs}
), judged AS (
    SELECT rid, keyed.doc_id, line, pos, often.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM often.holder AS lost
    FROM keyed LEFT JOIN often ON keyed.k = often.k
), kept_lines AS (
    SELECT rid, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '') AS new_text
    FROM judged GROUP BY rid
)"""


SQL = lines_sql("documents") + "\nSELECT doc_id, n_lines, n_dropped, sha256(new_text) AS kept_sha256 FROM kept_lines"
