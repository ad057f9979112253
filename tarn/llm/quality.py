"""Quality rules: a ledger of failure bits and measurements, with versioned policies over it.

Every rule is evaluated once per document. The ledger stores its
measurements and one bit per failed rule; a policy is a mask over those bits,
so that a new policy, or the effect of leaving a rule out, needs no second
look at a text.

Defined results: a null or empty text has no words and fails ``few_words``;
repeated rows are judged alike; an empty table gives an empty ledger; input
columns named like a ledger column are replaced by it.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import map_rows

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
# Bytes that begin no code point of a word: ASCII white space and UTF-8 continuation bytes.
_NOT_WORD_START = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])

MEASURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_upper")]
)


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES.fields)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    repeated = 0
    if len(seen) < len(windows):
        end = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (
        len(words),
        len(text.translate(None, _NOT_WORD_START)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(text) - len(text.translate(None, _UPPER)),
    )


# (name, SQL condition over the measurements under which a document fails); the position is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_word_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("capitals", "5 * n_upper > 2 * word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: A policy names the rules that reject. Versions are never edited, only added.
POLICIES: dict[str, int] = {"base": BASE, "v1": sum(BIT.values())}
PRODUCTION = "v1"


def ledger(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with the measurements and ``failed`` (a bit per failed rule)."""

    def batch(texts: list) -> dict[str, list]:
        cols = list(zip(*[measure(t) for t in texts])) or [()] * len(MEASURES.fields)
        return {f.name: list(c) for f, c in zip(MEASURES.fields, cols)}

    measured = map_rows(docs, text_col, MEASURES, batch, carry)
    bits = None
    for name, condition in RULES:
        bit = F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured.withColumn("failed", bits.cast("long"))


def kept(policy: str = PRODUCTION, failed: str = "failed") -> Column:
    """True where no rule of the policy failed."""
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(ledger_df: DataFrame, policy: str = PRODUCTION, failed: str = "failed") -> DataFrame:
    """Per rule of the policy: how many documents fail it, and how many it alone rejects.

    The ledger is first counted by failure bits, at most 2^rules rows, so the
    report costs one partial aggregation however many rules there are.
    """
    mask = POLICIES[policy]
    counts = ledger_df.groupBy(F.col(failed).bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in BIT.items() if b & mask])).alias("r")
    by_rule = counts.select("bits", "n", rules)
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return by_rule.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum("n").alias("n_docs"),
    )


def filter_documents(docs: DataFrame, policy: str = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns only.

    The measurements go beside the row, so a column named like one stays untouched.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias("judged"))
    judged = ledger(packed, "judged", carry=["doc"])
    return judged.filter(kept(policy)).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, base_failed, kept, failed."""
    out = ledger(docs.select("doc_id", "text"), carry=["doc_id"])
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
        kept(PRODUCTION).alias("kept"),
        "failed",
    )


#: Statement of the same ledger; {docs} names the documents relation.
LEDGER_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {docs}
), w AS (
    SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), g AS (
    SELECT rid, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM w
), t AS (
    SELECT rid, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM g WINDOW o AS (PARTITION BY rid ORDER BY i)
), r AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS c FROM t WHERE c IS NOT NULL
), covered AS (
    SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) o(k) WHERE c > 1 GROUP BY rid
), l AS (
    SELECT rid, count(*) AS n, count(DISTINCT line) AS u
    FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
    SELECT w.rid, w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(l.n - l.u, 0)::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
        coalesce(l.n, 0)::BIGINT AS n_word_lines,
        (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper
    FROM w LEFT JOIN covered ON covered.rid = w.rid LEFT JOIN l ON l.rid = w.rid
), f AS (
    SELECT *, ({bits})::BIGINT AS failed FROM m
)
"""
_BITS_SQL = " + ".join(f"CASE WHEN {cond} THEN {BIT[name]} ELSE 0 END" for name, cond in RULES)


def ledger_sql(docs: str) -> str:
    return LEDGER_SQL.replace("{docs}", docs).replace("{bits}", _BITS_SQL)


SQL = ledger_sql("documents") + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (failed & {BASE}) <> 0 AS base_failed, (failed & {POLICIES[PRODUCTION]}) = 0 AS kept, failed
FROM f
"""
