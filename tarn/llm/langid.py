"""Language identification by word-first backoff.

A model holds, per language, log frequencies of known words and of character
n-grams of one to five characters. A word that is known scores by its own
frequency; one that is not backs off to the longest n-grams of it that are
known. A text's score for a language is the sum over its words.

The model is learned from labelled rows, at most about SAMPLE_DOCS of them:
those whose id hash falls below the matching share of all labelled rows. It
keeps MAX_ENTRIES entries over all languages, so its size, and what is sent
to the executors, has a fixed bound.

Defined results: a null text, or one without a letter, is ``und`` with score
0; with nothing to learn from every text is ``und``; repeated rows get the
same language; ties go to the language first by name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import map_rows

UNKNOWN = "und"
SAMPLE_DOCS = 20_000
MAX_ENTRIES = 400_000
MIN_COUNT = 3
BROADCAST_LANGS = 10_000
ORDERS = (5, 4, 3, 2, 1)
# Log-odds that a backed-off word loses against a known one at each shorter order.
BACKOFF = 0.7
SMOOTHING = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 100_000

OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    """n-grams of the word between its boundary marks; the marks are in those of two and more."""
    w = word if order == 1 else f"<{word}>"
    return [w[i : i + order] for i in range(len(w) - order + 1)]


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    words: dict[str, np.ndarray]
    grams: dict[int, dict[str, np.ndarray]]

    def word_scores(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        for order in ORDERS:
            table = self.grams.get(order, {})
            found = [table[g] for g in grams_of(word, order) if g in table]
            if found:
                total = found[0].copy()
                for row in found[1:]:
                    total += row
                return total / len(found) * BACKOFF ** (ORDERS[0] + 1 - order)
        return np.zeros(len(self.langs))

    def predict(self, texts: list[str | None], cache: _Scores) -> list[tuple[str, float]]:
        """Language and score of each text: the words of all texts are looked up once, and their scores summed per text."""
        words = [words_of(t) if t and self.langs else [] for t in texts]
        sizes = np.array([len(w) for w in words])
        total = np.tile(self.prior, (len(texts), 1))
        held = np.flatnonzero(sizes)
        if len(held):
            if len(cache) > _CACHE:
                cache.reset()
            ids = np.fromiter((cache[w] for own in words for w in own), dtype=np.int64, count=int(sizes.sum()))
            total[held] += np.add.reduceat(cache.table[ids], (np.cumsum(sizes) - sizes)[held], axis=0)
        out = []
        for text, own, row in zip(texts, words, total):
            if not text or not self.langs or not (own or any(c.isalpha() for c in text)):
                out.append((UNKNOWN, 0.0))
                continue
            best = int(np.argmax(row))
            # Spread over the words, so that the score tells a clear text from a doubtful one.
            share = np.exp((row - row[best]) / math.sqrt(max(1, len(own))))
            out.append((self.langs[best], float(1.0 / share.sum())))
        return out


class _Scores(dict):
    """word -> its row in ``table``, the scores of the words met; emptied between batches when it is full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.table = np.zeros((1024, len(self.model.langs)))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[at] = self.model.word_scores(word)
        self[word] = at
        return at


def _count_words(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n), with a partial count per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w, n in Counter(words_of(text)).items():
                    counts[(lang, w)] += n
                if len(counts) > 500_000:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    counted = labelled.select(F.col(text_col), F.col(lang_col)).mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _explode_grams(counts: DataFrame) -> DataFrame:
    """(lang, order, gram, n) of the counted words; order 0 is the word itself."""
    word = F.concat(F.lit("<"), F.col("word"), F.lit(">"))

    def of(order: int):
        w = F.col("word") if order == 1 else word
        n = F.char_length(w) - (order - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.lit(order).alias("order"), F.substr(w, i, F.lit(order)).alias("gram"))))

    every = F.flatten(F.array_compact(F.array(F.array(F.struct(F.lit(0).alias("order"), F.col("word").alias("gram"))), *[of(o) for o in ORDERS])))
    return counts.select("lang", "n", F.explode(every).alias("g")).groupBy("lang", "g.order", "g.gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, max_entries: int = MAX_ENTRIES) -> Model:
    """Learn from rows that have a text and a language."""
    usable = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).withColumn("h", F.xxhash64(F.lit("langid"), F.col(id_col)))
    # Each language gives up to an equal share of the sample, so that rare ones are learned as well.
    sizes = usable.groupBy(lang_col).agg(F.count(F.lit(1)).alias("__n"))
    n_langs = sizes.count()
    if not n_langs:
        return Model([], np.zeros(0), {}, {})
    limits = sizes.select(F.col(lang_col).alias("__lang"), F.least(F.lit(1.0), F.lit(sample_docs / n_langs) / F.col("__n")).alias("__limit"))
    # A few bytes a language: broadcast up to a checked number of them, so that texts stay where they are.
    limits = F.broadcast(limits) if n_langs <= BROADCAST_LANGS else limits
    picked = usable.join(limits, F.col(lang_col) == F.col("__lang")).filter((F.col("h") / 2.0**64 + 0.5) <= F.col("__limit"))
    counts = _explode_grams(_count_words(picked, text_col, lang_col)).cache()
    totals = {(r["lang"], r["order"]): (r["n"], r["types"]) for r in counts.groupBy("lang", "order").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()}
    docs = {lang for lang, _ in totals}
    if not docs:
        counts.unpersist()
        return Model([], np.zeros(0), {}, {})
    per_table = max(100, max_entries // (len(docs) * (len(ORDERS) + 1)))
    top = Window.partitionBy("lang", "order").orderBy(F.desc("n"), "gram")
    kept = counts.filter(F.col("n") >= MIN_COUNT).withColumn("r", F.row_number().over(top)).filter(F.col("r") <= per_table).select("lang", "order", "gram", "n").collect()
    counts.unpersist()
    langs = sorted(docs)
    at = {k: i for i, k in enumerate(langs)}
    tables: dict[int, dict[str, np.ndarray]] = {o: {} for o in (0, *ORDERS)}
    base = {o: np.array([math.log(SMOOTHING / (totals.get((k, o), (0, 0))[0] + SMOOTHING * (totals.get((k, o), (0, 0))[1] + 1))) for k in langs]) for o in tables}
    for r in kept:
        row = tables[r["order"]].get(r["gram"])
        if row is None:
            row = tables[r["order"]][r["gram"]] = base[r["order"]].copy()
        n, types = totals[(r["lang"], r["order"])]
        row[at[r["lang"]]] = math.log((r["n"] + SMOOTHING) / (n + SMOOTHING * (types + 1)))
    return Model(langs, np.zeros(len(langs)), tables.pop(0), tables)


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_ENTRIES entries
    cache: list[_Scores] = []

    def batch(texts: list) -> dict[str, list]:
        if not cache:
            cache.append(_Scores(shared.value))
        got = shared.value.predict(texts, cache[0])
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return map_rows(docs, text_col, OUT, batch, carry, as_bytes=False)


def query(docs: DataFrame) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    fold = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(fold.filter(~F.col("held_out")).select("doc_id", "text", "lang"))
    return identify(fold.select("doc_id", "held_out", "text"), model, carry=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
