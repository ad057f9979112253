"""Stupid-backoff language-model scores over the n-gram counts of a corpus.

Texts are exploded into n-grams of hashed words, which are dealt into slices of
the hash space and shuffled by slice; in a slice the rows (h, uid, w) are
sorted by hash, the corpus count of each hash is summed and joined to all rows
of that hash, and what the rows add to their documents' scores is summed per
document. The count table and its join are one window over (h, slice): both
sides are dealt and sorted alike, so neither is moved a second time. One row
stands for places of a document that need the same n-gram; w holds how often it
occurs there, ends a word's scored context, and is the context of a scored
word. Between map and slice, rows travel as one row of arrays per slice and
block, sorted by hash, which leaves little but the hash to send and sorted runs
to merge.

S(w | context) = c(context w) / c(context) where c(context w) is at least
min_count, else ALPHA * S(w | shorter context); a word alone scores its share
of all words, or ALPHA of a single word's share if the corpus lacks it. N-grams
and documents (id and text) are known by 64-bit hashes; words are in lower case
(A-Z).

Where the corpus is the scored texts themselves and min_count is 1, every
n-gram that is asked for is met, so nothing backs off and rounds need not wait
for one another. Otherwise orders follow each other from the longest down, and
a document carries the n-grams that were not met into the next round.

Slices hold about SLICE_ENTRIES rows at any corpus size. An n-gram that a
sample of the documents shows to be in more than one document of HOT_SHARE is
counted by a plain aggregation with partial sums instead, and its count (at
most HOT_LIMIT of them) sent to the map side, so a frequent n-gram gathers in
no task; the sample steers only where an n-gram is counted. Texts are read in
stretches of about BLOCK_TOKENS words.

Defined results: a null or empty text has no words, sum 0 and a null mean;
repeated rows are scored each and count each; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import Scratch

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 1
BLOCK_TOKENS = 300_000
SLICE_ENTRIES = 3_000_000
HOT_SHARE = 256
HOT_LIMIT = 1 << 16
#: One document in so many is looked at for frequent n-grams.
HOT_SAMPLE = 64
#: Bytes of text that a word takes, for the number of slices and the size of blocks only.
_WORD_BYTES = 6
_BLOCK_ROWS = 30_000
_PIECE = 1 << 16
#: Rows that only count, for no document.
_NOBODY = -1
_SIGN = np.uint64(1 << 63)
#: w: times it occurs, times it is tried, times it is a context.
_FIELD = 21
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiply-xorshift generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in UTF-8 bytes, and where each begins."""
    hashes, begins, at = [], [], 0
    while at < len(data):
        # In pieces that stay in the processor's cache, cut before white space.
        to = at + _PIECE
        while to < len(data) and not _WHITE[data[to]]:
            to += 1
        piece = data[at:to]
        solid = ~_WHITE[piece]
        edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(begin):
            # A polynomial in the place within the word: the sum over a word is a difference of running sums.
            size = end - begin
            place = np.flatnonzero(solid) - np.repeat(begin, size)
            power = np.cumprod(np.full(int(size.max()), 0xD6E8FEB86659FD93, dtype=np.uint64))
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[piece[solid]] * power[place])))
            ends = np.cumsum(size)
            hashes.append(_mix(sums[ends] - sums[ends - size]))
            begins.append(begin + at)
        at = to
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(begins)


def ngram_hashes(tokens: np.ndarray, inner: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order, the hash of the n-gram that ends at each token (0 where its row has too few words before it).

    inner: each token's place in its row.
    """
    out = [_mix(tokens + np.uint64(0x9E3779B97F4A7C15))]
    for n in range(2, order + 1):
        prior = np.zeros_like(tokens)
        prior[1:] = out[-1][:-1]
        h = _mix((prior * np.uint64(0xD6E8FEB86659FD93) + tokens) ^ np.uint64(n))
        h[inner < n - 1] = 0
        out.append(h)
    return out


class _Block:
    """Rows of words: a text, or a stretch of one after ``lead`` words of context."""

    def __init__(self, uid: np.ndarray, begins: np.ndarray, lead: int, sizes: np.ndarray, tokens: np.ndarray, unmet: list, order: int):
        self.uid, self.begins, self.unmet = uid, begins, unmet
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.inner = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.own = self.inner >= lead
        self.first = begins[self.row]
        self.hashes = ngram_hashes(tokens, self.inner, order)

    def asked(self, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per order whether the n-gram is tried for the word it ends at, and whether it is the context of one met.

        unmet has per row the hashes of the n-grams tried before that were not met.
        """
        n = [0 if x is None else len(x) for x in self.unmet]
        pairs = None
        if sum(n):
            flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in self.unmet if x is not None]).view(np.uint64)
            pairs = np.sort(_mix(flat ^ _mix(np.repeat(np.arange(len(n)), n).astype(np.uint64))))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        context = np.zeros(len(self.own), dtype=bool)
        tried = self.own & (self.inner >= order - 1)
        for k in range(order, 0, -1):
            out.append((tried, context))
            missed = np.zeros(len(tried), dtype=bool)
            if pairs is not None:
                key = _mix(self.hashes[k - 1] ^ _mix(self.row.astype(np.uint64)))
                at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                missed = tried & (pairs[at] == key)
            met = tried & ~missed
            context = np.zeros(len(tried), dtype=bool)
            context[:-1] = met[1:] & (self.inner[1:] > 0)
            tried = missed | (self.own & self.first & (self.inner == k - 2))
        return out[::-1]


def _blocks(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[_Block]:
    """Blocks of the texts in columns uid, text and, where there is one, unmet."""
    limit = BLOCK_TOKENS * _WORD_BYTES
    uids: list[int] = []
    unmet: list = []
    texts: list[bytes] = []

    def block() -> _Block:
        tokens, begin = word_hashes(np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8))
        ends = np.cumsum([len(t) + 1 for t in texts])
        sizes = np.diff(np.searchsorted(begin, ends), prepend=0)
        return _Block(np.array(uids, dtype=np.int64), np.ones(len(uids), dtype=bool), 0, sizes, tokens, list(unmet), order)

    def stretches(uid: int, text: bytes, missing: list | None) -> Iterator[_Block]:
        before, at = np.zeros(0, dtype=np.uint64), 0
        while at < len(text):
            to = at + limit
            # Never within a word.
            while to < len(text) and not _WHITE[text[to]]:
                to += 1
            own, _ = word_hashes(np.frombuffer(text, dtype=np.uint8, offset=at, count=min(to, len(text)) - at))
            lead, tokens = len(before), np.concatenate((before, own))
            yield _Block(np.array([uid]), np.array([at == 0]), lead, np.array([len(tokens)]), tokens, [missing], order)
            before, at = tokens[max(0, len(tokens) - order + 1) :], to

    size = 0
    for batch in batches:
        column = batch.column(1).cast(pa.large_binary())
        for i, uid in enumerate(batch.column(0).to_pylist()):
            text = column[i].as_py() or b""
            missing = batch.column(2)[i].as_py() if batch.num_columns > 2 else None
            if len(text) > limit:
                yield from stretches(uid, text, missing)
                continue
            uids.append(uid)
            texts.append(text)
            unmet.append(missing)
            size += len(text)
            if size >= limit or len(uids) >= _BLOCK_ROWS:
                yield block()
                uids, texts, unmet, size = [], [], [], 0
    if uids:
        yield block()


_ENTRIES = "p int, uids array<long>, who array<short>, h array<long>, w array<long>, v array<double>, words array<long>, ones array<long>"


def _lists(ends: np.ndarray, *values: np.ndarray) -> list[pa.ListArray]:
    return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in values]


def _explode(texts: DataFrame, orders: Sequence[int], order: int, slices: int, counts: bool, asks: bool, sure: bool, hot: dict[str, np.ndarray]) -> DataFrame:
    """_ENTRIES: the n-grams of a block, a row per slice, and a row for its texts. counts: they count; asks: their documents ask; sure: whatever is asked for is met.

    hot: sorted hashes ``h`` and counts ``c`` of n-grams that are not to travel.
    The row of a block's texts has in v what those add, in words how many words
    a text has, in ones how many are tried alone, and in w whether it begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["p", "uids", "who", "h", "w", "v", "words", "ones"]
        serial = 0
        for block in _blocks(batches, order):
            rows = len(block.uid)
            needs = block.asked(order) if asks else None
            none = np.zeros(len(block.row), dtype=bool)
            hs, whos, ws = [], [], []
            v = np.zeros(rows)
            for k in orders:
                h = block.hashes[k - 1]
                tried, context = needs[k - 1] if needs else (none, none)
                if sure:
                    # What is tried and is a context adds nothing, so nobody asks for it.
                    tried, context = tried & ~context, context & ~tried
                one = block.own & (block.inner >= k - 1) if counts else none
                some = np.flatnonzero(one | tried | context)
                h, one, tried, context = h[some], one[some], tried[some], context[some]
                who = np.where(tried | context, block.row[some] + 1, 0)
                if len(hot["h"]):
                    at = np.minimum(np.searchsorted(hot["h"], h), len(hot["h"]) - 1)
                    is_hot = hot["h"][at] == h
                    use = np.flatnonzero(is_hot & (who > 0))
                    v += np.bincount(who[use] - 1, weights=(tried[use].astype(float) - context[use]) * np.log(hot["c"][at[use]]), minlength=rows)
                    h, one, tried, context, who = (x[~is_hot] for x in (h, one, tried, context, who))
                hs.append(h)
                whos.append(who)
                ws.append(one.astype(np.int64) << 2 * _FIELD | tried.astype(np.int64) << _FIELD | context)
            if asks:
                words = np.bincount(block.row[block.own], minlength=rows) if order in orders else np.zeros(rows, dtype=np.int64)
                ones = np.bincount(block.row[needs[0][0]], minlength=rows) if 1 in orders else np.zeros(rows, dtype=np.int64)
                every = np.array([0, rows])
                begins = block.begins.astype(np.int64) if order in orders else np.zeros(rows, dtype=np.int64)
                own = _lists(every, block.uid, np.arange(rows, dtype=np.int16), block.uid, begins, v, words, ones)
                serial += 1
                yield pa.RecordBatch.from_arrays([pa.array([serial % slices], pa.int32()), *own], names=names)
            h, who, w = (np.concatenate(x) for x in (hs, whos, ws))
            if not len(h):
                continue
            # In the order of signed numbers, which is also that of the slices.
            h = h ^ _SIGN
            sort = np.argsort(h)
            h, who, w = h[sort], who[sort], w[sort]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (who[1:] != who[:-1]))))
            h, who, w = h[first], who[first], np.add.reduceat(w, first)
            p = (((h >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            # The documents of each slice's row, and each entry's place among them.
            pairs, at = np.unique(p * (rows + 1) + who, return_inverse=True)
            of = pairs // (rows + 1)
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            uids = np.concatenate(([_NOBODY], block.uid))[pairs % (rows + 1)]
            ends = np.concatenate((edges, [len(p)]))
            at = at - np.repeat(starts, np.diff(ends))
            empty = np.zeros(len(ends), dtype=np.int64)
            columns = [
                *_lists(np.concatenate((starts, [len(pairs)])), uids),
                *_lists(ends, at.astype(np.int16), (h ^ _SIGN).view(np.int64), w),
                *_lists(empty, np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(p[edges].astype(np.int32)), *columns], names=names)

    return texts.mapInArrow(run, _ENTRIES)


def _counted(entries: DataFrame, slices: int) -> DataFrame:
    """The exploded rows (h, uid, w, v, words, ones) with c, the corpus count of their n-gram; rows of _NOBODY have counted and are gone."""
    packed = entries.repartitionById(slices, F.col("p"))
    rows = packed.select("p", "uids", "who", "w", "v", "words", "ones", F.posexplode("h").alias("i", "h"))
    at = F.col("i")
    rows = rows.select(
        "p", "h", F.get(F.col("uids"), F.get(F.col("who"), at).cast("int")).alias("uid"), F.get(F.col("w"), at).alias("w"),
        *[F.get(F.col(c), at).alias(c) for c in ("v", "words", "ones")],
    )
    # A text's own row has words and is no n-gram.
    n = F.when(F.col("words").isNull(), F.shiftright("w", 2 * _FIELD)).otherwise(F.lit(0))
    rows = rows.withColumn("n", n).selectExpr("*", "sum(n) OVER (PARTITION BY h, p) AS c")
    return rows.filter(F.col("uid") != _NOBODY)


def _sampled(sample: int) -> Column:
    return F.pmod("uid", F.lit(sample)) == 0


def _frequent(texts: DataFrame, orders: Sequence[int], order: int, sample: int, docs: int) -> np.ndarray:
    """Hashes of n-grams in more than one of HOT_SHARE of the sampled documents, of which there are docs; at most HOT_LIMIT."""
    if docs < HOT_SHARE:
        return np.zeros(0, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, order):
            found = []
            for k in orders:
                held = block.inner >= k - 1
                pair = np.unique(np.stack((block.row[held].astype(np.uint64), block.hashes[k - 1][held])), axis=1)
                found.append(pair[1])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    met = texts.filter(_sampled(sample)).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = met.filter(F.col("n") * HOT_SHARE > docs).orderBy(F.desc("n"), "h").limit(HOT_LIMIT).collect()
    return np.sort(np.array([r.h for r in top], dtype=np.int64).view(np.uint64))


def _frequent_counts(texts: DataFrame, orders: Sequence[int], order: int, frequent: np.ndarray, min_count: int) -> dict[str, np.ndarray]:
    """``h`` and ``c`` of those of the frequent n-grams that occur min_count times; a partial count per block, at most HOT_LIMIT rows in all."""
    if not len(frequent):
        return {"h": frequent, "c": np.zeros(0)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, order):
            h = np.concatenate([block.hashes[k - 1][block.own & (block.inner >= k - 1)] for k in orders])
            at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
            n = np.bincount(at[frequent[at] == h], minlength=len(frequent))
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(frequent[met].view(np.int64)), pa.array(n[met].astype(np.int64))], names=["h", "n"])

    counts = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count).collect()
    h = np.array([r.h for r in counts], dtype=np.int64).view(np.uint64)
    sort = np.argsort(h)
    return {"h": h[sort], "c": np.array([r.n for r in counts], dtype=float)[sort]}


def score(docs: DataFrame, order: int = ORDER, corpus: DataFrame | None = None, alpha: float = ALPHA, min_count: int | None = None, hot_sample: int | None = None) -> DataFrame:
    """doc_id, n_words, log_sum, log_mean (per word) and n_once of every row of docs (doc_id, text).

    corpus (doc_id, text) has the counts, docs itself by default. n_once counts
    the words whose n-gram of full order the corpus has at most once.
    """
    min_count = MIN_COUNT if min_count is None else min_count
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    key = F.xxhash64("doc_id", "text").alias("uid")
    texts = docs.select(key, "text")
    counted = texts if corpus is None else corpus.select(key, "text")
    sample = hot_sample or HOT_SAMPLE
    sizes = [x.agg(F.sum(F.octet_length("text")), F.count_if(_sampled(sample))).first() for x in ([texts] if corpus is None else [texts, counted])]
    asked = sum(int(n or 0) for n, _ in sizes) // _WORD_BYTES
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-asked // SLICE_ENTRIES))
    sure = corpus is None and min_count <= 1
    # Every order at once would be right too where all is met; apart, the shuffles are not there at one time.
    rounds = [r for r in ([order], list(range(order - 1, 0, -1))) if r] if sure else [[n] for n in range(order, 0, -1)]
    state = texts
    sums: list[DataFrame] = []
    orders = list(range(1, order + 1))
    hot = _frequent_counts(counted, orders, order, _frequent(counted, orders, order, sample, sizes[-1][1]), max(min_count, 2))
    for orders in rounds:
        entries = _explode(state, orders, order, slices, corpus is None, True, sure, hot)
        if corpus is not None:
            entries = entries.unionAll(_explode(counted, orders, order, slices, True, False, False, hot))
        rows = _counted(entries, slices)
        mask = (1 << _FIELD) - 1
        gram = F.col("words").isNull()
        tried = F.when(gram, F.shiftright("w", _FIELD).bitwiseAND(F.lit(mask))).otherwise(0)
        context = F.when(gram, F.col("w").bitwiseAND(F.lit(mask))).otherwise(0)
        log = F.log(F.greatest(F.col("c").cast("double"), F.lit(alpha if orders == [1] else 1.0)))
        missed = F.lit(False) if sure or orders == [1] else (tried > 0) & (F.col("c") < min_count)
        adds = F.when(missed, tried * math.log(alpha) - context * log).otherwise((tried - context) * log) + F.coalesce("v", F.lit(0.0))
        once = F.when(F.col("c") <= 1, tried).otherwise(0) if orders[0] == order else F.lit(0)
        found = [
            F.sum(adds).alias("log_sum"), F.sum(once).cast("long").alias("n_once"), F.sum(F.coalesce("words", F.lit(0))).alias("n_words"),
            F.sum(F.coalesce("ones", F.lit(0))).alias("ones"), F.sum(F.when(gram, 0).otherwise(F.col("w"))).cast("long").alias("copies"),
        ]
        if not sure:
            found.append(F.collect_list(F.when(missed, F.col("h"))).alias("unmet"))
        sums.append(scratch.write(rows.groupBy("uid").agg(*found), f"sums{orders[0]}"))
        if not sure and orders != [1]:
            unmet = sums[0].select("uid", "unmet")
            for more in sums[1:]:
                unmet = unmet.unionAll(more.select("uid", "unmet"))
            unmet = unmet.filter(F.size("unmet") > 0).groupBy("uid").agg(F.flatten(F.collect_list("unmet")).alias("unmet"))
            state = texts.join(unmet, "uid", "left").select("uid", "text", F.coalesce("unmet", F.array().cast("array<long>")).alias("unmet"))
    total = int(sums[0].agg(F.sum("n_words")).first()[0] or 0)
    if corpus is not None:
        total = _words(counted, order)
    every = sums[0].drop("unmet")
    for s in sums[1:]:
        every = every.unionAll(s.drop("unmet"))
    every = every.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("log_sum", "n_once", "n_words", "ones", "copies")])
    # Rows that agree in id and text are one document here: each gets its share.
    share = lambda c: (F.col(c) / F.col("copies")).cast("long").alias(c)
    log_sum = ((F.col("log_sum") - F.col("ones") * math.log(max(total, 1))) / F.col("copies")).alias("log_sum")
    scores = every.select("uid", share("n_words"), log_sum, share("n_once"))
    out = docs.select(key, "doc_id").join(scores, "uid")
    return out.select("doc_id", "n_words", "log_sum", F.when(F.col("n_words") > 0, F.col("log_sum") / F.col("n_words")).alias("log_mean"), "n_once")


def _words(texts: DataFrame, order: int) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(int(b.own.sum()) for b in _blocks(batches, order))], pa.int64())], names=["n"])

    return int(texts.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)


def query(docs: DataFrame) -> DataFrame:
    out = score(docs)
    return out.select("doc_id", "n_words", F.round("log_sum", 6).alias("log_sum"), F.round("log_mean", 9).alias("log_mean"), "n_once")
