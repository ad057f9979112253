"""Removal of long repeated byte strings, by difference-cover suffix comparison in buckets.

Every byte covered by a string of LENGTH bytes that also starts elsewhere, in
any document or the same one, is removed.

1. Buckets. A suffix's bucket is the least-hashed GRAM-byte string among the
   LENGTH - GRAM + 1 that its first LENGTH bytes hold. Equal strings fall into
   the same bucket at the same offset, so suffixes of different buckets need
   no comparison, and suffixes of one document that share a bucket gram form
   one run with one context (the bytes that the run's strings cover). Only the
   bucket, a 128-bit hash of the context and the run's place are shuffled.
2. Buckets met once hold nothing repeated. Runs with equal contexts are
   repeated as a whole. What is left, the contexts at the ends of repeated
   passages, is fetched once per distinct context.
3. Blocks of whole buckets are compared by ranks, one block at a time, which
   bounds memory: ranks of 16-byte strings for every place, and by prefix
   doubling ranks of 384-byte strings for the places of a difference cover
   modulo 16. Two suffixes tie on LENGTH bytes if their first and last 16
   bytes agree and, at the shift at which the cover holds both, their
   384-byte cover ranks do.
4. A bucket with more distinct contexts than one block takes is compared by
   128-bit hashes of all its strings in a distributed aggregation instead.

Passages of WORDS words that also start elsewhere may be shorter than LENGTH
bytes. They are found by the same steps with words as the units, whatever
whitespace is between them, and are reported, not removed. Words are known by
64-bit hashes; blocks are ranked by prefix doubling at every word. Runs of both
kinds go through the same tables: the lowest bit of a bucket is 1 for words.

A run's row stands for all runs of its document with that context, and keys
with over HOT_ROWS rows are joined by broadcasting them, so neither a periodic
text nor a passage of very many documents makes one task long.

Defined results: a null text is empty; texts under LENGTH bytes take no part;
repeated rows are repeats of each other; an empty table gives an empty result;
a null doc_id is an id like any other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import Scratch, null_safe

LENGTH = 400
GRAM = 64
#: Words of a passage, and of the gram that chooses its bucket.
WORDS = 50
WORD_GRAM = 8
COVER_MOD = 16
#: Every residue modulo 16 is a difference of two of these.
COVER = (0, 1, 2, 5, 8)
#: Distinct contexts of one bucket that are compared in one block.
GROUP_CONTEXTS = 4096
BLOCK_BYTES = 2 << 20
#: Rows of one key from which on a join broadcasts it.
HOT_ROWS = 4096
#: Suffixes hashed at once; only bounds memory for very long texts.
STRETCH = 1 << 20
_POS_BITS = np.uint64(21)
_POS_MASK = np.uint64((1 << 21) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiply-xorshift generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15))


def _power_hashes(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``length``-byte string; length is a sum of powers of two."""
    return _fold(_BYTE[data] if not seed else _mix(_BYTE[data] + np.uint64(seed)), length)


def _fold(level: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every ``length`` consecutive hashes of units."""
    count = len(level)
    size, total, done = 1, None, 0
    while True:
        if length & size:
            part = level[done:] if done else level
            if total is None:
                total = part
            else:
                n = min(len(total), len(part))
                total = total[:n] * np.uint64(0xD6E8FEB86659FD93) + part[:n]
            done += size
        if size * 2 > length:
            break
        level = level[:-size] * np.uint64((0x9E3779B97F4A7C15 * (2 * size + 1)) & (2**64 - 1)) + level[size:]
        size *= 2
    return _mix(total[: count - length + 1])


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(v) - width + 1
    pad = -len(v) % width
    blocks = np.concatenate((v, np.full(pad, np.iinfo(v.dtype).max, v.dtype))).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def bucket_runs(texts: list[bytes | None], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of suffixes by bucket: text, start, count, bytes of the context, bucket, context hash (two longs)."""
    parts = []
    for i, text in enumerate(texts):
        if text is not None and len(text) >= length:
            raw = np.frombuffer(text, dtype=np.uint8)
            parts.append((np.full(1, i), *_unit_runs(raw, np.array([len(raw)]), _power_hashes, length, gram)[1:]))
    if not parts:
        return (np.zeros(0, dtype=np.int64),) * 7
    owner = np.repeat(np.concatenate([p[0] for p in parts]), [len(p[1]) for p in parts])
    starts, counts, buckets, c1, c2 = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
    return owner, starts, counts, counts + length - 1, buckets & ~1, c1, c2


def word_runs(texts: list[bytes | None], length: int = WORDS, gram: int = WORD_GRAM) -> tuple[np.ndarray, ...]:
    """As bucket_runs, for strings of ``length`` words; start is the first word's place in bytes, count is in words."""
    parts = [[np.zeros(0, dtype=np.int64)] * 7]
    first = 0
    while first < len(texts):
        # Texts of a quarter of STRETCH bytes at once, which stay in the cache; a longer text is alone.
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or b"") <= STRETCH // 4):
            size += len(texts[last] or b"")
            last += 1
        begins, ends, ids, sizes, offsets = words_of_each([t or b"" for t in texts[first:last]])
        owner, starts, counts, buckets, c1, c2 = _unit_runs(ids, sizes, _fold, length, gram)
        if len(owner):
            begin = begins[starts]
            parts.append([owner + first, begin - offsets[owner], counts, ends[starts + counts + length - 2] - begin, buckets | 1, c1, c2])
        first = last
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(7))


def _unit_runs(units: np.ndarray, sizes: np.ndarray, hashed: Callable[[np.ndarray, int], np.ndarray], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes by bucket in texts of these sizes, one after the other: text, start among all units, count, bucket, context hash (two longs)."""
    owners, starts, counts, buckets, digests = [], [], [], [], []
    data = units.tobytes()
    z = units.itemsize
    width = length - gram + 1
    owner = np.repeat(np.arange(len(sizes)), sizes) if len(sizes) > 1 else None
    for at in range(0, len(units) - length + 1, STRETCH):
        n = min(STRETCH, len(units) - length + 1 - at)
        hashes = hashed(units[at : at + n + length - 1], gram)
        # Equal hashes: the last wins, by a rule that does not look beyond the string.
        packed = (hashes & ~_POS_MASK) | (_POS_MASK - np.arange(len(hashes), dtype=np.uint64))
        gram_at = (_POS_MASK - (_sliding_min(packed, width) & _POS_MASK)).astype(np.int64)
        new = np.concatenate(([True], gram_at[1:] != gram_at[:-1]))
        if owner is not None:
            # A string that reaches into the next text is none.
            whole = owner[at : at + n] == owner[at + length - 1 : at + n + length - 1]
            new |= np.concatenate(([True], whole[1:] != whole[:-1]))
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate((first, [n])))
        if owner is not None:
            held = whole[first]
            first, count = first[held], count[held]
            owners.append(owner[first + at])
        else:
            owners.append(np.zeros(len(first), dtype=np.int64))
        place = gram_at[first]
        starts.append(first + at)
        counts.append(count)
        buckets.append(hashes[place].view(np.int64))
        digest = xxhash.xxh3_128_digest
        digests.append(b"".join(digest(data[(at + s) * z : (at + s + c + length - 1) * z], o) for s, c, o in zip(first.tolist(), count.tolist(), (place - first).tolist())))
    if not starts:
        return (np.zeros(0, dtype=np.int64),) * 6
    both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    return np.concatenate(owners), np.concatenate(starts), np.concatenate(counts), np.concatenate(buckets), both[:, 0], both[:, 1]


#: Longer words are hashed one by one.
_LONG_WORD = 64
#: Keeps the first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between whitespace (space, \\x09-\\x0D): begin, end, 64-bit hash."""
    raw = np.frombuffer(data + bytes(8), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = (raw[:-8] != 0x20) & (raw[:-8] - np.uint8(0x09) > 0x0D - 0x09)
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    begins, ends = edges[:, 0].copy(), edges[:, 1].copy()
    sizes = ends - begins
    ids = _mix(sizes.astype(np.uint64))
    eights = np.lib.stride_tricks.sliding_window_view(raw, 8)
    for first in range(0, len(ids), STRETCH):
        held = np.arange(first, min(first + STRETCH, len(ids)))
        for at in range(0, _LONG_WORD, 8):
            held = held[sizes[held] > at]
            eight = eights[begins[held] + at].view("<u8")[:, 0] & _FIRST[np.minimum(sizes[held] - at, 8)]
            ids[held] = _mix(ids[held] ^ eight)
    for i in np.flatnonzero(sizes > _LONG_WORD).tolist():
        ids[i] = xxhash.xxh3_64_intdigest(data[begins[i] : ends[i]])
    return begins, ends, ids


def words_of_each(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """words_of the texts joined, the number of words of each, and where each begins."""
    begins, ends, ids = words_of(b"\n".join(texts))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return begins, ends, ids, np.diff(np.searchsorted(begins, offsets)), offsets[:-1]


def _rank(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(-1)


def repeated_suffixes(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its suffixes of at least ``length`` bytes tie on ``length`` bytes with any other here.

    length must be 16 + 384 for the cover ranks to fit; see the module text.
    """
    assert length == LENGTH == COVER_MOD + 384
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    text = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    m = len(text)
    padded = np.concatenate((text, np.zeros(2 * LENGTH, dtype=np.uint8)))
    # Ranks of 8, then 16 bytes, at every place.
    eight = np.zeros(m + LENGTH, dtype=np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | padded[j : j + m + LENGTH]
    r8 = _rank(eight)
    top = np.int64(len(eight) + 1)
    r16 = _rank(r8[:-8] * top + r8[8:])
    # Cover ranks: a row per residue of the cover, a column per block of 16; 32, 64, 128, 256 and 384 bytes.
    columns = (m + COVER_MOD - 1) // COVER_MOD
    reach = columns + 384 // COVER_MOD + 1
    grid = np.zeros((len(COVER), reach), dtype=np.int64)
    for row, d in enumerate(COVER):
        own = r16[d::COVER_MOD][:reach]
        grid[row, : len(own)] = own + 1

    def double(a: np.ndarray, b: np.ndarray, blocks: int) -> np.ndarray:
        moved = np.zeros_like(b)
        moved[:, :-blocks] = b[:, blocks:]
        return _rank((a * (top + 1) + moved).ravel()).reshape(a.shape) + 1

    r32 = double(grid, grid, 1)
    r64 = double(r32, r32, 2)
    r128 = double(r64, r64, 4)
    r256 = double(r128, r128, 8)
    r384 = double(r256, r128, 16)
    often = np.bincount(r384.ravel()) > 1
    row_of = np.full(COVER_MOD, -1)
    row_of[list(COVER)] = np.arange(len(COVER))

    counts = np.maximum(sizes - length + 1, 0)
    which = np.repeat(np.arange(len(contexts)), counts)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = begins[which] + inner
    ends = _rank(r16[place] * top + r16[place + length - COVER_MOD])
    found = np.zeros(len(place), dtype=bool)
    for shift in range(COVER_MOD):
        at = place + shift
        row = row_of[at % COVER_MOD]
        held = np.flatnonzero(row >= 0)
        rank = r384[row[held], at[held] // COVER_MOD]
        tied = often[rank]
        held, rank = held[tied], rank[tied]
        if len(held):
            _, back, n = np.unique(ends[held] * np.int64(r384.size + 2) + rank, return_inverse=True, return_counts=True)
            found[held[n[back.reshape(-1)] > 1]] = True
    return np.split(found, np.cumsum(counts)[:-1])


def repeated_words(ids: np.ndarray, sizes: np.ndarray, length: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lists of words of these sizes, one after the other: their numbers of strings of ``length`` words, the places of these, and which equal any other."""
    counts = np.maximum(sizes - length + 1, 0)
    place = np.repeat(np.cumsum(sizes) - sizes, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    found = np.zeros(len(place), dtype=bool)
    if len(place):
        rank, size = _rank(ids), 1
        top = np.int64(len(rank) + 1)
        while size * 2 <= length:
            rank, size = _rank(rank[:-size] * top + rank[size:]), size * 2
        _, back, n = np.unique(rank[place] * top + rank[place + length - size], return_inverse=True, return_counts=True)
        found = n[back.reshape(-1)] > 1
    return counts, place, found


def _spans_of(flags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, first and last index of each run of true values in lists with these counts, one after the other."""
    owner = np.repeat(np.arange(len(counts)), counts)
    apart = np.concatenate(([True], owner[1:] != owner[:-1], [True]))
    before, after = np.concatenate(([False], flags[:-1])), np.concatenate((flags[1:], [False]))
    first = np.flatnonzero(flags & (~before | apart[:-1][: len(flags)]))
    last = np.flatnonzero(flags & (~after | apart[1:][: len(flags)]))
    return owner[first], first, last


_RUN = [T.StructField("at", T.ArrayType(T.LongType())), *[T.StructField(c, T.LongType()) for c in ("n", "z", "bucket", "c1", "c2")]]


def _runs(docs: DataFrame, kinds: list[Callable[[list], tuple[np.ndarray, ...]]]) -> DataFrame:
    """(doc_id, th, at, n, z, bucket, c1, c2) for the suffix runs of docs (doc_id, th, text).

    at lists where the document's runs with that context start, n is their
    number of suffixes, z their context's bytes.
    """
    schema = T.StructType([docs.schema["doc_id"], docs.schema["th"], *_RUN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                texts = batch.column(2).cast(pa.binary()).to_pylist()
                owner, s, n, z, bucket, c1, c2 = (np.concatenate(c) for c in zip(*[make(texts) for make in kinds]))
                if len(owner):
                    order = np.lexsort((s, c2, c1, bucket, owner))
                    s, n, z, bucket, c1, c2, owner = (x[order] for x in (s, n, z, bucket, c1, c2, owner))
                    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])))
                    head = np.flatnonzero(new)
                    at = pa.ListArray.from_arrays(pa.array(np.append(head, len(s)).astype(np.int32)), pa.array(s, pa.int64()))
                    take = pa.array(owner[head])
                    cols = [pa.array(c[head], pa.int64()) for c in (n, z, bucket, c1, c2)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), at, *cols], names=schema.names)

    return docs.select("doc_id", "th", "text").mapInArrow(run, schema)


def _compare(contexts: DataFrame, scratch_schema: T.StructType) -> DataFrame:
    """(doc_id, th, kind, s, e): repeated suffixes among contexts that come bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch | None:
            out: list[tuple] = []

            def add(texts: list[tuple], kind: int, which: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
                for i, a, b in zip(which.tolist(), begin.tolist(), end.tolist()):
                    _, single, doc_id, th, s, _ = texts[i]
                    if single:
                        out.append((doc_id, th, kind, s + a, s + b))

            texts = [r for r in held if not r[0] & 1]
            if any(r[1] for r in texts):
                flags = repeated_suffixes([r[5] for r in texts])
                counts = np.array([len(f) for f in flags])
                which, first, last = _spans_of(np.concatenate(flags), counts)
                skip = (np.cumsum(counts) - counts)[which]
                add(texts, 0, which, first - skip, last - skip)
            texts = [r for r in held if r[0] & 1]
            if any(r[1] for r in texts):
                begins, ends, ids, sizes, offsets = words_of_each([r[5] for r in texts])
                counts, place, found = repeated_words(ids, sizes)
                which, first, last = _spans_of(found, counts)
                add(texts, 1, which, begins[place[first]] - offsets[which], ends[place[last] + WORDS - 1] - offsets[which])
            if not out:
                return None
            from pyspark.sql.pandas.types import to_arrow_schema

            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to_arrow_schema(scratch_schema))], names=scratch_schema.names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                # A block ends between buckets.
                if size > BLOCK_BYTES and held and held[-1][0] != row[0]:
                    if (done := flush()) is not None:
                        yield done
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if (done := flush()) is not None:
            yield done

    return contexts.select("bucket", "single", "doc_id", "th", "s", "context").mapInArrow(run, scratch_schema)


def _string_hashes(contexts: DataFrame) -> DataFrame:
    """(w1, w2, single, doc_id, th, kind, s, e) for every string of the contexts."""
    fields = contexts.schema
    longs = [T.StructField(c, T.LongType()) for c in ("w1", "w2", "kind", "s", "e")]
    schema = T.StructType([*longs[:2], fields["single"], fields["doc_id"], fields["th"], *longs[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, place = batch.column(0).to_pylist(), batch.column(4).to_pylist()
            for i, context in enumerate(batch.column(5).to_pylist()):
                kind = bucket[i] & 1
                if kind:
                    begins, ends, ids = words_of(context)
                    n = len(ids) - WORDS + 1
                    w = [_fold(ids if not seed else _mix(ids + np.uint64(seed)), WORDS) for seed in (0, 0x2545F491)]
                    s, e = begins[:n], ends[WORDS - 1 :]
                else:
                    data = np.frombuffer(context, dtype=np.uint8)
                    n = len(data) - LENGTH + 1
                    w = [_power_hashes(data, LENGTH, seed) for seed in (0x51ED2701, 0x2545F491)]
                    s = e = np.arange(n)
                take = pa.array(np.full(n, i))
                numbers = [pa.array(c, pa.int64()) for c in (np.full(n, kind), s + place[i], e + place[i])]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in w], *[batch.column(k).take(take) for k in range(1, 4)], *numbers], names=schema.names)

    return contexts.select("bucket", "single", "doc_id", "th", "s", "context").mapInArrow(run, schema)


def _met(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in keys, whose n is the number of rows of a key or more; frequent keys are broadcast.

    There are at most as many of those as rows / HOT_ROWS.
    """
    hot = F.broadcast(keys.filter(F.col("n") > HOT_ROWS).select(*on))
    rare = keys.filter(F.col("n") <= HOT_ROWS).select(*on)
    return rows.join(hot, on, "left_semi").unionAll(rows.join(hot, on, "left_anti").join(rare, on, "left_semi"))


def repeated_runs(docs: DataFrame, passages: bool = False) -> DataFrame:
    """(doc_id, th, runs): per document with repeats the runs (kind, s, e).

    Of kind 0 they are the places s to e where a repeated string starts, of
    kind 1 (with passages only) bytes s to e of words that repeated passages cover.
    docs needs doc_id and text; th is the hash of the text.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    runs = scratch.write(_runs(own, [bucket_runs, word_runs][: 1 + passages]), "runs")
    times = F.sum(F.size("at"))
    met_twice = scratch.write(runs.groupBy("bucket").agg(times.alias("n")).filter("n > 1"), "shared")
    live = scratch.write(_met(runs, met_twice, ["bucket"]), "live")
    scratch.drop("runs")
    key = ["bucket", "c1", "c2"]
    contexts = scratch.write(
        live.groupBy(*key).agg(times.alias("times"), F.min(F.struct("doc_id", "th", F.col("at")[0].alias("s"), "n", "z")).alias("rep")), "contexts"
    )
    kind = F.col("bucket").bitwiseAND(F.lit(1)).alias("kind")
    whole = _met(live, contexts.filter("times > 1").select(*key, F.col("times").alias("n")), key)
    whole = whole.select("doc_id", "th", kind, "n", "z", F.explode("at").alias("s"))
    whole = whole.select("doc_id", "th", "kind", "s", F.when(F.col("kind") == 1, F.col("s") + F.col("z")).otherwise(F.col("s") + F.col("n") - 1).alias("e"))

    unsettled = contexts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("times").alias("least")).filter("least = 1")
    unsettled = scratch.write(unsettled.select("bucket", "n"), "unsettled")
    wanted = _met(contexts, unsettled, ["bucket"]).select("bucket", (F.col("times") == 1).alias("single"), "rep.*")
    # At most as many as contexts / GROUP_CONTEXTS.
    large = F.broadcast(unsettled.filter(F.col("n") > GROUP_CONTEXTS).select("bucket"))
    by_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("bucket", "single", "s", "z")).alias("wants"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "__doc_id", "th": "__th"})
    found = own.join(by_doc.hint("shuffle_hash"), null_safe(own, by_doc, [("doc_id", "__doc_id"), ("th", "__th")]))
    cut = found.select("doc_id", "th", F.col("text").cast("binary").alias("text"), F.explode("wants").alias("w")).select(
        "w.bucket", "w.single", "doc_id", "th", "w.s", F.substring("text", (F.col("w.s") + 1).cast("int"), F.col("w.z").cast("int")).alias("context")
    )
    texts = scratch.write(cut, "texts")
    schema = T.StructType([live.schema["doc_id"], live.schema["th"], *[T.StructField(c, T.LongType()) for c in ("kind", "s", "e")]])
    regular = texts.join(large, "bucket", "left_anti")
    # As many tasks as the shuffle has: a bucket is met in one task, and is bounded by GROUP_CONTEXTS.
    regular = regular.repartition("bucket").sortWithinPartitions("bucket")
    compared = _compare(regular, schema)
    strings = _string_hashes(texts.join(large, "bucket", "left_semi"))
    often = scratch.write(strings.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "often")
    hashed = _met(strings.filter("single"), often, ["w1", "w2"]).select("doc_id", "th", "kind", "s", "e")
    every = whole.unionAll(compared).unionAll(hashed)
    return scratch.write(every.groupBy("doc_id", "th").agg(F.collect_list(F.struct("kind", "s", "e")).alias("runs")), "by_doc")


def removed_spans(runs: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte ranges (begin, end) covered by strings that start in the runs."""
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + length)
        else:
            out.append([s, e + length])
    return [(a, b) for a, b in out]


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def passages_of(text: bytes, covered: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """Maximal byte ranges (begin, end) of words that are covered, and the number of these words."""
    out: list[list[int]] = []
    for s, e in sorted(covered):
        if out and not _WORD.search(text, out[-1][1], s):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out], sum(len(_WORD.findall(text, a, b)) for a, b in out)


OUT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("kept", T.BinaryType()),
        T.StructField("n_passages", T.LongType()),
        T.StructField("n_passage_words", T.LongType()),
        T.StructField("passages", T.ArrayType(T.LongType())),
    ]
)


def dedup(docs: DataFrame, carry: list[str] | None = None, outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")) -> DataFrame:
    """docs' columns (or those in carry) with OUT: spans is begin, end, begin, end, …; kept the bytes that stay.

    What stays can be cut within a character, so it is binary. passages are
    the ranges of words covered by WORDS words that also start elsewhere, as
    begin, end, …; they are sought if outputs name them or their numbers.
    """
    from tarn.llm.common import map_rows

    carry = list(docs.columns if carry is None else carry)
    sought = not {"n_passages", "n_passage_words", "passages"}.isdisjoint(outputs)
    runs = repeated_runs(docs.select("doc_id", "text"), sought).withColumnsRenamed({"doc_id": "__doc_id", "th": "__th"})
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"), "text")
    flat = F.flatten(F.transform("runs", lambda r: F.array(r["kind"], r["s"], r["e"])))
    joined = packed.join(runs.hint("shuffle_hash"), null_safe(packed, runs, [("__id", "__doc_id"), ("__text", "__th")]), "left")
    both = joined.select("doc", F.struct("text", flat.alias("at")).alias("judged"))
    fields = T.StructType([f for f in OUT.fields if f.name in outputs])

    def batch(rows: list) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in OUT.fields}
        for row in rows:
            text = (row["text"] or "").encode()
            at = row["at"] or []
            found = list(zip(at[::3], at[1::3], at[2::3]))
            spans = removed_spans([(s, e) for kind, s, e in found if not kind])
            passages, n_words = passages_of(text, [(s, e) for kind, s, e in found if kind])
            kept, last = [], 0
            for a, b in spans:
                kept.append(text[last:a])
                last = b
            rest = b"".join([*kept, text[last:]])
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(rest))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            out["spans"].append([x for s in spans for x in s])
            out["kept"].append(rest)
            out["n_passages"].append(len(passages))
            out["n_passage_words"].append(n_words)
            out["passages"].append([x for p in passages for x in p])
        return out

    mapped = map_rows(both, "judged", fields, batch, ["doc"], as_bytes=False, rows_per_batch=128)
    return mapped.select(*[F.col("doc").getField(c).alias(c) for c in carry if c.lower() not in {f.name for f in fields.fields}], *[f.name for f in fields.fields])


def query(docs: DataFrame, passages: bool = False) -> DataFrame:
    outputs = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    return dedup(docs, carry=["doc_id"], outputs=outputs + ("n_passages", "n_passage_words") * passages)
