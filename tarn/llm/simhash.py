"""SimHash near-duplicates: pigeonring candidate filtering, Hamming check, connected components.

A fingerprint of 64 bits is cut into four segments on a ring. If two
fingerprints differ in at most 3 bits, then from some segment on every chain
of l consecutive segments differs in at most floor(3 l / 4) bits: the first in
none, the first two in at most one, three in at most two. So one side offers,
for each start, its first two segments as they are; the other also offers them
with each bit of the second flipped. They meet on start and 32 bits; what
meets is held against the budgets of the longer chains before the full
Hamming check.

Only distinct fingerprints are compared, so copies cost nothing further.

Two texts whose 5-word shingles have a Jaccard similarity of 0.8 differ in
about 15 % of the bits, which is too far for 64 bits and four segments. For a
similarity, fingerprints of the distinct shingles have 1024 bits and 64
segments on the ring. The distance expected at that similarity has a standard
deviation of about 11 bits: pairs beyond three of them are not near, pairs that
much nearer are near, and those between are settled by their shingles. Texts that agree in a segment are sorted by the 64 bits that
start there; each is compared with the next ones in that order, first by the
budgets of the chains of these four segments, then by all bits. So a group of
near copies costs rows in proportion to its size, whatever that is. This search
alone is not complete: a pair is missed if at every segment where it agrees
other texts lie between or a chain is over its budget.

What it leaves is found exactly. Of two sets of that similarity, each has at
most a fifth (at 0.8) of hashes that the other lacks. So among the least three
tenths of a text's hashes a tenth is also among those of the other text. Only
texts of which so many hashes are met in other components go on, then only
those of which four fifths of all hashes are. Their hashes are ordered from
the rarest on, those met in one component first; two such sets share one
of the first fifth of each. Texts of different components that meet there are
compared by sizes and places, by the parities of their hashes on 1024 places
(each that differs takes a shingle that only one has), and at last by all their
hashes; components with such a pair are joined. Texts of one component are not
compared again, so a group of near copies that the first search has joined
costs no pairs.

Defined results: a null text or one without words has fingerprint zero and is
linked like any other; fewer words than a shingle make one shingle of all;
repeated rows share a fingerprint; a null doc_id takes part and is no
component's name unless all its documents have none; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import Scratch, map_rows
from tarn.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS = 4
_WIDTH = 64 // SEGMENTS
# Near copies by similarity: words a shingle, the least similarity, longs a fingerprint, neighbours compared.
NEAR_SHINGLE = 5
SIMILARITY = 0.8
LONGS = 16
NEIGHBOURS = 2
# Parts into which the copies of one text are dealt.
SALTS = 32
# Members of one root under a hash, beyond which they are not compared with each other even to be told apart.
LARGE = 64
# Standard deviations of the distance within which the shingles decide.
DEVIATIONS = 3
# Share of a set's hashes that two heads of near sets have in common.
COMMON = 0.1
_GOLDEN = 0x9E3779B97F4A7C15
_STREAMS = np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
# Shingles counted at once; a byte holds the count.
_BLOCK = 255


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned SimHash of a UTF-8 text."""
    if not text:
        return 0
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        view = memoryview(joined)
        hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())), dtype=np.uint64)
    # Bits are counted block by block, so a very long text needs no more memory than a short one.
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i : i + (1 << 16)].astype(">u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The hashes of the distinct shingles of a UTF-8 text, sorted; of all its words if they are fewer."""
    words = (text or b"").lower().split()
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    hashes = np.zeros(max(len(words) - shingle + 1, min(len(words), 1)), dtype=np.uint64)
    for k in range(min(shingle, len(words))):
        hashes = _mix(hashes * np.uint64(_GOLDEN) + ids[k : k + len(hashes)])
    return np.unique(hashes)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of distinct shingles in LONGS signed longs, zero for a text without words."""
    counts = np.zeros(64 * LONGS, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        block = _mix(hashes[i : i + _BLOCK, None] + _STREAMS)
        counts += np.unpackbits(block.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).view(np.int64)


def fingerprints(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with ``fp``, the fingerprint as a signed long."""

    def batch(texts: list) -> dict[str, list]:
        return {"fp": np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)}

    return map_rows(docs, text_col, T.StructType([T.StructField("fp", T.LongType())]), batch, carry)


def needed(n: int, similarity: float) -> int:
    """So many of n hashes does any set share that is so similar."""
    return math.ceil(similarity * n - 1e-6)


def common_length(n: int) -> int:
    return max(math.ceil(COMMON * n), 1)


def head_length(n: int, similarity: float) -> int:
    """Of so many of the least of n hashes, common_length are shared with any set that is so similar: all but what the two must share, and these."""
    return n - needed(n, similarity) + common_length(n) if n else 0


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes falls on each of 64 LONGS places, in signed longs."""
    at = np.bincount((hashes % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS)
    return np.packbits((at & 1).astype(np.uint8)).view(np.int64)


def wide_fingerprints(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with ``longs``, the wide fingerprint, and ``fp``, a 64-bit hash of it that names it.

    Of the set of shingles, ``head`` has the least hashes, ``common`` is how
    many of them are in the head of any set that is so similar, whatever its
    size, and ``name`` is a 64-bit hash of all.
    """
    long, longs = T.LongType(), T.ArrayType(T.LongType())

    def batch(texts: list) -> dict[str, list]:
        hashes = [shingle_hashes(t, shingle) for t in texts]
        return {
            "longs": [wide_fingerprint(h) for h in hashes],
            "head": [h[: head_length(len(h), similarity)].view(np.int64) for h in hashes],
            "common": [common_length(needed(len(h), similarity)) for h in hashes],
            "name": np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in hashes], dtype=np.uint64).view(np.int64),
        }

    fields = T.StructType([T.StructField("longs", longs), T.StructField("head", longs), T.StructField("common", long), T.StructField("name", long)])
    return map_rows(docs, text_col, fields, batch, carry).withColumn("fp", F.xxhash64("longs"))


def whole_sets(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """docs with ``hashes``, those of all distinct shingles, ``n``, their number, and ``parity``, their parities."""

    def batch(texts: list) -> dict[str, list]:
        hashes = [shingle_hashes(t, shingle) for t in texts]
        return {"n": [len(h) for h in hashes], "parity": [parities(h) for h in hashes], "hashes": [h.view(np.int64) for h in hashes]}

    longs = T.ArrayType(T.LongType())
    return map_rows(docs, text_col, T.StructType([T.StructField("n", T.LongType()), T.StructField("parity", longs), T.StructField("hashes", longs)]), batch, carry)


def bits_apart(similarity: float, deviations: float = 0) -> int:
    """The distance expected of wide fingerprints of two sets with this Jaccard similarity, and so many standard deviations more."""
    share, bits = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * LONGS
    return max(int(bits * share + deviations * math.sqrt(bits * share * (1 - share))), 0)


def similar_enough(pairs: DataFrame, similarity: float, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """The rows (a, b, a_text, b_text) of pairs whose texts' sets of shingles have that Jaccard similarity, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, other = shingle_hashes(x.as_py(), shingle), shingle_hashes(y.as_py(), shingle)
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    texts = [F.coalesce(F.col(c), F.lit("")).cast("binary").alias(c) for c in ("a_text", "b_text")]
    return pairs.select("a", "b", *texts).mapInArrow(run, "a long, b long")


def near_links(fps: DataFrame, texts: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b), a < b, of distinct wide fingerprints found near each other.

    fps has (fp, longs, key), texts has (key, text) in which key names a text.
    """
    sure, distance = bits_apart(similarity, -DEVIATIONS), bits_apart(similarity, DEVIATIONS)
    per_long, ring = 64 // _WIDTH, LONGS * 64 // _WIDTH
    following = F.get("longs", (F.col("q") + 1) % LONGS)

    def window(r: int) -> Column:
        bits = F.shiftleft("x", _WIDTH * r).bitwiseOR(F.shiftrightunsigned(following, 64 - _WIDTH * r)) if r else F.col("x")
        return F.struct((F.col("q") * per_long + r).alias("start"), bits.alias("w"))

    starts = fps.select("fp", "longs", F.posexplode("longs").alias("q", "x"))
    offers = starts.select("fp", F.explode(F.array(*[window(r) for r in range(per_long)])).alias("o")).select("fp", "o.start", "o.w")
    order = Window.partitionBy("start", F.shiftrightunsigned("w", 64 - _WIDTH)).orderBy("w", "fp")
    after = [F.lead(F.struct("w", "fp"), k).over(order) for k in range(1, NEIGHBOURS + 1)]
    met = offers.select("fp", "w", F.array(*after).alias("after")).select("fp", "w", F.explode("after").alias("next")).filter("next IS NOT NULL")
    differ = F.col("w").bitwiseXOR(F.col("next.w"))
    for length in range(2, per_long + 1):
        met = met.filter(F.bit_count(F.shiftrightunsigned(differ, 64 - _WIDTH * length)) <= length * distance // ring)
    pairs = met.select(F.least("fp", "next.fp").alias("a"), F.greatest("fp", "next.fp").alias("b")).distinct()
    sides = [fps.select(F.col("fp").alias(s), F.col("longs").alias(f"{s}_longs"), F.col("key").alias(f"{s}_key")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    apart = reduce(add, [_differ(F.get("a_longs", F.lit(i)), F.get("b_longs", F.lit(i))) for i in range(LONGS)])
    near = scratch.write(both.withColumn("apart", apart).filter(F.col("apart") <= distance).select("a", "b", "a_key", "b_key", "apart"), "near")
    open_ = near.filter(F.col("apart") > sure)
    return near.filter(F.col("apart") <= sure).select("a", "b").unionAll(similar_enough(_with_texts(open_, texts, scratch, "open_texts"), similarity))


def _with_texts(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """pairs with a_text and b_text of a_key and b_key; texts has (key, text)."""
    keys = pairs.select(F.explode(F.array("a_key", "b_key")).alias("key")).distinct()
    # Texts under one key are the same; many copies of one are spread over the salts before one of each is taken.
    spread = texts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    salted = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    known = scratch.write(spread.join(salted, ["key", "salt"], "left_semi").groupBy("key").agg(F.first("text").alias("text")), name)
    for s in "ab":
        pairs = pairs.join(known.select(F.col("key").alias(f"{s}_key"), F.col("text").alias(f"{s}_text")), f"{s}_key")
    return pairs


def _met_elsewhere(places: DataFrame, root: Column) -> DataFrame:
    """The rows of places (hash, ...) whose hash is met under several roots, with ``met``, the rows with that hash."""
    same = Window.partitionBy("hash")
    ranged = places.withColumns({"least": F.min(root).over(same), "most": F.max(root).over(same), "met": F.count(F.lit(1)).over(same)})
    return ranged.filter("least <> most").drop("least", "most")


def sets_left(sets: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, root, n, parity, hashes) of those of sets (name, fp, root, common, head, key) whose heads leave a near set of another root possible.

    A null root is fp: most sets are their own, and rows then need not carry it. Rows of copies may be among the sets.
    """
    root = F.coalesce("root", "fp")
    # Sets that share a fingerprint are counted together: that drops none.
    mixed = _met_elsewhere(sets.select("fp", "root", F.explode("head").alias("hash")), root)
    counts = mixed.select("fp", "hash").distinct().groupBy("fp").agg(F.count(F.lit(1)).alias("shared"))
    distinct = sets.groupBy("name").agg(F.first("fp").alias("fp"), F.first(root).alias("root"), F.first("common").alias("common"), F.min("key").alias("key"))
    live = scratch.write(distinct.join(counts, "fp").filter("shared >= common").select("name", "root", "key"), "live")
    # Copies of one text are reduced to one before they are dealt by key.
    known = scratch.write(texts.join(live.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "live_texts")
    return scratch.write(whole_sets(live.join(known, "key"), "text", ["name", "root"]), "whole")


def first_places(whole: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """(hash, name, root, n, pos) of the hashes, rarest first, of which near sets of different roots share one."""
    needed_ = F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-6))
    mixed = scratch.write(_met_elsewhere(whole.select("name", "root", "n", F.explode("hashes").alias("hash")), F.col("root")).drop("met"), "mixed")
    enough = mixed.groupBy("name", "n").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= needed_).select("name")
    # Among the texts that are left hashes are rarer. Those met under one root come first: they take places, but no rows.
    by_name = Window.partitionBy("name")
    placed = _met_elsewhere(mixed.join(enough, "name", "left_semi"), F.col("root")).withColumns({
        "pos": F.row_number().over(by_name.orderBy("met", "hash")), "shared": F.count(F.lit(1)).over(by_name)
    })
    pos = F.col("n") - F.col("shared") + F.col("pos") - 1
    return scratch.write(placed.withColumn("pos", pos).filter((F.col("shared") >= needed_) & (F.col("pos") <= F.col("n") - needed_)).select("hash", "name", "root", "n", "pos"), "places")


def links_left(sets: DataFrame, texts: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of different roots under which two texts have that similarity: all of them.

    sets has (name, fp, root, common, head, key) as sets_left takes it, texts has (key, text).
    """
    whole = sets_left(sets, texts, scratch)
    places = first_places(whole, scratch, similarity)
    scratch.drop("live", "live_texts", "mixed")
    places = scratch.write(places.join(whole.select("name", "parity"), "name"), "with_parity")
    large = places.groupBy("hash", "root").count().filter(F.col("count") > LARGE).select("hash", "root")
    few, many = places.join(large, ["hash", "root"], "left_anti"), places.join(large, ["hash", "root"], "left_semi")

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.select("hash", *[F.col(c).alias(f"{s}_{c}") for c in ("name", "root", "n", "pos", "parity")])

    # If the first hash that both have is at these places, they share no more than what comes from there on;
    # and one of them alone has at least as many shingles as parities differ.
    both = F.col("a_n") + F.col("b_n")
    shared = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    alone = F.lit(1 - similarity) * both + F.lit(1e-6)
    apart = reduce(add, [_differ(F.get("a_parity", F.lit(i)), F.get("b_parity", F.lit(i))) for i in range(LONGS)])
    can = (shared * F.lit(1 + similarity) >= F.lit(similarity) * both - F.lit(1e-6)) & (apart * F.lit(1 + similarity) <= alone)
    # Many members of one root meet the other such roots under a hash before the members of these, so they make no pairs among themselves.
    some = side(few, "a").join(side(few, "b"), "hash").filter((F.col("a_root") < F.col("b_root")) & can)
    mix = side(few, "a").join(side(many, "b"), "hash").filter(can)
    ways = side(many, "a").join(large.withColumnRenamed("root", "b_root"), "hash").filter("a_root < b_root").join(side(many, "b"), ["hash", "b_root"]).filter(can)
    pairs = reduce(DataFrame.unionAll, [x.select("a_name", "b_name") for x in (some, mix, ways)]).distinct()
    pairs = scratch.write(pairs, "pairs_left")
    for s in "ab":
        pairs = pairs.join(whole.select(*[F.col(c).alias(f"{s}_{c}") for c in ("name", "hashes")], F.col("root").alias(s), F.col("n").alias(f"{s}_n")), f"{s}_name")
    pairs = pairs.withColumn("both", F.size(F.array_intersect("a_hashes", "b_hashes")))
    left = scratch.write(pairs.filter(F.col("both") >= F.lit(similarity) * (F.col("a_n") + F.col("b_n") - F.col("both"))).select("a", "b").distinct(), "left")
    scratch.drop("places", "with_parity", "whole", "pairs_left")
    return left


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, _WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << _WIDTH) - 1))


def _differ(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints within DISTANCE bits; fps has distinct ``fp``."""
    fp = F.col("fp")

    def key(i: int, flip: int | None) -> Column:
        two = F.shiftleft(_segment(fp, i), _WIDTH).bitwiseOR(_segment(fp, i + 1))
        return two if flip is None else two.bitwiseXOR(F.lit(1 << flip))

    def offer(flips: list[int | None]) -> DataFrame:
        return fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("start"), key(i, f).alias("key")) for i in range(SEGMENTS) for f in flips])).alias("o")).select("fp", "o.start", "o.key")

    # floor(3 / 4) = 0 bits in the first segment, floor(6 / 4) = 1 in the first two.
    plain = offer([None]).withColumnRenamed("fp", "b")
    varied = offer([None, *range(_WIDTH)]).withColumnRenamed("fp", "a")
    met = varied.join(plain, ["start", "key"]).filter(F.col("a") != F.col("b"))
    differ = [_differ(_segment(F.col("a"), i), _segment(F.col("b"), i)) for i in range(SEGMENTS)]
    chains = None
    for start in range(SEGMENTS):
        total, holds = F.lit(0), F.col("start") == start
        for length in range(1, SEGMENTS + 1):
            total = total + differ[(start + length - 1) % SEGMENTS]
            holds = holds & (total <= length * DISTANCE // SEGMENTS)
        chains = holds if chains is None else chains | holds
    near = met.filter(chains).filter(_differ(F.col("a"), F.col("b")) <= DISTANCE)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(own: DataFrame, scratch: Scratch, link: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """(fp, least, root) per distinct fingerprint of own (id, fp): the least id with it, and the least fingerprint reachable over links."""
    longs = [F.first("longs").alias("longs"), F.min("key").alias("key")] if "longs" in own.columns else []
    distinct = scratch.write(own.groupBy("fp").agg(F.min("id").alias("least"), *longs), "distinct")
    roots = components(link(distinct.drop("least")), scratch)
    return distinct.join(roots, distinct["fp"] == roots["id"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) per row of docs; component is the least id reachable over links."""
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.write(fingerprints(docs.select(id_col, text_col), text_col, [id_col]).select(F.col(id_col).alias("id"), "fp"), "fps")
    grouped = _roots(own, scratch)
    named = grouped.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = scratch.write(grouped.join(named, "root").select("fp", "component"), "by_fp")
    return own.join(by_fp, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """docs with one document of each component: that with the least id (a null one is last), and of rows that share it the least digest of the text.

    Components are those of ``classes``; with a similarity, those of wide
    fingerprints over shingles of NEAR_SHINGLE words that are as near.
    A component is known by its root, so documents without an id, or under an
    id that others have as well, stand for themselves.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    key = F.coalesce(F.md5(F.col(f"`{text_col}`")), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), key.alias("key"))
    if similarity is None:
        own = scratch.write(fingerprints(rows, "text", ["id", "key"]), "fps")
        grouped = _roots(own, scratch)
    else:
        wide = scratch.write(wide_fingerprints(rows, "text", ["id", "key"], similarity=similarity), "fps")
        found = scratch.write(_roots(wide, scratch, lambda fps: near_links(fps, rows, scratch, similarity)).select("fp", "root"), "found")
        scratch.drop("distinct", "near", "open_texts")
        moved = scratch.write(found.filter("root <> fp"), "moved")
        own = scratch.write(wide.select("id", "key", "fp"), "own")
        left = links_left(wide.join(moved, "fp", "left"), rows, scratch, similarity)
        scratch.drop("fps", "moved")
        joined = components(left, scratch).withColumnRenamed("root", "whole")
        grouped = found.join(joined, found["root"] == joined["id"], "left").select("fp", F.coalesce("whole", "root").alias("root"))
    by_fp = scratch.write(grouped.select("fp", "root"), "by_fp")
    scratch.drop("found", "left")
    ranked = own.select("id", "key", "fp").join(by_fp, "fp").groupBy("root", "id", "key").agg(F.count(F.lit(1)).alias("n"))
    first = ranked.groupBy("root").agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "key", "n")).alias("first"))
    keepers = first.select(F.col("first.id").alias("keeper"), F.col("first.key").alias("keeper_key"), (F.col("first.n") > 1).alias("again"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("id"), key.alias("key"))
    kept = packed.join(keepers, packed["id"].eqNullSafe(keepers["keeper"]) & (packed["key"] == keepers["keeper_key"]))
    # Rows that agree in id and text: the first in a fixed order stays, found by a partial aggregate. Maps have no order.
    ordered = F.struct(*[F.col("doc").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    several = kept.filter("again").groupBy("id", "key").agg(F.min_by("doc", ordered).alias("doc"))
    one = kept.filter("NOT again").select("doc").unionAll(several.select("doc"))
    return one.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    out = classes(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
