"""The training-data operators against brute force on small fixtures, with the cases that real tables bring."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarn.llm import flac, langid, line_dedup, lm_score, mixing, quality, sentencepiece_codec, simhash, suffix_dedup, warc
from tarn.llm.common import Scratch, shared_dir
from tarn.llm.components import components
from tests_llm_brute import brute_component_keepers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "This line is long enough to be counted as a shared one, by far."


def corpus(seed=3, n=40):
    r = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "été", "Zürich", "the", "of", "and", "x" * 20]
    passage = " ".join(r.choice(vocabulary) + str(r.randrange(1000)) for _ in range(90))
    docs = []
    for i in range(n):
        text = "\n".join(" ".join(r.choice(vocabulary) + str(r.randrange(50)) for _ in range(r.randrange(3, 30))) for _ in range(r.randrange(1, 8)))
        if i % 3 == 0:
            text += "\n  " + (LONG.upper() if i % 2 else LONG) + "\t"
        if i % 5 == 0:
            text = text[: r.randrange(50)] + passage + text
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
    docs += [(n, docs[0][1], "en", "s0", 0), (n + 1, docs[1][1] + " tail", None, "s1", 0)]
    # Nulls, empty and white texts, repeated rows, one very long text.
    docs += [(n + 2, None, None, None, None), (n + 3, "", "en", None, 0), (n + 4, " \n\t ", "en", "s1", 4), (n + 5, passage, "en", "s2", 0), (n + 5, passage, "en", "s2", 0), (None, passage + " x", "en", "s3", 0), (n + 6, (passage + "\n") * 40, "en", "s3", 0), (n + 7, "one two", "en", "s3", 0)]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert Scratch(spark, "x").root.startswith(shared_dir(spark))


# 1 -----------------------------------------------------------------------


def test_language_id_on_held_out_texts(spark):
    r = random.Random(1)
    stems = {"aa": ["kora", "mibu", "tela"], "bb": ["schu", "wern", "grop"], "cc": ["ille", "oure", "ais"]}
    rows = [(i, " ".join(r.choice(stems[lang]) + r.choice(stems[lang]) for _ in range(30)), lang, "s", 0) for i in range(120) for lang in [r.choice(list(stems))]]
    rows += [(1000, None, "aa", "s", 0), (1001, "12 34 !", "aa", "s", 0), (1002, "", None, "s", 0), (1003, "Ω", None, "s", 0)]
    out = langid.query(spark.createDataFrame(rows, SCHEMA)).collect()
    truth = {i: (t, lang) for i, t, lang, _, _ in rows}
    assert len(out) == len(rows)
    for x in out:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1
        if x.doc_id < 1000:
            assert x.lang_pred == truth[x.doc_id][1]
    assert {x.doc_id: x.lang_pred for x in out if x.doc_id >= 1000} | {1003: None} == {1000: "und", 1001: "und", 1002: "und", 1003: None}


def test_language_id_backs_off_to_shorter_grams():
    m = langid.Model(["a", "b"], np.zeros(2), {"known": np.array([0.0, -9.0])}, {2: {"zz": np.array([-9.0, 0.0])}, 1: {}, 3: {}, 4: {}, 5: {}})
    assert m.word_scores("known")[0] == 0 and m.word_scores("xzzx")[1] > m.word_scores("xzzx")[0]
    assert not m.word_scores("qq").any()


def test_language_id_against_plain_counts(spark, docs):
    """Counts, log frequencies and sums over words, recomputed word by word, and rows that real tables bring."""
    import math

    rows = [(i, r.text, ["xx", "yy"][i % 2], "s", 0) for i, r in enumerate(docs.collect())]
    rows += [(None, "alpha beta", "xx", "s", 0), (None, "alpha beta", "xx", "s", 0), (900, "alpha unheard " * 20000, None, "s", 0), (902, "alpha", " odd lang ", "s", 0)]
    table = spark.createDataFrame(rows, SCHEMA)
    labelled = table.filter("lang IS NOT NULL")
    model = langid.train(labelled)
    counts, totals = defaultdict(Counter), Counter()
    for _, t, lang, _, _ in rows:
        if t is None or lang is None:
            continue
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            counts[(lang, 0)][w] += 1
            for n in langid.ORDERS:
                for g in langid.grams_of(w, n):
                    counts[(lang, n)][g] += 1
    for key, c in counts.items():
        totals[key] = (sum(c.values()), len(c))
    # A language of which the sample's hash has drawn no row has no table.
    assert set(model.langs) <= {"xx", "yy", " odd lang "} and {"xx", "yy"} <= set(model.langs)

    def log_of(lang, n, item):
        c, (total, types) = counts[(lang, n)][item], totals.get((lang, n), (0, 0))
        return math.log(((c if c >= langid.MIN_COUNT else 0) + langid.SMOOTHING) / (total + langid.SMOOTHING * (types + 1)))

    for n, table_of in [(0, model.words), *model.grams.items()]:
        kept = {g for (_, k), c in counts.items() if k == n for g, v in c.items() if v >= langid.MIN_COUNT}
        assert set(table_of) == kept
        for item, row in table_of.items():
            assert row.tolist() == pytest.approx([log_of(lang, n, item) for lang in model.langs])
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(table, model, carry=["doc_id"]).collect())
    expected = Counter()
    for i, t, *_ in rows:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not words:
            expected[(i, "und", 0.0)] += 1
            continue
        total = sum(model.word_scores(w) for w in words)
        best = int(np.argmax(total))
        share = np.exp((total - total[best]) / math.sqrt(len(words)))
        expected[(i, model.langs[best], round(float(1 / share.sum()), 9))] += 1
    assert got == expected


def test_language_id_without_labels(spark, empty):
    assert langid.query(empty).count() == 0
    assert langid.query(spark.createDataFrame([(1, "text", None, "s", 0)], SCHEMA)).first().lang_pred == "und"


# 2 -----------------------------------------------------------------------


def brute_quality(text):
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs):
    rows = quality.query(docs).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id][0])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_quality_policies_and_ablation(docs, empty):
    ledger = quality.ledger(docs)
    kept = {p: ledger.filter(quality.kept(p)).count() for p in quality.POLICIES}
    assert kept["v1"] <= kept["base"] < docs.count()
    report = {r.rule: r for r in quality.ablation(ledger).collect()}
    assert set(report) == set(quality.BIT)
    for rule, bit in quality.BIT.items():
        only = ledger.filter(F.col("failed").bitwiseAND(F.lit(quality.POLICIES["v1"])) == bit).count()
        assert report[rule].n_only == only and report[rule].n_docs == docs.count()
    assert quality.query(empty).count() == 0


def test_quality_filter_keeps_clashing_columns(docs):
    clash = docs.withColumn("n_words", F.lit("mine")).withColumn("failed", F.lit(1.5)).withColumn("__pad", F.lit(2)).withColumn("row", F.lit(3)).withColumn("pad", F.create_map(F.lit("k"), F.lit("v")))
    out = quality.filter_documents(clash)
    assert out.columns == clash.columns and {r.n_words for r in out.collect()} == {"mine"}


# 3 -----------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def page_rows():
    big, other = "<p>é" + "x" * 1500, "y" * 999
    return [(1, "http://a/", big), (5, "http://b/ü?q=1", big), (3, None, big), (4, "u", other), (6, "u", other), (7, "u", None), (8, "u", ""), (None, "u", big), (5, "u", big), (9, "a\r\nb", "z" * 5000), (10, "u", "plain")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), PAGES).withColumn("payload", F.lit("clash"))
    got = Counter(tuple(r) for r in warc.query(pages).collect())
    best = defaultdict(list)
    for i, _, h in page_rows():
        if i is not None:
            best[h or ""].append(i)
    expected = Counter()
    for i, _, h in page_rows():
        b = (h or "").encode()
        first = max(best[h or ""]) if len(b) >= 1000 else None
        again = first is not None and i != first
        expected[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert got == expected
    assert warc.query(pages.limit(0)).count() == 0


def test_warc_files_and_payloads(spark):
    scratch = Scratch(spark, "test")
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html>{i} common body of a page</html>" * 40) for i in range(60)], PAGES)
    files = warc.write_archives(pages, scratch.path("a"), scratch=scratch).collect()
    assert sum(f.records for f in files) == 60
    back = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read_archives(spark, scratch.path("a")).collect()}
    assert back == {r.page_id: (r.url, r.html) for r in pages.collect()}
    data = open(files[0].path, "rb").read()
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D and warc.read_dictionary(data)[0]


def archive(dictionary=b"", **changes):
    record = warc.build_record(1, "http://a/", b"body" * 300, None, "response")
    for old, new in changes.items():
        record = record.replace(old.encode(), new) if isinstance(old, str) else record
    return warc.leading_frame(dictionary) + warc.compressor(dictionary).compress(record)


def test_warc_rejects_broken_archives():
    good = archive()
    assert [r["page_id"] for r in warc.read_archive(good + good)] == [1, 1]
    record = warc.build_record(1, "u", b"body", None, "response")
    for bad in (record[:-1], record.replace(b"body", b"bodi"), record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"Content-Length: 4\r\n\r\nbody", b"Content-Length: 5\r\n\r\nbody"), record.replace(b"WARC-Type: response", b"WARC-Type: other"), b"junk"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    for bad in (good[:-3], good[:20], b"junk" + good, good[:40] + b"\xff\xff" + good[42:], struct.pack("<II", 0x184D2A5D, 99) + b"short", struct.pack("<II", 0x184D2A5D, 4) + b"none"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))


# 4 -----------------------------------------------------------------------


def test_mix_reaches_targets(docs):
    rows = mixing.query(docs).collect()
    assert len(rows) == docs.count()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r.source_size] += r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert 0 <= r.taken <= 3 * r.size
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in target)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.query(docs.repartition(7)).collect()), key=repr)


def test_targets_stop_at_three_times_the_size():
    t = mixing.targets([10, 1000, 10], [1, 1, 100])
    assert t[2] == 30 and abs(sum(t) - 1020) < 1e-9 and t[0] <= 30
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0.0, 0.0]


def test_flow_over_overlapping_sources_is_cheapest():
    # Pattern 1 serves both sources; source 0 has only it besides its own.
    given = mixing.min_cost_flow([10, 10, 10], [[0], [0, 1], [1]], [20, 10])
    assert given == [10, 10, 10]
    assert mixing.min_cost_flow([10, 10], [[0], [0, 1]], [5, 10]) == [5, 10]
    assert mixing.min_cost_flow([10], [[0]], [100]) == [30]
    assert mixing.min_cost_flow([10, 5], [[0, 1], [1]], [10, 20]) == [10 + 5, 15] or sum(mixing.min_cost_flow([10, 5], [[0, 1], [1]], [10, 20])) == 30


def test_mix_with_overlap_and_repeats(spark, docs, empty):
    both = docs.withColumn("members", F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("all"))).otherwise(F.array("source")))
    placed, sources = mixing.mix(both, F.col("members"))
    assert placed.count() == docs.count() and placed.agg(F.max("times")).first()[0] <= 3 and "sall" in {r.source for r in sources.collect()}
    out = mixing.repeat_documents(docs)
    expected = sum(r.taken for r in mixing.query(docs).collect())
    assert out.columns == docs.columns and sum(len(words(r.text)) for r in out.collect()) == expected
    assert mixing.query(empty).count() == 0 and mixing.repeat_documents(empty).count() == 0


# 5 -----------------------------------------------------------------------


def brute_lines(rows, min_docs=5):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    rank = lambda i: -1 if i is None else i
    lost = {k: max(v, key=rank) for k, v in holders.items() if len(v) >= min_docs}
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in lost or lost[key(x)] == i]
        out[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_line_dedup(docs, batches, monkeypatch):
    monkeypatch.setattr(line_dedup, "_batch_bounds", lambda d, n, f=line_dedup._batch_bounds: f(d, batches))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute_lines(rows)
    assert any(k[2] for k in expected)
    assert Counter(tuple(r) for r in line_dedup.query(docs).collect()) == expected


def test_line_dedup_is_native_and_handles_empty(docs, empty):
    plan = line_dedup.query(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert line_dedup.query(empty).count() == 0
    out = line_dedup.filter_lines(docs.withColumn("th", F.lit(1)).withColumn("drops", F.lit("x")))
    assert out.count() == docs.count() and {r.drops for r in out.collect()} == {"x"} and out.filter("text IS NULL").count() == 1


def test_runs_are_compacted(spark):
    store = line_dedup.RunStore(spark, fanout=2, buckets=2)
    for i in range(4):
        df = spark.range(i * 10, i * 10 + 10).selectExpr("id AS h1", "id AS h2", "id AS holder", "1L AS n")
        assert store.fresh(df).count() == 10 and (not i or store.fresh(spark.range(10).selectExpr("id AS h1", "id AS h2", "id AS holder", "1L AS n")).count() == 0)
        store.add(df)
        store.compact()
    assert [len(level) for level in store.levels] == [0, 0, 1] and spark.table(store.names()[0]).count() == 40
    store.drop()


# 6 -----------------------------------------------------------------------


def naive_simhash(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(docs, empty):
    rows = docs.collect()
    out = simhash.query(docs).collect()
    prints = {r.text: naive_simhash(r.text) for r in rows}
    assert Counter((r.doc_id, f"{prints[r.text]:016x}") for r in rows) == Counter((r.doc_id, r.fingerprint) for r in out)
    assert simhash.query(empty).count() == 0
    group = defaultdict(set)
    for r in out:
        group[r.component_id].add(r.doc_id)
    assert {42, 43, 44} <= next(v for v in group.values() if 42 in v)  # no words: null, empty, white


def test_links_equal_brute_force(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base) | {b ^ sum(1 << k for k in r.sample(range(64), d)) for b in base for d in (1, 2, 3, 3, 4, 5)} | {0, 2**64 - 1, 1 << 63}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    expected = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == expected and expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5001), (5001, 5000)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50)) and got[5001] == 5000


def test_keep_one_of_each_group(docs):
    out = simhash.keep_one(docs.withColumn("fp", F.lit("mine")))
    found = simhash.query(docs).collect()
    assert out.count() == len({r.component_id for r in found}) and "fp" in out.columns
    assert {r.doc_id for r in out.collect()} == {r.component_id for r in found}


def test_keep_one_with_maps(spark):
    text = " ".join(f"w{i * i % 83}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None)], "doc_id long, text string").withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    assert sorted((r.doc_id, r.m["k"]) for r in simhash.keep_one(df).collect()) == [(1, 1), (3, 3)]


def test_keep_one_with_null_and_repeated_ids(spark):
    text = {k: " ".join(f"{k}{i * i % 83}" for i in range(60)) for k in "abcdef"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (None, text["c"]), (7, text["c"]), (8, text["d"]), (8, text["e"]), (8, text["e"]), (9, text["e"]), (None, text["f"]), (None, None), (3, None)]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = [(None, text["a"]), (None, text["b"]), (7, text["c"]), (8, text["d"]), (8, text["e"]), (None, text["f"]), (3, None)]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(kept)


# 7 -----------------------------------------------------------------------


def payloads():
    r = random.Random(2)
    return [flac.padded(x) for x in (b"", b"a", b"hello " * 300, bytes(range(256)) * 5, bytes(5000), bytes(r.randrange(256) for _ in range(3000)), "éàü".encode() * 700, bytes(i % 256 for i in range(9000)))]


@pytest.mark.parametrize("options", [{}, {"block": 192}, {"lpc_order": 2}, {"lpc_order": 8, "block": 256}])
def test_flac_is_lossless(options):
    files = flac.encode_many(payloads(), **options)
    got = flac.decode_many(files)
    assert [g[0] for g in got] == payloads()
    for f, p, (_, spans, _) in zip(files, payloads(), got):
        scalar, walked = flac._walk(f, flac.read_metadata(f))
        assert (scalar.astype(np.int8).view(np.uint8) ^ 128).tobytes() == p and walked == spans
    assert {k for g in got for k, _ in g[2]} > {-2}


def test_flac_without_a_seek_table():
    p = payloads()[2]
    f = flac.encode_many([p])[0]
    s = flac.read_metadata(f)
    bare = f[:4] + bytes([0x80]) + f[5:42] + f[s.audio :]
    assert flac.decode_many([bare])[0][0] == p


def test_flac_checks():
    f = flac.encode_many([payloads()[2]])[0]
    for at in (2, 30, len(f) - 1, len(f) - 40, flac.read_metadata(f).audio + 1, flac.read_metadata(f).audio + 6):
        with pytest.raises(flac.FlacError):
            flac.decode_many([f[:at] + bytes([f[at] ^ 0x10]) + f[at + 1 :]])
    with pytest.raises(flac.FlacError):
        flac.decode_many([f[:-5]])
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 2**21, 2**26, 2**31, 2**36 - 1):
        assert flac._read_utf8_number(flac._utf8_number(n), 0)[0] == n


def _plain_flac(data):
    """The samples of an 8-bit mono FLAC file, bit by bit from the format's description."""
    bits = "".join(f"{b:08b}" for b in data)
    at = 32

    def take(n):
        nonlocal at
        at += n
        return int(bits[at - n : at], 2) if n else 0

    def signed(n):
        v = take(n)
        return v - (1 << n) if v >> (n - 1) else v

    last = 0
    while not last:
        last, kind, size = take(1), take(7), take(24)
        if kind == 0:
            begin = at
            at += 80 + 20 + 3 + 5
            total = take(36)
            at = begin
        at += size * 8
    out, kinds = [], set()
    while len(out) < total:
        assert take(14) == 0x3FFE
        take(2)
        size_code, rate_code = take(4), take(4)
        take(8)
        lead = take(8)
        at += 8 * max(0, f"{lead:08b}".index("0") - 1) if lead & 0x80 else 0
        size = {6: lambda: take(8) + 1, 7: lambda: take(16) + 1}.get(size_code, lambda: 192 if size_code == 1 else 576 << size_code - 2 if size_code < 6 else 256 << size_code - 8)()
        at += {12: 8, 13: 16, 14: 16}.get(rate_code, 0) + 8
        take(1)
        kind = take(6)
        assert take(1) == 0
        kinds.add(min(kind, 32))
        if kind == 0:
            x = [signed(8)] * size
        elif kind == 1:
            x = [signed(8) for _ in range(size)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [signed(8) for _ in range(order)]
            c, shift = ([[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0) if kind < 32 else (None, 0)
            if kind >= 32:
                precision, shift = take(4) + 1, signed(5)
                c = [signed(precision) for _ in range(order)]
            method, parts = take(2), take(4)
            for part in range(1 << parts):
                k = take(4 + method)
                for _ in range((size >> parts) - (order if part == 0 else 0)):
                    end = bits.index("1", at)
                    high, at = end - at, end + 1
                    v = high << k | take(k)
                    x.append((v >> 1 ^ -(v & 1)) + (sum(a * b for a, b in zip(c, x[: -order - 1 : -1])) >> shift if order else 0))
        out += x
        at = (at + 7) // 8 * 8 + 16
    return bytes(v + 128 for v in out), kinds


def test_media_read_by_another_decoder(spark):
    """The query's files, linear predictors among them, against a decoder that shares no code with the module."""
    r = random.Random(8)
    texts = ["", "x", "Plain words of a text. " * 40, "".join(chr(97 + int(8 + 7 * np.sin(i / 9))) for i in range(3000)), "".join(r.choice("ab \n") for _ in range(1500))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    media = {m.doc_id: bytes(m.media) for m in flac.encode(table, carry=["doc_id"], lpc_order=flac.LPC_ORDER).collect()}
    met = set()
    for i, t in enumerate(texts):
        data, kinds = _plain_flac(media[i])
        met |= kinds
        assert data == flac.padded(t.encode())
    assert 32 in met
    for row in flac.query(table).collect():
        assert row.media_bytes == len(media[row.doc_id]) and row.media_sha256 == hashlib.sha256(media[row.doc_id]).hexdigest()
        x = np.frombuffer(flac.padded(texts[row.doc_id].encode()), dtype=np.uint8).astype(int)
        assert row.feature.startswith(f"frames={-(-len(x) // flac.BLOCK)};steps={np.abs(np.diff(x)).sum()};")


def test_media_columns(docs, empty):
    rows = flac.query(docs).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append((r.text or "").encode())
    for r in rows:
        p = flac.padded(texts[r.doc_id][0])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id][0]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len(rows) == docs.count() and flac.query(empty).count() == 0
    media = flac.encode(docs.select("doc_id", "text", F.lit("mine").alias("media")))
    blocks = flac.pcm_blocks(media, carry=["doc_id"]).collect()
    for r in blocks:
        assert b"".join(b.pcm for b in r.blocks) == flac.padded(texts[r.doc_id][0]) and [b.sample for b in r.blocks] == list(range(0, len(flac.padded(texts[r.doc_id][0])), flac.BLOCK))


# 8 -----------------------------------------------------------------------


def test_sentencepiece_parity(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    rows = sentencepiece_codec.encode(docs).collect()
    for r in rows:
        ids = own.encode(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(own.decode(ids).encode()).hexdigest()
        assert r.round_trip == (own.decode(ids) == (r.text or ""))
    assert sentencepiece_codec.query(empty).count() == 0
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def _field(number, value):
    if isinstance(value, bytes):
        return bytes([number << 3 | 2]) + _varint(len(value)) + value
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def unigram_model(squeeze, pieces=("▁the", "▁", "he", "t", "h", "e", "s", "▁she", "▁▁", "é")):
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(p, -1.0 - i * 0.37, 1) for i, p in enumerate(pieces)], *[(f"<0x{b:02X}>", -30.0, 6) for b in range(256)]]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in rows)
    return data + _field(2, _field(3, 1) + _field(35, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, squeeze))


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_models_with_byte_fallback(squeeze):
    pytest.importorskip("sentencepiece")
    from sentencepiece import SentencePieceProcessor

    data = unigram_model(squeeze)
    own, codec = SentencePieceProcessor(model_proto=data), sentencepiece_codec.Codec(*sentencepiece_codec.rebuild(data))
    texts = ["the she", "  the   she ", "hé the\n", "x", "thethe she the", "", "<0x41> the<0x42>s", "the "]
    ids = codec.encode(texts)
    assert [i.tolist() for i in ids] == own.encode(texts) and codec.decode(ids) == own.decode(own.encode(texts))


def test_bad_model_files():
    with pytest.raises(ValueError):
        sentencepiece_codec.parse_model(unigram_model(0)[:-3])
    with pytest.raises(ValueError):
        sentencepiece_codec.parse_model(_field(2, _field(3, 4)))


# 9 -----------------------------------------------------------------------


@pytest.mark.parametrize(("block", "entries"), [(2_000_000, 4_000_000), (50, 100)])
def test_stupid_backoff(docs, empty, monkeypatch, block, entries):
    import math

    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm_score, "SLICE_ENTRIES", entries)
    rows = docs.collect()
    w = [(r.text or "").encode().lower().split() for r in rows]
    c = Counter(tuple(x[i : i + n]) for x in w for n in (1, 2, 3) for i in range(len(x) - n + 1))
    total = sum(map(len, w))

    def s(x, i, n):
        if n == 1:
            return c[(x[i],)] / total
        g = tuple(x[i - n + 1 : i + 1])
        return c[g] / c[g[:-1]] if c[g] >= lm_score.MIN_COUNT else lm_score.ALPHA * s(x, i, n - 1)

    expected = sorted((repr(r.doc_id), len(x), sum(math.log(s(x, i, min(3, i + 1))) for i in range(len(x)))) for r, x in zip(rows, w))
    got = sorted((repr(r.doc_id), r.n_words, r.log_sum) for r in lm_score.query(docs).collect())
    assert [g[:2] for g in got] == [e[:2] for e in expected] and [g[2] for g in got] == pytest.approx([e[2] for e in expected], abs=1e-5)
    assert lm_score.query(empty).count() == 0


def brute_backoff(rows, corpus, min_count, order=3):
    import math

    w = [(t or "").encode().lower().split() for _, t in rows]
    c = Counter(tuple(x[i : i + n]) for _, t in corpus for x in [(t or "").encode().lower().split()] for n in range(1, order + 1) for i in range(len(x) - n + 1))
    total = sum(n for g, n in c.items() if len(g) == 1)

    def s(x, i, n):
        g = tuple(x[i - n + 1 : i + 1])
        if n == 1:
            return max(c[g], lm_score.ALPHA) / max(total, 1)
        return c[g] / c[g[:-1]] if c[g] >= min_count else lm_score.ALPHA * s(x, i, n - 1)

    once = [sum(c[tuple(x[i : i + order])] <= 1 for i in range(len(x) - order + 1)) for x in w]
    return sorted((repr(i), len(x), n, sum(math.log(s(x, k, min(order, k + 1))) for k in range(len(x)))) for (i, _), x, n in zip(rows, w, once))


@pytest.mark.parametrize(("block", "min_count", "order", "other", "hot"), [(1_000_000, 1, 3, False, False), (30, 2, 3, False, False), (30, 1, 3, True, False), (1_000_000, 2, 4, True, True), (1_000_000, 1, 3, False, True), (50, 3, 2, False, True), (50, 1, 1, False, False), (50, 1, 1, True, True)])
def test_backoff_against_other_corpora(spark, docs, monkeypatch, block, min_count, order, other, hot):
    """Thresholds, orders and a corpus of its own; also with frequent n-grams counted apart."""
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm_score, "HOT_SHARE", 8 if hot else 10**9)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    corpus = docs.filter("doc_id % 3 = 1") if other else None
    counted = [(r.doc_id, r.text) for r in corpus.collect()] if other else rows
    out = lm_score.score(docs.withColumn("uid", F.lit("mine")).withColumn("c", F.lit(1)), order, corpus, min_count=min_count, hot_sample=1).collect()
    got = sorted((repr(r.doc_id), r.n_words, r.n_once, r.log_sum) for r in out)
    expected = brute_backoff(rows, counted, min_count, order)
    assert [g[:3] for g in got] == [e[:3] for e in expected] and [g[3] for g in got] == pytest.approx([e[3] for e in expected], abs=1e-6)


# 10 ----------------------------------------------------------------------


def brute_suffix(rows, n=400):
    c = Counter(t[i : i + n] for _, t in rows for i in range(len(t) - n + 1))
    out = Counter()
    for d, t in rows:
        spans = suffix_dedup.removed_spans([(i, i) for i in range(len(t) - n + 1) if c[t[i : i + n]] > 1])
        kept, last = b"", 0
        for a, b in spans:
            kept, last = kept + t[last:a], b
        kept += t[last:]
        out[(d, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("group", "stretch", "block"), [(4096, 1 << 20, 2 << 20), (1, 1 << 20, 2 << 20), (4096, 100, 1)])
def test_suffix_dedup(docs, empty, monkeypatch, group, stretch, block):
    """Also with every shared bucket taken as oversized, and with tiny stretches and blocks."""
    monkeypatch.setattr(suffix_dedup, "GROUP_CONTEXTS", group)
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    expected = brute_suffix(rows)
    assert sum(k[2] for k in expected) > 1000
    assert Counter(tuple(r) for r in suffix_dedup.query(docs).collect()) == expected
    assert suffix_dedup.query(empty).count() == 0


def test_cover_ranks_equal_brute_force():
    r = random.Random(9)
    for _ in range(5):
        shared = bytes(r.randrange(97, 100) for _ in range(700))
        texts = [bytes(r.randrange(97, 100) for _ in range(r.randrange(0, 300))) + shared[r.randrange(200) : r.randrange(450, 700)] + bytes(r.randrange(97, 100) for _ in range(r.randrange(0, 200))) for _ in range(6)] + [b"a" * 900, b"", b"x" * 400]
        c = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
        got = suffix_dedup.repeated_suffixes(texts)
        assert [g.tolist() for g in got] == [[c[t[i : i + 400]] > 1 for i in range(len(t) - 399)] for t in texts]
    diffs = {(a - b) % 16 for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert diffs == set(range(16))


def brute_passages(rows, n=50):
    """Per row: id, maximal runs of words covered by n words that also start elsewhere, and the number of these words."""
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", t) for _, t in rows]
    c = Counter(tuple(w[i : i + n]) for w in texts for i in range(len(w) - n + 1))
    out = Counter()
    for (d, _), w in zip(rows, texts):
        starts = [i for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1]
        covered = {k for i in starts for k in range(i, i + n)}
        out[(d, sum(k - 1 not in covered for k in covered), len(covered))] += 1
    return out


def with_passages():
    """Texts of 90 to 160 words; in some 60, 50 or 49 words that others hold too, of under 400 bytes, between other whitespace."""
    r = random.Random(17)
    word = lambda: "".join(r.choices("abcdefghijklmnopq\u00e9", k=r.randrange(1, 9)))
    shared = [word() for _ in range(60)]
    assert len(" ".join(shared).encode()) < 400
    texts = []
    for i in range(40):
        own = [word() for _ in range(r.randrange(90, 160))]
        at, size = r.randrange(len(own)), (0, 60, 49, 50)[i % 4]
        own[at:at] = shared[60 - size :]
        texts.append(("\n" if i % 3 else "\t").join(own))
    return [*texts, texts[0], texts[1], "ab cd " * 300, "ab " * 49, "x" * 9000 + " " + " ".join(shared), "x" * 8999 + "y " + " ".join(shared), "", None]


@pytest.mark.parametrize(("group", "hot"), [(4096, 4096), (1, 4096), (4096, 1), (1, 1)])
def test_passages_of_words_shorter_than_400_bytes(spark, monkeypatch, group, hot):
    """Also with every shared bucket taken as oversized, and every key met twice as frequent."""
    monkeypatch.setattr(suffix_dedup, "GROUP_CONTEXTS", group)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    frame = spark.createDataFrame(list(enumerate(with_passages())), "doc_id long, text string").repartition(4)
    rows = [(d, (t or "").encode()) for d, t in enumerate(with_passages())]
    expected = brute_passages(rows)
    alone = [d for d in range(4, 40, 4) if (d, 0, 0) in expected]
    assert len(alone) == 9 and all((d, 1, 60) in expected for d in range(5, 40, 4))
    got = suffix_dedup.query(frame, passages=True).collect()
    assert Counter((r.doc_id, r.n_passages, r.n_passage_words) for r in got) == expected
    assert Counter(tuple(r)[:5] for r in got) == brute_suffix(rows)
    assert all(r.n_removed == 0 for r in got if r.doc_id in range(5, 40, 4))


def test_runs_of_one_document_with_equal_contexts_are_one_row(spark):
    """A periodic text gives rows by its distinct contexts, not by its length."""
    frame = spark.createDataFrame([(1, "ab cd " * 2000), (2, "ab cd " * 1000)], "doc_id long, text string").coalesce(1)
    own = frame.select("doc_id", F.lit(0).cast("long").alias("th"), "text")
    runs = suffix_dedup._runs(own, [suffix_dedup.bucket_runs, suffix_dedup.word_runs]).collect()
    assert len(runs) < 20
    assert sum(len(r.at) * r.n for r in runs if not r.bucket & 1) == 12000 + 6000 - 2 * 399
    assert sum(len(r.at) * r.n for r in runs if r.bucket & 1) == 4000 + 2000 - 2 * 49


def test_words_and_their_runs_do_not_depend_on_stretches(monkeypatch):
    text = " ".join(t or "" for t in with_passages()).encode() + b"  tail\x0b" + b"\xc3" * 5000 + b" end \r"
    begins, ends, ids = suffix_dedup.words_of(text)
    words = [text[a:b] for a, b in zip(begins, ends)]
    assert words == re.findall(rb"[^\x20\x09-\x0D]+", text)
    assert len(set(ids.tolist())) == len(set(words)) == len(set(zip(ids.tolist(), words)))
    monkeypatch.setattr(suffix_dedup, "STRETCH", 100)
    assert suffix_dedup.words_of(text)[2].tolist() == ids.tolist()
    at = dict(zip(begins.tolist(), range(len(begins))))
    texts = [b"", None, b"a b", text, b"c " * 49, b"d " * 50, text[:300]]
    for stretch in (100, 20000, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
        owner, s, n = suffix_dedup.word_runs(texts)[:3]
        assert set(owner.tolist()) == {3, 5, 6} if len(suffix_dedup.words_of(text[:300])[0]) >= 50 else {3, 5}
        assert sorted(at[a] + k for o, a, m in zip(owner.tolist(), s.tolist(), n.tolist()) if o == 3 for k in range(m)) == list(range(len(words) - 49))


def near_copies():
    """Texts of 40 to 200 words, each with copies in which some words differ."""
    random = np.random.default_rng(5)
    rows = []
    for base in range(60):
        length = int(random.integers(40, 200))
        own = [f"w{x}" for x in random.integers(0, 3000, length)]
        rows.append((len(rows), " ".join(own)))
        for edits in (1, 2, 3, length // 30, length // 20):
            changed = list(own)
            for at in random.integers(0, length, edits):
                changed[at] = f"v{random.integers(0, 3000)}"
            rows.append((len(rows), " ".join(changed) if edits != 2 else " ".join(changed).upper()))
    return rows


def test_keep_one_by_similarity(spark):
    rows = near_copies()
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8)
    kept, expected = {r.doc_id for r in out.collect()}, brute_component_keepers(rows)
    # No pair below the similarity is linked, so every group of the brute force keeps one at least.
    assert kept >= expected and len(rows) - len(expected) > 100
    assert len(rows) - len(kept) >= 0.95 * (len(rows) - len(expected))


@pytest.mark.parametrize("large", [3, 64])
def test_keep_one_by_similarity_loses_no_link(spark, monkeypatch, large):
    """Few shingles, for which bits say little; and a group of near copies with others right at the similarity."""
    monkeypatch.setattr(simhash, "LARGE", large)
    texts = [t for _, t in near_copies()[:120]]
    for i in range(30):
        own = [f"p{i}x{k}" for k in range(9)]
        texts += [" ".join(own[:8]), " ".join(own)]
    for base in "gh":
        own = [f"{base}{k}" for k in range(104)]
        texts += [" ".join([*own[:50], f"{base}{i}y", *own[51:]]) for i in range(40)]
        # 80 of 100 shingles, and of 101.
        texts += [" ".join(own[:84]), " ".join([*own[:84], *[f"{base}z{k}" for k in range(21)]])]
    texts += [" ".join(f"g{k}" for k in range(40)) + f" only {i} of these" + " ".join(f" o{i}x{k}" for k in range(40)) for i in range(20)]
    rows = list(enumerate(texts))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    assert kept == brute_component_keepers(rows)


def test_keep_one_by_similarity_edges(spark):
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "one two three"), (7, long), (8, long + " end"), (None, long), (None, "four five"), (9, "same header " * 300 + "first tail of these"), (10, "same header " * 300 + "another end is here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("longs", F.lit("x")).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    out = simhash.keep_one(docs, similarity=0.8)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 4, 6, 7, None, 9, 10])
    assert simhash.keep_one(docs.limit(0), similarity=0.8).count() == 0


def test_a_large_group_of_near_copies_gives_few_pairs(spark, tmp_path):
    own = [f"w{i * i % 9973}" for i in range(300)]
    rows = [(str(i), " ".join(own[:k] + [f"x{i}"] + own[k:])) for i in range(400) for k in [i * 7 % 300]]
    docs = spark.createDataFrame(rows, "key string, text string")
    fps = simhash.wide_fingerprints(docs, "text", ["key"])
    pairs = simhash.near_links(fps, docs, Scratch(spark, "test")).collect()
    assert 399 <= len(pairs) <= simhash.NEIGHBOURS * 64 * 400 and len(set(pairs)) == len(pairs)
    roots = components(spark.createDataFrame([(p.a, p.b) for p in pairs], "a long, b long"), Scratch(spark, "test")).collect()
    assert len(roots) == 400 and len({r.root for r in roots}) == 1


def test_texts_that_share_lines_only_make_no_pairs(spark, tmp_path):
    """Every two of the texts share half of their shingles, so each meets all others under those."""
    rows = [(str(i), " ".join([f"c{k}" for k in range(54)] + [f"o{i}x{k}" for k in range(50)])) for i in range(60)]
    own = [f"n{k}" for k in range(104)]
    rows += [("near", " ".join(own[:84])), ("other", " ".join(own))]
    docs = spark.createDataFrame(rows, "key string, text string")
    scratch = Scratch(spark, "test")
    sets = scratch.write(simhash.wide_fingerprints(docs, "text", ["key"]).withColumn("root", F.col("fp")), "sets")
    names = {r.key: r.fp for r in sets.collect()}
    whole = simhash.sets_left(sets, docs, scratch)
    assert {r.root for r in simhash.first_places(whole, scratch).collect()} == {names["near"], names["other"]}
    assert [{r.a, r.b} for r in simhash.links_left(sets, docs, scratch).collect()] == [{names["near"], names["other"]}]
