"""SentencePiece models run by the tokenizers library.

The model file is parsed here (protobuf wire format), and its parts rebuilt:
the normaliser (character map, white-space rules, the metaspace marker put
before the text), unigram scores or the merge order that BPE scores imply, and
byte fallback. A model is rebuilt once on the driver, checked against the
sentencepiece library on PROBES, and sent to the executors as JSON; the file
itself need not exist there.

Where no piece has the marker after another character, no token can cross the
start of a run of markers, so texts are cut there: a batch's words that are
not in a bounded cache are encoded together, multithreaded, each once, and a
text's ids are those of its words. A very long text thus needs no more memory
than its ids. Other models encode whole texts.

Defined results: a null or empty text has no tokens and decodes to the empty
text; repeated rows get equal ids; an empty table gives an empty result; input
columns named like an output column are replaced by it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import map_rows

MARK = "▁"
WORD = f"{MARK}*[^{MARK}]+|{MARK}+"
_WORD = re.compile(WORD)
THREADS = 2
#: Words whose ids a worker keeps; the cache is emptied when full.
CACHE_WORDS = 150_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PROBES = [
    "", " ", "   ", "a", " a", "a ", "Hello  world", "  two  spaces ", "tab\tand\nline\r\n", "café naïve", "€\U0001f600\U0001f468‍\U0001f469", "aaaaaaaaaa abababab",
    "1234567890 3.14", "▁mark▁", "é́ é", "<s></s><unk>", "<0x41><0x0A>", "x" * 300, "中文 日本語", "def f(x):\n    return x  # doubled",
]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"wire type {kind} in a model file")
        n = {1: 8, 5: 4}.get(kind) or varint()
        if i + n > len(data):
            raise ValueError("model file ends within a field")
        yield key >> 3, data[i : i + n]
        i += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix_mark: bool = False


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(_fields(value))
            m.kind = spec.get(3, UNIGRAM)
            m.byte_fallback = bool(spec.get(35, 0))
            m.suffix_mark = bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix = bool(spec.get(3, 1))
            m.squeeze = bool(spec.get(4, 1))
            m.escape = bool(spec.get(5, 1))
    if m.kind not in (UNIGRAM, BPE) or not m.escape or m.suffix_mark:
        raise ValueError("only unigram and BPE models with escaped, leading white space are supported")
    return m


def cuttable(m: Model) -> bool:
    """True if no piece has the marker after another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in m.pieces if kind in (NORMAL, USER))


def merges_of(m: Model) -> list[tuple[str, str]]:
    """All pairs that make a piece, those of the best-scored piece first."""
    score = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER)}
    found = []
    for piece, s in score.items():
        for i in range(1, len(piece)):
            if piece[:i] in score and piece[i:] in score:
                found.append((-s, i, piece[:i], piece[i:]))
    found.sort(key=lambda x: x[:2])
    return [(a, b) for _, _, a, b in found]


def build(m: Model):
    """The tokenizers.Tokenizer of the model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = next((i for i, (_, _, kind) in enumerate(m.pieces) if kind == UNKNOWN), None)
    if m.kind == UNIGRAM:
        # Only plain pieces match text: the others get names that text does not have, and bytes a score that leaves the least one.
        least = min((s for _, s, kind in m.pieces if kind in (NORMAL, USER)), default=0.0)
        rows = [(p, s) if kind in (NORMAL, USER) else (p, least) if kind == BYTE else (f"\U0010fffd{i}", 0.0) for i, (p, s, kind) in enumerate(m.pieces)]
        core = models.Unigram(rows, unk_id=unk, byte_fallback=m.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        core = models.BPE(vocab, merges_of(m), unk_token=None if unk is None else m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A | \z"), "")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    if m.squeeze:
        # Markers at the end go with the spaces, those that the text had itself as well.
        steps.append(normalizers.Replace(Regex(rf"{MARK}+\z"), ""))
    t.normalizer = normalizers.Sequence(steps)
    if cuttable(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), "isolated")
    user = [p for p, _, kind in m.pieces if kind == USER]
    if user:
        t.add_tokens([AddedToken(p, normalized=False) for p in user])
    return t


class Codec:
    """A rebuilt model that encodes and decodes batches."""

    def __init__(self, tokenizer: str, pieces: list[list], cut: bool, plain: bool, prefix: bool, squeeze: bool, unigram: bool):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer)
        self.words = Tokenizer(self.whole.model)
        self.cut, self.plain, self.prefix, self.squeeze = cut, plain, prefix, squeeze
        self.byte_ids = np.array([i for i, (_, kind, _) in enumerate(pieces) if kind == BYTE], dtype=np.int64)
        self.bytes_of = [_piece_bytes(p, kind) for p, kind, _ in pieces]
        # The library's unigram model takes a byte piece's name in a text for the piece; such words are encoded here.
        self.scores = {p: (s, i) for i, (p, kind, s) in enumerate(pieces) if kind in (NORMAL, USER)} if unigram and len(self.byte_ids) else None
        self.unknown = next((i for i, (_, kind, _) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.cache: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.cut:
            found = self.whole.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(self._unigram(self.whole.normalizer.normalize_str(t)) if self.scores and "<0x" in (t or "") else e.ids, dtype=np.int32) for t, e in zip(texts, found)]
        words = [self._words(t) if t else [] for t in texts]
        new = list({w for own in words for w in own if w not in self.cache})
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list({w for own in words for w in own})
        self.cache.update(zip(new, (e.ids for e in self.words.encode_batch_fast(new, add_special_tokens=False))))
        if self.scores:
            self.cache.update((w, self._unigram(w)) for w in new if "<0x" in w)
        known = self.cache
        return [np.fromiter(chain.from_iterable(map(known.__getitem__, own)), dtype=np.int32) for own in words]

    def _unigram(self, word: str) -> list[int]:
        """The best segmentation of a word, unknown characters as bytes."""
        unknown = min(s for s, _ in self.scores.values()) - 10
        longest = max(map(len, self.scores))
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        for end in range(1, len(word) + 1):
            options = [(best[end - 1][0] + unknown, end - 1, -1)] if word[end - 1] not in self.scores else []
            for start in range(max(0, end - longest), end):
                hit = self.scores.get(word[start:end])
                if hit:
                    options.append((best[start][0] + hit[0], start, hit[1]))
            best.append(max(options, key=lambda o: o[0]))
        out, end = [], len(word)
        while end:
            _, start, piece = best[end]
            out.append([piece] if piece >= 0 else [int(self.byte_ids[b]) for b in word[start:end].encode()])
            end = start
        return [i for part in reversed(out) for i in part]

    def _words(self, text: str) -> list[str]:
        """The normalised text cut before each run of markers."""
        if self.plain:
            if self.prefix and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
                return [MARK + w for w in text.split(" ")]
            return _WORD.findall((MARK if self.prefix else "") + text.replace(" ", MARK))
        return _WORD.findall(self.whole.normalizer.normalize_str(text))

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The pieces' bytes, markers as spaces, without the dummy prefix."""
        out = []
        for own in ids:
            text = b"".join(map(self.bytes_of.__getitem__, own.tolist())).decode("utf-8", "replace")
            if self.squeeze:
                text = text.lstrip(" ")
            out.append(text[1:] if self.prefix and text.startswith(" ") else text)
        return out


def _piece_bytes(piece: str, kind: int) -> bytes:
    if kind == BYTE:
        return bytes([int(piece[3:5], 16)])
    if kind == CONTROL:
        return b""
    return (" \u2047 " if kind == UNKNOWN else piece.replace(MARK, " ")).encode()


def verify(data: bytes, codec: Codec, probes: list[str] = PROBES) -> None:
    """Raise unless ids and decoded texts equal those of the sentencepiece library, for texts in words and whole."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_proto=data)
    for text, ids in zip(probes, codec.encode(probes)):
        expected = own.encode(text)
        whole = codec.whole.encode(text, add_special_tokens=False).ids if "<0x" not in text else expected
        if not expected == ids.tolist() == whole or own.decode(expected) != codec.decode([ids])[0]:
            raise ValueError(f"the rebuilt tokenizer differs on {text!r}: {ids.tolist()}, not {expected}")


def rebuild(data: bytes) -> tuple:
    """What Codec needs, from the bytes of a model file."""
    m = parse_model(data)
    cut = cuttable(m) and not any(kind == USER for _, _, kind in m.pieces)
    parts = build(m).to_str(), [[p, kind, s] for p, s, kind in m.pieces], cut, not m.charsmap and not m.squeeze, m.dummy_prefix, m.squeeze, m.kind == UNIGRAM
    verify(data, Codec(*parts))
    return parts


def load(path: str | None = None) -> tuple:
    """The same from the file at path (default: the public 32k piece model)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return rebuild(f.read())


OUT = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_byte_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
)


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", carry: list[str] | None = None, with_ids: bool = True, threads: int = THREADS) -> DataFrame:
    """docs with ids, their count and digest (SHA-256 of little-endian 32-bit ids), and the decoded text's digest.

    round_trip: the decoded text is the text itself (empty for null).
    """
    parts = load(path)
    shared = docs.sparkSession.sparkContext.broadcast(json.dumps(parts))  # a few MB, whatever the table
    fields = T.StructType([f for f in OUT.fields if with_ids or f.name != "ids"])
    made: list[Codec] = []

    def batch(texts: list) -> dict[str, list]:
        if not made:
            os.environ["TOKENIZERS_PARALLELISM"] = "true"
            os.environ["RAYON_NUM_THREADS"] = str(threads)
            made.append(Codec(*json.loads(shared.value)))
        codec = made[0]
        ids = codec.encode(texts)
        decoded = codec.decode(ids)
        return {
            "ids": ids if with_ids else None,
            "n_tokens": [len(x) for x in ids],
            "n_byte_tokens": [int(np.isin(x, codec.byte_ids).sum()) for x in ids],
            "ids_sha256": [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
            "round_trip": [x == (t or "") for x, t in zip(decoded, texts)],
        }

    return map_rows(docs, text_col, fields, batch, carry, as_bytes=False, rows_per_batch=256)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids; null ids give null."""
    parts = load(path)
    shared = encoded.sparkSession.sparkContext.broadcast(json.dumps(parts))
    made: list[Codec] = []

    @F.pandas_udf(T.StringType())
    def text_of(ids):
        import pandas as pd

        if not made:
            made.append(Codec(*json.loads(shared.value)))
        given = [x is not None for x in ids]
        texts = iter(made[0].decode([np.asarray(x) for x in ids if x is not None]))
        return pd.Series([next(texts) if g else None for g in given], dtype=object)

    return encoded.withColumn(out_col, text_of(F.col(ids_col)))


def query(docs: DataFrame) -> DataFrame:
    return encode(docs.select("doc_id", "text"), carry=["doc_id"], with_ids=False)
