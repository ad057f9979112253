"""FLAC media columns: lossless encoding of 8-bit samples, vectorised decoding, PCM blocks with offsets.

Frames are independent, and the seek table written here has a point for every
frame, so frames of many files are decoded side by side: one numpy step per
sample position, each step a gather over all frames. Files without a full
seek table are walked frame by frame. Header CRC-8, frame CRC-16, sample
counts and the MD5 of the samples are all verified.

The encoder chooses per frame among constant, verbatim and fixed predictors
(orders 0 to 2), or a linear predictor if asked for one; the decoder takes
constant, verbatim, fixed (0 to 4) and LPC subframes with either Rice coding.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal
files; repeated rows are encoded alike; an empty table gives an empty result;
input columns named like an output column are replaced by it. Media that fail
a check raise FlacError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import Scratch, map_rows

BLOCK = 1024
SAMPLE_RATE = 8000
BITS = 8
PAD = 64
#: Linear predictors that the query's files may use.
LPC_ORDER = 2
#: By how much they must beat the best fixed predictor.
LPC_GAIN = 1.2
# Fixed predictor coefficients by order (newest sample first), from the format.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
#: Frames worked on side by side; bounds memory for long payloads.
GROUP = 2048


class FlacError(ValueError):
    pass


def _crc_table(bits: int, poly: int) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c >> (bits - 1) else c << 1
        out[i] = c & ((1 << bits) - 1)
    return out


_CRC8 = _crc_table(8, 0x07)
_CRC16 = _crc_table(16, 0x8005)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16_many(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of buf[begin:end] for many ranges, one step per byte position."""
    order = np.argsort(begin - end, kind="stable")
    at, lengths = begin[order], (end - begin)[order]
    crc = np.zeros(len(begin), dtype=np.uint32)
    alive = len(at)
    # Ranges are sorted by length, longest first, so those still running are a prefix.
    ends_at = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    for step, alive in enumerate(ends_at.tolist()):
        c = crc[:alive]
        crc[:alive] = ((c << np.uint32(8)) & np.uint32(0xFFFF)) ^ _CRC16[(c >> np.uint32(8)) ^ buf[at[:alive] + step]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(n: int) -> bytes:
    """The format's coding of a frame number."""
    if n < 0x80:
        return bytes([n])
    parts: list[int] = []
    limit = 0x20
    while n >= limit * 2 or not parts:
        parts.append(0x80 | (n & 0x3F))
        n >>= 6
        if n < limit:
            break
        limit >>= 1
    lead = {1: 0xC0, 2: 0xE0, 3: 0xF0, 4: 0xF8, 5: 0xFC, 6: 0xFE}[len(parts)]
    return bytes([lead | n, *reversed(parts)])


def _read_utf8_number(buf, at: int) -> tuple[int, int]:
    b = int(buf[at])
    if b < 0x80:
        return b, at + 1
    extra = 0
    while b & (0x40 >> extra):
        extra += 1
    if not 1 <= extra <= 6:
        raise FlacError("bad frame number")
    n = b & (0x3F >> extra)
    for k in range(extra):
        c = int(buf[at + 1 + k])
        if c & 0xC0 != 0x80:
            raise FlacError("bad frame number")
        n = n << 6 | c & 0x3F
    return n, at + 1 + extra


def _frame_header(size: int, number: int) -> bytes:
    # Fixed block size stream, block size in 16 bits at the end, rate and sample size from STREAMINFO/8 bits, mono.
    head = bytes([0xFF, 0xF8, 0x70, 0x02]) + _utf8_number(number) + struct.pack(">H", size - 1)
    return head + bytes([crc8(head)])


def _residuals(x: np.ndarray, order: int) -> np.ndarray:
    """Differences of the given order along the rows."""
    return np.diff(x, n=order, axis=1) if order else x


def _lpc_fit(x: np.ndarray, order: int, precision: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares coefficients of every frame (a row each), as integers with a shift per frame."""
    past = np.stack([x[:, order - 1 - k : x.shape[1] - 1 - k] for k in range(order)], axis=2).astype(float)
    square = np.einsum("ntk,ntl->nkl", past, past) + np.eye(order) * 1e-6
    c = np.linalg.solve(square, np.einsum("ntk,nt->nk", past, x[:, order:].astype(float))[:, :, None])[:, :, 0]
    top = np.abs(c).max(axis=1)
    shift = np.where(top > 2**-20, np.clip(precision - 2 - np.floor(np.log2(np.maximum(top, 2**-20))), 0, 15), 0).astype(np.int64)
    limit = 2 ** (precision - 1)
    return np.clip(np.round(c * 2.0 ** shift[:, None]), -limit, limit - 1).astype(np.int64), shift


def _lpc_residuals(x: np.ndarray, c: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = c.shape[1]
    guess = sum(c[:, k : k + 1] * x[:, order - 1 - k : x.shape[1] - 1 - k] for k in range(order)) >> shift[:, None]
    return x[:, order:] - guess


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    """Write each value in ``width`` bits, most significant first."""
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def encode_many(payloads: list[bytes], block: int = BLOCK, lpc_order: int = 0) -> list[bytes]:
    """A FLAC file per payload; payload bytes are samples offset by 128."""
    lengths = np.array([len(p) for p in payloads], dtype=np.int64)
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    per_file = -(-lengths // block)
    n_frames = int(per_file.sum())
    file = np.repeat(np.arange(len(payloads)), per_file)
    number = np.arange(n_frames) - np.repeat(np.cumsum(per_file) - per_file, per_file)
    starts = np.repeat(np.cumsum(lengths) - lengths, per_file) + number * block
    sizes = np.minimum(block, lengths[file] - number * block)
    bodies: list[bytes | None] = [None] * n_frames
    # Frames of one size form a matrix; nearly all have the full block size.
    for size in np.unique(sizes).tolist():
        every = np.flatnonzero(sizes == size)
        for g in range(0, len(every), GROUP):
            own = every[g : g + GROUP]
            matrix = samples[starts[own][:, None] + np.arange(size)].astype(np.int64) - 128
            for i, body in zip(own.tolist(), _bodies(matrix, lpc_order)):
                bodies[i] = body
    out, at = [], 0
    heads = [_frame_header(int(s), int(n)) for s, n in zip(sizes, number)]
    joined = [h + b for h, b in zip(heads, bodies)]
    buf = np.frombuffer(b"".join(joined), dtype=np.uint8)
    ends = np.cumsum([len(j) for j in joined])
    crcs = crc16_many(buf, ends - np.array([len(j) for j in joined]), ends) if joined else []
    frames = [j + struct.pack(">H", int(c)) for j, c in zip(joined, crcs)]
    for i, payload in enumerate(payloads):
        own = frames[at : at + int(per_file[i])]
        at += int(per_file[i])
        raw = (np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()
        lens = [len(f) for f in own]
        info = struct.pack(">HH", block, block) + min(lens).to_bytes(3, "big") + max(lens).to_bytes(3, "big")
        info += (SAMPLE_RATE << 44 | 0 << 41 | (BITS - 1) << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(raw).digest()
        points, offset = [], 0
        for k, f in enumerate(own):
            points.append(struct.pack(">QQH", k * block, offset, min(block, len(payload) - k * block)))
            offset += len(f)
        table = b"".join(points)
        # A metadata block holds 2^24 - 1 bytes; a longer table goes on in further blocks.
        blocks = [bytes([0]) + len(info).to_bytes(3, "big") + info]
        step = (2**24 - 1) // 18 * 18
        for k in range(0, len(table), step):
            part = table[k : k + step]
            blocks.append(bytes([3]) + len(part).to_bytes(3, "big") + part)
        blocks[-1] = bytes([blocks[-1][0] | 0x80]) + blocks[-1][1:]
        out.append(b"fLaC" + b"".join(blocks) + b"".join(own))
    return out


def _bodies(x: np.ndarray, lpc_order: int) -> list[bytes]:
    """The subframes of frames of one size, padded to whole bytes."""
    n, size = x.shape
    out: list[bytes | None] = [None] * n
    constant = (x == x[:, :1]).all(axis=1)
    for i in np.flatnonzero(constant).tolist():
        out[i] = bytes([0, int(x[i, 0]) & 0xFF])
    rest = np.flatnonzero(~constant)
    if not len(rest):
        return out
    y = x[rest]
    orders = [o for o in (0, 1, 2) if size > o]
    cost = np.stack([np.abs(_residuals(y, o)).sum(axis=1) for o in orders], axis=1)
    best = np.argmin(cost, axis=1)
    if lpc_order and size > 2 * lpc_order:
        c, shift = _lpc_fit(y, lpc_order)
        residual = _lpc_residuals(y, c, shift)
        # The coefficients take some bits too, and a fixed predictor is undone faster.
        pick = np.flatnonzero(np.abs(residual).sum(axis=1) * LPC_GAIN + 16 * lpc_order < cost.min(axis=1))
        best[pick] = -1
        heads = np.concatenate((np.full((len(pick), 1), (32 | lpc_order - 1) << 1), y[pick, :lpc_order] & 0xFF), axis=1)
        extra = [(6, 4), (shift[pick], 5), *[(c[pick, k] & 0x7F, 7) for k in range(lpc_order)]]
        for i, body in zip(rest[pick].tolist(), _rice(heads, residual[pick], y[pick], extra)):
            out[i] = body
    for order in orders:
        pick = np.flatnonzero(best == order)
        if not len(pick):
            continue
        z = y[pick]
        heads = np.concatenate((np.full((len(pick), 1), (8 | order) << 1), z[:, :order] & 0xFF), axis=1)
        for i, body in zip(rest[pick].tolist(), _rice(heads, _residuals(z, order), z, [])):
            out[i] = body
    return out


def _rice(heads: np.ndarray, residual: np.ndarray, samples: np.ndarray, extra: list[tuple[np.ndarray | int, int]]) -> list[bytes]:
    """Subframes with one Rice partition each; verbatim where that is not longer."""
    n, m = residual.shape
    folded = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    totals = np.stack([m * (k + 1) + (folded >> k).sum(axis=1) for k in range(12)], axis=1)
    parameter = np.argmin(totals, axis=1)
    longest = (folded.max(axis=1, initial=0) >> parameter) if m else np.zeros(n, dtype=np.int64)
    fixed_bits = heads.shape[1] * 8 + sum(w for _, w in extra) + 2 + 4 + 4
    bits_of = fixed_bits + totals[np.arange(n), parameter]
    verbatim = (bits_of >= 8 * (samples.shape[1] + 1)) | (longest > 31)
    out: list[bytes] = [b""] * n
    for i in np.flatnonzero(verbatim).tolist():
        out[i] = bytes([2]) + (samples[i] & 0xFF).astype(np.uint8).tobytes()
    use = np.flatnonzero(~verbatim)
    if not len(use):
        return out
    size_bytes = (bits_of[use] + 7) // 8
    begin = np.cumsum(size_bytes) - size_bytes
    bits = np.zeros(int(size_bytes.sum()) * 8, dtype=np.uint8)
    at = begin * 8
    for col in range(heads.shape[1]):
        _put(bits, at, heads[use, col], 8)
        at = at + 8
    for value, width in extra:
        _put(bits, at, np.broadcast_to(value, n)[use], width)
        at = at + width
    # Rice with 4-bit parameters, partition order 0.
    _put(bits, at + 6, parameter[use], 4)
    at = at + 10
    k = parameter[use][:, None]
    high = folded[use] >> k
    width = high + 1 + k
    place = at[:, None] + np.cumsum(width, axis=1) - width + high
    bits[place.ravel()] = 1
    for p in np.unique(parameter[use]).tolist():
        rows = parameter[use] == p
        if p:
            _put(bits, place[rows].ravel() + 1, folded[use][rows].ravel(), p)
    packed = np.packbits(bits)
    for i, b, s in zip(use.tolist(), begin.tolist(), size_bytes.tolist()):
        out[i] = packed[b : b + s].tobytes()
    return out


class _Bits:
    """A scalar bit reader, for headers and for files without a full seek table."""

    def __init__(self, data: bytes, at: int):
        self.data, self.pos = data, at * 8

    def take(self, n: int) -> int:
        end = self.pos + n
        if end > len(self.data) * 8:
            raise FlacError("file ends within a frame")
        first, last = self.pos >> 3, (end + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (last * 8 - end)
        self.pos = end
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


@dataclass
class Stream:
    block: int
    total: int
    md5: bytes
    points: list[tuple[int, int, int]]
    audio: int


def read_metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("not a FLAC file")
    at, last, info, points = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise FlacError("file ends within its metadata")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if len(body) != size:
            raise FlacError("file ends within its metadata")
        at += 4 + size
        if kind == 0:
            info = body
        elif kind == 3:
            points += [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
    if info is None or len(info) != 34:
        raise FlacError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    if (packed >> 41 & 7) != 0 or (packed >> 36 & 31) != BITS - 1:
        raise FlacError("only one channel of 8-bit samples is read")
    return Stream(struct.unpack(">H", info[2:4])[0], packed & (1 << 36) - 1, info[18:34], points, at)


def _read_frame_header(data, at: int) -> tuple[int, int, int]:
    """(frame or sample number, samples, offset of the subframe) of a frame, its CRC-8 verified."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame where one is expected")
    size_code, rate_code = data[at + 2] >> 4, data[at + 2] & 15
    if data[at + 3] >> 4 or (data[at + 3] >> 1 & 7) not in (0, 1):
        raise FlacError("only one channel of 8-bit samples is read")
    number, i = _read_utf8_number(data, at + 4)
    if size_code == 6:
        size, i = data[i] + 1, i + 1
    elif size_code == 7:
        size, i = int.from_bytes(data[i : i + 2], "big") + 1, i + 2
    elif size_code == 1:
        size = 192
    elif 2 <= size_code <= 5:
        size = 576 << (size_code - 2)
    elif size_code >= 8:
        size = 256 << (size_code - 8)
    else:
        raise FlacError("reserved block size")
    i += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(bytes(data[at:i])) != data[i]:
        raise FlacError("frame header CRC does not match")
    return number, size, i + 1


def _walk(data: bytes, s: Stream) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Decode frame by frame, for files whose seek table does not name every frame."""
    out, spans, at, done = np.zeros(s.total, dtype=np.int64), [], s.audio, 0
    while done < s.total:
        _, size, body = _read_frame_header(data, at)
        r = _Bits(data, body)
        kind, wasted = r.take(7), r.take(1)
        if wasted:
            raise FlacError("wasted bits are not read")
        if kind == 0:
            x = [r.signed(8)] * size
        elif kind == 1:
            x = [r.signed(8) for _ in range(size)]
        else:
            x, c, shift = _scalar_prediction(r, kind)
            order = len(x)
            residual = _scalar_rice(r, size, order)
            for e in residual:
                x.append(e + (sum(a * b for a, b in zip(c, x[: -order - 1 : -1])) >> shift if order else 0))
        end = (r.pos + 7) >> 3
        if crc16_many(np.frombuffer(data, dtype=np.uint8), np.array([at]), np.array([end]))[0] != int.from_bytes(data[end : end + 2], "big"):
            raise FlacError("frame CRC does not match")
        out[done : done + size] = x
        spans.append((done, size))
        done, at = done + size, end + 2
    return out, spans


def _scalar_prediction(r: _Bits, kind: int) -> tuple[list[int], list[int], int]:
    if 8 <= kind <= 12:
        order = kind - 8
        return [r.signed(8) for _ in range(order)], FIXED[order], 0
    if kind < 32:
        raise FlacError("reserved subframe type")
    order = kind - 31
    warm = [r.signed(8) for _ in range(order)]
    precision = r.take(4) + 1
    shift = r.signed(5)
    if precision == 16 or shift < 0:
        raise FlacError("bad linear predictor")
    return warm, [r.signed(precision) for _ in range(order)], shift


def _scalar_rice(r: _Bits, size: int, order: int) -> list[int]:
    method = r.take(2)
    if method > 1:
        raise FlacError("reserved residual coding")
    width = 4 + method
    parts = 1 << r.take(4)
    out: list[int] = []
    for p in range(parts):
        count = size // parts - (order if p == 0 else 0)
        k = r.take(width)
        if k == (1 << width) - 1:
            raw = r.take(5)
            out += [r.signed(raw) if raw else 0 for _ in range(count)]
            continue
        for _ in range(count):
            v = r.unary() << k
            v |= r.take(k) if k else 0
            out.append(v >> 1 if not v & 1 else -(v >> 1) - 1)
    return out


def decode_many(files: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]], list[tuple[int, int]]]]:
    """Per file: its bytes, (first sample, samples) per frame, and (predictor, Rice parameter) per frame.

    The predictor is -2 for constant, -1 for verbatim, else its order (100 more for LPC); the parameter -1 if none.
    """
    metas = [read_metadata(f) for f in files]
    out: list = [None] * len(files)
    full = []
    for i, (f, s) in enumerate(zip(files, metas)):
        ends = [a + n for a, _, n in s.points]
        if s.points and s.points[0][:2] == (0, 0) and [a for a, _, _ in s.points[1:]] == ends[:-1] and ends[-1] == s.total:
            full.append(i)
        else:
            x, spans = _walk(f, s)
            out[i] = (x, spans, [])
    if full:
        for i, got in zip(full, _decode_full([files[i] for i in full], [metas[i] for i in full])):
            out[i] = got
    for i, s in enumerate(metas):
        signed = np.asarray(out[i][0], dtype=np.int8)
        if hashlib.md5(signed.tobytes()).digest() != s.md5:
            raise FlacError("the samples' MD5 does not match")
        out[i] = ((signed.view(np.uint8) ^ 0x80).tobytes(), *out[i][1:])
    return out


def _decode_full(files: list[bytes], metas: list[Stream]) -> list[tuple]:
    joined = b"".join(files)
    base = np.cumsum([0] + [len(f) for f in files])
    buf = np.frombuffer(joined + bytes(16), dtype=np.uint8)
    frame_at, frame_end, first, size, body, owner = [], [], [], [], [], []
    for i, (f, s) in enumerate(zip(files, metas)):
        offsets = [o for _, o, _ in s.points] + [len(f) - s.audio]
        for k, (a, o, n) in enumerate(s.points):
            number, got, sub = _read_frame_header(f, s.audio + o)
            if got != n or number != k or offsets[k + 1] < o + (sub - s.audio - o) + 3:
                raise FlacError("seek table and frames differ")
            frame_at.append(base[i] + s.audio + o)
            frame_end.append(base[i] + s.audio + offsets[k + 1])
            first.append(a)
            size.append(n)
            body.append(base[i] + sub)
            owner.append(i)
    at, end, size_a, body_a = (np.array(x, dtype=np.int64) for x in (frame_at, frame_end, size, body))
    stored = buf[end - 2].astype(np.uint32) << np.uint32(8) | buf[end - 1]
    if (crc16_many(buf, at, end - 2) != stored).any():
        raise FlacError("frame CRC does not match")
    if (buf[body_a] & 0x81).any():
        raise FlacError("wasted bits are not read")
    what = np.full((len(at), 2), -1, dtype=np.int64)
    decoded = []
    for g in range(0, len(at), GROUP):
        low, high = g, min(g + GROUP, len(at))
        origin, stop = int(at[low]), int(end[high - 1])
        part = np.concatenate((buf[origin:stop], np.zeros(16, dtype=np.uint8)))
        samples = _decode_group(part, body_a[low:high] - origin, size_a[low:high], end[low:high] - origin, what[low:high])
        if (samples < -128).any() or (samples > 127).any():
            raise FlacError("a sample leaves its 8 bits")
        decoded += [row[:n].astype(np.int8) for row, n in zip(samples, size_a[low:high].tolist())]
    out, at_frame = [], 0
    counts = np.bincount(np.array(owner), minlength=len(files))
    for c in counts.tolist():
        own = range(at_frame, at_frame + c)
        out.append((np.concatenate([decoded[j] for j in own]), [(first[j], size[j]) for j in own], [tuple(what[j].tolist()) for j in own]))
        at_frame += c
    return out


def _decode_group(buf: np.ndarray, body: np.ndarray, sizes: np.ndarray, ends: np.ndarray, what: np.ndarray) -> np.ndarray:
    """A row of samples per frame; ``what`` gets predictor and Rice parameter."""
    kind = buf[body] >> 1
    samples = np.zeros((len(body), int(sizes.max())), dtype=np.int64)
    for i in np.flatnonzero(kind == 0).tolist():
        samples[i, : sizes[i]] = buf[body[i] + 1 : body[i] + 2].view(np.int8)[0]
        what[i, 0] = -2
    for i in np.flatnonzero(kind == 1).tolist():
        samples[i, : sizes[i]] = buf[body[i] + 1 : body[i] + 1 + sizes[i]].view(np.int8)
    raw = buf.tobytes()
    simple, parameters, bit, predictors = [], [], [], []
    for i in np.flatnonzero(kind > 1).tolist():
        r = _Bits(raw, int(body[i]) + 1)
        warm, c, shift = _scalar_prediction(r, int(kind[i]))
        order = len(warm)
        what[i, 0] = order + (100 if kind[i] >= 32 else 0)
        here = r.pos
        method, parts = r.take(2), r.take(4)
        width = 4 + method
        k = r.take(width) if method < 2 else -1
        samples[i, :order] = warm
        if method < 2 and parts == 0 and k != (1 << width) - 1:
            simple.append(i)
            parameters.append(k)
            bit.append(r.pos)
            predictors.append((order, tuple(c), shift))
            what[i, 1] = k
            continue
        r.pos = here
        x = list(warm)
        for e in _scalar_rice(r, int(sizes[i]), order):
            x.append(e + (sum(a * b for a, b in zip(c, x[: -order - 1 : -1])) >> shift if order else 0))
        samples[i, : sizes[i]] = x
    if simple:
        _decode_rice(buf, np.array(simple), np.array(parameters), np.array(bit), predictors, sizes, ends, samples)
    return samples


def _decode_rice(buf, rows, k, bit, predictors, sizes, ends, samples) -> None:
    """Residuals of single-partition frames, side by side, then their predictors."""
    # Eight bytes from every byte on, most significant first.
    word = np.zeros(len(buf) - 8, dtype=np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | buf[j : j + len(word)]
    orders = np.array([p[0] for p in predictors], dtype=np.int64)
    left = sizes[rows] - orders
    order = np.argsort(-left, kind="stable")
    rows, k, bit, left, orders = rows[order], k[order].astype(np.int64), bit[order].astype(np.int64), left[order], orders[order]
    residual = np.zeros((len(rows), int(left[0])), dtype=np.int64)
    alive_at = np.searchsorted(-left, -np.arange(1, left[0] + 1), side="right")
    mask = (np.int64(1) << k) - 1
    top = (len(word) - 1) * 8
    for step, alive in enumerate(alive_at.tolist()):
        b = bit[:alive]
        if b.max(initial=0) > top:
            raise FlacError("file ends within a frame")
        # 57 bits from b on; the first 32 say how long the unary part is.
        peek = word[b >> 3] << (b & 7).astype(np.uint64)
        lead = (peek >> np.uint64(32)).astype(np.int64)
        if (lead == 0).any():
            raise FlacError("a unary part of more than 31 bits")
        high = 32 - np.frexp(lead.astype(np.float64))[1].astype(np.int64)
        kk = k[:alive]
        after = b + high + 1
        low = (word[after >> 3] << (after & 7).astype(np.uint64)) >> np.uint64(32)
        low = (low.astype(np.int64) >> (32 - kk)) & mask[:alive]
        v = (high << kk) | low
        residual[:alive, step] = (v >> 1) ^ -(v & 1)
        bit[:alive] = after + kk
    if ((bit + 7) // 8 != ends[rows] - 2).any():
        raise FlacError("a frame's length does not match its samples")
    groups: dict[tuple, list[int]] = {}
    for i, j in enumerate(order.tolist()):
        p, c, shift = predictors[j]
        fixed = shift == 0 and list(c) == FIXED[p] if p < len(FIXED) else False
        # Linear predictors of one order are undone together, whatever their coefficients.
        groups.setdefault((p, c, 0) if fixed else (p, None, None), []).append(i)
    for (p, c, shift), own in groups.items():
        own = np.array(own)
        target = samples[rows[own]]
        if p == 0:
            target[:, : residual.shape[1]] = residual[own][:, : target.shape[1]]
        elif c is not None and p <= 2:
            # A fixed predictor undone by running sums, from the warm-up's own differences.
            start = [np.diff(target[:, :p], n=d, axis=1)[:, -1] for d in range(p)]
            x = residual[own]
            for d in range(p - 1, -1, -1):
                x = np.cumsum(x, axis=1) + start[d][:, None]
            room = min(target.shape[1] - p, x.shape[1])
            target[:, p : p + room] = x[:, :room]
        else:
            every = [predictors[j] for j in order[own].tolist()]
            factors = np.array([e[1] for e in every], dtype=np.int64).T
            shifts = np.array([e[2] for e in every], dtype=np.int64)
            # A row per point of time, so that a step reads and writes whole rows.
            x, r = np.ascontiguousarray(target.T), np.ascontiguousarray(residual[own].T)
            for t in range(int(left[own].max())):
                guess = factors[0] * x[p + t - 1]
                for d in range(1, p):
                    guess += factors[d] * x[p + t - 1 - d]
                x[p + t] = r[t] + (guess >> shifts)
            target = x.T
        # Beyond a frame's own size the running sums go on; those cells are no samples.
        target[np.arange(target.shape[1])[None, :] >= sizes[rows[own]][:, None]] = 0
        samples[rows[own]] = target


def padded(text: bytes | None) -> bytes:
    """The text with zero bytes up to a positive multiple of PAD."""
    text = text or b""
    return text + bytes(-len(text) % PAD or (0 if text else PAD))


MEDIA = T.StructType([T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())])
FEATURES = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)
BLOCKS = T.ArrayType(T.StructType([T.StructField("sample", T.LongType()), T.StructField("pcm", T.BinaryType())]))
ROWS = 512


def encode(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, lpc_order: int = 0) -> DataFrame:
    """docs with ``media``, a FLAC file of the text's padded bytes, and ``n_bytes``, the bytes of the text."""

    def batch(texts: list) -> dict[str, list]:
        return {"media": encode_many([padded(t) for t in texts], lpc_order=lpc_order), "n_bytes": [len(t or b"") for t in texts]}

    return map_rows(docs, text_col, MEDIA, batch, carry, rows_per_batch=ROWS)


def pcm_blocks(media: DataFrame, media_col: str = "media", carry: list[str] | None = None) -> DataFrame:
    """media with ``blocks``: the decoded bytes of each frame with the offset of its first sample."""

    def batch(files: list) -> dict[str, list]:
        return {"blocks": [[{"sample": a, "pcm": x[a : a + n]} for a, n in spans] for x, spans, _ in decode_many(files)]}

    return map_rows(media, media_col, T.StructType([T.StructField("blocks", BLOCKS)]), batch, carry, rows_per_batch=ROWS)


def features(media: DataFrame, media_col: str = "media", carry: list[str] | None = None) -> DataFrame:
    """media with FEATURES of what its files hold, after decoding and verifying them.

    feature: frames, sum of absolute steps between samples, and how often each predictor was used.
    """

    def batch(files: list) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in FEATURES.fields}
        for f, (samples, spans, what) in zip(files, decode_many(files)):
            # The blocks in the order of their offsets, each where the one before ends.
            at = 0
            for offset, n in sorted(spans):
                if offset != at:
                    raise FlacError("a block is missing")
                at += n
            x = samples[:at]
            steps = int(np.abs(np.diff(np.frombuffer(x, dtype=np.uint8).astype(np.int64))).sum())
            used = sorted({p: sum(q == p for q, _ in what) for p, _ in what}.items())
            out["payload_bytes"].append(len(x))
            out["payload_sha256"].append(hashlib.sha256(x).hexdigest())
            out["tail_crc32"].append(zlib.crc32(x[-PAD:]))
            out["media_bytes"].append(len(f))
            out["media_sha256"].append(hashlib.sha256(f).hexdigest())
            out["feature"].append(f"frames={len(spans)};steps={steps};predictors=" + ",".join(f"{p}:{n}" for p, n in used))
        return out

    return map_rows(media, media_col, FEATURES, batch, carry, rows_per_batch=ROWS)


def query(docs: DataFrame) -> DataFrame:
    media = Scratch(docs.sparkSession, "flac").write(encode(docs.select("doc_id", "text"), carry=["doc_id"], lpc_order=LPC_ORDER), "media")
    return features(media, carry=["doc_id", "n_bytes"]).select("doc_id", "n_bytes", *[f.name for f in FEATURES.fields])
