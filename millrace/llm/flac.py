"""FLAC media column: 8-bit mono streams, encoded and decoded in numpy over many frames at once.

Encoding picks for each frame a constant, verbatim, fixed (order 0-4) or, if asked for, LPC subframe
with Rice-coded residuals. Every stream has a seek table with one point per frame, so that a frame is
found by its sample offset and frames decode independently; however long a stream is, `GROUP` frames are
encoded or decoded at once. Decoding reads the streams' bytes alone:
it parses frame headers, checks their CRC-8 and the frames' CRC-16, decodes the Rice residuals of all
frames in step, one sample of every frame at a time, undoes the predictors, and checks the MD5 of the
samples. A stream without a seek table is walked frame by frame. Any mismatch raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, texts

FRAME = 1024
RATE = 8000
#: Payload bytes that a worker encodes or decodes at once (or one longer stream).
CHUNK = 2 << 20
#: Frames that are encoded or decoded at once, and bytes in which the next frame of a stream without a seek table must end.
GROUP, REACH = 2048, 1 << 18
#: Order of the linear predictors that the media column's encoder tries beside the fixed ones.
ORDER = 4
#: Coefficient precision of LPC subframes, in bits.
PRECISION = 12


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c >> (bits - 1) else c << 1
            c &= (1 << bits) - 1
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(buf: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
    """CRCs of buf[start:end] for many ranges; leading zeros leave a CRC of 0 as it is."""
    crc = np.zeros(len(start), np.uint16)
    for back in range(int((end - start).max(initial=0)), 0, -1):
        at = end - back
        byte = np.where(at >= start, buf[np.maximum(at, 0)], 0)
        crc = CRC8[crc ^ byte] if bits == 8 else (crc << np.uint16(8)) ^ CRC16[(crc >> np.uint16(8)) ^ byte]
    return crc


def _number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *tail[::-1]])


@lru_cache(1 << 16)
def _header(number: int, size: int) -> bytes:
    code, tail = (0b1010, b"") if size == FRAME else (0b0111, struct.pack(">H", size - 1))
    head = bytes([0xFF, 0xF8, code << 4 | 0b0100, 0b0010]) + _number(number) + tail
    raw = np.frombuffer(head, np.uint8)
    return head + bytes([int(_crc(raw, np.array([0]), np.array([len(head)]), 8)[0])])


def _lpc(s: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors of each row by the autocorrelation method: (coefficients, shift)."""
    x = np.where(np.arange(s.shape[1]) < n[:, None], s, 0).astype(float)
    r = np.stack([(x[:, k:] * x[:, : x.shape[1] - k]).sum(1) for k in range(order + 1)], 1)
    r[:, 0] = r[:, 0] * 1.0001 + 1
    a = np.linalg.solve(np.stack([np.stack([r[:, abs(i - j)] for j in range(order)], 1) for i in range(order)], 1), r[:, 1:, None])[:, :, 0]
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(np.abs(a).max(1) + 1e-9)), 0, 14).astype(np.int64)
    top = (1 << PRECISION - 1) - 1
    return np.clip(np.rint(a * 2.0 ** shift[:, None]), -top, top).astype(np.int64), shift


def encode(payloads: list[bytes], lpc_order: int = 0) -> list[bytes]:
    """FLAC streams of byte strings; a byte b is the sample b - 128. lpc_order > 0 also tries LPC of that order."""
    places = [(k, at) for k, p in enumerate(payloads) for at in range(0, len(p), FRAME)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for first in range(0, len(places), GROUP):
        some = places[first : first + GROUP]
        frames = [payloads[k][at : at + FRAME] for k, at in some]
        raw = [_header(at // FRAME, len(f)) + b for (_, at), f, b in zip(some, frames, _subframes(frames, lpc_order), strict=True)]
        ends = np.cumsum([0, *map(len, raw)])
        crc = _crc(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:], 16)
        for (k, _), r, c in zip(some, raw, crc, strict=True):
            out[k].append(r + struct.pack(">H", int(c)))
    return [_stream(p, f) for p, f in zip(payloads, out, strict=True)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames] or [0]
    info = struct.pack(">HH", FRAME, FRAME) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + _md5(payload[k : k + CHUNK] for k in range(0, len(payload), CHUNK))
    seek, at = [], 0
    for k, f in enumerate(frames):
        seek.append(struct.pack(">QQH", k * FRAME, at, min(FRAME, len(payload) - k * FRAME)))
        at += len(f)
    table = b"".join(seek)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


_FLIP = bytes(b ^ 128 for b in range(256))


def _md5(parts: Iterable[bytes]) -> bytes:
    """The MD5 of the signed samples."""
    out = hashlib.md5()
    for p in parts:
        out.update(p.translate(_FLIP))
    return out.digest()


def _subframes(frames: list[bytes], lpc_order: int) -> list[bytes]:
    n = np.fromiter(map(len, frames), np.int64, len(frames))
    width = int(n.max())
    s = np.zeros((len(n), width), np.int32)
    on = np.arange(width) < n[:, None]
    s[on] = np.frombuffer(b"".join(frames), np.uint8).astype(np.int32) - 128
    rows = np.arange(len(n))

    # the predictor with the smallest residuals
    res, cost, d = [], [], s
    for p in range(5):
        valid = on.copy()
        valid[:, :p] = False
        full = np.zeros_like(s)
        full[:, p:] = d
        res.append(np.where(valid, full, 0))
        cost.append(np.where(n > p, np.abs(res[-1]).sum(1), 1 << 40))
        d = np.diff(d, axis=1)
    if lpc_order:
        coef, shift = _lpc(s, n, lpc_order)
        pred = sum(coef[:, j, None] * np.pad(s, ((0, 0), (j + 1, 0)))[:, :width] for j in range(lpc_order)) >> shift[:, None]
        valid = on.copy()
        valid[:, :lpc_order] = False
        res.append(np.where(valid, s - pred, 0).astype(np.int32))
        cost.append(np.where(n > lpc_order, np.abs(res[-1]).sum(1) + lpc_order * PRECISION, 1 << 40))
    best = np.argmin(np.stack(cost), 0)
    order = np.where(best == 5, lpc_order, best)
    r = res[0]
    for p in range(1, len(res)):
        r[best == p] = res[p][best == p]
    u = ((r << 1) ^ (r >> 31)).astype(np.int32)
    bits = np.stack([(u >> k).sum(1) + (n - order) * (k + 1) for k in range(13)])
    k = bits.argmin(0)
    extra = np.where(best == 5, 9 + lpc_order * PRECISION, 0)
    verbatim = bits.min(0) + 10 + 8 * order + extra >= 8 * n
    constant = np.where(on, s == s[:, :1], True).all(1)
    order = np.where(verbatim, n, order)
    order = np.where(constant, n, order)
    k, extra = np.where(verbatim | constant, 0, k), np.where(verbatim | constant, 0, extra)
    kind = np.where(best == 5, 32 + lpc_order - 1, 8 + best)
    kind = np.where(constant, 0, np.where(verbatim, 1, kind))
    coded = ~(verbatim | constant)

    # every code has a value of few bits behind zeros: its length, and the place of its last bit
    col = np.arange(width)
    warm = col < order[:, None]
    length = np.where(warm, 8, (u >> k[:, None]) + 1 + k[:, None])
    value = np.where(warm, s & 255, (1 << k[:, None]) | (u & ((1 << k[:, None]) - 1)))
    length[~on | (constant[:, None] & (col > 0))] = 0
    end = 8 + np.cumsum(length, 1) + np.where(warm, 0, 10 + extra[:, None])
    total = end[rows, n - 1]
    size = (total + 7) >> 3
    base = np.cumsum(size) - size
    use = length > 0
    places, values = [(end + 8 * base[:, None])[use], 8 * base + 8], [value[use], kind << 1]
    c = np.flatnonzero(coded)
    places.append(8 * base[c] + 8 + 8 * order[c] + extra[c] + 10)
    values.append(k[c])  # method 0, one partition, parameter k
    for f in np.flatnonzero(coded & (best == 5)):
        at = 8 * base[f] + 8 + 8 * order[f]
        places.append(at + np.array([4, 9, *(9 + PRECISION * (j + 1) for j in range(lpc_order))]))
        values.append(np.array([PRECISION - 1, shift[f], *(coef[f] & ((1 << PRECISION) - 1))]))
    place, val = np.concatenate(places) - 1, np.concatenate(values).astype(np.int64)
    val <<= 7 - (place & 7)
    byte, out = place >> 3, np.zeros(int(size.sum()) + 3, np.uint8)
    for back in range(3):
        part = (val >> (8 * back)) & 255
        hit = part > 0
        out[:] |= np.bincount(byte[hit] - back + 2, part[hit], len(out))[: len(out)].astype(np.uint8) if hit.any() else 0
    raw = out[2:].tobytes()
    return [raw[a : a + b] for a, b in zip(base.tolist(), size.tolist(), strict=True)]


class _Bits:
    """Reads numbers at bit positions of many frames at once."""

    def __init__(self, buf: np.ndarray):
        pad = np.concatenate([buf, np.zeros(16, np.uint8)])
        self.words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(pad, 8)).view(">u8").reshape(-1).astype(np.uint64)

    def window(self, pos: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(pos >> 3, len(self.words) - 1)] << (pos & 7).astype(np.uint64)

    def take(self, pos: np.ndarray, bits) -> np.ndarray:
        b = np.asarray(bits, np.uint64)
        return ((self.window(pos) >> np.uint64(1)) >> (np.uint64(63) - b)).astype(np.int64)

    def signed(self, pos: np.ndarray, bits) -> np.ndarray:
        v = self.take(pos, bits)
        return v - ((v >> (bits - 1)) << bits)


def _frames(buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The frames that begin at start: (samples, one row each; their counts; frame numbers; ends)."""
    bits = _Bits(buf)
    at = lambda k: buf[np.minimum(start + k, len(buf) - 1)].astype(np.int64)
    if ((at(0) != 0xFF) | (at(1) != 0xF8)).any():
        raise ValueError("no frame of fixed block size where one should begin")
    if (at(3) != 0b0010).any():
        raise ValueError("only 8-bit mono is supported")
    code, lead = at(2) >> 4, at(4)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], range(6), 6)
    number = np.where(more == 0, lead, lead & ((1 << np.maximum(6 - more, 0)) - 1))
    for k in range(1, 7):
        number = np.where(more >= k, number << 6 | at(4 + k) & 0x3F, number)
    pos = start + 5 + more
    here = lambda k: buf[np.minimum(pos + k, len(buf) - 1)].astype(np.int64)
    n = np.select([code == 1, code == 6, code == 7, (code >= 2) & (code <= 5), code >= 8], [192 + 0 * code, here(0) + 1, (here(0) << 8 | here(1)) + 1, 576 << np.maximum(code - 2, 0), 256 << np.maximum(code - 8, 0)], 0)
    pos = pos + np.select([code == 6, code == 7], [1, 2], 0)
    if (n == 0).any() or ((at(2) & 15) > 11).any():
        raise ValueError("unsupported frame header")
    if (_crc(buf, start, pos, 8) != buf[np.minimum(pos, len(buf) - 1)]).any():
        raise ValueError("frame header CRC-8 differs")
    pos = 8 * (pos + 1)
    head = bits.take(pos, 8)
    pos = pos + 8
    kind = head >> 1
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if ((head & 129) != 0).any() or (~(fixed | lpc | (kind <= 1))).any():
        raise ValueError("unsupported subframe")
    order = np.select([kind == 0, kind == 1, fixed], [1 + 0 * n, n, kind - 8], kind - 31)
    width = int(n.max())
    s = np.zeros((width, len(n)), np.int64)
    for k in range(int(order.max())):
        f = np.flatnonzero(order > k)
        s[k, f] = bits.signed(pos[f], 8)
        pos[f] += 8
    f = np.flatnonzero(lpc)
    coef, shift, prec = np.zeros((len(n), int(order[f].max(initial=0))), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    prec[f], shift[f] = bits.take(pos[f], 4) + 1, bits.signed(pos[f] + 4, 5)
    pos[f] += 9
    for k in range(coef.shape[1]):
        g = f[order[f] > k]
        coef[g, k] = bits.signed(pos[g], prec[g])
        pos[g] += prec[g]
    if (shift < 0).any():
        raise ValueError("negative predictor shift")
    _residuals(bits, pos, s, np.flatnonzero(fixed | lpc), n, order)
    for p in range(1, 5):  # fixed predictors: order p sums up p times
        g = np.flatnonzero(fixed & (order == p))
        if len(g):
            x, warm = s[:, g], s[:p, g]
            for q in range(p, 0, -1):
                x[q - 1] = np.diff(warm[:q], n=q - 1, axis=0)[-1]  # the difference of order q - 1 that ends here
                x[q - 1 :] = np.cumsum(x[q - 1 :], 0)
            s[:, g] = x
    if len(f):
        top = int(order[f].max())
        for t in range(1, int(n[f].max())):
            g = f[(order[f] <= t) & (n[f] > t)]
            back = np.maximum(t - 1 - np.arange(top)[:, None], 0)
            s[t, g] += (coef[g].T * s[back, g[None, :]]).sum(0) >> shift[g]
    s = np.where(kind == 0, s[:1], s).T
    end = (pos + 7) >> 3
    if (end + 2 > len(buf)).any() or (_crc(buf, start, end, 16) != (buf[end].astype(np.uint16) << 8 | buf[end + 1])).any():
        raise ValueError("frame CRC-16 differs")
    return s, n, number, end + 2


def _residuals(bits: _Bits, pos: np.ndarray, s: np.ndarray, f: np.ndarray, n: np.ndarray, order: np.ndarray) -> None:
    """Fills s from row order on with the Rice-coded residuals of frames f, all in step; pos ends behind them."""
    if not len(f):
        return
    method, parts = bits.take(pos[f], 2), bits.take(pos[f] + 2, 4)
    if (method > 1).any() or ((n[f] >> parts) << parts != n[f]).any():
        raise ValueError("unsupported residual coding")
    if (n[f] <= order[f]).any():
        raise ValueError("a frame is shorter than its predictor")
    wide, lane, last = 4 + method, f.copy(), n[f]
    at, p, nth = order[f].copy(), pos[f] + 6, n[f] >> parts
    k, raw = np.zeros(len(f), np.int64), np.full(len(f), -1)
    ahead, until = nth.copy(), at.copy()  # where the partition after next, and the next one, begins
    one = np.uint64(1)
    while len(lane):
        new = np.flatnonzero(at == until)
        k[new] = bits.take(p[new], wide[new])
        p[new] += wide[new]
        esc = new[k[new] == (1 << wide[new]) - 1]
        raw[new] = -1
        raw[esc] = bits.take(p[esc], 5)
        p[esc] += 5
        until[new] = ahead[new]
        ahead[new] += nth[new]
        plain, tail = not (raw >= 0).any(), np.uint64(63) - k.astype(np.uint64)
        for _ in range(int((until - at).min())):
            w = bits.words[p >> 3] << (p & 7).astype(np.uint64)
            q = 32 - np.frexp((w >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
            if (q >= 32).any():
                q = _long_unary(bits, p, q)
                w = bits.window(p + q - np.minimum(q, 31))
                small = np.minimum(q, 31)
            else:
                small = q
            u = q << k | (((w << (small + 1).astype(np.uint64)) >> one) >> tail).astype(np.int64)
            v, used = (u >> 1) ^ -(u & 1), q + 1 + k
            if not plain:
                e = np.flatnonzero(raw >= 0)
                z = raw[e]
                v[e] = np.where(z > 0, bits.signed(p[e], np.maximum(z, 1)), 0)
                used[e] = z
            s[at, lane] = v
            p += used
            at += 1
            if (p >> 3 >= len(bits.words)).any():
                raise ValueError("residuals run past the end")
        if (done := at >= last).any():
            pos[lane[done]] = p[done]
            on = ~done
            lane, last, at, p, nth, k, raw, until, ahead, wide = (x[on] for x in (lane, last, at, p, nth, k, raw, until, ahead, wide))


def _long_unary(bits: _Bits, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The lengths of zero runs of 32 bits and more."""
    q = q.copy()
    todo = np.flatnonzero(q >= 32)
    q[todo] = 32
    while len(todo):
        if ((p[todo] + q[todo]) >> 3 >= len(bits.words)).any():
            raise ValueError("residuals run past the end")
        more = 32 - np.frexp((bits.window(p[todo] + q[todo]) >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
        q[todo] += np.minimum(more, 32)
        todo = todo[more >= 32]
    return q


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its PCM blocks: (offset of the first sample, samples as unsigned bytes)."""
    buf, starts, own, info, base = np.frombuffer(b"".join(streams), np.uint8), [], [], [], 0
    for k, m in enumerate(streams):
        if m[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, points, head = 4, False, [], None
        while not last:
            last, kind, size = m[at] >> 7, m[at] & 127, int.from_bytes(m[at + 1 : at + 4], "big")
            body = m[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                head = (struct.unpack(">H", body[:2])[0], packed & (1 << 36) - 1, body[18:34])
            elif kind == 3:
                points = [x for x in struct.iter_unpack(">QQH", body) if x[0] < 1 << 63]
            at += 4 + size
        info.append((head, at, base, len(m)))
        offsets = sorted({x[1] for x in points} | ({0} if at < len(m) else set()))
        starts += [base + at + x for x in offsets]
        own += [k] * len(offsets)
        base += len(m)
    got: list[dict[int, tuple[int, bytes]]] = [{} for _ in streams]  # by where a frame begins: its end and samples
    start, own = np.array(starts, np.int64), np.array(own, np.int64)
    while len(start):
        more, by = [], np.argsort(start, kind="stable")
        start, own = start[by], own[by]
        if start[-1] >= len(buf):
            raise ValueError("a seek point lies behind the stream")
        for first in range(0, len(start), GROUP):  # a group lies in one slice of the bytes
            part, of = start[first : first + GROUP], own[first : first + GROUP]
            lo = int(part[0])
            hi = int(part[-1]) + REACH  # no frame is longer: it has 65535 samples of 8 bits at most
            s, n, number, end = _frames(buf[lo:hi], part - lo)
            end = end + lo
            pcm = (s + 128).astype(np.uint8)
            for i, k in enumerate(of.tolist()):
                head, _, b, size = info[k]
                a = int(part[i])
                got[k][a] = (int(number[i]) * head[0], int(end[i]), pcm[i, : n[i]].tobytes())
                if end[i] < b + size:
                    more.append((int(end[i]), k))
            del s, pcm
        more = [x for x in dict.fromkeys(more) if x[0] not in got[x[1]]]
        start, own = np.array([x[0] for x in more], np.int64), np.array([x[1] for x in more], np.int64)
    out = []
    for (head, at, b, size), frames in zip(info, got, strict=True):
        blocks, want, where = [], 0, b + at
        for a in sorted(frames):
            offset, end, pcm = frames[a]
            if a != where or offset != want:
                raise ValueError("frames don't follow each other")
            blocks.append((offset, pcm))
            want, where = want + len(pcm), end
        if where != b + size or want != head[1] or _md5(x for _, x in blocks) != head[2]:
            raise ValueError("the samples differ from the stream's MD5 or count")
        out.append(blocks)
    return out


def padded(text: bytes, unit: int = 64) -> bytes:
    """text with zero bytes up to a positive multiple of unit."""
    return text + bytes(-len(text) % unit or (0 if text else unit))


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of items of `CHUNK` bytes, or of one larger item at the end."""
    at, size = 0, 0
    for k, x in enumerate(sizes):
        size += x
        if size >= CHUNK or k == len(sizes) - 1:
            yield at, k + 1
            at, size = k + 1, 0


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded, as a FLAC stream. A null text counts as empty.

    Rows with null or repeated ids come back as they are; an empty table gives no rows; other columns are
    ignored, so their names don't matter. Very long texts are one stream, encoded a group of frames at a time.
    Equal texts give equal streams: of predictors that do equally well the simplest is taken.
    """

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = b.column(1)
        size = [len(t.as_buffer()) if t.is_valid else 0 for t in text]
        for a, z in _chunks(size):
            raw = [padded(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in text.slice(a, z - a)]
            media = encode(raw, ORDER)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(size[a:z], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    docs = texts(df, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return in_arrow(docs, run, f"id {docs.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(id, sample_offset, n_samples, pcm binary): the decoded blocks of each stream, to be written and sought by offset; a null stream has none."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
        ids, raw = zip(*[(i, m) for i, m in zip(ids, raw, strict=True) if m is not None], strict=True) if any(m is not None for m in raw) else ((), ())
        for a, z in _chunks([len(m) for m in raw]):
            rows = [(i, o, len(p), p) for i, blocks in zip(ids[a:z], decode(list(raw[a:z])), strict=True) for o, p in blocks]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema[0].type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["id", "sample_offset", "n_samples", "pcm"])

    it = media.select("id", "media")
    return in_arrow(it, run, f"id {it.schema[0].dataType.simpleString()}, sample_offset long, n_samples long, pcm binary")


def read_back(media: DataFrame) -> DataFrame:
    """Digests and features of the decoded streams of encode_column(): one row for each stream.

    feature: samples, blocks, zero crossings, sum of absolute values and largest step, of the signed samples.
    A damaged stream raises ValueError. Repeated rows come back as often; an empty table gives no rows; long
    streams are decoded a group of frames at a time.
    """
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        streams = b.column(2)
        for a, z in _chunks([len(m.as_buffer()) for m in streams]):
            raw, rows = [m.as_buffer().to_pybytes() for m in streams.slice(a, z - a)], []
            for m, blocks in zip(raw, decode(raw), strict=True):
                sha, n, crossings, level, largest, last = hashlib.sha256(), 0, 0, 0, 0, None
                for _, p in blocks:
                    sha.update(p)
                    x = np.frombuffer(p, np.uint8).astype(np.int16) - 128
                    level += int(np.abs(x).sum(dtype=np.int64))
                    x = x if last is None else np.concatenate([[last], x])
                    crossings += int(((x[1:] < 0) != (x[:-1] < 0)).sum())
                    largest = max(largest, int(np.abs(np.diff(x)).max(initial=0)))
                    n, last = n + len(p), x[-1]
                tail = b"".join(p for _, p in blocks[-2:])[-64:]
                rows.append((n, sha.hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), f"{n}:{len(blocks)}:{crossings}:{level}:{largest}"))
            cols = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), *cols], names=names)

    it = media.select("id", "n_bytes", "media")
    return in_arrow(it, run, f"id {it.schema[0].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
