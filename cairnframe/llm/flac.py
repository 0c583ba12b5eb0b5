"""FLAC streams: an encoder and a checking decoder that work on many frames at once.

Both follow the public format (RFC 9639). A worker lays the frames of many streams
side by side: every step of the decoder reads one Rice code of each frame, so the
sequential codes cost array operations over frames and not a Python loop over samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches

BLOCK = 1024
UNIT = 64
#: Bytes of payload that are coded or decoded at once.
BYTES = 1 << 21
LPC_ORDER, PRECISION = 4, 10
RATE = 8000

MEDIA = "doc_id long, n_bytes long, media binary"
BLOCKS = "doc_id long, block int, sample_offset long, byte_offset long, samples int, pcm binary, error string"
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


class _Crc:
    """A CRC with start value 0 of many rows at once: each byte adds a value that depends on its distance from the end."""

    def __init__(self, width: int, poly: int):
        table = []
        for value in range(256):
            value <<= width - 8
            for _ in range(8):
                value = (value << 1) ^ (poly if value >> (width - 1) & 1 else 0)
            table.append(value & ((1 << width) - 1))
        self.width, self.table = width, np.array(table, np.uint16)
        self.at = self.table[None, :]

    def _reach(self, length: int) -> None:
        rows = [self.at[-1]]
        while len(self.at) + len(rows) - 1 < length:
            last = rows[-1]
            high = last >> np.uint16(self.width - 8)
            rows.append(((last << np.uint16(8)) & np.uint16((1 << self.width) - 1)) ^ self.table[high] if self.width > 8 else self.table[last])
        self.at = np.concatenate([self.at, np.array(rows[1:]).reshape(-1, 256)])

    def of(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC of ``buffer[start:end]`` for each pair."""
        longest = int((ends - starts).max(initial=0))
        if longest > len(self.at):
            self._reach(longest)
        out = np.empty(len(starts), np.uint16)
        for first in range(0, len(starts), 512):
            s, e = starts[first : first + 512], ends[first : first + 512]
            back = np.arange(int((e - s).max(initial=0)))
            place = e[:, None] - 1 - back
            values = np.where(place >= s[:, None], buffer[np.maximum(place, 0)], 0)
            out[first : first + 512] = np.bitwise_xor.reduce(self.at[back, values], axis=1)
        return out


_CRC8, _CRC16 = _Crc(8, 0x07), _Crc(16, 0x8005)


def _coded_number(number: int) -> bytes:
    """A frame number in the format's extension of UTF-8."""
    if number < 0x80:
        return bytes([number])
    tail = []
    while not tail or number >= 1 << (6 - len(tail)):
        tail.append(0x80 | number & 0x3F)
        number >>= 6
    return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | number, *reversed(tail)])


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
    """Write ``value`` in ``width`` bits at each position, most significant bit first."""
    width = np.broadcast_to(width, at.shape)
    for j in range(int(width.max(initial=0))):
        on = width > j
        bits[at[on] + j] = (value[on] >> (width[on] - 1 - j)) & 1


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear prediction coefficients and shifts, by autocorrelation and the Levinson recursion."""
    f = x.astype(np.float64)
    r = np.array([(f[:, k:] * f[:, : f.shape[1] - k]).sum(axis=1) for k in range(LPC_ORDER + 1)])
    error, a = r[0] * (1 + 1e-9) + 1e-9, np.zeros((LPC_ORDER, len(x)))
    for i in range(LPC_ORDER):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / error
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(axis=0), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)).astype(int), 0, 15)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.round(a * 2.0**shift), -limit, limit - 1).astype(np.int32), shift


def _rice(z: np.ndarray, order: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Best Rice parameter of each partition, and the bits that all codes then take."""
    size = z.shape[1] // parts
    count = np.full((len(z), parts), size) - np.where(np.arange(parts) == 0, order[:, None], 0)
    blocks = z.reshape(len(z), parts, size)
    cost = np.array([(blocks >> k).sum(axis=2) + count * (k + 1) for k in range(10)])
    return cost.argmin(axis=0), cost.min(axis=0).sum(axis=1) + 4 * parts


def _subframes(x: np.ndarray, bits_per_sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits (one a byte) of each row's subframe, as one array and the row's offsets."""
    rows, n = x.shape
    x = x.astype(np.int32)
    parts = 1
    while parts < 4 and n % (parts * 2 * UNIT) == 0:
        parts *= 2

    sums, residuals, now = [], [], x
    for order in range(5):
        full = np.zeros_like(x)
        full[:, order:] = now
        residuals.append(full)
        sums.append(np.abs(now).sum(axis=1))
        now = np.diff(now, axis=1)
    order = np.argmin(sums, axis=0)
    fixed = np.choose(order[:, None], residuals)
    coefficients, shift = _predictors(x)
    predicted = np.zeros_like(x)
    for j in range(LPC_ORDER):
        predicted[:, LPC_ORDER:] += coefficients[j][:, None] * x[:, LPC_ORDER - 1 - j : n - 1 - j]
    lpc = x - (predicted >> shift[:, None])
    lpc[:, :LPC_ORDER] = 0
    z_fixed, z_lpc = (fixed << 1) ^ (fixed >> 31), (lpc << 1) ^ (lpc >> 31)
    k_fixed, c_fixed = _rice(z_fixed, order, parts)
    k_lpc, c_lpc = _rice(z_lpc, np.full(rows, LPC_ORDER), parts)
    c_fixed = c_fixed + order * bits_per_sample + 6
    c_lpc = c_lpc + LPC_ORDER * (bits_per_sample + PRECISION) + 15

    constant = (x == x[:, :1]).all(axis=1)
    use_lpc = ~constant & (c_lpc < c_fixed) & (c_lpc < n * bits_per_sample)
    verbatim = ~constant & ~use_lpc & (c_fixed >= n * bits_per_sample)
    order = np.where(use_lpc, LPC_ORDER, np.where(verbatim, n, np.where(constant, 1, order)))
    kind = np.select([constant, verbatim, use_lpc], [0, 1, 0x20 | (LPC_ORDER - 1)], 8 | order)
    coded = kind >= 8
    z, k = np.where(use_lpc[:, None], z_lpc, z_fixed), np.where(use_lpc[:, None], k_lpc, k_fixed)

    # Every sample is a token: raw (before ``order``), a Rice code, or, of a constant, nothing.
    place = np.arange(n)
    raw = place < order[:, None]
    rice = ~raw & coded[:, None]
    k_of = np.repeat(k, n // parts, axis=1)
    ones = np.where(rice, z >> k_of, 0)
    low_bits = np.where(raw, bits_per_sample, np.where(rice, k_of, 0))
    low = np.where(raw, x, z) & ((1 << low_bits) - 1)
    length = ones + rice + low_bits
    # What stands between the tokens: coefficients, coding method and partition order, Rice parameters.
    before = np.zeros_like(length)
    before[:, 0] = 8
    line = np.arange(rows)
    at_order = np.minimum(order, n - 1)
    before[line, at_order] += np.where(coded, np.where(use_lpc, 9 + LPC_ORDER * PRECISION, 0) + 10, 0)
    for part in range(1, parts):
        before[:, part * (n // parts)] += np.where(coded, 4, 0)
    total = (length + before).sum(axis=1)
    total += -total % 8
    offsets = np.concatenate([[0], np.cumsum(total)])
    ends = np.cumsum(length + before, axis=1) + offsets[:-1, None]
    start = ends - length

    bits = np.zeros(int(offsets[-1]), np.uint8)
    _put(bits, offsets[:-1], kind << 1, 8)
    bits[(start + ones)[rice]] = 1
    token = low_bits > 0
    _put(bits, (start + ones + rice)[token], low[token], low_bits[token])
    at = start[line, at_order] - np.where(coded, 10, 0)
    _put(bits, at[coded] + 2, np.full(int(coded.sum()), parts.bit_length() - 1), 4)
    _put(bits, at[coded] + 6, k[coded, 0], 4)
    for part in range(1, parts):
        _put(bits, start[coded, part * (n // parts)] - 4, k[coded, part], 4)
    at = at[use_lpc] - 9 - LPC_ORDER * PRECISION
    _put(bits, at, np.full(len(at), PRECISION - 1), 4)
    _put(bits, at + 4, shift[use_lpc], 5)
    for j in range(LPC_ORDER):
        _put(bits, at + 9 + j * PRECISION, coefficients[j][use_lpc] & ((1 << PRECISION) - 1), PRECISION)
    return bits, offsets


def _header(number: int, n: int) -> bytes:
    code = 8 + (n // 256).bit_length() - 1 if n in (256, 512, 1024, 2048, 4096) else 6 if n <= 256 else 7
    extra = b"" if code >= 8 else struct.pack(">B", n - 1) if code == 6 else struct.pack(">H", n - 1)
    return bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + _coded_number(number) + extra


def encode(payloads: list[bytes]) -> list[bytes]:
    """One mono stream of 8-bit samples (byte minus 128) for each payload, with a seek point for every frame."""
    frames = [(i, number, start) for i, p in enumerate(payloads) for number, start in enumerate(range(0, len(p), BLOCK))]
    sizes = np.array([min(BLOCK, len(payloads[i]) - start) for i, _, start in frames])
    body: list[bytes] = [b""] * len(frames)
    for n in np.unique(sizes).tolist():
        chosen = np.flatnonzero(sizes == n)
        x = np.frombuffer(b"".join(payloads[frames[f][0]][frames[f][2] : frames[f][2] + n] for f in chosen), np.uint8).reshape(-1, n).astype(np.int32) - 128
        bits, offsets = _subframes(x, 8)
        packed, ends = np.packbits(bits).tobytes(), offsets // 8
        for row, f in enumerate(chosen):
            body[f] = packed[ends[row] : ends[row + 1]]
    heads = [_header(number, n) for (_, number, _), n in zip(frames, sizes.tolist())]
    flat = np.frombuffer(b"".join(heads), np.uint8)
    ends = np.cumsum([len(h) for h in heads])
    check = _CRC8.of(flat, np.concatenate([[0], ends[:-1]]), ends).astype(np.uint8)
    whole = [h + bytes([c]) + b for h, c, b in zip(heads, check.tolist(), body)]
    flat = np.frombuffer(b"".join(whole), np.uint8)
    ends = np.cumsum([len(w) for w in whole])
    check = _CRC16.of(flat, np.concatenate([[0], ends[:-1]]), ends)
    whole = [w + struct.pack(">H", c) for w, c in zip(whole, check.tolist())]

    out, at = [], 0
    for payload in payloads:
        many = -(-len(payload) // BLOCK)
        mine = whole[at : at + many]
        at += many
        lengths = [len(w) for w in mine]
        digest = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        packed = (RATE << 44) | (0 << 41) | (7 << 36) | len(payload)
        info = struct.pack(">HH", BLOCK, BLOCK) + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big") + packed.to_bytes(8, "big") + digest
        points = b"".join(
            struct.pack(">QQH", f * BLOCK, start, min(BLOCK, len(payload) - f * BLOCK)) for f, start in enumerate(np.concatenate([[0], np.cumsum(lengths)[:-1]]).tolist())
        )
        out.append(b"fLaC" + struct.pack(">I", len(info)) + info + struct.pack(">I", 0x83 << 24 | len(points)) + points + b"".join(mine))
    return out


class _Bits:
    """Reads fields at many bit positions of one buffer at once."""

    def __init__(self, buffer: np.ndarray):
        padded = np.concatenate([buffer, np.full(16, 0xFF, np.uint8)])
        n = len(padded) - 8
        wide = padded.astype(np.uint64)
        self.window = sum(wide[j : n + 2 + j] << np.uint64(32 - 8 * j) for j in range(5)).astype(np.int64)
        bits = np.unpackbits(padded[:n])
        self.last = len(bits) - 8
        self.ones = np.flatnonzero(bits).astype(np.int64)
        self.rank = np.cumsum(bits, dtype=np.int32) - bits

    def read(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        at = np.minimum(at, self.last)
        return (self.window[at >> 3] >> (40 - (at & 7) - width)) & ((np.int64(1) << np.asarray(width, np.int64)) - 1)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        value, top = self.read(at, width), np.int64(1) << (np.asarray(width, np.int64) - 1)
        return (value ^ top) - top

    def next_one(self, at: np.ndarray) -> np.ndarray:
        return self.ones[self.rank[np.minimum(at, self.last)]]


def _rice_codes(bits: _Bits, at: np.ndarray, k: np.ndarray, count: np.ndarray, base: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Read ``count`` codes of each row into ``flat[base:]``; the positions after them."""
    by_count = np.argsort(-count, kind="stable")
    at, k, count, base = at[by_count], k[by_count], count[by_count], base[by_count]
    mask, left = (np.int64(1) << k) - 1, 40 - k
    ones, rank, window, last = bits.ones, bits.rank, bits.window, bits.last
    active = np.searchsorted(-count, -np.arange(int(count.max(initial=0))), side="left")
    for step, a in enumerate(active.tolist()):
        p = np.minimum(at[:a], last)
        one = ones[rank[p]]
        low = one + 1
        value = (window[low >> 3] >> (left[:a] - (low & 7))) & mask[:a]
        flat[base[:a] + step] = ((one - p) << k[:a]) | value
        at[:a] = low + k[:a]
    out = np.empty_like(at)
    out[by_count] = at
    return out


def _read_subframes(bits: _Bits, at: np.ndarray, n: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (one row for a frame), the positions after the subframes, and whether each is well formed."""
    rows, longest = len(at), int(n.max(initial=1))
    head = bits.read(at, 8)
    kind, ok = (head >> 1) & 63, head < 128
    at = at + 8
    wasted = np.where(head & 1, np.minimum(bits.next_one(at) - at + 1, 32), 0)
    at, width = at + wasted, np.maximum(width - wasted, 1)
    is_fixed, is_lpc = (kind >= 8) & (kind <= 12), kind >= 32
    ok &= (kind <= 1) | is_fixed | is_lpc
    order = np.where(is_fixed, kind - 8, np.where(is_lpc, (kind & 31) + 1, 0))
    coded = is_fixed | is_lpc
    ok &= order <= n
    order = np.where(ok, order, 0)
    out = np.zeros((rows, longest), np.int64)

    single = kind == 0
    out[single] = bits.signed(at[single], width[single])[:, None]
    at = at + np.where(single, width, 0)
    plain = kind == 1
    out[plain] = bits.signed(at[plain][:, None] + np.arange(longest) * width[plain][:, None], width[plain][:, None])
    at = at + np.where(plain, n * width, 0)
    for j in range(int(order.max(initial=0))):
        here = order > j
        out[here, j] = bits.signed(at[here], width[here])
        at = at + np.where(here, width, 0)
    top = int(order[is_lpc].max(initial=0))
    coefficients, shift = np.zeros((top, rows), np.int64), np.zeros(rows, np.int64)
    if top:
        precision = np.where(is_lpc, bits.read(at, 4) + 1, 1)
        ok &= ~is_lpc | (precision < 16)
        shift = np.where(is_lpc, np.maximum(bits.signed(at + 4, 5), 0), 0)
        at = at + np.where(is_lpc, 9, 0)
        for j in range(top):
            here = is_lpc & (order > j)
            coefficients[j, here] = bits.signed(at[here], precision[here])
            at = at + np.where(here, precision, 0)

    method, depth = bits.read(at, 2), bits.read(at + 2, 4)
    size = n >> depth
    ok &= ~coded | ((method <= 1) & (size >= order) & (size << depth == n))
    at = at + np.where(coded, 6, 0)
    coded = coded & ok
    parameter_bits = 4 + np.minimum(method, 1)
    flat = out.reshape(-1)
    for part in range(1 << int(depth[coded].max(initial=0)) if coded.any() else 0):
        here = np.flatnonzero(coded & (part < (1 << depth)))
        skip = order[here] if part == 0 else 0
        count = np.maximum(size[here] - skip, 0)
        base = here * longest + part * size[here] + skip
        p = at[here]
        k = bits.read(p, parameter_bits[here])
        p = p + parameter_bits[here]
        escaped = k == (1 << parameter_bits[here]) - 1
        if escaped.any():
            e = np.flatnonzero(escaped)
            raw = bits.read(p[e], 5)
            for row, w in zip(e, raw.tolist()):
                many = int(count[row])
                if w:
                    value = bits.signed(p[row] + 5 + np.arange(many) * w, w)
                    flat[base[row] : base[row] + many] = (value << 1) ^ (value >> 63)
                p[row] += 5 + many * w
        r = np.flatnonzero(~escaped)
        p[r] = _rice_codes(bits, p[r], k[r], count[r], base[r], flat)
        at[here] = p
    place = np.arange(longest)
    residual = coded[:, None] & (place >= order[:, None])
    np.copyto(out, (out >> 1) ^ -(out & 1), where=residual)

    for o in range(1, 5):
        here = np.flatnonzero(is_fixed & ok & (order == o))
        if len(here):
            x = out[here]
            first = [np.diff(x[:, : j + 1], n=j, axis=1)[:, 0] for j in range(o)]
            for j in range(o - 1, -1, -1):
                x[:, j] = first[j]
                x[:, j:] = np.cumsum(x[:, j:], axis=1)
            out[here] = x
    here = np.flatnonzero(is_lpc & ok)
    if len(here):
        x = np.ascontiguousarray(out[here].T)
        c, s, o = coefficients[:, here], shift[here], order[here]
        for t in range(int(o.min()), longest):
            back = min(t, top)
            predicted = (c[:back] * x[t - back : t][::-1]).sum(axis=0) >> s
            x[t] += np.where(t >= o, predicted, 0)
        out[here] = x.T
    return out << wasted[:, None], at, ok


_BLOCK_SIZES = np.array([0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768])
_SAMPLE_BITS = np.array([0, 8, 12, 0, 16, 20, 24, 32])
_RATE_BYTES = np.array([0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 2, 0])


def read_frames(buffer: np.ndarray, starts: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decode the frames that begin at ``starts``: samples [channel, frame, sample], lengths, ends, and errors (0: none).

    Errors: 1 not a frame or a reserved value, 2 the header's CRC-8, 3 the frame's CRC-16.
    ``width`` is the sample size where a frame's header leaves it to the stream.
    """
    bits = _Bits(buffer)
    starts = np.minimum(starts, len(buffer))
    at = starts * 8
    good = (bits.read(at, 15) == 0x7FFC) & (starts + 6 <= len(buffer))
    size_code, rate_code, channel_code, bit_code = (bits.read(at + o, w) for o, w in ((16, 4), (20, 4), (24, 4), (28, 3)))
    lead = bits.read(at + 32, 8)
    number_bytes = np.where(lead < 0x80, 1, 7 - np.floor(np.log2(np.maximum(255 - lead, 1))).astype(int))
    p = at + 32 + 8 * number_bytes
    n = np.select([size_code == 6, size_code == 7], [bits.read(p, 8) + 1, bits.read(p, 16) + 1], _BLOCK_SIZES[size_code])
    p = p + np.select([size_code == 6, size_code == 7], [8, 16], 0) + 8 * _RATE_BYTES[rate_code]
    width = np.where(bit_code == 0, width, _SAMPLE_BITS[bit_code])
    good &= (n > 0) & (width > 0) & (width <= 24) & (channel_code <= 10) & (p // 8 < len(buffer))
    error = np.where(good, 0, 1)
    ends = np.where(good, p // 8, starts)
    error[good & (_CRC8.of(buffer, starts, ends) != bits.read(p, 8))] = 2
    p = p + 8

    live = np.flatnonzero(error == 0)
    channels = np.where(channel_code >= 8, 2, channel_code + 1)
    samples = np.zeros((int(channels[live].max(initial=1)), len(starts), int(n[live].max(initial=1))), np.int64)
    for c in range(samples.shape[0] if len(live) else 0):
        here = live[channels[live] > c]
        side = ((channel_code[here] == 8) & (c == 1)) | ((channel_code[here] == 9) & (c == 0)) | ((channel_code[here] == 10) & (c == 1))
        x, after, ok = _read_subframes(bits, p[here], n[here], width[here] + side)
        samples[c, here, : x.shape[1]] = x
        p[here] = after
        error[here[~ok]] = 1
    if samples.shape[0] > 1:
        a, b = samples[0].copy(), samples[1].copy()
        left_side, side_right, mid_side = ((channel_code == code)[:, None] for code in (8, 9, 10))
        middle = (a << 1) | (b & 1)
        samples[0] = np.where(side_right, a + b, np.where(mid_side, (middle + b) >> 1, a))
        samples[1] = np.where(left_side, a - b, np.where(mid_side, (middle - b) >> 1, b))
    ends = np.where(error == 0, (p + 7) // 8, starts)
    outside = ends + 2 > len(buffer)
    error[(error == 0) & outside] = 1
    ends = np.minimum(ends, len(buffer))
    check = _CRC16.of(buffer, np.where(error == 0, starts, 0), np.where(error == 0, ends, 0))
    error[(error == 0) & (check != bits.read(ends * 8, 16))] = 3
    return samples, n, ends + 2, error


@dataclass
class Stream:
    """A stream's frames: sample and byte offsets, PCM bytes, and what is wrong with it (None: nothing)."""

    channels: int = 1
    width: int = 8
    sample_offsets: list[int] | None = None
    byte_offsets: list[int] | None = None
    blocks: list[np.ndarray] | None = None
    error: str | None = None


_ERRORS = {1: "not a frame", 2: "frame header checksum", 3: "frame checksum"}


def _metadata(media: bytes) -> tuple[int, int, int, int, bytes, list[tuple[int, int, int]]]:
    """First frame's offset, channels, sample size, total samples, MD5 and seek points."""
    if media[:4] != b"fLaC" or len(media) < 42:
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, None, []
    while not last:
        if at + 4 > len(media):
            raise ValueError("metadata is cut off")
        last, kind, size = media[at] >= 128, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        block = media[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0 and len(block) == 34:
            packed = int.from_bytes(block[10:18], "big")
            info = ((packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, block[18:])
        if kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", block[: size // 18 * 18]) if p[0] != (1 << 64) - 1]
    if info is None:
        raise ValueError("no stream information")
    return (at, *info, points)


def decode(media: list[bytes]) -> list[Stream]:
    """Decode streams side by side, by their seek points where these name every frame, else frame after frame."""
    out, heads = [], []
    for m in media:
        try:
            heads.append(_metadata(m))
            out.append(Stream(heads[-1][1], heads[-1][2], [], [], []))
        except ValueError as e:
            heads.append(None)
            out.append(Stream(error=str(e)))
    buffer = np.frombuffer(b"".join(media), np.uint8)
    bases = np.concatenate([[0], np.cumsum([len(m) for m in media])[:-1]]).astype(np.int64)
    todo = []
    for i, head in enumerate(heads):
        if head is not None:
            total, points = head[3], head[5]
            whole = points and sum(p[2] for p in points) == total and [p[0] for p in points] == [0, *np.cumsum([p[2] for p in points])[:-1].tolist()]
            todo += [(i, head[0] + p[1]) for p in points] if whole else [(i, head[0])] if total else []
    while todo:
        samples, n, ends, errors = read_frames(buffer, np.array([bases[i] + at for i, at in todo]), np.array([heads[i][2] for i, _ in todo]))
        more = []
        for row, (i, at) in enumerate(todo):
            stream, head = out[i], heads[i]
            if stream.error is not None:
                continue
            if errors[row] or ends[row] > bases[i] + len(media[i]):
                stream.error = _ERRORS.get(int(errors[row]), "not a frame")
                continue
            done = stream.sample_offsets[-1] + stream.blocks[-1].shape[1] if stream.blocks else 0
            stream.sample_offsets.append(done)
            stream.byte_offsets.append(at)
            stream.blocks.append(samples[: stream.channels, row, : n[row]])
            last = row + 1 == len(todo) or todo[row + 1][0] != i
            if last and done + int(n[row]) < head[3]:
                more.append((i, int(ends[row] - bases[i])))
        todo = more
    for stream, head in zip(out, heads):
        if head is not None and stream.error is None:
            pcm = b"".join(pcm_bytes(stream, b) for b in stream.blocks)
            if sum(b.shape[1] for b in stream.blocks) != head[3]:
                stream.error = "samples are missing"
            elif head[4] != bytes(16) and hashlib.md5(pcm).digest() != head[4]:
                stream.error = "stream checksum"
    return out


def pcm_bytes(stream: Stream, block: np.ndarray) -> bytes:
    """A block's samples, channels interleaved, in signed little-endian bytes."""
    size = (stream.width + 7) // 8
    return block.T.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :size].tobytes() if size != 1 else block.T.astype(np.int8).tobytes()


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of 64; null as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(UNIT * max(1, -(-len(data) // UNIT)) - len(data))


def _by_size(items: list[bytes], limit: int = BYTES) -> Iterator[slice]:
    start, size = 0, 0
    for i, item in enumerate(items):
        if i > start and size + len(item) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(item)
    if items:
        yield slice(start, len(items))


def _encode_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1000):
        texts = batch.column(1).to_pylist()
        payloads = [payload_of(t) for t in texts]
        sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        for part in _by_size(payloads):
            ids = batch.column(0).slice(part.start, part.stop - part.start).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes[part], pa.int64()), pa.array(encode(payloads[part]), pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every text's payload as a FLAC stream.

    * Null text: as empty text, 64 zero bytes. Very long texts are stored whole.
    * Equal texts give equal streams, whatever stands beside them. Null ``doc_id`` and
      repeated rows each have their row. No rows: no rows. Other columns play no part.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode_batches, MEDIA)


def _streams(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list, list[bytes], list[Stream]]]:
    for batch in sliced(batches, 1000):
        ids, sizes, media = (c.to_pylist() for c in batch.columns[:3])
        media = [m or b"" for m in media]
        for part in _by_size(media):
            yield ids[part], sizes[part], media[part], decode(media[part])


def _block_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, _, streams in _streams(batches):
        rows = []
        for doc_id, s in zip(ids, streams):
            for i, (sample, byte, block) in enumerate(zip(s.sample_offsets or [], s.byte_offsets or [], s.blocks or [])):
                rows.append((doc_id, i, sample, byte, block.shape[1], pcm_bytes(s, block), s.error))
            if not s.blocks:
                rows.append((doc_id, None, None, None, None, None, s.error))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "block", "sample_offset", "byte_offset", "samples", "pcm", "error"])


def pcm_blocks(media: DataFrame) -> DataFrame:
    """One row for each frame of the streams in ``doc_id, n_bytes, media``: its offsets in samples and bytes, and its PCM.

    A sample is found by the last block whose ``sample_offset`` is not beyond it. A
    damaged stream gives the blocks before the damage, each with the ``error``; a row
    that holds no stream gives one row with the error alone.
    """
    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_block_batches, BLOCKS)


def write_pcm(media: DataFrame, path: str) -> None:
    """Write the blocks sorted by sample offset, so that a reader can skip to an offset."""
    pcm_blocks(media).sortWithinPartitions("doc_id", "sample_offset").write.mode("overwrite").parquet(path)


def _digest_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sizes, media, streams in _streams(batches):
        rows = []
        for doc_id, size, m, s in zip(ids, sizes, media, streams):
            if s.error is not None:
                rows.append((doc_id, size, None, None, None, len(m), hashlib.sha256(m).hexdigest(), None, s.error))
                continue
            x = np.concatenate(s.blocks, axis=1)[0] if s.blocks else np.empty(0, np.int64)
            payload = (x + 128).astype(np.uint8).tobytes()
            turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
            feature = f"blocks={len(s.blocks)};peak={int(np.abs(x).max(initial=0))};energy={int((x * x).sum())};crossings={turns}"
            rows.append(
                (doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature, None)
            )
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def digests(media: DataFrame) -> DataFrame:
    """What the decoded streams of ``doc_id, n_bytes, media`` hold: sizes, digests of payload and stream, and a summary of the samples."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest_batches, DIGESTS)
