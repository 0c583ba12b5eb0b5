import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from cairnframe.llm import flac

from .cases import edge_documents, no_documents, rows


def _samples(stream):
    return np.concatenate(stream.blocks, axis=1)


def test_payloads_come_back():
    rng = np.random.default_rng(4)
    texts = [r[1] for r in rows()] + ["", "a" * 63, "a" * 64, "a" * 65, "\0" * 3000, "é" * 5000, "ab" * 9000]
    payloads = [flac.payload_of(t) for t in texts]
    payloads += [rng.integers(0, 256, n, np.uint8).tobytes() for n in (64, 1024, 1088, 4096, 64 * 999)]
    payloads += [bytes(np.tile(np.array([0, 255], np.uint8), 704)), bytes(range(256)) * 5]
    media = flac.encode(payloads)
    streams = flac.decode(media)
    for payload, stream in zip(payloads, streams):
        assert stream.error is None
        assert (_samples(stream)[0] + 128).astype(np.uint8).tobytes() == payload
        assert stream.sample_offsets == list(range(0, len(payload), flac.BLOCK))
    # A stream does not depend on what stands beside it.
    assert [flac.encode([p])[0] for p in payloads[:6]] == media[:6]


def test_seek_points_lead_to_frames():
    (media,) = flac.encode([bytes(range(64)) * 100])
    (stream,) = flac.decode([media])
    first = flac._metadata(media)[0]
    for sample, byte in zip(stream.sample_offsets, stream.byte_offsets):
        assert media[byte : byte + 2] == b"\xff\xf8"
        x, n, _, error = flac.read_frames(np.frombuffer(media, np.uint8), np.array([byte]), np.array([8]))
        assert error[0] == 0 and (x[0, 0, : n[0]] == _samples(stream)[0][sample : sample + n[0]]).all()
    assert stream.byte_offsets[0] == first


def test_any_changed_byte_is_found():
    rng = random.Random(2)
    payload = flac.payload_of("The quick brown fox jumps over the lazy dog. " * 60)
    (media,) = flac.encode([payload])
    start = flac._metadata(media)[0]
    damaged = []
    for at in [start, start + 3, start + 4, start + 5, len(media) - 1, *(rng.randrange(start, len(media)) for _ in range(40))]:
        copy = bytearray(media)
        copy[at] ^= 1 << rng.randrange(8)
        damaged.append(bytes(copy))
    damaged += [media[:-5], media[:30], b"", b"RIFF" + media, media[:start] + b"\xff" * 50]
    assert all(s.error for s in flac.decode(damaged))


class _Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & ((1 << width) - 1), f"0{width}b") if width else ""

    def rice(self, value, k):
        z = value << 1 if value >= 0 else (-value << 1) - 1
        self.bits += "0" * (z >> k) + "1"
        self.put(z, k)

    def bytes(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return bytes(int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8))


def _crc(data, width, poly):
    value = 0
    for byte in data:
        value ^= byte << (width - 8)
        for _ in range(8):
            value = ((value << 1) ^ (poly if value >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
    return value


def _stream(frames, total, channels, width, pcm, points=()):
    packed = (44100 << 44) | ((channels - 1) << 41) | ((width - 1) << 36) | total
    info = struct.pack(">HH", 16, 4096) + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC" + struct.pack(">I", 0x80 << 24 | len(info)) + info + b"".join(frames)


def _frame(number, n, channel_code, bit_code, write):
    head = bytes([0xFF, 0xF8, 0x60 | 0x9, channel_code << 4 | bit_code << 1]) + flac._coded_number(number) + bytes([n - 1])
    head += bytes([_crc(head, 8, 0x07)])
    body = _Writer()
    write(body)
    whole = head + body.bytes()
    return whole + struct.pack(">H", _crc(whole, 16, 0x8005))


def test_decodes_what_other_encoders_write():
    """Two frames of 16-bit stereo without seek points: mid and side, wasted bits, escaped partitions, prediction of order 2."""
    rng = random.Random(6)
    n = 64
    left = [[rng.randint(-3000, 3000) * 4 for _ in range(n)] for _ in range(2)]
    right = [[x + rng.randint(-5, 5) * 4 for x in block] for block in left]

    def write(block):
        def body(w):
            mid = [(a + b) >> 1 for a, b in zip(left[block], right[block])]
            side = [a - b for a, b in zip(left[block], right[block])]
            w.put(0, 1), w.put(8 | 1, 6), w.put(1, 1), w.put(1, 1)  # fixed, order 1, one wasted bit
            half = [m >> 1 for m in mid]
            w.put(half[0], 15)
            w.put(0, 2), w.put(1, 4)
            residual = [b - a for a, b in zip(half, half[1:])]
            w.put(9, 4)
            for r in residual[:31]:
                w.rice(r, 9)
            w.put(15, 4), w.put(15, 5)
            for r in residual[31:]:
                w.put(r, 15)
            w.put(0, 1), w.put(0x20 | 1, 6), w.put(0, 1)  # linear prediction of order 2 on 17 bits
            w.put(side[0], 17), w.put(side[1], 17)
            w.put(7, 4), w.put(3, 5), w.put(5, 8), w.put(-3, 8)
            w.put(1, 2), w.put(0, 4), w.put(4, 5)
            for t in range(2, n):
                w.rice(side[t] - ((5 * side[t - 1] - 3 * side[t - 2]) >> 3), 4)

        return body

    # mid is even here, since all samples are multiples of 4 and differ by multiples of 4
    pcm = b"".join(struct.pack("<hh", a, b) for x, y in zip(left, right) for a, b in zip(x, y))
    media = _stream([_frame(i, n, 10, 4, write(i)) for i in range(2)], 2 * n, 2, 16, pcm)
    (stream,) = flac.decode([media])
    assert stream.error is None
    assert b"".join(flac.pcm_bytes(stream, b) for b in stream.blocks) == pcm


@pytest.mark.parametrize("number,coded", [(0, "00"), (127, "7f"), (128, "c280"), (2047, "dfbf"), (65535, "efbfbf"), (65536, "f0908080"), (2**31 - 1, "fdbfbfbfbfbf")])
def test_frame_numbers(number, coded):
    assert flac._coded_number(number).hex() == coded


def test_digests_of_documents(spark):
    docs = edge_documents(spark)
    got = flac.digests(flac.encode_documents(docs)).collect()
    assert len(got) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], r["text"])
    for r in got:
        payload = flac.payload_of(texts[r["doc_id"]])
        assert r["error"] is None and r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (1, 2)}) == 1
    assert flac.digests(flac.encode_documents(no_documents(spark))).count() == 0


def test_blocks_and_damaged_media(spark, tmp_path):
    media = flac.encode_documents(edge_documents(spark).filter("doc_id = 6"))
    flac.write_pcm(media, str(tmp_path / "pcm"))
    blocks = spark.read.parquet(str(tmp_path / "pcm")).orderBy("sample_offset").collect()
    payload = flac.payload_of(next(t for i, t, *_ in rows() if i == 6))
    assert bytes((b + 128) % 256 for b in b"".join(r["pcm"] for r in blocks)) == payload
    damaged = spark.createDataFrame([(1, 1, b"no stream"), (2, 1, None)], flac.MEDIA)
    assert {(r["doc_id"], r["error"]) for r in flac.pcm_blocks(damaged).collect()} == {(1, "not a FLAC stream"), (2, "not a FLAC stream")}
    assert flac.digests(damaged).filter("payload_bytes IS NULL").count() == 2
