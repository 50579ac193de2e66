"""FLAC streams of other encoders, put together here bit by bit."""

import hashlib
import struct

import numpy as np
import pytest

from marginalia.llm import flac, flac_read, media

SIDES = {8: lambda a, b: (a, a - b), 9: lambda a, b: (a - b, b), 10: lambda a, b: ((a + b) >> 1, a - b)}


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(int(value) >> (width - 1 - i)) & 1 for i in range(width)]

    def residual(self, r, k):
        u = 2 * r if r >= 0 else -2 * r - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u, k)

    def bytes(self):
        return np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), np.uint8)).tobytes()


def crc16(data):
    c = 0
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
    return c


def subframe(w, values, width, kind, wasted=0, parts=1, method=0, escape=False):
    values = [int(v) >> wasted for v in values]
    w.put(0, 1)
    coefficients, shift, precision = [], 0, 6
    if kind == "constant":
        code, order = 0, 0
    elif kind == "verbatim":
        code, order = 1, 0
    elif kind == "lpc":
        coefficients, shift, code, order = [7, -3], 2, 33, 2
    else:
        code, order = 8 + kind, kind
        coefficients = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][kind]
    w.put(code, 6)
    w.put(int(wasted > 0), 1)
    if wasted:
        w.bits += [0] * (wasted - 1) + [1]
    width -= wasted
    if kind in ("constant", "verbatim"):
        for v in values[: 1 if kind == "constant" else None]:
            w.put(v, width)
        return
    for v in values[:order]:
        w.put(v, width)
    if kind == "lpc":
        w.put(precision - 1, 4)
        w.put(shift, 5)
        for c in coefficients:
            w.put(c, precision)
    rest = [v - (sum(c * values[i - 1 - j] for j, c in enumerate(coefficients)) >> shift) for i, v in enumerate(values) if i >= order]
    w.put(method, 2)
    w.put(parts.bit_length() - 1, 4)
    size, at = len(values) // parts, 0
    for part in range(parts):
        n, k = size - (order if part == 0 else 0), 3 + part % 3
        if escape and part == parts - 1:
            w.put((1 << (4 + method)) - 1, 4 + method)
            w.put(width + 4, 5)
            for r in rest[at : at + n]:
                w.put(r, width + 4)
        else:
            w.put(k, 4 + method)
            for r in rest[at : at + n]:
                w.residual(r, k)
        at += n


def frame(number, channels, bits, channel_code, **how):
    w, size = Writer(), len(channels[0])
    w.put(0x7FFC, 15)
    w.put(0, 1)
    w.put(7, 4)  # the size follows in 16 bits
    w.put(0, 4)
    w.put(channel_code, 4)
    w.put(0, 3)
    w.put(0, 1)
    w.put(number, 8)
    w.put(size - 1, 16)
    w.put(flac.crc8(w.bytes()), 8)
    sent = SIDES[channel_code](*channels) if channel_code > 7 else channels
    for i, c in enumerate(sent):
        extra = channel_code > 7 and i == (0 if channel_code == 9 else 1)
        subframe(w, c, bits + extra, **how)
    return w.bytes() + crc16(w.bytes()).to_bytes(2, "big")


def stream(frames, samples, bits, seek=()):
    width = (bits + 7) // 8
    raw = b"".join(int(v).to_bytes(width, "little", signed=True) for v in samples.ravel())
    info = struct.pack(">HH", 16, 4096) + bytes(6) + ((44100 << 44) | (samples.shape[1] - 1 << 41) | (bits - 1 << 36) | len(samples)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    table = b"".join(struct.pack(">QQH", *p) for p in seek)
    blocks = [(0, info), *([(3, table)] if seek else [])]
    return b"fLaC" + b"".join(bytes([kind | (0x80 if i == len(blocks) - 1 else 0)]) + len(b).to_bytes(3, "big") + b for i, (kind, b) in enumerate(blocks)) + b"".join(frames)


def wave(rng, n, bits):
    top = 1 << (bits - 1)
    return np.clip(np.cumsum(rng.integers(-6, 7, n)), -top // 2, top // 2 - 1).astype(np.int64)


HOWS = [dict(kind="lpc", parts=4), dict(kind=2, parts=8, method=1), dict(kind=4, parts=1), dict(kind=1, parts=2, escape=True), dict(kind="verbatim"), dict(kind=0, parts=1), dict(kind=3, wasted=2, parts=4)]


@pytest.mark.parametrize("how", HOWS, ids=lambda h: "-".join(f"{k}{v}" for k, v in h.items()))
@pytest.mark.parametrize("bits, channel_code", [(8, 0), (16, 0), (16, 8), (16, 9), (12, 10), (24, 2)])
def test_streams_are_read_back(how, bits, channel_code):
    rng, counts = np.random.default_rng(bits + channel_code), (64, 16, 160)
    channels = 2 if channel_code > 7 else channel_code + 1
    blocks = [np.stack([wave(rng, n, bits) << how.get("wasted", 0) for _ in range(channels)]) for n in counts]
    blocks = [b & ~7 if how.get("wasted") else b for b in blocks]
    frames = [frame(i, b, bits, channel_code, **how) for i, b in enumerate(blocks)]
    samples = np.concatenate(blocks, axis=1).T
    data = stream(frames, samples, bits, [(64, len(frames[0]), 16), ((1 << 64) - 1, 0, 0)])
    pcm = flac_read.read_stream(data)
    assert (pcm.samples == samples).all() and pcm.offsets.tolist() == [0, 64, 80] and (pcm.bits, pcm.rate) == (bits, 44100)
    begin, block = flac_read.read_block(data, 70)
    assert begin == 64 and (block == blocks[1].T).all()
    for damaged in (data[:-1], data[:-20] + bytes([data[-20] ^ 4]) + data[-19:], stream(frames, samples, bits, [(64, 3, 16)]), stream(frames[:2], samples, bits)):
        with pytest.raises(ValueError):
            flac_read.read_stream(damaged)


def test_constant_blocks_and_the_own_streams():
    block = np.full((1, 32), -5)
    assert (flac_read.read_stream(stream([frame(0, block, 8, 0, kind="constant")], block.T, 8)).samples == -5).all()
    payload = media.payload(b"some text that is stored " * 90)
    own = flac.encode([payload])[0]
    pcm = flac_read.read_stream(own)
    assert pcm.to_bytes() == payload and pcm.offsets.tolist() == flac.decode([own])[0][1].tolist()
    assert flac_read.read_block(own, 600)[0] == 576


def test_media_tables_hold_streams_of_both_kinds(spark):
    rng = np.random.default_rng(3)
    block = wave(rng, 64, 8)[None, :]
    other = stream([frame(0, block, 8, 0, kind=1, parts=4)], block.T, 8)
    own = flac.encode([media.payload(b"abc")])[0]
    frame_ = spark.createDataFrame([(1, own), (2, other), (3, own)], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.decode_media(frame_).collect()}
    assert bytes(got[2]["pcm"]) == (block[0] + 128).astype(np.uint8).tobytes() and got[2]["block_offsets"] == [0]
    assert bytes(got[1]["pcm"]) == bytes(got[3]["pcm"]) == media.payload(b"abc") and got[1]["n_bytes"] == 3
