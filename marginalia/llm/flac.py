"""FLAC streams of 8-bit mono samples: encoder and decoder over many frames at a time.

Frames of a batch are handled side by side as rows of arrays: predictors, Rice codes, bit positions and
both checksums advance in lock-step over all frames. Streams hold STREAMINFO with the MD5 of the samples, and
a SEEKTABLE with a point for each frame, so a reader finds any sample's frame without decoding those before it.

Written: constant, verbatim, fixed (order 0 to 2) and LPC subframes, one Rice partition. Read side by side: all subframe
kinds, up to order 32, one partition of either Rice method, no wasted bits. ``flac_read`` reads streams with
other features, as other encoders write them.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 576
RATE = 8000
LPC_ORDER, LPC_PRECISION = 6, 10
#: Frames that are handled side by side.
BATCH_FRAMES = 2048
_HEADER_BITS = 8 + 2 + 4 + 4  # subframe header, Rice method, partition order, parameter


def _table(width: int, poly: int) -> np.ndarray:
    rows = np.arange(256, dtype=np.uint32) << np.uint32(width - 8)
    top, mask = np.uint32(1 << (width - 1)), np.uint32((1 << width) - 1)
    for _ in range(8):
        rows = np.where(rows & top, (rows << np.uint32(1)) ^ np.uint32(poly), rows << np.uint32(1)) & mask
    return rows


_CRC8, _CRC16 = _table(8, 0x07), _table(16, 0x8005)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def _crc16_rows(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-16 of the first ``lengths`` bytes of each row."""
    order = np.argsort(-lengths, kind="stable")
    data, sizes = np.ascontiguousarray(rows[order].T), lengths[order]
    crc = np.zeros(len(rows), np.uint32)
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(len(data)), side="right")
    for i in range(int(sizes[0]) if len(sizes) else 0):
        n = active[i]
        c = crc[:n]
        crc[:n] = ((c << np.uint32(8)) & np.uint32(0xFFFF)) ^ _CRC16[(c >> np.uint32(8)) ^ data[i, :n]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """UTF-8 style coding of a frame number."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    lead = (0xFF00 >> size) & 0xFF
    return bytes([lead | (n >> (6 * (size - 1))), *(0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 2, -1, -1))])


_HEADERS: dict[int, bytes] = {}


def _frame_header(number: int) -> bytes:
    if number not in _HEADERS:
        head = b"\xff\xf8\x24\x02" + _coded_number(number)  # fixed blocking, 576 samples, 8 kHz, mono, 8 bits
        head += bytes([crc8(head)])
        if len(_HEADERS) > 4096:
            return head
        _HEADERS[number] = head
    return _HEADERS[number]


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best parameter and the bits of each row's residuals."""
    mean = u.mean(1)
    guess = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, 13).astype(np.int32)
    best = best_bits = None
    for d in (-1, 0, 1):
        k = np.clip(guess + d, 0, 14)
        bits = (u >> k[:, None]).sum(1) + u.shape[1] * (k + 1)
        if best is None:
            best, best_bits = k, bits
        else:
            better = bits < best_bits
            best, best_bits = np.where(better, k, best), np.where(better, bits, best_bits)
    return best, best_bits


def _lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised coefficients (rows x order), shifts, and which rows have usable ones."""
    f = x.astype(np.float64)
    auto = np.stack([(f[:, lag:] * f[:, : f.shape[1] - lag]).sum(1) for lag in range(order + 1)], 1)
    ok = auto[:, 0] > 0
    error = np.where(ok, auto[:, 0], 1.0)
    a = np.zeros((len(x), order))
    for i in range(order):
        reflect = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(1)) / error
        new = a.copy()
        new[:, i] = reflect
        if i:
            new[:, :i] = a[:, :i] - reflect[:, None] * a[:, i - 1 :: -1][:, :i]
        a = new
        error = error * (1 - reflect**2)
        ok &= error > 0
        error = np.where(error > 0, error, 1.0)
    top = np.abs(a).max(1)
    shift = np.clip(LPC_PRECISION - 1 - np.ceil(np.log2(np.maximum(top, 1e-9) + 1e-12)), 0, 15).astype(np.int32)
    coefficients = np.clip(np.rint(a * (1 << shift)[:, None]), -(1 << (LPC_PRECISION - 1)), (1 << (LPC_PRECISION - 1)) - 1).astype(np.int32)
    return coefficients, shift, ok & (np.abs(a).max(1) < 64)


def _put(bits: np.ndarray, rows: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Writes each row's value, most significant bit first; returns the positions behind it."""
    for j in range(width):
        bits[rows, at + j] = (values >> (width - 1 - j)) & 1
    return at + width


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """One frame for each row of ``samples`` (rows x 576, -128 to 127); ``numbers`` are the frames' numbers."""
    out: list[bytes] = []
    for begin in range(0, len(samples), BATCH_FRAMES):
        out += _encode_batch(samples[begin : begin + BATCH_FRAMES].astype(np.int32), numbers[begin : begin + BATCH_FRAMES])
    return out


def _encode_batch(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    n = len(x)
    residuals = [x, np.diff(x, axis=1)]
    residuals.append(np.diff(residuals[1], axis=1))
    coefficients, shift, usable = _lpc(x, LPC_ORDER)
    predicted = np.zeros((n, BLOCK - LPC_ORDER), np.int32)
    for j in range(LPC_ORDER):
        predicted += coefficients[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j]
    residuals.append(x[:, LPC_ORDER:] - (predicted >> shift[:, None]))
    coded = [_zigzag(r) for r in residuals]
    rice = [_rice(u) for u in coded]
    warm = [0, 8, 16, 8 * LPC_ORDER + 4 + 5 + LPC_PRECISION * LPC_ORDER]
    sizes = np.stack([bits + w + _HEADER_BITS for (_, bits), w in zip(rice, warm)], 1)
    sizes[~usable, 3] = 1 << 30
    kind = sizes.argmin(1)
    size = sizes[np.arange(n), kind]
    kind[size >= 8 + 8 * BLOCK] = 4  # verbatim
    kind[(x == x[:, :1]).all(1)] = 5  # constant
    body_bits = np.where(kind == 4, 8 + 8 * BLOCK, np.where(kind == 5, 16, size))
    width = -(-int(body_bits.max()) // 8) * 8
    bits = np.zeros((n, width), np.uint8)
    for t in range(6):
        rows = np.flatnonzero(kind == t)
        if not len(rows):
            continue
        at = np.zeros(len(rows), np.int64)
        subframe = {0: 8, 1: 9, 2: 10, 3: 32 + LPC_ORDER - 1, 4: 1, 5: 0}[t]
        at = _put(bits, rows, at, np.full(len(rows), subframe << 1), 8)
        if t == 5:
            _put(bits, rows, at, x[rows, 0] & 255, 8)
            continue
        if t == 4:
            bits[rows, 8 : 8 + 8 * BLOCK] = np.unpackbits((x[rows] & 255).astype(np.uint8), axis=1)
            continue
        order = (0, 1, 2, LPC_ORDER)[t]
        for j in range(order):
            at = _put(bits, rows, at, x[rows, j] & 255, 8)
        if t == 3:
            at = _put(bits, rows, at, np.full(len(rows), LPC_PRECISION - 1), 4)
            at = _put(bits, rows, at, shift[rows], 5)
            for j in range(order):
                at = _put(bits, rows, at, coefficients[rows, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
        k = rice[t][0][rows]
        at = _put(bits, rows, at, np.zeros(len(rows), np.int64), 6)
        at = _put(bits, rows, at, k, 4)
        u = coded[t][rows]
        q = u >> k[:, None]
        lengths = q + 1 + k[:, None]
        stop = at[:, None] + np.cumsum(lengths, axis=1) - lengths + q
        flat, base = bits.reshape(-1), rows[:, None].astype(np.int64) * width
        flat[(base + stop).ravel()] = 1
        for value in np.unique(k):
            own = k == value
            place, low = (base + stop)[own], u[own]
            for j in range(int(value)):
                flat[(place + 1 + j).ravel()] = ((low >> (int(value) - 1 - j)) & 1).ravel()
    packed, body = np.packbits(bits, axis=1), (body_bits + 7) // 8
    heads = [_frame_header(int(i)) for i in numbers]
    sizes_bytes = np.array([len(h) for h in heads]) + body
    rows = np.zeros((n, int(sizes_bytes.max())), np.uint8)
    for length in {len(h) for h in heads}:
        own = np.flatnonzero([len(h) == length for h in heads])
        rows[own, :length] = np.frombuffer(b"".join(heads[i] for i in own), np.uint8).reshape(len(own), length)
        span = min(packed.shape[1], rows.shape[1] - length)
        rows[own, length : length + span] = packed[own, :span]
    crc = _crc16_rows(rows, sizes_bytes)
    return [rows[i, : sizes_bytes[i]].tobytes() + int(crc[i]).to_bytes(2, "big") for i in range(n)]


_SIZE_AT, _SIZE_HEAD = 4 + 4 + 34, b"\x02\x00\x00\x0csize"  # behind STREAMINFO: an APPLICATION block of 12 bytes


def told_size(stream: bytes) -> int | None:
    """How many of a stream's bytes are content, where ``encode`` was told."""
    at = _SIZE_AT + len(_SIZE_HEAD)
    return int.from_bytes(stream[at : at + 8], "big") if stream[_SIZE_AT:at] == _SIZE_HEAD else None


def encode(payloads: list[bytes], content: list[int | None] | None = None) -> list[bytes]:
    """A FLAC stream for each payload; its bytes, less 128, are the samples. Lengths are multiples of 576, over 0. A number
    in ``content`` is kept in the stream, for ``told_size``."""
    counts = [len(p) // BLOCK for p in payloads]
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).astype(np.int8).reshape(-1, BLOCK)
    frames = encode_frames(samples, np.concatenate([np.arange(c) for c in counts]) if counts else np.empty(0, int))
    out, at = [], 0
    for payload, count, told in zip(payloads, counts, content or [None] * len(payloads)):
        own = frames[at : at + count]
        sizes = [len(f) for f in own]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8, "big")
        info += hashlib.md5(samples[at : at + count].tobytes()).digest()
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        seek = b"".join(struct.pack(">QQH", i * BLOCK, int(o), BLOCK) for i, o in enumerate(offsets))
        size = b"" if told is None else _SIZE_HEAD + told.to_bytes(8, "big")
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + size + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(own))
        at += count
    return out


def _blocks(stream: bytes) -> tuple[bytes, list[tuple[int, int]], int]:
    """STREAMINFO, the seek points (sample, byte) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, b"", []
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        data = stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = data
        elif kind == 3:
            points = [struct.unpack(">QQ", data[i : i + 16]) for i in range(0, size, 18)]
        at += 4 + size
    return info, points, at


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each stream its payload (bytes as an array) and the sample offset of each PCM block.

    Frame header and frame checksums, sample counts and the MD5 of the samples are verified; a mismatch is
    an error.
    """
    frames: list[bytes] = []
    spans: list[tuple[bytes, list[int], int]] = []
    for stream in streams:
        info, points, at = _blocks(stream)
        total = int.from_bytes(info[10:18], "big") & ((1 << 36) - 1)
        if len(points) * BLOCK != total:
            raise ValueError("the seek table doesn't name all frames")
        edges = [at + p[1] for p in points] + [len(stream)]
        frames += [stream[a:b] for a, b in zip(edges, edges[1:])]
        spans.append((info, [p[0] for p in points], len(points)))
    samples = np.empty((len(frames), BLOCK), np.int8)
    for begin in range(0, len(frames), BATCH_FRAMES):
        samples[begin : begin + BATCH_FRAMES] = _decode_batch(frames[begin : begin + BATCH_FRAMES])
    out, at = [], 0
    for info, offsets, count in spans:
        own = samples[at : at + count]
        if hashlib.md5(own.tobytes()).digest() != info[18:34]:
            raise ValueError("the samples' MD5 differs")
        out.append(((own.ravel().astype(np.int16) + 128).astype(np.uint8), np.array(offsets, np.int64)))
        at += count
    return out


def _decode_batch(frames: list[bytes]) -> np.ndarray:
    n = len(frames)
    lengths = np.array([len(f) for f in frames])
    width = int(lengths.max()) + 4
    rows = np.zeros((n, width), np.uint8)
    for i, f in enumerate(frames):
        rows[i, : len(f)] = np.frombuffer(f, np.uint8)
    if _crc16_rows(rows, lengths - 2).tolist() != ((rows[np.arange(n), lengths - 2].astype(np.uint32) << 8) | rows[np.arange(n), lengths - 1]).tolist():
        raise ValueError("a frame's CRC-16 differs")
    heads = np.empty(n, np.int64)
    for i, f in enumerate(frames):
        lead, extra = f[4], 0
        while lead & (0x80 >> extra):
            extra += 1
        heads[i] = 4 + max(1, extra) + 1
        if f[:4] != b"\xff\xf8\x24\x02" or crc8(f[: heads[i] - 1]) != f[heads[i] - 1]:
            raise ValueError("a frame header is damaged or of another kind")
    subframe = rows[np.arange(n), heads] >> 1
    out = np.empty((n, BLOCK), np.int32)
    bits = np.unpackbits(rows, axis=1)
    start = heads * 8 + 8
    constant, verbatim = np.flatnonzero(subframe == 0), np.flatnonzero(subframe == 1)
    out[constant] = rows[constant, heads[constant] + 1].astype(np.int8)[:, None]
    for i in verbatim:
        out[i] = rows[i, heads[i] + 1 : heads[i] + 1 + BLOCK].view(np.int8)
    predicted = np.flatnonzero(subframe > 1)
    if len(predicted):
        out[predicted] = _decode_predicted(rows[predicted], bits[predicted], subframe[predicted].astype(np.int64), start[predicted])
    return out.astype(np.int8)


def _take(bits: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    rows, value = np.arange(len(at)), np.zeros(len(at), np.int64)
    for j in range(width):
        value = (value << 1) | bits[rows, at + j]
    return value


def _signed(value: np.ndarray, width: int) -> np.ndarray:
    return value - ((value >> (width - 1)) << width)


def _decode_predicted(rows: np.ndarray, bits: np.ndarray, subframe: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(rows)
    lpc = subframe >= 32
    order = np.where(lpc, subframe - 31, subframe - 8)
    if ((subframe & 1 == 1) & (subframe < 8)).any() or (~lpc & (order > 4)).any():
        raise ValueError("a subframe of a reserved kind")
    residual = np.zeros((n, BLOCK), np.int32)
    warm = np.zeros((n, BLOCK), bool)
    shift, precision = np.zeros(n, np.int64), np.zeros(n, np.int64)
    coefficients = np.zeros((n, 32), np.int64)
    for p in range(int(order.max())):
        own = np.flatnonzero(order > p)
        residual[own, p] = _signed(_take(bits[own], at[own], 8), 8)
        warm[own, p] = True
        at[own] += 8
    own = np.flatnonzero(lpc)
    if len(own):
        precision[own] = _take(bits[own], at[own], 4) + 1
        shift[own] = _signed(_take(bits[own], at[own] + 4, 5), 5)
        at[own] += 9
        for value in np.unique(precision[own]):
            same = own[precision[own] == value]
            for p in range(int(order[same].max())):
                part = same[order[same] > p]
                coefficients[part, p] = _signed(_take(bits[part], at[part], int(value)), int(value))
                at[part] += value
    method, partitions = _take(bits, at, 2), _take(bits, at + 2, 4)
    if partitions.any() or (method > 1).any():
        raise ValueError("more than one Rice partition")
    at += 6
    k = np.where(method == 0, _take(bits, at, 4), _take(bits, at, 5))
    if (k == np.where(method == 0, 15, 31)).any():
        raise ValueError("residuals that aren't Rice coded")
    at += np.where(method == 0, 4, 5)

    place = np.where(bits.astype(bool), np.arange(bits.shape[1], dtype=np.int32), np.int32(1 << 30))
    following = np.ascontiguousarray(np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    wide = np.zeros((n, rows.shape[1]), np.int64)
    for j in range(4):
        wide[:, : rows.shape[1] - j] |= rows[:, j:].astype(np.int64) << (24 - 8 * j)
    wide, bit_base, byte_base = wide.reshape(-1), np.arange(n) * bits.shape[1], np.arange(n) * rows.shape[1]
    mask, at = (1 << k) - 1, at.astype(np.int64)
    for step in range(BLOCK):
        if step < 32 and warm[:, step].any():
            active = np.flatnonzero(~warm[:, step])
            if not len(active):
                continue
            a, kk, mm, bb, yb = at[active], k[active], mask[active], bit_base[active], byte_base[active]
        else:
            active, a, kk, mm, bb, yb = slice(None), at, k, mask, bit_base, byte_base
        stop = following[bb + a]
        low_at = stop + 1
        low = (wide[yb + (low_at >> 3)] >> (32 - (low_at & 7) - kk)) & mm
        u = ((stop - a) << kk) | low
        residual[active, step] = (u >> 1) ^ -(u & 1)
        at[active] = low_at + kk

    for o in range(1, 5):  # fixed predictors: sums of sums, each on top of the warm-up's last difference
        own = np.flatnonzero(~lpc & (order == o))
        if len(own):
            head, x = residual[own, :o].astype(np.int64), residual[own, o:].astype(np.int64)
            for level in range(o - 1, -1, -1):
                x = np.diff(head, n=level, axis=1)[:, -1:] + np.cumsum(x, axis=1)
            residual[own, o:] = x
    for o in np.unique(order[lpc]):
        own = np.flatnonzero(lpc & (order == o))
        x, c, s = residual[own].astype(np.int64), coefficients[own, :o][:, ::-1], shift[own]
        for t in range(int(o), BLOCK):
            x[:, t] += (x[:, t - o : t] * c).sum(1) >> s
        residual[own] = x
    return residual
