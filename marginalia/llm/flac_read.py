"""A reader for FLAC streams of any ordinary encoder, one frame after the other.

``flac`` decodes its own streams many frames at a time; this reads what the format allows besides: fixed and
variable block sizes, one to eight channels with their differences, 4 to 32 bits, wasted bits, Rice partitions of either
method with unencoded ones, and streams without a seek table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from marginalia.llm.flac import _blocks, _crc16_rows, crc8

# Fixed values of the format: bits by their code.
_SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class Bits:
    """Reads numbers from bytes, the most significant bit first."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, width: int) -> int:
        begin, end = self.at >> 3, (self.at + width + 7) >> 3
        if end > len(self.data):
            raise ValueError("the stream ends within a frame")
        value = int.from_bytes(self.data[begin:end], "big") >> (8 * end - self.at - width)
        self.at += width
        return value & ((1 << width) - 1)

    def signed(self, width: int) -> int:
        value = self.take(width)
        return value - ((value >> (width - 1)) << width) if width else 0

    def zeros(self) -> int:
        """How many zero bits stand before the next one, which is passed."""
        count = 0
        while True:
            width = min(64, 8 * len(self.data) - self.at)
            if width <= 0:
                raise ValueError("the stream ends within a frame")
            window = self.take(width)
            if window:
                run = width - window.bit_length()
                self.at -= width - run - 1
                return count + run
            count += width


@dataclass
class Pcm:
    samples: np.ndarray  # samples x channels
    bits: int
    rate: int
    offsets: np.ndarray  # the sample at which each frame begins

    def to_bytes(self, unsigned: bool = True) -> bytes:
        """Channels by turns, little-endian; up to 8 bits are unsigned, as in a WAV file."""
        width = (self.bits + 7) // 8
        values = self.samples.astype(np.int64).ravel() + (128 if width == 1 and unsigned else 0)
        return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _residual(bits: Bits, order: int, size: int) -> list[int]:
    method, parts = bits.take(2), 1 << bits.take(4)
    if method > 1:
        raise ValueError("residuals of a reserved kind")
    width = 4 + method
    if size % parts or size // parts < order:
        raise ValueError("partitions that the block doesn't hold")
    out: list[int] = []
    for part in range(parts):
        count, k = size // parts - (order if part == 0 else 0), bits.take(width)
        if k == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(count)]
            continue
        for _ in range(count):
            u = (bits.zeros() << k) | (bits.take(k) if k else 0)
            out.append((u >> 1) ^ -(u & 1))
    return out


# The coefficients of the fixed predictors of order 0 to 4.
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _subframe(bits: Bits, size: int, width: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("a subframe's first bit is set")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.zeros() + 1
        width -= wasted
    if kind == 0:
        values = [bits.signed(width)] * size
    elif kind == 1:
        values = [bits.signed(width) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        values = [bits.signed(width) for _ in range(order)]
        coefficients, shift = (_FIXED[order], 0) if kind < 32 else ([], 0)
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("a predictor of a reserved kind")
            coefficients = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, order, size):
            values.append(r + (sum(c * values[-1 - j] for j, c in enumerate(coefficients)) >> shift))
    else:
        raise ValueError("a subframe of a reserved kind")
    return np.array(values, np.int64) << wasted


def _frame(stream: bytes, at: int, info_bits: int) -> tuple[np.ndarray, int]:
    """The samples of the frame at ``at`` (samples x channels), and where the next one begins."""
    bits = Bits(stream, at)
    if bits.take(15) != 0x7FFC:
        raise ValueError("a frame header is damaged")
    bits.take(1)
    size_code, rate_code, channel_code, bits_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    extra = 0
    first = bits.take(8)
    while first & (0x80 >> extra):
        extra += 1
    for _ in range(max(0, extra - 1)):
        bits.take(8)
    if size_code in (6, 7):
        size = bits.take(8 if size_code == 6 else 16) + 1
    elif size_code == 0:
        raise ValueError("a frame header is damaged")
    else:
        size = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    if rate_code >= 12:
        bits.take(8 if rate_code == 12 else 16)
    head = bits.at >> 3
    if crc8(stream[at:head]) != bits.take(8):
        raise ValueError("a frame header is damaged")
    width = _SAMPLE_BITS.get(bits_code, info_bits)
    if channel_code > 10:
        raise ValueError("channels of a reserved kind")
    if channel_code < 8:
        channels = [_subframe(bits, size, width) for _ in range(channel_code + 1)]
    else:  # a difference has a bit more
        one, other = _subframe(bits, size, width + (channel_code == 9)), _subframe(bits, size, width + (channel_code != 9))
        if channel_code == 8:
            channels = [one, one - other]
        elif channel_code == 9:
            channels = [one + other, other]
        else:
            total = (one << 1) | (other & 1)
            channels = [(total + other) >> 1, (total - other) >> 1]
    end = (bits.at + 7) >> 3
    own = np.frombuffer(stream[at:end], np.uint8)[None, :]
    if stream[end : end + 2] != int(_crc16_rows(own, np.array([end - at]))[0]).to_bytes(2, "big"):
        raise ValueError("a frame's CRC-16 differs")
    return np.stack(channels, 1), end + 2


def _info(info: bytes) -> tuple[int, int, int, int]:
    """Rate, channels, bits and samples of STREAMINFO."""
    packed = int.from_bytes(info[10:18], "big")
    return packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)


def read_stream(stream: bytes) -> Pcm:
    """All samples of a stream; both checksums of each frame, the number of samples (where it is told), the seek points and
    the MD5 (where it is told) are verified, and a mismatch is an error."""
    info, points, first = _blocks(stream)
    rate, channels, width, total = _info(info)
    frames, starts, offsets, at = [], {}, [], first
    count = 0
    while at < len(stream):
        samples, end = _frame(stream, at, width)
        if samples.shape[1] != channels:
            raise ValueError("a frame has other channels")
        starts[count] = at - first
        offsets.append(count)
        frames.append(samples)
        count, at = count + len(samples), end
    if total and count != total:
        raise ValueError("the stream has more or fewer samples than it tells")
    if any(starts.get(sample) != place for sample, place in points if sample != (1 << 64) - 1):
        raise ValueError("a seek point isn't at a frame")
    pcm = Pcm(np.concatenate(frames) if frames else np.empty((0, channels), np.int64), width, rate, np.array(offsets, np.int64))
    if any(info[18:34]) and hashlib.md5(pcm.to_bytes(unsigned=False)).digest() != info[18:34]:
        raise ValueError("the samples' MD5 differs")
    return pcm


def read_block(stream: bytes, sample: int) -> tuple[int, np.ndarray]:
    """The frame that holds a sample: its first sample's number and its samples. The seek table, if there is one, spares
    the frames before it."""
    info, points, first = _blocks(stream)
    count, at = max(((s, first + place) for s, place in points if s <= sample), default=(0, first))
    while at < len(stream):
        samples, at = _frame(stream, at, _info(info)[2])
        if count + len(samples) > sample:
            return count, samples
        count += len(samples)
    raise IndexError("the stream has no such sample")
