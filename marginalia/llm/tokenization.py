"""Token ids by the ``tokenizers`` library, with a bounded cache of encoded words.

Both vocabularies that the queries use cut a text at white space before they merge anything, so
the ids of a text are those of its white-space units in turn. Each distinct unit is encoded by the
library once and kept; a text with white space or special-token strings for which that cut is not
plain goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marginalia.llm.common import holds

#: Units that a worker keeps; beyond it new units are encoded each time they occur.
CACHE_UNITS = 700_000
#: Longer units are encoded, but not kept.
CACHED_CHARS = 40

# White space besides the space and the line feed, for which libraries differ; and the start of special tokens.
_ODD_ASCII = ["<|", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f"]
_ODD_WIDE = re.compile("[" + "".join(map(chr, [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])) + "]")
# A word of letters, and the signs that may stand behind it, which both vocabularies cut apart; without the apostrophe, which may belong to letters.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Units that go to the library in one call, whose answer takes far more memory than their ids.
CALL_UNITS = 1024
#: Stands between units; no plain text holds it.
CUT = "\x1e"
# Runs of white space, whose cut depends on what follows.
_RUNS = ["  ", " \n", "\n ", "\n\n"]


def _pieces(ids: np.ndarray, ends: list[int], skip: int) -> list[bytes]:
    """The bytes of the ids up to each end; ``skip`` ids stand between two pieces."""
    data, begin, out = ids.tobytes(), 0, []
    for end in ends:
        out.append(data[4 * begin : 4 * end])
        begin = end + skip
    return out


class UnitEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``keeps_spaces``: a space belongs to the word after it (byte-level BPE) rather than being
    dropped.
    """

    def __init__(self, path: str):
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = self.tokenizer.encode("a b", add_special_tokens=False).tokens
        self.keeps_spaces = any(t.startswith("Ġ") for t in probe)
        # A special token's string parts a text into pieces that are encoded each by itself.
        self.part = next(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special)
        self.part_id = self.tokenizer.token_to_id(self.part)
        # Tokens that begin a unit (byte-level) or end one (word ends), by id.
        tokens = self.tokenizer.get_vocab()
        self.marks = np.zeros(max(tokens.values()) + 1, bool)
        for token, i in tokens.items():
            self.marks[i] = token.startswith("Ġ") if self.keeps_spaces else token.endswith("</w>")
        self.units: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, units: list[str]) -> dict[str, bytes]:
        """The ids of many short units, CALL_UNITS of them by a call: words of letters by themselves, then the others. Of a
        word with signs behind it both are units by themselves, so words are encoded once whatever follows them."""
        known, letters, others, cut = self.units, set(), set(), []
        for u in units:
            word = u.rstrip(_SIGNS)
            plain = _WORD(word)
            if plain and len(word) < len(u):
                signs = u[len(word) :]
                cut += (u, word, signs)  # no tuples are kept, for which the collector would come by
                if signs not in known:
                    others.add(signs)
                if word in known:
                    continue
            else:
                word = u
            (letters if plain and (word[0] == " ") == self.keeps_spaces else others).add(word)
        out: dict[str, bytes] = {}
        for called, kind in ((self._marked, letters), (self._parted, others)):
            kind = list(kind)
            for i in range(0, len(kind), CALL_UNITS):
                some = kind[i : i + CALL_UNITS]
                found = called(some)
                out.update(self._parted(some) if found is None else found)
        for u, word, signs in zip(cut[::3], cut[1::3], cut[2::3]):
            out[u] = (known.get(word) or out[word]) + (known.get(signs) or out[signs])
        return out

    def _marked(self, units: list[str]) -> dict[str, bytes] | None:
        """Units that the library doesn't cut further, told apart by the marks of their tokens; None where the
        marks don't give one piece for each."""
        ids = np.array(self.tokenizer.encode_batch_fast([("" if self.keeps_spaces else " ").join(units)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.marks[ids])
        ends = np.append(at[1:], len(ids)) if self.keeps_spaces else at + 1
        if len(ends) != len(units) or int(ends[-1]) != len(ids):
            return None
        return dict(zip(units, _pieces(ids, ends.tolist(), 0)))

    def _parted(self, units: list[str]) -> dict[str, bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([self.part.join(units)], add_special_tokens=False)[0].ids, "<u4")
        return dict(zip(units, _pieces(ids, [*np.flatnonzero(ids == self.part_id).tolist(), len(ids)], 1)))

    def _marked_units(self, text: str) -> str:
        """The text with CUT between its units, some of which may be empty."""
        if not self.keeps_spaces:
            return (text.lower() if text.isascii() else text).replace("\n", CUT).replace(" ", CUT)
        return text.replace(" ", f"{CUT} ").replace("\n", f"{CUT}\n{CUT}")

    def _odd(self, text: str) -> bool:
        if any(x in text for x in (_ODD_ASCII + _RUNS if self.keeps_spaces else _ODD_ASCII)):
            return True
        return not text.isascii() and _ODD_WIDE.search(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Each different unit of the plain texts is looked up once; the texts' ids are then taken
        from those of the units."""
        out = [b""] * len(texts)
        odd = list(map(self._odd, texts))
        whole, plain = [i for i, x in enumerate(odd) if x], [i for i, x in enumerate(odd) if not x]
        if whole:
            for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
                out[i] = ids
        if not plain:
            return out
        cut = pc.split_pattern(pa.array([self._marked_units(texts[i]) for i in plain], pa.large_string()), CUT)
        own = cut.values.dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own.dictionary)], pa.int32()), own.dictionary), pa.scalar(CUT, pa.large_string()))
        units, known = joined[0].as_py().split(CUT), self.units  # faster than one by one
        parts = list(map(known.get, units))
        missing = [i for i, part in enumerate(parts) if part is None]
        if missing:
            fresh = self._each([units[i] for i in missing if units[i]])
            for i in missing:
                parts[i] = fresh.get(units[i], b"")
            if len(known) < CACHE_UNITS:
                known.update((u, b) for u, b in fresh.items() if len(u) <= CACHED_CHARS)
        rows = pa.array(parts, pa.large_binary()).take(own.indices)
        _, ends, ids = rows.buffers()
        stops = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()].tolist()
        data = memoryview(ids) if ids else b""
        for i, begin, stop in zip(plain, stops, stops[1:]):
            out[i] = bytes(data[begin:stop])
        return out


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a vocabulary file; it lives until the worker is at something else."""
    holds(path, lambda: _ENCODERS.pop(path, None))
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; the package is installed on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
