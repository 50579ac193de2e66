"""New units go to the library in small calls, and known ones cost little beside their ids."""

import random
import tracemalloc

from marginalia.llm import tokenization


class Counted:
    """A tokenizer that notes the longest text of a call."""

    def __init__(self, tokenizer):
        self.tokenizer, self.longest = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.longest = max(self.longest, sum(map(len, texts)))
        return self.tokenizer.encode_batch_fast(texts, **options)


def _texts(units):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=8)) + rng.choice(["", "", ".", ",", "1", ")!"]) for _ in range(units)]
    return [" ".join(words[i : i + 500]) for i in range(0, units, 500)]


def test_calls_are_small():
    texts = [*_texts(12_000), "", "a\n\nb", "don't, été"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = tokenization.UnitEncoder(tokenization.vocabulary(name))
        want = own._whole(texts)
        own.tokenizer = Counted(own.tokenizer)
        assert own.encode(texts) == want
        assert own.tokenizer.longest <= 32 * 1024


def test_known_units_cost_little():
    texts = _texts(2_000) * 100
    own = tokenization.UnitEncoder(tokenization.vocabulary("byte_bpe_50k.json"))
    own.encode(texts)
    tracemalloc.start()
    try:
        ids = own.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2.5 * sum(map(len, ids))
