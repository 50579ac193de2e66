"""Long words count whole for the quality score."""

import numpy as np

from marginalia.llm import quality


def test_a_text_without_spaces_is_scored_whole():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdeiou"), 5))
    model = quality.fit([(" ".join(word() + ("%%%" if not y else "") for _ in range(40)), y) for y in rng.integers(0, 2, 200).tolist()])
    look = quality.TokenIds(model.ids)
    rows = lambda text: quality.token_rows(text, look, model.ids[quality.REPEATED])
    assert not np.array_equal(rows("a" * 64 + "b" * 6000), rows("a" * 64 + "b%" * 3000)) and len(rows("ab%" * 3000)) > 500
    for text in ("x" * 1000, "aB9%" * 300, "漢字" * 100, "plain words", "a" * 64, "a%" * 4, ""):
        assert "".join(quality.tokens(text)) == text.replace(" ", "")
        assert all(len(t) <= 64 and len(quality.shape(t)) <= 9 for t in quality.tokens(text))
    assert quality.tokens("a" * 64) == ["a" * 64] and len(quality.tokens("a%" * 4)) == 1
