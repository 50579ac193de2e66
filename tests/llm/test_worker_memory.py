"""What a worker keeps for one operator goes when it works for another."""

from marginalia.llm import quality, tokenization
from marginalia.llm.common import holds


def test_memos_of_other_operators_go():
    path = tokenization.vocabulary("byte_bpe_50k.json")
    tokenization.encoder(path).encode(["some words"])
    assert tokenization.encoder(path).units
    holds("quality", quality._PIECES.clear)
    assert not tokenization._ENCODERS
    quality.tokens("A1b2C3d4E5f6-and-more")
    assert quality._PIECES
    tokenization.encoder(path)
    assert not quality._PIECES and list(tokenization._ENCODERS) == [path]


def test_units_with_signs_are_encoded_as_the_library_does():
    texts = ["", " ", "\n", "a", "Word. word, (word) don't don't! we'll... été, 'twas' x.y,z", "a\nb. c\n", "été!?\n...\n a1. 12, İstanbul. Ǆ, ß$$$ ſ. ª. naïve&&& …. word….", "two  spaces.", "x" * 60 + ".", "café. café."]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = tokenization.UnitEncoder(tokenization.vocabulary(name))
        for _ in range(2):
            assert own.encode(texts) == own._whole(texts)
    assert "café" not in own.units or own.units["café."] == own.units["café"] + own.units["."]
