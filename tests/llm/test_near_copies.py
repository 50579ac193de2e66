"""The pipeline's near-duplicate stage against brute force."""

import itertools
import re

import numpy as np

import corpus_pipeline
from marginalia.llm import near_copies, simhash


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    parent, sets = list(range(len(texts))), [shingles(t) for t in texts]
    root = lambda x: x if parent[x] == x else root(parent[x])
    pairs = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        shared, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if 5 * shared >= 4 * union:
            pairs += sets[i] != sets[j]
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))], pairs


def near_texts():
    rng, words = np.random.default_rng(12), [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "A b", "a B", "a b c", "one two three four five", "one two three four five six"]
    for length in (9, 12, 30, 50, 90, 200, 900):
        for _ in range(3):
            base = rng.choice(words, length).tolist()
            texts.append(" ".join(base))
            for changed in (0.005, 0.01, 0.02, 0.03, 0.05):
                copy = list(base)
                for at in rng.choice(length, max(1, int(changed * length)), replace=False):
                    copy[at] = "X" + copy[at]
                texts += [" ".join(copy), " ".join(base[: int(length * (1 - 4 * changed))])]
    line = " ".join(rng.choice(words, 60))
    return [*texts, *(f"{line} {' '.join(rng.choice(words, n))}" for n in rng.integers(1, 40, 40))]


def test_stage_drops_all_near_copies(spark, monkeypatch):
    texts = near_texts()
    roots, pairs = brute_components(texts)
    assert pairs > 100
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sample, broadcast in ((near_copies.SAMPLE_ROWS, near_copies.BROADCAST_TEXTS), (20, 0)):
        monkeypatch.setattr(near_copies, "SAMPLE_ROWS", sample)
        monkeypatch.setattr(near_copies, "BROADCAST_TEXTS", broadcast)
        kept = corpus_pipeline.drop_near_duplicates(spark, frame, "")
        assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))
    assert corpus_pipeline.drop_near_duplicates(spark, frame.limit(0), "").count() == 0


def test_sets_at_the_border():
    same = np.arange(8, dtype=np.uint64)
    assert near_copies._enough(8, 8 + 10) and not near_copies._enough(7, 8 + 9) and len(near_copies.prefix(same, (same[:0], same[:0]))) == 2


def test_fingerprints_come_first_and_the_exact_check_follows(spark):
    texts = near_texts()
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    stages = dict(corpus_pipeline.STAGES)
    left = stages["simhash"](spark, frame, "").localCheckpoint()
    ids = sorted(r["doc_id"] for r in left.collect())
    assert ids == sorted({r["component_id"] for r in simhash.near_duplicates(frame).collect()})
    roots, pairs = brute_components([texts[i] for i in ids])
    assert pairs and {r["doc_id"] for r in stages["mixing"](spark, left, "").collect()} == {ids[r] for r in set(roots) if shingles(texts[ids[r]])}
