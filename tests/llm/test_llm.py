"""The training-data operators against brute force, exact round trips and edge cases."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import flac, hmm, html_text, media, mixing, packing, quality, simhash, token_store, topk, toxicity
from marginalia.llm.components import connected_components
from marginalia.llm.tokenization import encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, start long, key string"
TEXTS = ["the cat sat on the mat. The dog ran", "a", "", None, "x  y\n\n z\t\x0b", "<|endoftext|> hi", "Ünï cödé 漢字 — “quotes” it's we'll", "the cat sat on the mat. The dog ran", "word " * 3000, "é" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 4 == 3 else f"s{i % 3}", 0, 1, 2, "k") for i, t in enumerate(TEXTS)]
    rows += [(5, "repeated row", "en", "s1", 0, 1, 2, "k")] * 2 + [(None, "no id", None, "s0", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(name, text, end):
    found = Tokenizer.from_file(vocabulary(name)).encode(text or "", add_special_tokens=False).ids
    return np.array([*found, end], "<u4")


def text_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_unit_encoder_equals_the_library(name):
    rng = np.random.default_rng(1)
    alphabet = list("ab cD'.,!1 \n\t") + ["é", "ß", "漢", "́", "\xa0", "İ", "Σ", " the", "'s", "<|"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(1500)]
    own = encoder(vocabulary(name)).encode(texts)
    library = Tokenizer.from_file(vocabulary(name)).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(o, "<u4").tolist() for o in own] == [e.ids for e in library]


def test_packing_covers_each_id_once(spark, docs, nothing):
    got = packing.pack(docs, vocabulary("byte_bpe_50k.json")).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, text in {d: t for d, t in text_rows(docs) if d != 5}.items():
        ids, at = ids_of("byte_bpe_50k.json", text, 0), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and {r["sequence_tokens"] for r in rows} == {at}
    assert packing.pack(nothing, vocabulary("byte_bpe_50k.json")).count() == 0


def test_bin_tree_is_first_fit():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 300).tolist()
    bins, free = packing.first_fit_decreasing(sizes, 100), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if at == len(free):
            free.append(100)
        free[at] -= sizes[i]
        assert bins[i] == at


def test_token_store_round_trip(spark, docs, nothing, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path, vocabulary("word_bpe_49k.json"), 2)
    want, at = [], 0
    for doc_id, text in sorted(text_rows(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of("word_bpe_49k.json", text, 2)
        want.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.verify_store(spark, path).collect()]
    assert sorted(((d, n, c) for d, _, n, c in got), key=repr) == sorted(want, key=repr)
    ends = sorted((s, s + n) for _, s, n, _ in got)
    assert ends[0][0] == 0 and ends[-1][1] == at and all(a[1] == b[0] for a, b in itertools.pairwise(ends))
    assert [d for d, *_ in sorted(got, key=lambda r: r[1])] == [d for d, *_ in want]
    whole = {r["doc_id"]: r["ids"] for r in token_store.read_documents(spark, path).where("doc_id <> 5").collect()}
    assert whole[8] == ids_of("word_bpe_49k.json", TEXTS[8], 2).tolist()
    digests = [bytes(r["digest"]) for r in token_store.read_chunks(spark, path).collect()]
    assert len(digests) == len(set(digests))
    empty = f"file://{tmp_path}/empty"
    token_store.write_store(nothing, empty, vocabulary("word_bpe_49k.json"), 2)
    assert token_store.verify_store(spark, empty).count() == 0


def test_crc_shift_joins_checksums():
    a, b = b"abcd" * 7, b"wxyz" * 3001
    moved = token_store.crc_times(token_store.crc_shift(np.array([len(b) // 4])), np.array([zlib.crc32(a)], np.uint32))
    assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_toxicity_grammar_and_induction(spark, docs, nothing):
    model = toxicity.Model({"idiot": 1.0}, {"lowei": 1.0}, {"insult": 2.0, "target": 0.5, "threat": 2.0, "negated": 0.4, "reported": 0.5})
    score = lambda t: toxicity.evidence(toxicity.clause_scores(t, toxicity.Lexer(model), toxicity.machine(model)))
    assert score("you idiot") > score("an idiot") > score("he said an idiot") > 0
    assert score("an idiot") > score("not an idiot") > 0 and score("kill the lights") == 0 < score("i will kill you")
    assert score("x loweiab y") == score("an idiot") and score("") == 0
    sample = [(f"w{i} bad{i % 7}{'zorgabc' if i % 2 else ''} t{i}", i % 2) for i in range(200)]
    sample = [(t.replace("bad" + str(i % 7) + "zorgabc", "zorg" + "abcdefghij"[i % 10] * 3), y) for i, (t, y) in enumerate(sample)]
    words, prefixes = toxicity.induce(sample)
    assert any(p.startswith("zorg") for p in prefixes)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.without_toxic(docs, model, 0.7).columns == docs.columns
    assert toxicity.fit([]).words and toxicity.fit([("a b", 0)]).slope > 0


def test_quality_learns_junk(spark, docs, nothing):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdeiou"), 5))
    sample = [(" ".join(word() + ("%%%" if not y else "") for _ in range(40)), y) for y in rng.integers(0, 2, 300).tolist()]
    model = quality.fit(sample[:200])
    look = quality.TokenIds(model.ids)
    x = np.stack([quality.pooled(quality.token_rows(t, look, model.ids[quality.REPEATED]), model.vectors) for t, _ in sample[200:]])
    assert np.mean((quality.probabilities(x, model) >= 0.5) == np.array([y for _, y in sample[200:]])) > 0.95
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got) and quality.score(nothing, model).count() == 0
    assert quality.score(docs, quality.fit([])).count() == docs.count()


def test_hmm_scores_are_exact(spark, docs, nothing):
    got = hmm.score(docs, rounds=2).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    rows = [(d, [*hmm.tokens((t or "").encode()), b""]) for d, t in text_rows(docs)]
    counts = collections.Counter(w for d, ws in rows if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, held(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for d, ws in rows), key=repr)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == want
    assert all(r["score"] < 0 for r in got) and hmm.score(nothing, rounds=1).count() == 0


def test_forward_equals_enumeration_and_training_helps():
    rng = np.random.default_rng(5)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    chain = hmm.Chain(norm(rng.random(3)), norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 4))))
    sequences = [rng.integers(0, 4, n) for n in (5, 1, 3)]
    packed = hmm.Packed(sequences)
    logs = np.empty(3)
    logs[packed.order] = hmm.forward(packed, np.broadcast_to(chain.first, (3, 3)), chain, False)[0]
    for s, log in zip(sequences, logs):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = chain.first[path[0]] * chain.emit[path[0], s[0]]
            for a, b, c in zip(path, path[1:], s[1:]):
                p *= chain.move[a, b] * chain.emit[b, c]
            total += p
        assert math.isclose(math.log(total), log, rel_tol=1e-9)
    sums = [np.zeros(3), np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))]
    before = hmm.expected_counts(packed, np.ones(3, bool), chain, sums)
    assert math.isclose(sums[3].sum(), 9) and math.isclose(sums[2].sum(), 6)
    better = hmm.Chain(norm(sums[0]), chain.middle, norm(sums[2]), norm(sums[3]))
    assert hmm.expected_counts(packed, np.ones(3, bool), better, [np.zeros_like(s) for s in sums]) > before


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash._LOWER))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, docs, nothing, monkeypatch):
    rng, base = np.random.default_rng(6), "one two three four five six seven eight nine ten eleven twelve".split()
    texts = [" ".join(base * 20 + [f"x{i}" for i in range(k)]) for k in range(40)] + [" ".join(rng.permutation(base)) for _ in range(60)] + [None, "", "A b", "a B", "a b c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    fps = [brute_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, f"{f:016x}", root(i)) for i, f in enumerate(fps)]
    for crowded in (simhash.CROWDED, 2):
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        assert sorted(tuple(r) for r in simhash.near_duplicates(frame).collect()) == want
    assert simhash.near_duplicates(docs).count() == docs.count() and simhash.near_duplicates(nothing).count() == 0
    kept = simhash.deduplicated(frame)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root(i) for i in range(len(texts))})
    assert simhash.deduplicated(docs).columns == docs.columns


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 300), (300, 200), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 300: 200}


@pytest.mark.parametrize("scale", [1.0, 3e6])
def test_top_k_is_exact(spark, scale):
    rng = np.random.default_rng(7)
    vectors = (rng.normal(0, 0.2, (300, 12)) * scale).tolist()
    vectors[10:40] = [vectors[10]] * 30
    rows = [(i, v) for i, v in enumerate(vectors)] + [(500, None), (550, [float("nan")] * 12), (600, [None] * 12), (None, vectors[0]), (650, []), (700, vectors[3])]
    ints = {i: [math.floor(256 * x) for x in v] for i, v in [*rows[:300], *rows[-2:]]}  # an empty vector is one of zeros
    got = sorted(tuple(r) for r in topk.top_k(topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), F.col("vec_id") % 50 == 0).collect())
    want = []
    for q in [i for i in ints if i % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:5]
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert got == sorted(want)
    few = topk.integer_vectors(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(few.where("false"), F.lit(True)).count() == 0


def test_flac_round_trip_and_damage(spark, docs, nothing):
    rng = np.random.default_rng(8)
    raw = [b"", b"abc", bytes(range(256)) * 9, rng.integers(0, 256, 5760).astype(np.uint8).tobytes(), bytes([7]) * 1152, (128 + 100 * np.sin(np.arange(5760) / 20)).astype(np.uint8).tobytes(), np.cumsum(rng.integers(-2, 3, 5760)).astype(np.uint8).tobytes()]
    payloads = [media.payload(r) for r in raw]
    streams = flac.encode(payloads)
    assert [p.tobytes() for p, _ in flac.decode(streams)] == payloads
    assert len(streams[5]) < len(payloads[5]) / 2 and flac.crc8(b"123456789") == 0xF4
    damaged = bytearray(streams[3])
    damaged[-40] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(damaged)])
    read = media.decode_media(media.encode_texts(docs))
    texts = collections.Counter(hashlib.sha256(media.payload((t or "").encode())).hexdigest() for _, t in text_rows(docs))
    assert collections.Counter(hashlib.sha256(bytes(r["pcm"])).hexdigest() for r in read.collect()) == texts
    assert media.pcm_blocks(read).where("octet_length(block) <> 576").count() == 0 and media.encode_texts(nothing).count() == 0


def test_mixing_meets_targets(spark, nothing):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), None if i % 50 == 0 else "abcde"[min(4, i % 9)]) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(frame.repartition(7)).collect()), key=repr)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["size"] == len((rows[r["doc_id"]][1] or "").split())
    order = [*sorted(s for s in size if s is not None), None]
    weight, free, left = {s: i % 3 + 1 for i, s in enumerate(order)}, set(order), sum(size.values())
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]]:
        for s in over:
            assert math.isclose(target[s], 3 * size[s])
            left -= 3 * size[s]
            free.discard(s)
    for s in free:
        assert math.isclose(target[s], left * weight[s] / sum(weight[x] for x in free))
    assert all(abs(taken[s] - target[s]) < 1 for s in order) and mixing.mix(nothing).count() == 0
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns and sum(len(r["text"].split()) for r in mixed.collect()) == sum(taken.values())


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site name</header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="ad">Buy this now</div><article><h1>Head &amp; line</h1><p><b>First<br><p>It is&nbsp;the   second of the paragraphs, which is long enough to count as text by itself.</p><p>Short.</p><form>Name <input></form></article>
<div id="comments"><p>I think that this is the best of all the articles that I have read, and so on.</p></div><footer>&copy; x</footer>"""


def test_html_text(spark, nothing):
    assert html_text.main_text(PAGE) == "Head & line First It is the second of the paragraphs, which is long enough to count as text by itself. Short."
    plain = "<div><p>" + "This is the text of a page that has no article and that is long enough for the rules. " * 4 + "</p><p>Yes.</p></div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>"
    assert html_text.main_text(plain).endswith("rules. Yes.")
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<<<>>> <p"), (5, "u", "<p>" * 2000 + "x"), (1, "u", PAGE), (None, "u", "</div></p>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "mixing", "packing"]
    sf = "/root/testdata/sf0.001"
    documents = docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        assert docs.columns == documents.columns
        if name == "quality":
            before = docs
    want = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(want)
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.count() > 0 and "sequence_id" in pieces.columns
