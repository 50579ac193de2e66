"""Operators against plain versions of the same rules, and on labelled documents that they haven't seen."""

import collections
import itertools
import math
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import hmm, html_text, mixing, near_copies, packing, quality, queries, toxicity
from marginalia.llm.tokenization import vocabulary

WORDS = {"idiot": "i", "kill": "t", "you": "y", "not": "n", "said": "r", "x": "o"}


def plain_clause(symbols, w):
    """The score of one clause, by flags and counters instead of machines."""
    total, seen_target, aimed, insult_open, after_threat, negated, reported, last_target = 0.0, False, False, False, 0, 0, False, False
    for s in symbols:
        hit = None
        is_target = s == "y" and not last_target
        last_target = s == "y"
        s = s if s != "y" or is_target else "o"
        threat_done = False
        if s == "t":
            threat_done = seen_target
            after_threat = 0 if seen_target else 4
        elif s == "y":
            threat_done, after_threat, seen_target = after_threat > 0, 0, True
        else:
            after_threat = max(0, after_threat - 1)
        if threat_done:
            hit, aimed = w["threat"], True
        elif s == "i":
            hit = w["insult"] + (w["target"] if aimed else 0.0)
            insult_open = not aimed
        elif s == "y":
            hit = w["target"] if insult_open and not aimed else None
            aimed = True
        if hit is not None:
            total += hit * (w["negated"] if negated else 1.0) * (w["reported"] if reported else 1.0)
        negated = 3 if s == "n" else max(0, negated - 1)
        reported = reported or s == "r"
    return total


def test_composed_machines_equal_a_plain_reader():
    rng, w = np.random.default_rng(1), {"insult": 2.0, "target": 0.5, "threat": 3.0, "negated": 0.4, "reported": 0.3}
    model = toxicity.Model({"idiot": 1.0}, {}, w)
    lexer, grammar = toxicity.Lexer(model), toxicity.machine(model)
    matched = 0
    for _ in range(800):
        clauses = [[str(x) for x in rng.choice(list(WORDS), rng.integers(1, 9))] for _ in range(rng.integers(1, 4))]
        text = " ".join(" ".join(c[:-1] + [c[-1] + "."]) for c in clauses)
        want = [s for s in (plain_clause([WORDS[x] for x in c], w) for c in clauses) if s]
        got = toxicity.clause_scores(text, lexer, grammar)
        assert np.allclose(got, want), text
        matched += len(want)
    assert matched > 500


def labelled(column, modulus, held):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), {column} FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) WHERE {column} IS NOT NULL ORDER BY doc_id").fetchall()
    is_held = lambda i: zlib.crc32(str(i).encode()) % modulus == held
    return [(t, y) for i, t, y in rows if not is_held(i)], [(t, y) for i, t, y in rows if is_held(i)]


def test_toxicity_finds_unseen_toxic_texts():
    seen, unseen = labelled("toxic", 3, 1)
    model = toxicity.fit(seen)
    lexer, grammar = toxicity.Lexer(model), toxicity.machine(model)
    found = [toxicity.probability(model, min(toxicity.evidence(toxicity.clause_scores(t, lexer, grammar)), toxicity.MOST_EVIDENCE)) >= queries.TOXIC_FROM for t, _ in unseen]
    right = sum(f and y for f, (_, y) in zip(found, unseen))
    assert right >= 0.9 * sum(y for _, y in unseen) and right >= 0.95 * sum(found)


def test_quality_is_right_on_unseen_texts_and_equals_plain_sums(spark):
    seen, unseen = labelled("quality", 5, 0)
    model = quality.fit(seen)
    rows = [(i, t) for i, (t, _) in enumerate(unseen)]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert np.mean([(got[i] >= queries.GOOD_FROM) == bool(y) for i, (_, y) in enumerate(unseen)]) > 0.98
    for i, text in rows[:25]:
        words = quality.tokens(text)
        ids = [model.ids.get(x, model.ids.get(quality.shape(x), 0)) for x in words]
        ids += [model.ids[quality.REPEATED]] * sum(a == b for a, b in itertools.pairwise(words))
        vectors = np.array([model.vectors[k] for k in ids], np.float64)
        x = np.concatenate([vectors.mean(0), vectors.std(0), [math.log1p(len(ids)), len(set(ids)) / len(ids)]])
        logit = sum(model.w2[h] * math.tanh(sum((x[d] - model.mean[d]) / model.spread[d] * model.w1[d, h] for d in range(len(x))) + model.b1[h]) for h in range(len(model.w2))) + model.b2
        assert math.isclose(got[i], 1 / (1 + math.exp(-logit / model.temperature)), abs_tol=1e-3)


def test_word_vectors_sum_their_neighbours(monkeypatch):
    monkeypatch.setattr(quality, "LEAST_COUNT", 1)
    texts = ["a b c a", "b c", "c"]
    ids, vectors = quality.word_vectors(texts)
    context = collections.defaultdict(lambda: np.zeros(quality.DIMENSIONS))
    for t in texts:
        words = t.split()
        for i, j in itertools.permutations(range(len(words)), 2):
            if abs(i - j) <= quality.WINDOW:
                context[words[i]] += quality.index_vector(words[j])
    for word in "abc":
        own = context[word] / (np.linalg.norm(context[word]) or 1) + quality.index_vector(word) / math.sqrt(quality.NONZERO)
        assert np.allclose(vectors[ids[word]], own, atol=1e-5)


def test_model_scores_equal_enumeration(spark, monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 3)
    monkeypatch.setattr(hmm, "OWN_CLASSES", 3)
    rng, pool = np.random.default_rng(2), "the cat sat mat dog ran red hat big sun".split()
    rows = [(i, " ".join(rng.choice(pool[: 3 + i % 8], rng.integers(0, 5)))) for i in range(60)] + [(100, "never seen")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    training = frame.where(~held)
    lexicon = hmm.build_lexicon(hmm.word_counts(training))
    shared = spark.sparkContext.broadcast(lexicon)
    chain = hmm.baum_welch(training, shared, hmm.first_chain(lexicon))
    counts = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*hmm.tokens(t.encode()), b""])
    by_class = collections.defaultdict(lambda: [0, 0])
    for w, c in counts.items():
        if lexicon.codes[w] >= lexicon.own:
            by_class[hmm.ending_class(w)][0] += c
            by_class[hmm.ending_class(w)][1] += 1
    got = {r["doc_id"]: r["score"] for r in hmm.score(frame).collect()}
    for i, text in rows:
        classes, share = [], 0.0
        for w in [*hmm.tokens(text.encode()), b""]:
            own = lexicon.codes.get(w, lexicon.own) < lexicon.own
            classes.append(lexicon.codes[w] if own else lexicon.own + hmm.ending_class(w))
            if not own:
                total, distinct = by_class[hmm.ending_class(w)]
                share += math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1)))
        p = 0.0
        for path in itertools.product(range(3), repeat=len(classes)):
            q = chain.first[path[0]] * chain.emit[path[0], classes[0]]
            for a, b, c in zip(path, path[1:], classes[1:]):
                q *= chain.move[a, b] * chain.emit[b, c]
            p += q
        assert math.isclose(got[i], math.log10(p) + share, rel_tol=1e-5), text


def test_expected_counts_of_blocks_equal_those_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(3)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    chain = hmm.Chain(norm(rng.random(4)), norm(rng.random(4)), norm(rng.random((4, 4))), norm(rng.random((4, 9))))
    texts = [rng.integers(0, 9, n) for n in (700, 3, 64, 1, 250, 64)]
    results = []
    for words in (10**6, 40, 1):
        monkeypatch.setattr(hmm, "PACK_WORDS", words)
        sums = [np.zeros(4), np.zeros(4), np.zeros((4, 4)), np.zeros((4, 9))]
        log = sum(hmm.expected_counts(hmm.Packed(pack), np.ones(len(pack), bool), chain, sums) for pack in hmm.packs(texts))
        results.append((log, sums))
    assert math.isclose(results[0][1][3].sum(), sum(map(len, texts))) and math.isclose(results[0][1][2].sum(), sum(len(t) - 1 for t in texts))
    for log, sums in results[1:]:
        assert math.isclose(log, results[0][0], rel_tol=1e-9) and all(np.allclose(a, b) for a, b in zip(sums, results[0][1]))


LONG = "This is the first of the paragraphs, and it is as long as it has to be for the rules to see that it is text. "
#: Blocks of pages without an article, each with what it is.
PAGES = [
    [("good", f"<h2>Of the house</h2><p>{LONG * 2}</p>"), ("good", "<p>Yes.</p>"), ("bad", "<ul><li><a href=a>One</a></li><li><a href=b>Two more of them</a></li></ul>"), ("bad", "<p>Shop now</p>")],
    [("bad", "<div class=menu>Home About</div>"), ("good", f"<p>{LONG}</p>"), ("good", "<p>Short.</p>"), ("good", f"<div>{LONG}{LONG}</div>"), ("bad", "<div id=footer>All rights</div>")],
    [("bad", "<p><a href=x>" + "word link text " * 8 + "</a></p>"), ("bad", "<p>zxq qrt <a href=y>plk</a> vvb nnm kkl wwq ppo mmn bbv ccx zza qqw rrt yyu uui ooi ppa</p>"), ("good", f"<p>{LONG}</p>")],
]


@pytest.mark.parametrize("blocks", PAGES)
def test_pages_without_an_article(blocks):
    page = "<html><body>" + "".join(html for _, html in blocks) + "</body></html>"
    want = [html_text.blocks_of(html) for kind, html in blocks if kind == "good"]
    assert html_text.main_text(page) == " ".join(b.text for own in want for b in own)


def test_broken_pages_take_time_in_proportion():
    for unit in ("<a ", "<b>", "</i>", "<!", "<p title=\"x>", "<li>x", "</title", "<", "&", "<a b='c=\""):
        page = unit * (1_000_000 // len(unit))
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 20, unit
    assert html_text.main_text('<p>a</p><p title="foo>bar') == "a bar" and html_text.main_text("<article><p>x <math>y+1</math> &lt;</p></article>") == "x y+1 <"


def test_large_and_missing_ids_stay_as_they_are(spark):
    ids = [2**53 + 1, None, None, 2**53, -(2**62)]
    rows = [(i, f"some text {n}") for n, i in enumerate(ids)] + [(None, "same"), (None, "same"), (7, "same")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(frame, vocabulary("byte_bpe_50k.json")).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows)
    lengths = packing.token_lengths(frame.coalesce(1), vocabulary("byte_bpe_50k.json"), 1024, 0).where("doc_id IS NULL").groupBy("crcs").agg(F.sort_array(F.collect_list("nth")).alias("n")).collect()
    assert sorted(r["n"] for r in lengths) == [[0], [0], [0, 1]]


def test_keys_of_low_weight_have_no_ties_and_columns_may_clash(spark):
    rows = [(i, "% # $ & " * 10, "s", i, "t", 1, 2) for i in range(3000)] + [(9000 + i, "word " * 40, "z", 0, "t", 1, 2) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, taken string, copy long, row_mixed long")
    weight = mixing.quality_weight(F.col("text"), F.lit(40))
    assert frame.select(weight.alias("w")).distinct().count() == 2
    taken = [r["doc_id"] for r in mixing.mix(frame).where("source = 's' AND taken >= size AND taken > 0").collect()]
    assert 0 < len(taken) < 3000 and abs(np.mean(taken) - 1500) < 150  # drawn at random, not by id
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns and mixed.where("taken <> 't' OR copy <> 1").count() == 0


def test_groups_of_near_copies_are_measured_against_their_centre(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FEW", 3)
    monkeypatch.setattr(near_copies, "SPREAD", 10)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choice(words, 60).tolist()
    base = rng.choice(words, 200).tolist()
    copies = []
    for i in range(60):
        own = list(base)
        own[int(rng.integers(0, 200))] = f"own{i}"
        copies.append(" ".join(own))
    sharing = [" ".join([*rng.choice(words, 90).tolist(), *passage, *rng.choice(words, 90).tolist()]) for _ in range(40)]
    texts = [" ".join(base), *copies, *sharing]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = []
    measured = near_copies.measured
    monkeypatch.setattr(near_copies, "measured", lambda docs, classes, p: pairs.append(p.count()) or measured(docs, classes, p))
    kept = sorted(r["doc_id"] for r in near_copies.deduplicated(frame).collect())
    assert kept == [0, *range(61, 101)]
    assert sum(pairs) < 300  # of 1,830 pairs of copies, and 780 of texts that share the passage
    sketch, groups = near_copies.frequency_sketch(frame, len(texts))
    shared = near_copies.shingle_hashes([w.encode() for w in passage])
    order = near_copies.Order(*near_copies.common_shingles([]), sketch, groups)
    assert (near_copies.frequencies(shared, order) > 0).all()
