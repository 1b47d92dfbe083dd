"""Scores, toxicity and languages: against brute force, and by held-out accuracy."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import crf, suffix_tree, toxicity
from lexloom.llm.common import id_fold

SF = "/root/testdata/sf0.01"


def symbols(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["\0"]


def brute_tree(train, share, deviations=suffix_tree.DEVIATIONS, least=suffix_tree.LEAST_NATS):
    """The model of suffix_tree.score over lists of symbols; gives a function that scores one."""
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    root = lambda x: (c[x] + 1) / (n + v + 1)
    frequent = {w for w in c if c[w] >= max(1, share * n) and w != "\0"}
    after = {}
    pairs = Counter()
    for t in train:
        for i in range(1, len(t)):
            if t[i - 1] in frequent:
                after.setdefault((t[i - 1],), Counter())[t[i]] += 1
            if i >= 2 and t[i - 1] in frequent and t[i - 2] in frequent:
                pairs[t[i - 2], t[i - 1]] += 1
                after.setdefault((t[i - 2], t[i - 1]), Counter())[t[i]] += 1
    after = {s: f for s, f in after.items() if len(s) == 1 or pairs[s] >= max(1, share * n)}

    def p(s, x, nodes):
        if not s:
            return root(x)
        f, below = after.get(s), p(s[1:], x, nodes)
        if f is None or (nodes is not None and s not in nodes):
            return below
        return (f[x] + len(f) * below) / (sum(f.values()) + len(f))

    nodes = set()
    for s, f in after.items():
        size = sum(f.values())
        gain = sum(k * (math.log(k / size) - math.log(p(s[1:], x, None))) for x, k in f.items())
        if 2 * gain > len(f) + deviations * (2 * len(f)) ** 0.5 and gain >= least * size:
            nodes |= {s, s[1:]} - {()}

    def score(t):
        base = sum(math.log10(root(x)) for x in t)
        tree = sum(math.log10(p(tuple(t[max(0, i - 2) : i]), x, nodes)) for i, x in enumerate(t))
        return base, tree, sum(c[x] > 0 for x in t)

    return score, n, nodes


@pytest.mark.parametrize("block", [1 << 11, 1 << 20])
def test_suffix_tree_equals_brute_force(spark, sf, monkeypatch, block):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", block)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: symbols(r.text) for r in docs.collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    score, n, nodes = brute_tree(train, 2e-3)
    assert any(len(s) == 2 for s in nodes) or any(len(s) == 1 for s in nodes)
    for r in suffix_tree.score(docs, id_fold("doc_id", 7) != 2, share=2e-3).collect():
        base, tree, known = score(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(texts[r.doc_id]), known, n)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score == pytest.approx(tree, rel=1e-4)


def test_two_word_contexts(make):
    rows = [(i, "a b x c b y " * 20) for i in range(12)]
    docs = make(rows)
    score, _, nodes = brute_tree([symbols(t) for _, t in rows], 1e-2)
    assert ("a", "b") in nodes and ("c", "b") in nodes
    for r in suffix_tree.score(docs, F.lit(True), share=1e-2).collect():
        assert r.score == pytest.approx(score(symbols(rows[0][1]))[1], rel=1e-4)


def test_distribution_sums_to_one():
    train = [symbols("a b a c a b d"), symbols("a b")]
    score, _, _ = brute_tree(train, 1e-2)
    vocabulary = {w for t in train for w in t} | {"unseen"}
    for before in (["a"], ["d", "a"], ["q"]):
        whole = sum(10 ** (score([*before, x])[1] - score(before)[1]) for x in vocabulary)
        assert whole == pytest.approx(1)


def test_suffix_tree_odd(odd, empty):
    rows = suffix_tree.score(odd, F.lit(True)).collect()
    assert len(rows) == odd.count()
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert all(math.isfinite(r.score) for r in rows)
    none = suffix_tree.score(odd, F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in none} == {(0, 0, 0.0, 0.0)}
    assert suffix_tree.score(empty, F.lit(True)).count() == 0


def test_held_out_scores_beat_the_root(spark):
    held = suffix_tree.op1_suffix_tree(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b


def test_contexts_of_one_in_four_thousand_symbols(make):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 200_000, 3980)) + " rare follower") for i in range(10)]
    found = suffix_tree.score(make(rows), F.lit(True)).agg(F.sum("n_in_context").alias("n"), F.max("train_tokens").alias("t")).first()
    assert 2e-4 < 10 / found.t < 3e-4 and found.n >= 10


def test_contexts_grow_with_the_corpus(make):
    assert suffix_tree.least_share(10**6) == suffix_tree.SHARE  # never fewer than by the fixed share
    assert suffix_tree.least_share(10**10) == pytest.approx(1e-5)
    # more rows than may be broadcast are joined by a shuffle, with equal scores
    docs = make([(i, "a b x c b y " * 20) for i in range(12)])
    small = suffix_tree.score(docs, F.lit(True), share=1e-2).collect()
    before, suffix_tree.BROADCAST_ROWS = suffix_tree.BROADCAST_ROWS, 0
    try:
        assert sorted(suffix_tree.score(docs, F.lit(True), share=1e-2).collect()) == sorted(small)
    finally:
        suffix_tree.BROADCAST_ROWS = before
    with pytest.raises(ValueError, match="candidates"):
        suffix_tree.score(docs, F.lit(True), share=1e-10)


def test_forward_backward():
    rng = np.random.default_rng(0)
    k = 3
    score, moves, begin = np.exp(rng.normal(size=(7, k))).astype(np.float32), np.exp(rng.normal(size=(k, k))), np.exp(rng.normal(size=k))
    index, bounds = rng.integers(0, 7, 20), np.array([0, 8, 8, 9, 13, 20])
    crf.SEGMENT, before = 3, crf.SEGMENT
    try:
        found = crf.marginal_sums(score, index, bounds, moves, begin)
    finally:
        crf.SEGMENT = before
    for d in range(5):
        x, total, sums = index[bounds[d] : bounds[d + 1]], 0.0, np.zeros(k)
        for y in itertools.product(range(k), repeat=len(x)) if len(x) else []:
            p = begin[y[0]] * score[x[0], y[0]]
            for t in range(1, len(x)):
                p *= moves[y[t - 1], y[t]] * score[x[t], y[t]]
            total += p
            for label in y:
                sums[label] += p
        assert np.allclose(found[d], sums / total if total else 0, atol=1e-4)


def test_languages(spark):
    rows = crf.op9_crf_language(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switching():
    model = crf.fit([("en", "the house of the king and the road to the sea " * 30), ("fr", "la maison du roi et le chemin vers les mers " * 30)])
    share = model.shares(*(lambda i, b, w: (i, b, w.to_pylist()))(*crf.letters(pa.array(["the king and the road la maison et le chemin vers"]))))
    assert 0.3 < share[0][0] < 0.7


def test_languages_of_short_texts_only():
    rng = np.random.default_rng(8)
    made = {lang: [f"{end}{x}{end}" for x in "abcdefghij"] for lang, end in (("aa", "k"), ("bb", "ou"), ("cc", "z"))}
    say = lambda lang, n: " ".join(rng.choice(made[lang], n))
    long = [("aa", say("aa", 200)) for _ in range(40)] + [("bb", say("bb", 200)) for _ in range(40)]
    model = crf.fit(long + [("cc", say("cc", 12)) for _ in range(40)])
    texts = [(lang, say(lang, 20)) for lang in made for _ in range(5)]
    index, bounds, distinct = crf.letters(pa.array([t for _, t in texts]))
    share = model.shares(index, bounds, distinct.to_pylist())
    assert [model.languages[i] for i in share.argmax(axis=1)] == [lang for lang, _ in texts]


def test_languages_odd(odd, empty):
    model = crf.train(odd)
    rows = crf.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (3, 4, 5, 10)} == {("und", 0.0)}
    kept = crf.accept(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.where("doc_id IN (3, 4, 5, 10)").count() == 0
    assert crf.identify(empty, model).count() == 0
    none = crf.train(empty)
    assert {r.lang_pred for r in crf.identify(odd, none).collect()} == {"und"}
    assert crf.accept(odd, none).count() == 0


@pytest.fixture(scope="module")
def characters(spark):
    return toxicity.character_model(toxicity.narrow(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text"))


@pytest.mark.parametrize(("token", "word"), [("1d10t", "idiot"), ("tr4$h", "trash"), ("looooser", "loser"), ("s t u p i d", "stupid"), ("m.o.r.o.n", "moron"), ("p@thet1c", "pathetic"), ("cl0wn", "clown")])
def test_decoding(characters, token, word):
    assert toxicity.decode(token, characters) == word


def test_viterbi_is_optimal(characters):
    def cost(path, readings):
        total, x, y = 0.0, 0, 0
        for (text, price), _ in zip(path, readings, strict=True):
            total += price
            for c in text:
                if c == "\0" and y == 0:
                    continue
                k = toxicity._CODE.get(c, toxicity.SIZE - 1)
                total -= characters.log_p[x, y, k]
                x, y = (y, k) if k else (0, 0)
        return total

    for token in ("1d1", "a-b", "l00p", "e55"):
        readings = [*toxicity.lattice(token), [("\0", 0.0)]]
        best = min(itertools.product(*readings), key=lambda p: cost(p, readings))
        assert toxicity.decode(token, characters) == " ".join("".join(t for t, _ in best).split("\0")).strip()


def test_toxicity(spark):
    rows = toxicity.op5_deobfuscated_toxicity(spark, "/root/testdata/sf0.1").collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    hits = sum(r.predicted and label[r.doc_id] for r in held)
    assert hits >= 0.85 * sum(label[r.doc_id] for r in held) and hits >= 0.85 * sum(r.predicted for r in held)
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 10_000


def test_disguises_score_like_the_word(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    plain, hidden, clean = model.scores(pa.array(["the of idiot and stupid moron", "the of 1d10t and s t u p i d m0r0n", "the of and to that"]), toxicity.Restorer(model.characters))
    assert plain > 0.5 and hidden > 0.5 and clean < 0.5


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (6, 0), (8, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, model).count() == 0
    assert {r.score for r in toxicity.score(odd, toxicity.train(odd, labels.where("toxic = 0"))).collect()} == {0.0}
    assert toxicity.train(empty, labels).weights is None


def test_features_are_held_for_a_bounded_number_of_words(monkeypatch):
    model = crf.fit([("en", "the house and the words of it"), ("de", "das haus und die worte darin")])
    words, real, held = [f"wort{i}" for i in range(40_000)], crf.features, []
    monkeypatch.setattr(crf, "features", lambda some: held.append(len(some)) or real(some))
    found = model.emissions(words)
    assert max(held) <= 1 << 14 and sum(held) == len(words)
    who, what = real(words)
    assert all((found[:, j] == np.bincount(who, model.weights[what, j], len(words))).all() for j in range(2))
