"""Passages, decontamination and the pipeline."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from lexloom.llm import decontaminate, passages


def words(rng, n):
    return [f"w{i}" for i in rng.integers(0, 4000, n)]


def test_planted_passages(make):
    rng = np.random.default_rng(1)
    shared, fuzzy = words(rng, 60), words(rng, 80)
    edited = list(fuzzy)
    for i in range(9, 80, 16):
        edited[i] = "changed"
    del edited[41]
    rows = [(i, " ".join(words(rng, 120))) for i in range(20)]
    for i in (3, 7, 11):
        rows[i] = (i, " ".join([*words(rng, 40 + i), *shared, *words(rng, 30)]))
    rows[5] = (5, " ".join([*words(rng, 20), *fuzzy, *words(rng, 20)]))
    rows[9] = (9, " ".join([*words(rng, 33), *edited, *words(rng, 20)]))
    found = {(r.doc_id, r.other_id): r for r in passages.passages(make(rows)).collect()}
    assert set(found) == {(7, 3), (11, 3), (9, 5)}
    r = found[7, 3]
    assert (r.start, r.end, r.other_start, r.other_end, r.similarity) == (47, 107, 43, 103, 1.0)
    r = found[9, 5]
    assert r.start <= 36 and r.end >= 109 and 0.85 < r.similarity < 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("abZÉßñ中İ09_.,- \n\u0301"), max_size=12)), max_size=6), st.sampled_from(["", "—", "“a”", "😀"]), st.integers(0, 2))
def test_words_by_bytes_equal_the_regex(texts, other, skipped):
    import pyarrow as pa
    import regex

    from lexloom.llm import words

    texts = [*texts, other]
    index, bounds, found = words.letter_words(pa.array(["é skipped"] * skipped + texts).slice(skipped))
    got = [[found[i].as_py() for i in index[a:b].tolist()] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    lower = pa.compute.utf8_lower(pa.array([t or "" for t in texts])).to_pylist()
    assert got == [regex.findall(r"[\p{L}\p{M}\p{N}]+", t) for t in lower]


def test_words_are_cut_without_a_regex_and_hubs_without_stretches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lexloom.llm import words

    monkeypatch.setattr(words.pc, "split_pattern_regex", None)
    index, bounds, found = words.letter_words(pa.array(["Été, le 3 mai.", None, "le\n\nete"]))
    assert [found[i].as_py() for i in index.tolist()] == ["été", "le", "3", "mai", "le", "ete"] and bounds.tolist() == [0, 4, 4, 6]
    values, at = words.mix(np.arange(300, dtype=np.uint64) % np.uint64(90)), np.array([0, 120, 300])
    with_, without = passages.seeds(values, at, 33), passages.seeds(values, at, 0)
    assert all((a == b).all() for a, b in zip(with_[:3], without[:3], strict=True))
    assert with_[3].any() and not without[3].any()


def test_seeds_are_found_once_and_hubs_in_their_order(make, spark, monkeypatch):
    """Seeds that go on over many batches keep their first place; texts are cut into seeds once."""
    rng = np.random.default_rng(3)
    calls, real = [], passages.seed_rows
    monkeypatch.setattr(passages, "seed_rows", lambda *a: calls.append(1) or real(*a))
    text = words(rng, 60)
    assert passages.passages(make([(i, " ".join(text)) for i in range(3)])).count() == 2 and len(calls) == 1
    rows = [(int(s), int(d), int(p), 0) for s, d, p in zip(rng.integers(0, 12, 300), rng.integers(0, 9, 300), range(300), strict=True)] + [(50, 7, i, 0) for i in range(20)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = passages.shared_seeds(spark.createDataFrame(rows, "seed long, doc long, place int, stretch long")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    own = {s: sorted((d, p) for t, d, p, _ in rows if t == s) for s in {r[0] for r in rows}}
    expected = {(s, d, p, *o[0], len(o) > 2) for s, o in own.items() if o[0][0] != o[-1][0] for d, p in o}
    assert {(r.seed, r.doc, r.place, r.hub, r.hub_place, r.many) for r in found} == expected and len(found) == len(expected)


def test_passages_of_all_documents_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id for r in passages.op3_chained_passages(spark, sf).collect()}
    from lexloom.llm.words import letter_words
    import pyarrow as pa

    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    index, bounds, _ = letter_words(pa.array([r.text for r in rows]))
    first, repeats = {}, set()
    for n, r in enumerate(rows):
        seq = index[bounds[n] : bounds[n + 1]]
        for j in range(len(seq) - 49):
            if first.setdefault(seq[j : j + 50].tobytes(), n) != n:
                repeats.add(r.doc_id)
    assert repeats and repeats <= found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_alignment_is_the_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert passages.aligned(a, b) == table[-1][-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), unique_by=lambda m: m[0], max_size=18))
def test_chain_scores(matches):
    x, y = [m[0] for m in matches], [m[1] for m in matches]
    order = sorted(range(len(x)), key=lambda i: (x[i], -y[i]))
    best = {}
    for i in order:
        before = [best[j] - passages.GAP * (x[i] - x[j] + y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i]]
        best[i] = passages.WORTH + max([0.0, *before])
    found = passages.chains(x, y)
    assert sorted(i for c in found for i in c) == list(range(len(x)))
    for c in found:
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:], strict=False))
    if matches:
        top = max(best.values())
        whole = [c for c in found if max(best[i] for i in c) == pytest.approx(top)]
        assert whole


def test_passages_with_fragments_in_earlier_documents(make):
    rng = np.random.default_rng(5)
    rows, expected, n = [], set(), 0
    for order in ("abWW", "aWbW", "WabW", "aWabWaW"):
        whole, held = words(rng, 60), 0
        for kind in order:
            part = {"a": whole[:36], "b": whole[24:], "W": whole}[kind]
            rows.append((n, " ".join([*words(rng, 30 + n % 7), *part, *words(rng, 30)])))
            if kind == "W" and held:
                expected.add(n)
            held += kind == "W"
            n += 1
    found = [r for r in passages.passages(make(rows)).collect() if r.agreeing >= 60]
    assert {r.doc_id for r in found} == expected
    assert all(r.other_id < r.doc_id and r.similarity == 1.0 for r in found)


def test_a_passage_whose_pieces_lie_in_many_earlier_documents(make):
    """Two long documents share 80 words, of which fifteen lesser documents hold 24, and as many 32, each."""
    for piece in (24, 32):
        rng = np.random.default_rng(piece)
        passage = words(rng, 80)
        rows = [(i, " ".join([*words(rng, 40), *passage[4 * i : 4 * i + piece], *words(rng, 40)])) for i in range(15)]
        rows += [(i, " ".join([*words(rng, 90 + i), *passage, *words(rng, 50)])) for i in (100, 101)]
        found = passages.passages(make(rows)).collect()
        assert [(r.doc_id, r.other_id, r.agreeing) for r in found if r.doc_id > 99] == [(101, 100, 80)]


@pytest.mark.parametrize("copies", [1, 6])
def test_a_fuzzy_passage_whose_pieces_lie_in_many_earlier_documents(make, monkeypatch, copies):
    """Two pairs of long documents share 80 words, but for every twentieth; lesser documents hold 24 of them each, and so all seeds: few for each, or more than are compared with one another."""
    monkeypatch.setattr(passages, "HOLDERS", 64 if copies == 1 else 4)
    rng = np.random.default_rng(12)
    rows, expected = [], set()
    for n in (0, 1000):
        passage = words(rng, 80)
        edited = [f"changed{i}" if i % 20 == 10 else w for i, w in enumerate(passage)]
        for i in range(29 * copies):
            at = 2 * (i % 29)
            rows.append((n + i, " ".join([*words(rng, 40), *(passage[at : at + 24] if i % 2 else edited[at : at + 24]), *words(rng, 40)])))
        rows += [(n + 900, " ".join([*words(rng, 90), *passage, *words(rng, 50)])), (n + 901, " ".join([*words(rng, 33), *edited, *words(rng, 50)]))]
        expected.add((n + 901, n + 900, 76))
    found = passages.passages(make(rows)).collect()
    assert {(r.doc_id, r.other_id, r.agreeing) for r in found} == expected and len(found) == len(expected)


def test_forty_equal_words_whose_stretches_lie_in_earlier_documents(make):
    """Two documents share forty words, of which lesser ones hold the first and the last 36: the least with any stretch of 33 never holds the whole."""
    rng = np.random.default_rng(9)
    rows, expected = [], set()
    for n in range(0, 40, 4):
        run = words(rng, 40)
        rows += [(n + i, " ".join([*words(rng, 20 + n + i), *part, *words(rng, 30)])) for i, part in enumerate((run[:36], run[4:], run, run))]
        expected.add((n + 3, n + 2))
    found = passages.passages(make(rows)).collect()
    assert {(r.doc_id, r.other_id) for r in found if r.agreeing >= 40} == expected


def test_a_run_that_begins_within_another_passage(make):
    """A document shares one passage with one document, and with another forty words, of which seven lie in that passage."""
    rng = np.random.default_rng(10)
    rows, expected = [], set()
    for n in range(0, 24, 3):
        one, two = words(rng, 60), words(rng, 33)
        parts = (one, one[-7:] + two, one + two)
        rows += [(n + i, " ".join([*words(rng, 20 + n + i), *part, *words(rng, 30)])) for i, part in enumerate(parts)]
        expected |= {(n + 2, n), (n + 2, n + 1)}
    assert {(r.doc_id, r.other_id) for r in passages.passages(make(rows)).collect()} == expected


def test_passages_equal_all_pairs(spark):
    """Exactly the documents that share forty words in a row with a lesser one are found, but for fuzzy passages, and those agree."""
    sf = "/root/testdata/sf0.001"
    found = passages.op3_chained_passages(spark, sf).collect()
    from lexloom.llm.words import letter_words
    import pyarrow as pa

    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    index, bounds, _ = letter_words(pa.array([r.text for r in rows]))
    own = {r.doc_id: index[bounds[n] : bounds[n + 1]] for n, r in enumerate(rows)}
    holders = {}
    for doc, seq in own.items():
        for j in range(len(seq) - 39):
            holders.setdefault(seq[j : j + 40].tobytes(), set()).add(doc)
    exact = {doc for docs in holders.values() for doc in docs if doc != min(docs)}
    assert exact <= {r.doc_id for r in found}
    for r in found:
        a, b = own[r.doc_id][r.start : r.end].tolist(), own[r.other_id][r.other_start : r.other_end].tolist()
        assert r.other_id < r.doc_id and min(len(a), len(b)) >= 40
        table = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, table[j + 1] = table[j + 1], before + 1 if x == y else max(table[j + 1], table[j])
        assert r.agreeing == table[-1] >= 0.8 * max(len(a), len(b))


def test_all_copies_of_a_passage_in_a_document(make):
    rng = np.random.default_rng(6)
    passage, line, other = words(rng, 60), words(rng, 25), words(rng, 50)
    rows = [(1, " ".join([*words(rng, 30), *passage, *words(rng, 33)])), (2, " ".join([*words(rng, 20), *passage, *words(rng, 40), *passage, *words(rng, 20)]))]
    rows += [(3, " ".join([*words(rng, 20), *line, *other])), (4, " ".join([*line, *words(rng, 50), *line, *other]))]
    docs = make(rows)
    found = passages.passages(docs)
    spans = {(r.doc_id, r.other_id, r.start, r.end) for r in found.collect()}
    assert {(2, 1, 20, 80), (2, 1, 120, 180), (4, 3, 75, 150)} <= spans
    out = {r.doc_id: r.text for r in passages.remove(docs, found).collect()}
    text = " ".join(passage)
    assert [out[i].count(text) for i in (1, 2)] == [1, 0]


def test_removal(make):
    rng = np.random.default_rng(2)
    shared = words(rng, 70)
    rows = [(1, " ".join([*words(rng, 30), *shared])), (2, "Start, " + " ".join(shared) + "! End.")]
    docs = make(rows)
    out = {r.doc_id: r.text for r in passages.remove(docs, passages.passages(docs)).collect()}
    assert out[1] == rows[0][1] and out[2] == "Start, ! End."
    assert passages.without(None, []) is None and passages.without("a b", []) == "a b"


def test_passages_odd(odd, empty):
    assert passages.passages(odd).count() == 0
    assert passages.passages(empty).count() == 0


def test_rows_without_ids(make):
    text = " ".join(words(np.random.default_rng(4), 90))
    found = passages.passages(make([(None, text), (None, text), (5, text), (5, "other")])).collect()
    assert len(found) == 2 and all(r.similarity == 1.0 for r in found)


def brute_leaks(docs, items, similarity=0.8, least=10):
    """Every diagonal of every pair, the best stretch of each by trying all."""
    out = set()
    for i, d in docs:
        for j, t in items:
            for shift in range(-len(t) + 1, len(d)):
                a = max(0, -shift)
                b = min(len(t), len(d) - shift)
                agree = [t[k] == d[k + shift] for k in range(a, b)]
                if sum(agree) < min(least, len(t)):
                    continue
                for n in range(len(agree), 0, -1):
                    runs = [agree[s : s + n] for s in range(len(agree) - n + 1)]
                    good = [sum(r) for r in runs if r[0] and r[-1] and sum(r) >= similarity * n]
                    if good:
                        if max(good) >= min(least, len(t)):
                            out.add((i, j))
                        break
    return out


def test_leaks_equal_brute_force(spark, make):
    rng = np.random.default_rng(5)
    items = [(j, words(rng, int(n))) for j, n in enumerate([30, 15, 40, 6, 12])]
    docs = []
    for i in range(40):
        d = words(rng, 60)
        if i % 2:
            t = list(items[i % 5][1])
            for k in range(4, len(t), 9):  # substituted words
                t[k] = "sub"
            cut = t if len(t) < 20 or i % 3 else t[: len(t) // 2]
            d[10 : 10 + len(cut)] = cut
        docs.append((i, d))
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in items], "item_id long, text string")
    frame = make([(i, " ".join(d)) for i, d in docs])
    expected = brute_leaks(docs, items)
    assert len(expected) >= 10
    for block in (2_000_000, 40):  # at once, and in blocks
        found = decontaminate.leaks(frame, bench, block_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in found} == expected
        assert len(found) == len(expected)
        kept = {r.doc_id for r in decontaminate.clean(frame, bench, block_words=block).collect()}
        assert kept == {i for i, _ in docs} - {i for i, _ in expected}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.booleans(), max_size=30))
def test_longest_overlap(agree):
    best = 0
    for s in range(len(agree)):
        for e in range(s + 1, len(agree) + 1):
            if agree[s] and agree[e - 1] and sum(agree[s:e]) >= 0.8 * (e - s) - 1e-9:
                best = max(best, e - s)
    a, b = decontaminate.longest_overlap(np.array(agree, bool), 0.8)
    # the longest stretch may begin or end beside agreement, and is then trimmed
    assert sum(agree[a:b]) >= 0.8 * (b - a) - 1e-9
    assert b - a <= best and (best == 0 or b > a)


def test_leaks_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "the same text here"), (2, None), (None, ""), (4, "x"), (4, "x")], "item_id long, text string")
    found = decontaminate.leaks(odd, bench).collect()
    assert {r.doc_id for r in found} == {1, 2, 8, 9}
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.where("doc_id IN (1, 2, 8, 9)").count() == 0 and kept.count() == odd.count() - 5
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.write_scratch(stage(spark, kept, sf), name)
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == ids
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len({texts[i] for i in ids}) == len(ids)
    assert not any(b in texts[i] for i in ids for b in bench)
    assert len(ids) >= 0.75 * len(set(texts.values()))


def test_pipeline_odd(spark, odd, empty, sf):
    for docs in (odd, empty):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            kept = corpus_pipeline.write_scratch(stage(spark, kept, sf), name)
