"""Digest index and SimHash, against brute force."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import digest_index, simhash
from lexloom.llm.common import components, scratch_path


def test_index_keeps_what_it_has(spark, make):
    path = scratch_path(spark, "test-index")
    first = digest_index.DigestIndex(spark, path, buckets=4)
    a = first.ingest(make([(1, "a"), (2, "a"), (3, "b")])).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in a} == {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)}
    spark.sql(f"DROP TABLE {first.table}")  # another session
    again = digest_index.DigestIndex(spark, path, buckets=4)
    b = again.ingest(make([(9, "a"), (8, "c"), (7, "c")])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in b} == {(9, 2, False), (8, 8, True), (7, 8, False)}
    assert again.read().count() == 3


def test_index_keeps_its_buckets(spark, make):
    path = scratch_path(spark, "test-buckets")
    first = digest_index.DigestIndex(spark, path, buckets=4)
    docs = make([(i, f"text {i}") for i in range(500)])
    assert sum(r.kept for r in first.ingest(docs).collect()) == 500
    spark.sql(f"DROP TABLE {first.table}")
    again = digest_index.DigestIndex(spark, path, buckets=8)
    assert again.buckets == 4
    assert sum(r.kept for r in again.ingest(docs).collect()) == 0 and again.read().count() == 500


def test_a_batch_that_comes_again_gets_its_first_verdict(spark, make):
    index = digest_index.DigestIndex(spark, scratch_path(spark, "test-again"), buckets=4)
    index.ingest(make([(900, "text 3"), (901, "other")]), batch="first")
    docs = make([(i, f"text {i % 40}") for i in range(60)])
    verdict = lambda rows: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows.collect())
    found = verdict(index.ingest(docs, batch="second"))
    assert verdict(index.ingest(docs, batch="second")) == found and index.read().count() == 41
    assert sum(x[3] for x in found) == 39 and [x[1] for x in found if x[0] in (3, 43)] == [900, 900]
    # half of the batch was appended when the driver was lost
    half = digest_index.DigestIndex(spark, scratch_path(spark, "test-half"), buckets=4)
    half.ingest(make([(i, f"text {i % 40}") for i in range(60) if i % 40 < 20]), batch="b")
    rows = verdict(half.ingest(docs, batch="b"))
    assert sum(x[3] for x in rows) == 40 == half.read().count() and all(x[1] == max(i for i in range(60) if i % 40 == x[0] % 40) for x in rows)


def test_anti_join_is_sort_merge_on_buckets(spark, make):
    index = digest_index.DigestIndex(spark, scratch_path(spark, "test-plan"), buckets=8)
    index.ingest(make([(1, "a")]))
    groups = make([(1, "a")]).selectExpr("unhex(sha2(cast(text as binary), 256)) AS digest").distinct()
    plan = groups.join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_exact_odd(spark, odd, empty):
    rows = digest_index.DigestIndex(spark, scratch_path(spark, "odd"), buckets=4).ingest(odd).collect()
    assert len(rows) == odd.count()
    assert sum(r.kept for r in rows) == len({r.digest for r in rows})
    same = [r for r in rows if r.doc_id in (1, 2)]
    assert {r.keep_id for r in same} == {2} and sum(r.kept for r in same) == 1
    kept = digest_index.dedup(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert digest_index.dedup(empty).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(5, 4), (4, 5), (3, 3), (9, 8), (8, 4)]])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.root for r in components(df).collect()}
    assert found == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def brute_components(ids, prints):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for m, j in enumerate(ids[:n]):
            if (prints[n] ^ prints[m]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def print_of(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


@settings(max_examples=25, deadline=None)
@given(base=st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), flips=st.lists(st.tuples(st.integers(0, 11), st.sets(st.integers(0, 63), min_size=1, max_size=4)), max_size=25), bits=st.sampled_from([8, 12, 16]))
def test_ball_hashing_finds_all_components(base, flips, bits):
    prints = set(base)
    for i, f in flips:
        prints.add(base[i % len(base)] ^ sum(1 << b for b in f))
    fp = np.array(sorted(prints), np.uint64)
    who, prefix = simhash.prefixes(fp, bits)
    order = np.argsort(prefix, kind="stable")
    prefix, rows = prefix[order], fp[who][order]
    parent = {int(x): int(x) for x in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in simhash.runs(prefix, 100):
        for a, b in simhash.meet(prefix[i:j], rows[i:j], bits):
            near = (a != b) & (simhash.ones(a ^ b) <= 3)
            for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
    ids = [int(x) for x in fp]
    assert {x: find(x) for x in ids} == brute_components(ids, ids)


def test_simhash_query(spark, sf):
    found = simhash.op2_simhash_ball(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: print_of(t) for i, t in docs.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == prints
    ids = sorted(docs)
    assert {r.doc_id: r.component_id for r in found} == brute_components(ids, [prints[i] for i in ids])


def test_simhash_odd(odd, empty):
    rows = simhash.clusters(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}
    assert simhash.clusters(empty).count() == 0
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert simhash.representatives(empty).count() == 0


def test_near_copies_go_and_others_stay(make):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(30)]
    rows = list(enumerate(texts))
    for i in range(10):  # two words of two hundred differ
        t = texts[i].split()
        t[20 + i], t[150 - i] = "other", "another"
        rows.append((100 + i, " ".join(t)))
    assert sorted(r.doc_id for r in simhash.representatives(make(rows)).collect()) == list(range(30))


def similarity(a, b, size=5):
    x, y = ({tuple(t.split()[i : i + size]) for i in range(max(1, len(t.split()) - size + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_like_documents_with_an_unlike_hub(make):
    """Documents 2, 3 and 5 are alike; document 1 has the same words in another order, and 4 too, so that their fingerprints are one."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    near = list(words)
    near[150] = near[151] = "w7"
    texts = {1: rng.permutation(words), 2: words, 3: near, 4: rng.permutation(words), 5: words[:-2] + ["w1"]}
    assert similarity(" ".join(texts[2]), " ".join(texts[3])) > 0.9
    kept = simhash.representatives(make([(i, " ".join(t)) for i, t in texts.items()])).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 4]


def test_links_in_a_chain_of_copies(make):
    """Each copy is made from the one before it; only neighbours are alike, and all are one group."""
    rng = np.random.default_rng(8)
    text, rows = [f"w{i}" for i in rng.integers(0, 9000, 240)], []
    for i in range(60):
        rows.append((int(rng.integers(0, 1 << 40)), " ".join(text)))
        text[int(rng.integers(0, 240))] = f"new{i}"
    assert all(similarity(a, b) > 0.9 for (_, a), (_, b) in zip(rows, rows[1:], strict=False)) and similarity(rows[0][1], rows[-1][1]) < 0.4
    assert [r.doc_id for r in simhash.representatives(make(rows)).collect()] == [min(i for i, _ in rows)]


def test_recall_by_kind_of_edit(make):
    """At least nine in ten pairs of a similarity of 0.8 or more come together, whatever the edit; no others do."""
    rng = np.random.default_rng(9)
    fresh = iter(range(1 << 30))
    more = lambda n: [f"new{next(fresh)}" for _ in range(n)]
    kinds = {
        "append": lambda t, n: t + more(n),
        "prepend": lambda t, n: more(n) + t,
        "truncate": lambda t, n: t[: len(t) - n],
        "cut head": lambda t, n: t[n:],
        "insert": lambda t, n: t[: (at := int(rng.integers(0, len(t)))) ] + more(n) + t[at:],
        "remove": lambda t, n: t[: (at := int(rng.integers(0, len(t) - n + 1)))] + t[at + n :],
    }
    rows, pairs = [], {}
    for kind, edit in kinds.items():
        for size in (14, 30, 38, 60, 200, 700):
            for _ in range(16):
                text = [f"w{i}" for i in rng.zipf(1.3, size) % 3000]
                other = edit(list(text), max(1, int(size * rng.uniform(0.02, 0.22))))
                if 0.8 <= similarity(" ".join(text), " ".join(other)) < 1:
                    pairs.setdefault(kind, []).append((len(rows), len(rows) + 1))
                rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(other))]
    for share in (0.005, 0.01, 0.015, 0.02, 0.025):
        for size in (60, 200, 700):
            for _ in range(12):
                text = [f"w{i}" for i in rng.zipf(1.3, size) % 3000]
                other = [x if rng.random() > share else f"s{i}" for i, x in enumerate(text)]
                if 0.8 <= similarity(" ".join(text), " ".join(other)) < 1:
                    pairs.setdefault("substitute", []).append((len(rows), len(rows) + 1))
                rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(other))]
    found = {r.node: r.root for r in simhash.near_links(make(rows).selectExpr("doc_id AS doc", "text")).collect()}
    recall = {kind: (round(float(np.mean([found.get(a) == found.get(b, -1) for a, b in own])), 3), len(own)) for kind, own in pairs.items()}
    assert all(share >= 0.9 and n >= 25 for share, n in recall.values()), recall
    texts = dict(rows)
    assert all(similarity(texts[a], texts[b]) >= 0.8 for a, b in found.items() if a != b)


def test_near_duplicates_equal_all_pairs(spark, make):
    """The stage's groups over all documents of a table, against all pairs of them."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    ids = sorted(first.values())
    sets = {}
    for i in ids:
        words = docs[i].encode().lower().split()
        sets[i] = {b" ".join(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else {b""}
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    shared = {}
    for own in holders.values():
        for n, i in enumerate(own):
            for j in own[:n]:
                shared[j, i] = shared.get((j, i), 0) + 1
    true = {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    narrow = make([(i, docs[i]) for i in ids]).selectExpr("doc_id AS doc", "text")
    found = {r.node: r.root for r in simhash.near_links(narrow).collect()}
    joined = [p for p in true if found.get(p[0]) == found.get(p[1], -1)]
    assert len(true) > 4 and len(joined) >= 0.9 * len(true)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in true:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert all(find(a) == find(b) for a, b in found.items())


def test_crowded_prefixes_are_parted(monkeypatch):
    """Fingerprints that share leading bits meet by more of them, and no link is lost."""
    monkeypatch.setattr(simhash, "ROWS", 16)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 40, 20)
    prints = sorted({int(x) ^ sum(1 << int(b) for b in rng.integers(0, 48, int(rng.integers(0, 4)))) for x in base for _ in range(15)})
    fp = np.array(prints, np.uint64)
    who, prefix = simhash.prefixes(fp, 8, 48)
    a, b, most = [], [], 0
    for p in np.unique(prefix):
        for bits, longer, own in simhash.narrowed(int(p), fp[who[prefix == p]], 8, 48):
            most = max(most, bits)
            for x, y in simhash.meet(np.full(len(own), longer, np.uint64), own, bits, 48):
                near = (x != y) & (simhash.ones(x ^ y) <= 3)
                a, b = [*a, *x[near].tolist()], [*b, *y[near].tolist()]
    node, root = simhash.joined(np.array(a), np.array(b))
    assert most > 8 and dict(zip(prints, prints, strict=True)) | dict(zip(node.tolist(), root.tolist(), strict=True)) == brute_components(prints, prints)


def test_a_dense_group_gives_few_rows(spark):
    """Of fingerprints that are all close to one another each gets an edge in a task, not one to each hub."""
    center = 0x5A5A5A5A5A5A
    prints = sorted({center ^ (1 << i) ^ (1 << j) for i in range(48) for j in range(48)})
    found = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), width=48).repartition(1).collect()
    roots = {r.node: r.root for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
    assert len(roots) == len(prints) and set(roots.values()) == {prints[0]}
    assert len(found) < 12 * len(prints)


@pytest.mark.parametrize("block", [2048, 8])
def test_all_alike_of_a_group(make, monkeypatch, block):
    """Documents of one group in many blocks or in one, against all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(120)], []
    for _ in range(90):  # most pairs are below 0.8, some above, and chains lead from one to another
        text = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 5))):
            text[at] = f"x{rng.integers(0, 9)}"
        texts.append(" ".join(text))
    texts = list(dict.fromkeys(texts))
    docs = make(list(enumerate(texts))).selectExpr("doc_id AS doc", "text")
    groups = docs.selectExpr("doc % 1 AS group", "doc")
    found = {r.node: r.root for r in simhash.alike(docs, groups, 5, 0.8).collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {i: found.get(i, i) for i in range(len(texts))} == {i: find(i) for i in range(len(texts))}
    assert 1 < len(set(found.values())) or len(found) > 10
