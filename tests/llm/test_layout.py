"""Sharding, packing and the id files."""

import subprocess
import sys
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import hilbert, jvm, mixing_coder, packing, tokens

TEXT = st.text(alphabet=st.sampled_from("ab é中 \n\t '.<|>1"), max_size=30)


def test_curve_steps_to_neighbours():
    for bits, dims in ((3, 2), (2, 3), (1, 4)):
        points = np.stack(np.meshgrid(*[range(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        path = sorted((hilbert.hilbert_index(tuple(p), bits), tuple(p)) for p in points.tolist())
        assert [i for i, _ in path] == list(range(1 << bits * dims))
        assert all(sum(abs(x - y) for x, y in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(path, path[1:], strict=False))


def check_shards(rows, n, shards):
    assert len(rows) == n
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards(spark, sf):
    rows = hilbert.op6_hilbert_shards(spark, sf).collect()
    check_shards(rows, 200, 40)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.size == len(docs[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.cell for r in order] == sorted(r.cell for r in rows)


def test_shards_odd(odd, empty, tmp_path):
    meta = hilbert.metadata(odd)
    found = hilbert.hilbert_shards(meta, ["source_code", "lang_code", "size"], 5, splits=3)
    check_shards(found.collect(), odd.count(), 5)
    hilbert.write_shards(found, str(tmp_path / "shards"))
    assert odd.sparkSession.read.parquet(str(tmp_path / "shards")).count() == odd.count()
    assert hilbert.hilbert_shards(hilbert.metadata(empty), ["size"], 5).count() == 0


def test_text_dimension_orders_by_whole_values(spark, monkeypatch):
    """Long values with one beginning still part the rows, also where only some of the values are counted."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('https://www.example.org/', lpad(id * 7919 % 4000, 5, '0')) AS source")
    for values in (10_000, 500):
        monkeypatch.setattr(hilbert, "VALUES", values)
        bounds = hilbert.text_bounds(docs, "source", 16)
        assert bounds == sorted(bounds) and len(bounds) == 15
        sizes = docs.groupBy(hilbert.text_code(docs["source"], bounds)).count().collect()
        assert len(sizes) == 16 and max(r["count"] for r in sizes) < 4000 / 16 * 2.5
    assert hilbert.text_bounds(docs.limit(0), "source", 16) == []


def test_text_bounds_are_those_of_all_values(spark, monkeypatch):
    """The same bounds, those of a plain walk over all values, however many values there are beside VALUES."""
    rng = np.random.default_rng(3)
    values = [f"{'é' if x % 3 else 'z'}{x * x}" for x in rng.zipf(1.3, 6000) % 3000]
    docs = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "doc_id long, source string")
    ordered = sorted(values, key=str.encode)
    upto = {v: i + 1 for i, v in enumerate(ordered)}
    expected = [v for v in sorted(set(values), key=str.encode)[:-1] if (upto[v] - values.count(v)) * 16 // len(values) != upto[v] * 16 // len(values)]
    for most in (10_000, 100, 1):
        monkeypatch.setattr(hilbert, "VALUES", most)
        assert hilbert.text_bounds(docs, "source", 16) == expected


def test_one_cell_is_ranked_in_parts(spark):
    same = spark.range(1000).selectExpr("id AS doc_id", "1 AS size")
    check_shards(hilbert.hilbert_shards(same, ["size"], 7, splits=16).collect(), 1000, 7)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=12))
def test_encode_equals_the_library(texts):
    path = tokens.default_path()
    ids, bounds = tokens.encode(path, pa.array(texts, pa.string()), 0)
    whole = [e.ids for e in tokens.tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [w + [0] for w in whole]


PIECE = st.text(alphabet=st.sampled_from("abZéß0_'.,!)(-^`~²\u0301"), min_size=1, max_size=5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PIECE, st.sampled_from([" ", "\n", " ", "\n\n", "\t", "\r\n", " \n", "  "])), max_size=30), st.lists(st.integers(0, 30), max_size=3))
def test_cut_words_equal_the_library(pieces, cuts):
    path, bounds = tokens.default_path(), [0, *sorted(cuts), len(pieces)]
    texts = ["".join(x + y for x, y in pieces[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    ids, at = tokens.encode(path, pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [tokens.tokenizer(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_encoded_once_whatever_stands_around_them(monkeypatch):
    """The library is asked for a word once, not again for each sign behind it or for each word that it shares a line's end with."""
    asked = []
    fresh = tokens._fresh
    monkeypatch.setattr(tokens, "_fresh", lambda path, words, *lead: asked.extend(words.to_pylist()) or fresh(path, words, *lead))
    monkeypatch.setattr(tokens, "_known", lru_cache(tokens._known.__wrapped__))
    words = [f"wo{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    text = "begin " + " ".join(f"{a}{sign}\n{b}{sign}" for a in words for b, sign in zip(words, "., ! ;) :" * 8, strict=False) if sign != " ")
    ids, _ = tokens.encode(tokens.default_path(), pa.array([text]))
    assert ids.tolist() == tokens.tokenizer(tokens.default_path()).encode(text, add_special_tokens=False).ids
    assert len(asked) <= 2 * len(words) + 10


def test_the_library_is_given_little_at_a_time_and_known_words_are_not_hashed(monkeypatch):
    """Neither what the library holds nor what is looked up grows with a batch, or with all that a worker has seen."""
    path, given, hashed = tokens.default_path(), [], []
    real, index_in = tokens.tokenizer(path), tokens.pc.index_in

    class Told:
        def __getattr__(self, name):
            return getattr(real, name)

        def encode_batch_fast(self, texts, **options):
            given.append(sum(len(x.encode()) for x in texts))
            return real.encode_batch_fast(texts, **options)

    assert tokens.cuts(path) and len(tokens.byte_lengths(path))
    monkeypatch.setattr(tokens, "tokenizer", lambda _: Told())
    monkeypatch.setattr(tokens, "_known", lru_cache(tokens._known.__wrapped__))
    monkeypatch.setattr(tokens.pc, "index_in", lambda values, value_set: hashed.append(len(value_set)) or index_in(values, value_set=value_set))
    made = [" ".join(f"{'abcdefg'[i % 7]}{i * 7919:x}" for i in range(60_000)), *[f"two  spaces {i} " * 100 for i in range(700)]]
    ids, _ = tokens.encode(path, pa.array(made))
    assert ids.tolist() == [x for e in real.encode_batch(made, add_special_tokens=False) for x in e.ids]
    assert max(given) <= 1 << 18 and sum(given) > 1 << 20
    hashed.clear()
    tokens.encode(path, pa.array(["few new words, and a0"]))
    assert max(hashed) <= 5


MEMORY = """
import threading, time
import numpy as np, pyarrow as pa
from lexloom.llm import packing, tokens

class Docs:
    def __getattr__(self, name):
        return lambda *parts, **named: self
    def mapInArrow(self, run, schema):
        self.run = run

def own():
    size, shared = map(int, open("/proc/self/statm").read().split()[1:3])
    return (size - shared) * 4096 / 1e6

packing.F, docs, most = Docs(), Docs(), [0.0]
packing.encoded_pieces(docs, tokens.default_path(), 1024, 0, False, "doc_id", "text")
words = np.array([f"{'abcdefg'[i % 7]}{i * 7919:x}" for i in range(100_000)])
texts = [" ".join(words[np.random.default_rng(i).integers(0, len(words), 300)]) for i in range(5000)]
few, many = (pa.record_batch([pa.array(range(len(x))), pa.array(x)], ["doc_id", "text"]) for x in (texts[:10], texts))
list(docs.run(iter([few])))
before = own()

def watch():
    while True:
        most[0] = max(most[0], own())
        time.sleep(0.002)

threading.Thread(target=watch, daemon=True).start()
list(docs.run(iter([many])))
print(most[0] - before)
"""


def test_packing_takes_little_memory_for_a_batch():
    """10 MB of text in one batch: two workers of an executor do this side by side."""
    found = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2], timeout=120)
    assert float(found.stdout) < 150


def naive_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            i = min(fit, key=rooms.__getitem__)
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit_plan(counts, capacity)
    used, placed = {}, []
    for length, rank, n, first, offset in plan.tolist():
        for i in range(n):
            used.setdefault(first + i, []).append((offset, length))
            placed.append((length, rank + i))
    assert sorted(placed) == sorted((n, i) for n, c in counts.items() for i in range(c))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == naive_best_fit(lengths, capacity)
    assert sorted(used) == list(range(len(used)))


def check_pieces(rows, texts, capacity, end):
    path = tokens.default_path()
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in texts.items():
        ids = [*tokens.tokenizer(path).encode(text or "", add_special_tokens=False).ids, end]
        data, at = np.array(ids, "<u4").tobytes(), 0
        for start, length, crc, total in sorted(docs[i]):
            assert (start, total) == (at, len(ids)) and crc == zlib.crc32(data[4 * at : 4 * (at + length)])
            at += length
        assert at == len(ids)
    return len(seqs)


def test_packing(spark, sf):
    rows = packing.op7_best_fit_packing(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = check_pieces(rows, texts, 1024, 0)
    assert n <= 1.03 * sum(r.length for r in rows) / 1024 + 1


def test_packing_odd(odd, empty, make):
    rows = packing.pack(odd, capacity=16, with_ids=True).collect()
    assert sum(r.length for r in rows) == sum(len(r.ids) for r in rows)
    assert len({r.sequence_id for r in rows}) == max(r.sequence_id for r in rows) + 1
    assert packing.pack(empty).count() == 0
    few = [(1, None), (2, ""), (3, "a b c " * 30)]
    check_pieces(packing.pack(make(few), capacity=16, end_id=5).collect(), dict(few), 16, 5)


def back_and_forth(spark, lists, block=1 << 18):
    """(ids that come back, payload) of each list."""
    jvm.register(spark)
    rows = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(lists)], "i int, ids binary")
    coded = rows.select("i", mixing_coder.encoded("ids", block).alias("payload"))
    found = coded.select("i", "payload", mixing_coder.decoded("payload").alias("ids")).orderBy("i").collect()
    return [(np.frombuffer(r.ids, "<u4"), bytes(r.payload)) for r in found]


def test_coder_round_trip(spark):
    rng = np.random.default_rng(1)
    lists = [[], [0], [2**32 - 1] * 70, [5, 5, 5], list(range(50_000)), [2**32 - 1, 0, 2**31] * 40]
    lists += [rng.integers(0, rng.integers(1, 50_257), rng.integers(0, 900)).tolist() for _ in range(40)]
    lists += [(rng.integers(0, 50, 9).tolist() * int(rng.integers(1, 900))) for _ in range(20)]
    lists += [np.minimum(rng.zipf(1.3, 20_000), 50_000).tolist()]
    for block in (1 << 18, 1000, 7):
        few = lists if block > 7 else [x[:200] for x in lists]
        for given_ids, (back, _) in zip(few, back_and_forth(spark, few, block), strict=True):
            assert back.tolist() == given_ids


def test_coder_mixes(spark, sf):
    """Smaller than what counts alone allow, and than what a general compressor makes of two bytes an id."""
    texts = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").orderBy("doc_id").select("text").toPandas()["text"]
    ids, _ = tokens.encode(tokens.default_path(), pa.array(texts, pa.string()), 2)
    ((back, payload),) = back_and_forth(spark, [ids])
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    bits = 8 * len(payload) / len(ids)
    assert (back == ids).all()
    assert bits < -(share * np.log2(share)).sum() - 1
    assert bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids) - 1.5


def test_coder_notices_damage(spark):
    rng = np.random.default_rng(0)
    ids = np.array([1, 2, 3, 4], np.uint32)[rng.integers(0, 4, 20_000) * (rng.random(20_000) < 0.1)]
    ((_, data),) = back_and_forth(spark, [ids], 3000)
    assert len(data) < len(ids) / 3
    for at in (0, 5, 9, 14, 18, 40, len(data) // 2, len(data) - 12):
        broken = bytearray(data)
        broken[at] ^= 255
        with pytest.raises(Exception, match="damaged|format|cut short|failed to execute|FAILED_EXECUTE_UDF"):
            out = spark.createDataFrame([(broken,)], "p binary").select(mixing_coder.decoded("p").alias("ids")).first().ids
            assert bytes(out) != ids.astype("<u4").tobytes()
            pytest.fail("other ids came back in silence")


def check_files(rows, texts):
    path, at = tokens.default_path(), 0
    for r in sorted(rows, key=lambda r: r.start):
        ids = [*tokens.tokenizer(path).encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_id_files(spark, sf):
    rows = mixing_coder.op8_mixing_coder(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted(texts)
    check_files(rows, texts)


def test_id_files_odd(spark, odd, empty, tmp_path):
    mixing_coder.write_ids(odd, str(tmp_path / "odd"))
    rows = mixing_coder.read_ids(spark, str(tmp_path / "odd")).collect()
    assert len(rows) == odd.count() and all(len(r.ids) == r.n_tokens and r.ids[-1] == 2 for r in rows)
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    mixing_coder.write_ids(empty, str(tmp_path / "empty"))
    assert mixing_coder.read_ids(spark, str(tmp_path / "empty")).count() == 0
