"""Language-model scores by a probabilistic suffix tree over words.

Symbols are words and one end per text. The root's distribution is add-one over all training symbols. A context, one or two
preceding words, is a candidate if it makes up at least ``share`` of the N training symbols (so there are 1 / share of each length at
most); unless given, the share is 1 / sqrt(N), so that contexts grow with the corpus as sqrt(N) does, and ``SHARE`` at most. A candidate is retained if a likelihood-ratio test finds its next symbols to diverge from those of its suffix. A retained
context's distribution is smoothed with its suffix's by the number of different symbols seen after it (Witten and Bell):
p(x | s) = (c(s, x) + d(s) p(x | suffix of s)) / (c(s) + d(s)). A symbol is scored in the state of the longest retained suffix of
what precedes it in its text.

Counts cover the whole corpus. Those of words are exact; words that follow a context are told apart by 64-bit hashes. They are never held in one place, but for the candidates: texts are cut into blocks; each block sends one row for
each of its distinct words, or pairs of context and next word, to be summed, and gets back the sums that differ from its own. The
blocks are a table bucketed by block, so that they stay where they are while the counts travel.

Defined results: a null text counts as empty, a text of its end alone; a null id belongs to the fold of the empty string;
repeated rows count and are scored each; without training texts every symbol has probability one; an empty table gives no rows. Only
the id and the text are read.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import id_fold, scratch_path, write_scratch
from lexloom.llm.tokens import by_bytes
from lexloom.llm.words import ascii_words, hashes

#: Text bytes of a block, and bytes of a row that holds a part of one.
BLOCK_BYTES, CHUNK = 3 << 20, 1 << 18
SHARE, DEVIATIONS, LEAST_NATS = 2e-4, 4.0, 0.01
#: Candidates or contexts up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: The hash that stands for a text's end, and the bits of a candidate word's code. A pair's code is its place among
#: the candidate pairs, after all words' codes.
END, CODE_BITS = 0, 31


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.BufferReader(data)).read_all()


@dataclass
class Block:
    """Texts as indices of the block's words, most frequent first."""

    doc_ids: pa.Array
    train: np.ndarray
    bounds: np.ndarray
    ids: np.ndarray
    words: pa.Array

    @staticmethod
    def of(doc_ids: pa.Array, train: np.ndarray, texts: pa.Array) -> Block:
        ids, bounds, words = ascii_words(texts)
        order = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        return Block(doc_ids, train, bounds, place[ids], words.take(pa.array(order)))

    def rows(self, number: int) -> pa.RecordBatch:
        """The block as rows of a table, of ``CHUNK`` bytes each: one value of megabytes is hard on a JVM's heap."""
        docs = pa.table({"doc_id": self.doc_ids, "train": self.train, "n": np.diff(self.bounds)})
        data = pickle.dumps((pack(docs), pack(pa.table({"id": self.ids})), pack(pa.table({"word": self.words}))))
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        tokens, texts, zeros = int((np.diff(self.bounds) + 1)[self.train].sum()), int(self.train.sum()), [0] * (len(chunks) - 1)
        columns = [[number] * len(chunks), list(range(len(chunks))), [tokens, *zeros], [texts, *zeros], chunks]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["block", "chunk", "tokens", "texts", "data"])

    @staticmethod
    def from_rows(table: pa.Table) -> Block:
        pa.default_memory_pool().release_unused()  # workers go from block to block; what is kept would add up
        docs, ids, words = pickle.loads(b"".join(table.sort_by("chunk")["data"].to_pylist()))
        d = unpack(docs)
        bounds = np.concatenate([[0], np.cumsum(d["n"].to_numpy())]).astype(np.int64)
        words = unpack(words)["word"].combine_chunks()
        return Block(d["doc_id"].combine_chunks(), d["train"].to_numpy(zero_copy_only=False).astype(bool), bounds, unpack(ids)["id"].to_numpy(), words)

    def counts(self) -> np.ndarray:
        """How often each word occurs in the block's training texts."""
        train = np.repeat(self.train, np.diff(self.bounds))
        return np.bincount(self.ids[train], minlength=len(self.words))

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, text, place in the text) of all words and ends; an end is the number of words."""
        n = len(self.bounds) - 1
        lengths = np.diff(self.bounds) + 1
        starts = np.cumsum(lengths) - lengths
        out = np.full(int(lengths.sum()), len(self.words), np.int32)
        text = np.repeat(np.arange(n, dtype=np.int32), lengths)
        place = np.arange(len(out), dtype=np.int32) - starts.astype(np.int32)[text]
        out[place < lengths[text] - 1] = self.ids
        return out, text, place


@dataclass
class Root:
    """What all blocks know: training symbols, different ones, ends, and the candidates' words."""

    total: int
    distinct: int
    ends: int
    frequent: list[str]  # the words that are candidates, by their codes
    twos: np.ndarray  # the pairs of these that are candidates, as first << CODE_BITS | last, sorted

    def log_p(self, counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 1.0) / (self.total + self.distinct + 1.0))


def candidates(block: Block, frequent: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, its text, code of the word before it, code of the one before that) of a block; -1 for none."""
    symbol, text, place = block.symbols()
    code = np.full(len(block.words) + 1, -1, np.int32)
    at = pc.index_in(pa.array(frequent, pa.string()), value_set=block.words)
    here = np.asarray(pc.is_valid(at), dtype=bool)
    code[at.filter(pa.array(here)).to_numpy()] = np.flatnonzero(here)
    coded = code[symbol]
    last, before = np.full(len(symbol), -1, np.int32), np.full(len(symbol), -1, np.int32)
    last[1:], before[2:] = coded[:-1], coded[:-2]
    last[place < 1] = -1
    before[(place < 2) | (last < 0)] = -1
    return symbol, text, last, before


class Pairs:
    """A block's pairs of a candidate context and the symbol after it, by the context's length."""

    def __init__(self, block: Block, root: Root) -> None:
        self.symbol, self.text, last, before = candidates(block, root.frequent)
        self.size = len(block.words) + 1
        both = np.full(len(last), -1, np.int64)
        here = np.flatnonzero(before >= 0)
        if len(here) and len(root.twos):
            codes = before[here].astype(np.int64) << CODE_BITS | last[here]
            found = np.minimum(np.searchsorted(root.twos, codes), len(root.twos) - 1)
            both[here] = np.where(root.twos[found] == codes, found + (1 << CODE_BITS), -1)
        train = block.train[self.text]
        self.context, self.keys, self.own, self.at = [last, both], [], [], []
        for context in self.context:
            here = np.flatnonzero(context >= 0)
            keys, at = np.unique(context[here] * np.int64(self.size) + self.symbol[here], return_inverse=True)
            full = np.full(len(self.symbol), -1, np.int32)
            full[here] = at
            self.keys.append(keys)
            self.at.append(full)
            self.own.append(np.bincount(at[train[here]], minlength=len(keys)))


def blocks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """The corpus in blocks: a table bucketed by block."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 20, [], 0

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            return Block.of(*(table[c].combine_chunks() if c != "train" else table[c].to_numpy() for c in ("doc_id", "train", "text"))).rows(number)

        for batch in (part for whole in batches for part in by_bytes(whole, "text", BLOCK_BYTES)):
            parts.append(batch)
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield made()
                number, parts, size = number + 1, [], 0
        if parts:
            yield made()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), train.alias("train"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "block long, chunk int, tokens long, texts long, data binary")
    name = f"suffix_tree_{uuid.uuid4().hex}"
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a task then sorts few blocks
    found.write.bucketBy(buckets, "block").option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def word_sums(table: DataFrame, least: float) -> DataFrame:
    """For each block and word, by its place in the block: its sum over all blocks (total), whether that is the block's own count
    (same), whether this row stands for the word (lead), and the word itself in such a row if its sum is ``least`` at least."""

    def run(rows: pa.Table) -> pa.Table:
        block = Block.from_rows(rows)
        n = len(block.words)
        return pa.table({"block": np.full(n, rows["block"][0].as_py()), "word": block.words, "at": np.arange(n, dtype=np.int32), "n": block.counts()})

    rows = table.select("block", "chunk", "data").groupBy("block").applyInArrow(run, "block long, word string, at int, n long")
    own = Window.partitionBy("word")
    found = rows.select("*", F.sum("n").over(own).alias("total"), (F.row_number().over(own.orderBy("block")) == 1).alias("lead"))
    return write_scratch(found.select("block", "at", "total", (F.col("n") == F.col("total")).alias("same"), "lead", F.when(F.col("lead") & (F.col("total") >= least), F.col("word")).alias("word")), "word-sums")


def totals(block: Block, rows: pa.Table) -> np.ndarray:
    """Sums of the block's words over all blocks."""
    out = block.counts()
    out[rows["at"].to_numpy()] = rows["total"].to_numpy()
    return out


def frequent_pairs(table: DataFrame, frequent: list[str], least: float) -> np.ndarray:
    """The pairs of frequent words that occur in at least ``least`` places, as in :class:`Root`."""
    shared = table.sparkSession.sparkContext.broadcast(frequent)

    def run(rows: pa.Table) -> pa.Table:
        block = Block.from_rows(rows)
        _, text, last, before = candidates(block, shared.value)
        here = np.flatnonzero((before >= 0) & block.train[text])
        codes, n = np.unique(before[here].astype(np.int64) << CODE_BITS | last[here], return_counts=True)
        return pa.table({"code": codes, "n": n})

    counts = table.select("block", "chunk", "data").groupBy("block").applyInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["code"] for r in counts.where(F.col("n") >= least).select("code").collect()), np.int64)


def pair_sums(table: DataFrame, sums: DataFrame, root: Root) -> DataFrame:
    """For each block, context and next symbol: the sum over all blocks, as in :func:`word_sums`, and the symbol's log
    probability at the root."""
    shared = table.sparkSession.sparkContext.broadcast(root)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block, number = Block.from_rows(left), left["block"][0].as_py()
        root = shared.value
        count = totals(block, right)
        pairs = Pairs(block, root)
        symbol_hash = np.append(hashes(block.words).view(np.int64), END)
        log_p = root.log_p(np.append(count, root.ends))
        keys, own = np.concatenate(pairs.keys), np.concatenate(pairs.own)
        x = keys % pairs.size
        return pa.table({"block": np.full(len(keys), number), "context": keys // pairs.size, "x": symbol_hash[x], "n": own.astype(np.int32), "log_p": log_p[x].astype(np.float32)})

    came = sums.where(~F.col("same")).select("block", "at", "total")
    rows = table.select("block", "chunk", "data").groupBy("block").cogroup(came.groupBy("block")).applyInArrow(run, "block long, context long, x long, n int, log_p float")
    own = Window.partitionBy("context", "x")
    found = rows.select("block", "context", "x", "n", "log_p", F.sum("n").over(own).alias("total"), (F.row_number().over(own.orderBy("block")) == 1).alias("lead"))
    found = found.select("block", "context", "x", "total", (F.col("n") == F.col("total")).alias("same"), "lead", F.when(F.col("lead"), F.col("log_p")).alias("log_p"))
    return write_scratch(found, "pair-sums")


def least_share(total: int) -> float:
    """The share of all symbols that makes a candidate in a corpus of ``total`` symbols."""
    return min(SHARE, max(total, 1) ** -0.5)


def sized(rows: DataFrame, most: float) -> DataFrame:
    """``rows``, of which there are ``most`` at the utmost, to be broadcast if these are few."""
    return F.broadcast(rows) if most <= BROADCAST_ROWS else rows


def retained(sums: DataFrame, root: Root, share: float, deviations: float = DEVIATIONS, least_nats: float = LEAST_NATS) -> list[tuple[int, int, int]]:
    """(context, symbols after it, different ones) of all contexts of the tree: those whose next symbols diverge from their
    suffix's, and the suffixes of these. No more than 2 / share."""
    leads = sums.where("lead AND total > 0").select("context", "x", F.col("total").alias("c"), "log_p")
    # the number of symbols after a context, with its different ones
    sizes = leads.groupBy("context").agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("kinds"))
    rows = leads.join(sized(sizes, 2 / share), "context")
    log_q = F.log((F.col("c") + F.col("kinds") * F.exp("log_p")) / (F.col("size") + F.col("kinds")))
    ones = rows.where(F.col("context") < 1 << CODE_BITS)
    tested = ones.select("context", "c", "size", "kinds", F.col("log_p").alias("suffix_log_p"))
    if len(root.twos):
        ends = sums.sparkSession.createDataFrame([((1 << CODE_BITS) + i, int(c) & (1 << CODE_BITS) - 1) for i, c in enumerate(root.twos)], "context long, last long")
        suffix = ones.select(F.col("context").alias("last"), "x", log_q.alias("suffix_log_p"))
        twos = rows.join(sized(ends, len(root.twos)), "context").join(suffix, ["last", "x"])
        tested = tested.unionByName(twos.select("context", "c", "size", "kinds", "suffix_log_p"))
    gain = F.col("c") * (F.log(F.col("c") / F.col("size")) - F.col("suffix_log_p"))
    scored = tested.groupBy("context").agg(F.sum(gain).alias("gain"), F.first("size").alias("size"), F.first("kinds").alias("kinds")).collect()
    every = {r["context"]: (r["size"], r["kinds"]) for r in scored}
    # twice the gain is about chi-square distributed if nothing diverges
    kept = {r["context"] for r in scored if 2 * r["gain"] > r["kinds"] + deviations * (2 * r["kinds"]) ** 0.5 and r["gain"] >= least_nats * r["size"]}
    kept |= {int(root.twos[c - (1 << CODE_BITS)]) & (1 << CODE_BITS) - 1 for c in kept if c >= 1 << CODE_BITS}
    return sorted((c, *every[c]) for c in kept if c in every)


def score(docs: DataFrame, train: Column, share: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows where ``train`` holds and score all: doc_id, train, n_tokens, n_known, train_tokens, base_score,
    score (log10 probabilities of the text at the root and in the tree), n_in_context (symbols scored in a retained context)."""
    spark = docs.sparkSession
    table = blocks(docs, id_col, text_col, train)
    known = table.agg(F.sum("tokens"), F.sum("texts")).first()
    total, ends = known[0] or 0, known[1] or 0
    share = least_share(total) if share is None else share
    if not 2.0**-CODE_BITS < share <= 1:
        raise ValueError(f"share {share} gives more candidates than their codes can tell apart")
    sums = word_sums(table, max(1.0, share * total))
    distinct = sums.where("lead AND total > 0").count() + (ends > 0)
    # words with share of all symbols at least: 1 / share at most
    frequent = sorted(r["word"] for r in sums.where("word IS NOT NULL").select("word").collect())
    root = Root(total, distinct, ends, frequent, frequent_pairs(table, frequent, max(1.0, share * total)))
    pairs = pair_sums(table, sums, root)
    tree = retained(pairs, root, share)
    nodes = np.array(tree, np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((root, nodes))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        root, nodes = shared.value
        block = Block.from_rows(left)
        of_pairs = pc.is_valid(right["x"])
        count = totals(block, right.filter(pc.invert(of_pairs)))
        pairs = Pairs(block, root)
        came = right.filter(of_pairs)
        symbol_hash = np.append(hashes(block.words).view(np.int64), END)
        order = np.argsort(symbol_hash, kind="stable")
        x = order[np.searchsorted(symbol_hash[order], came["x"].to_numpy())]
        context, sum_ = came["context"].to_numpy(), came["total"].to_numpy()
        all_counts = np.append(count, root.ends)
        base = root.log_p(all_counts)[pairs.symbol]
        log_p, p, deep = base.copy(), np.exp(base), np.zeros(len(base), bool)
        for depth in (0, 1):
            own, mine = pairs.own[depth].copy(), (context >= 1 << CODE_BITS) == bool(depth)
            own[np.searchsorted(pairs.keys[depth], context[mine] * pairs.size + x[mine])] = sum_[mine]
            state = pairs.context[depth]
            node = np.minimum(np.searchsorted(nodes[:, 0], state), max(len(nodes) - 1, 0))
            here = np.flatnonzero((state >= 0) & (nodes[node, 0] == state)) if len(nodes) else np.zeros(0, np.int64)
            size, kinds = nodes[node[here], 1], nodes[node[here], 2]
            p[here] = (own[pairs.at[depth][here]] + kinds * p[here]) / (size + kinds)
            log_p[here] = np.log(p[here])
            deep[here] = True
        n = len(block.bounds) - 1
        sums = [np.bincount(pairs.text, w, n) for w in (base / np.log(10), log_p / np.log(10))]
        counts = [np.bincount(pairs.text, w, n).astype(np.int64) for w in (np.ones(len(base)), all_counts[pairs.symbol] > 0, deep)]
        names = ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_in_context"]
        return pa.table([block.doc_ids, pa.array(block.train), counts[0], counts[1], np.full(n, root.total), *sums, counts[2]], names)

    words = sums.where(~F.col("same")).select("block", "at", "total", F.lit(None).cast("long").alias("context"), F.lit(None).cast("long").alias("x"))
    kept = spark.createDataFrame([(int(c),) for c, _, _ in tree], "context long")
    came = pairs.where(~F.col("same")).join(sized(kept, len(tree)), "context", "left_semi").select("block", F.lit(None).cast("int").alias("at"), "total", "context", "x")
    back = words.unionByName(came)
    schema = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_in_context long"
    return table.select("block", "chunk", "data").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from six sevenths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, id_fold("doc_id", 7) != 2)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_in_context")
