"""Toxicity scores of texts after noisy-channel deobfuscation.

Tokens that look disguised (digits or symbols among letters, letters repeated three times or more, single letters in a
row with spaces or marks between them) become lattices of characters: a symbol may stand for a letter or for nothing, a
run for one or two letters, a gap for nothing or a word break, each at a cost. Viterbi decoding under a character language
model finds the likeliest reading. A sparse logistic regression over the words of the restored text and their
first letters scores it.

The language model's trigram counts are taken over all training texts. The classifier is fitted on a bounded sample of
the labelled ones: about ``PER_CLASS`` rows of each class at most, by a hash of the id, with texts of up to
``SAMPLE_BYTES`` bytes. Scoring takes whole texts.

Defined results: a null or empty text has the score of a text without words; without labels of both classes all scores
are 0; repeated labels of one id count once, as toxic if any says so; repeated rows get equal scores; a null id stays null; an
empty table gives no rows. Only the id, to join labels, and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import id_fold
from lexloom.llm.tokens import by_bytes, ragged
from lexloom.llm.words import hashes, indexed

PER_CLASS, SAMPLE_BYTES = 3000, 20_000
#: Letters that a symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
#: Marks that may stand between letters.
GAPS = " .-_~'"
#: Costs (negative natural logarithms) of the channel.
READ_AS_LETTER, DROPPED, DOUBLED, JOINED, PARTED = 1.0, 8.0, 1.0, 0.3, 4.0
#: Characters that the language model tells apart; 0 is a word's bound, the last all others.
ALPHABET = "\0abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôöùúûüýßœ"
SIZE = len(ALPHABET) + 1
FEATURES, PREFIXES = 1 << 18, (4, 5, 6)
PENALTY, RATE, ROUNDS = 8e-4, 0.5, 200


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all words as numbers, each word with a bound before and after it; word of each character)."""
    text = np.frombuffer("".join(f"\0{w}\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.full(0x180, SIZE - 1, np.int64)
    table[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return table[np.minimum(text, 0x17F)], np.repeat(np.arange(len(words)), lengths)


def trigram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, word) for every trigram of each word between two bounds before and one after it."""
    code, word = coded(words)
    before = np.concatenate([[0], code[:-1]]) * (np.concatenate([[-1], word[:-1]]) == word)
    before2 = np.concatenate([[0, 0], code[:-2]]) * (np.concatenate([[-1, -1], word[:-2]]) == word)[: len(code)]
    real = np.flatnonzero(np.concatenate([[-1], word[:-1]]) == word)
    return (before2[real] * SIZE + before[real]) * SIZE + code[real], word[real]


@dataclass
class CharacterModel:
    """Interpolated trigrams: log_p[a, b, c] is the log probability of c after a, b."""

    log_p: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> CharacterModel:
        tri = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + SIZE)
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
        return CharacterModel(np.log(p3))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """The readings of each part of a token with their costs."""
    out: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, n = m[1], len(m[0])
        if c in GAPS:
            out.append([("", JOINED), ("\0", PARTED)])
        elif c in LEET:
            once = [(x, READ_AS_LETTER + DOUBLED * (n == 2)) for x in LEET[c]] + [("", DROPPED / min(n, 3))]
            out.append(once + [(x + x, READ_AS_LETTER) for x in LEET[c] if n == 2])
        elif not c.isalpha():
            out.append([("\0", 0.0)])
        elif n == 1:
            out.append([(c, 0.0)])
        elif n == 2:
            out.append([(c + c, 0.0), (c, DOUBLED)])
        else:
            out.append([(c, 0.0), (c + c, DOUBLED)])
    return out


_CODE = {c: i for i, c in enumerate(ALPHABET)}


def decode(token: str, model: CharacterModel) -> str:
    """The likeliest reading of a token; words are parted by spaces. Viterbi over the last two characters."""
    log_p = model.log_p
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in [*lattice(token), [("\0", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for text, price in readings:
                x, y, total = a, b, cost + price
                for c in text:
                    if c == "\0" and y == 0:
                        continue
                    k = _CODE.get(c, SIZE - 1)
                    total -= log_p[x, y, k]
                    x, y = (y, k) if k else (0, 0)
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, (path, text))
        states = new
    path, parts = min(states.values(), key=lambda s: s[0])[1], []
    while path is not None:
        path, text = path
        parts.append(text)
    return " ".join("".join(reversed(parts)).split("\0")).strip()


#: What is cut off a token's ends: marks, and symbols in a row.
ENDS = r"^(?:[^\pL\pN@$]+|[@$]{2,})|(?:[^\pL\pN]{2,}|[^\pL\pN@$*+]+)$"
NOISY = r"\pL.*[0-9@$!|+(€£*]|[0-9@$!|+(€£*].*\pL|^\pL(?:[.\-_~']\pL){2,}$"


@dataclass
class Restorer:
    """Splits texts into words with disguised ones restored; keeps readings it has found."""

    model: CharacterModel
    known: dict[str, str] = field(default_factory=dict)

    def read(self, token: str) -> str:
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = decode(token, self.model)
        return self.known[token]

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(text, word) pairs and the distinct words: each pair is a word's occurrence in the restored text."""
        lower = pc.utf8_lower(pc.fill_null(texts, ""))
        index, bounds, tokens = indexed(pc.split_pattern_regex(lower, r"\s+"), len(texts))
        text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        stripped = pc.replace_substring_regex(tokens, ENDS, "")
        noisy = np.asarray(pc.match_substring_regex(stripped, NOISY), dtype=bool) | _threefold(stripped)
        at = np.flatnonzero(noisy)
        restored = {int(i): self.read(s) for i, s in zip(at, stripped.take(pa.array(at)).to_pylist(), strict=True)}
        plain = pc.if_else(pa.array(noisy), pa.array([restored.get(i, "") for i in range(len(tokens))] if restored else [""] * len(tokens), pa.string()), stripped)
        parts = pc.split_pattern_regex(plain, r"[^\pL\pM]+")
        part, part_bounds, distinct = indexed(parts, len(tokens))
        words = distinct.to_pylist()
        # single characters in a row
        single = np.asarray(pc.match_substring_regex(tokens, r"^[\pL0-9@$!|+(€£*]$"), dtype=bool)
        rows, spelled = self._spelled(index, text_of, single, tokens)
        took, took_bounds = ragged(part_bounds[index], np.diff(part_bounds)[index])
        text_of = np.repeat(text_of, np.diff(took_bounds))
        place = {w: i for i, w in enumerate(words)}
        more = []
        for w in spelled:
            if w not in place:
                place[w] = len(words)
                words.append(w)
            more.append(place[w])
        return np.concatenate([text_of, np.array(rows, np.int64)]), np.concatenate([part[took], np.array(more, np.int64)]), words

    def _spelled(self, index: np.ndarray, text_of: np.ndarray, single: np.ndarray, tokens: pa.Array) -> tuple[list[int], list[str]]:
        flags = single[index]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]]).astype(np.int8)) | np.concatenate([[1], np.diff(text_of) != 0, [1]]) if len(index) else np.zeros(1))
        rows, words = [], []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if flags[a] and b - a >= 3 and (index[a:b] != index[a]).any():
                for w in self.read(" ".join(tokens.take(pa.array(index[a:b])).to_pylist())).split():
                    rows.append(int(text_of[a]))
                    words.append(w)
        return rows, words


def _threefold(words: pa.Array) -> np.ndarray:
    """Whether a letter comes three times in a row."""
    lengths = np.asarray(pc.utf8_length(words), dtype=np.int64)
    text = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.repeat(np.arange(len(words)), lengths)
    out = np.zeros(len(words), bool)
    if len(text) > 2:
        same = ((text[2:] >= ord("a")) & (text[2:] <= ord("z")) | (text[2:] > 0xA9)) & (text[2:] == text[1:-1]) & (text[1:-1] == text[:-2]) & (word[2:] == word[:-2])
        out[word[2:][same]] = True
    return out


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature): the word itself and its first four to six letters."""
    array = pa.array(words, pa.string())
    who, what = [np.arange(len(words))], [hashes(array, 1)]
    lengths = np.asarray(pc.utf8_length(array), dtype=np.int64)
    for n in PREFIXES:
        long = np.flatnonzero(lengths >= n)
        starts = pc.utf8_slice_codeunits(array.take(pa.array(long)), 0, n).dictionary_encode()
        who.append(long)
        what.append(hashes(starts.dictionary, 10 + n)[starts.indices.to_numpy()] if len(long) else np.zeros(0, np.uint64))
    return np.concatenate(who), (np.concatenate(what) % np.uint64(FEATURES)).astype(np.int64)


def fit(rows: np.ndarray, features: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Sparse logistic regression over presence of features, by proximal gradients with a step for each feature; both
    classes weigh the same."""
    n = len(labels)
    found, features = np.unique(features, return_inverse=True)
    often = np.bincount(features, minlength=len(found)) >= 3
    keep = often[features]
    rows, features, found = rows[keep], (np.cumsum(often) - 1)[features[keep]], found[often]
    share = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    w, bias = np.zeros(len(found)), 0.0
    squares, bias_square = np.full(len(found), 1e-8), 1e-8
    for _ in range(ROUNDS):
        margin = np.bincount(rows, w[features], n) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) * share
        slope = np.bincount(features, error[rows], len(found))
        squares += slope * slope
        step = RATE / np.sqrt(squares)
        w = w - step * slope
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0)
        bias_square += error.sum() ** 2
        bias -= RATE * error.sum() / bias_square**0.5
    weights = np.zeros(FEATURES, np.float32)
    weights[found] = w
    return weights, float(bias)


@dataclass
class Model:
    characters: CharacterModel
    weights: np.ndarray | None
    bias: float

    def scores(self, texts: pa.Array, restorer: Restorer) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        rows, word, words = restorer.words(texts)
        who, what = word_features(words)
        hot = self.weights[what] != 0
        who, what = who[hot], what[hot]
        order = np.argsort(who, kind="stable")
        who, what = who[order], what[order]
        # features with weight that each text has, once each
        count = np.bincount(who, minlength=len(words))
        some = np.flatnonzero(count[word] > 0)
        rows, word = rows[some], word[some]
        at, bounds = ragged((np.cumsum(count) - count)[word], count[word])
        pairs = np.unique(np.repeat(rows, np.diff(bounds)) * FEATURES + what[at])
        margin = np.bincount(pairs // FEATURES, self.weights[pairs % FEATURES], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def character_model(docs: DataFrame) -> CharacterModel:
    """Trigram counts over all rows of ``docs`` (doc_id, text); at most SIZE^3 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            lower = pc.utf8_lower(pc.fill_null(batch.column("text"), ""))
            index, _, words = indexed(pc.split_pattern_regex(lower, r"[^\pL\pM]+"), len(lower))
            if len(index):
                codes, word = trigram_codes(words.to_pylist())
                total += np.bincount(codes, np.bincount(index, minlength=len(words))[word], SIZE**3).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    rows = docs.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3, np.int64)
    counts[rows["code"].to_numpy()] = rows["n"].to_numpy()
    return CharacterModel.of(counts)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from ``docs`` and the labels (id, 0 or 1) of some of them."""
    docs = narrow(docs, id_col, text_col)
    characters = character_model(docs)
    verdicts = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    verdicts = verdicts.groupBy("doc_id").agg(F.max("label").alias("label"))
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES)
    count = {r["label"]: r["count"] for r in verdicts.groupBy("label").count().collect()}
    if len(count) < 2:
        return Model(characters, None, 0.0)
    share = F.when(F.col("label") == 1, PER_CLASS / count[1]).otherwise(PER_CLASS / count[0])
    # parts of 2^40: about PER_CLASS of each class, however many there are
    chosen = verdicts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share * float(1 << 40))
    shared = docs.sparkSession.sparkContext.broadcast(characters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            rows, word, words = restorer.words(batch.column("text"))
            who, what = word_features(words)
            order = np.argsort(who, kind="stable")
            count = np.bincount(who, minlength=len(words))
            at, bounds = ragged((np.cumsum(count) - count)[word], count[word])
            pairs = np.unique(np.repeat(rows, np.diff(bounds)) * FEATURES + what[order][at])
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * FEATURES)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((pairs % FEATURES).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("doc_id"), lists], ["label", "doc_id", "features"])

    # one text for an id; the sample is about PER_CLASS of each class, and so is its broadcast
    sample = short.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", "text").mapInArrow(run, "label int, doc_id long, features array<int>").toArrow().sort_by("doc_id")
    if len(sample) == 0 or len(pc.unique(sample["label"])) < 2:
        return Model(characters, None, 0.0)
    lists = sample["features"].combine_chunks()
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    weights, bias = fit(rows, lists.flatten().to_numpy().astype(np.int64), sample["label"].to_numpy().astype(np.float64))
    return Model(characters, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value.characters)
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text"), restorer))], ["doc_id", "score"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def op5_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = id_fold("doc_id", 5)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.where(fold != 0), labels.where(fold != 0))
    found = score(docs, model)
    return found.select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
