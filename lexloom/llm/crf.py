"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a distribution over the learned languages: its features (affixes of one to three letters,
letter bigrams and trigrams with word bounds, membership in each language's lexicon) give a score for each language,
learned transitions tie neighbouring words together, and forward-backward sums over all label sequences. So a text that
switches between languages is labelled word by word; the text's language is the one with the largest mean probability, and that
mean is the score.

Fitted on a bounded sample: about ``DOCS_PER_LANGUAGE`` different labelled texts of up to ``SAMPLE_BYTES`` bytes for each
language, chosen by a hash of id and text (a language that has longer texts only gives their first ``SAMPLE_BYTES`` characters), cut into ``SEQUENCES`` sequences,
drawn in turn from each language (short texts and the tails of others run together), a third of which are made to
switch in the middle. Prediction takes whole texts: they are cut into segments whose transfer matrices are
multiplied along the text, so the result is that of one pass, and a long text costs no more steps than a short one.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without labelled texts all are; of equal
probabilities the language that sorts first wins; repeated rows get equal results; a null id stays null; an empty table
gives no rows. Other columns aren't read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import id_fold, trimmed
from lexloom.llm.tokens import by_bytes
from lexloom.llm.words import indexed

DOCS_PER_LANGUAGE, SAMPLE_BYTES = 500, 20_000
SEQUENCES, LENGTH, EPOCHS, BATCH, RATE = 6000, 64, 4, 500, 0.3
#: Hashed features, and words of each lexicon.
BUCKETS, LEXICON = 1 << 16, 300
SEGMENT = 128
#: Words whose features are held at a time.
WORDS = 1 << 14
OPEN, CLOSE = 2, 3


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(index of each word, bounds of the texts, distinct words): runs of letters in lower case."""
    return indexed(pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), "[^\\pL\\pM]+"), len(texts))


def has_letter(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(pc.fill_null(texts, ""), "\\pL"), dtype=bool)


def _hash(parts: list[np.ndarray], salt: int) -> np.ndarray:
    out = np.full(len(parts[0]), salt * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for p in parts:
        out = (out ^ p) * np.uint32(0x85EBCA6B)
        out ^= out >> np.uint32(13)
    return out * np.uint32(0xC2B2AE35) >> np.uint32(16)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) for all hashed features of the words."""
    text = np.frombuffer("".join(f"\2{w}\3" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    starts = ends - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    who, what = [], []

    def add(at: np.ndarray, n: int, salt: int) -> None:
        who.append(word[at])
        what.append(_hash([text[at + i] for i in range(n)], salt))

    room = np.repeat(ends, lengths) - np.arange(len(text))
    for n in (2, 3):
        add(np.flatnonzero(room >= n), n, n)
    for n in (1, 2, 3):
        long = lengths - 2 >= n
        add(starts[long] + 1, n, 10 + n)
        add(ends[long] - 1 - n, n, 20 + n)
    return np.concatenate(who), np.concatenate(what).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS hashed features, then one for each lexicon; by language
    moves: np.ndarray  # transitions
    begin: np.ndarray
    lexicons: dict[str, int]  # word: set of languages as bits

    def emissions(self, words: list[str]) -> np.ndarray:
        k = len(self.languages)
        out = np.empty((len(words), k))
        for at in range(0, len(words), WORDS):
            some = words[at : at + WORDS]
            who, what = features(some)
            for j in range(k):
                out[at : at + len(some), j] = np.bincount(who, self.weights[what, j], len(some))
        for i, bits in ((i, self.lexicons[w]) for i, w in enumerate(words) if w in self.lexicons):
            out[i] += sum(self.weights[BUCKETS + j] for j in range(k) if bits >> j & 1)
        return out

    def shares(self, index: np.ndarray, bounds: np.ndarray, words: list[str]) -> np.ndarray:
        """Mean probability of each language over the words of each text; zeros for a text without words."""
        if not len(index):
            return np.zeros((len(bounds) - 1, len(self.languages)))
        scores = self.emissions(words)
        return marginal_sums(np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32), index, bounds, np.exp(self.moves), np.exp(self.begin)) / np.maximum(np.diff(bounds), 1)[:, None]


def _scaled(x: np.ndarray) -> np.ndarray:
    x /= np.maximum(x.reshape(len(x), -1).sum(axis=1), 1e-30).reshape((-1,) + (1,) * (x.ndim - 1))
    return x


def marginal_sums(scores: np.ndarray, index: np.ndarray, bounds: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Forward-backward over texts of any lengths: sums of each text's label probabilities.

    scores: exp of each distinct word's scores; moves, begin: exp of the transitions and of the first label's score.
    """
    k, n = scores.shape[1], len(bounds) - 1
    moves, begin = moves.astype(np.float32), begin.astype(np.float32)
    lengths = np.diff(bounds)
    count = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(n), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[:-1][text] + place * SEGMENT
    size = np.minimum(SEGMENT, bounds[1:][text] - start)
    order = np.argsort(-size, kind="stable")
    start, size, text, place = start[order], size[order], text[order], place[order]
    lanes = np.searchsorted(-size, -np.arange(SEGMENT), side="left")  # how many segments are longer than t
    # transfer matrix of each segment: from the label before it to the label of its last word
    transfer = np.tile(np.eye(k, dtype=np.float32), (len(start), 1, 1))
    for t in range(int(size[0])):
        a = lanes[t]
        step = (transfer[:a].reshape(-1, k) @ moves).reshape(a, k, k) * scores[index[start[:a] + t]][:, None, :]
        transfer[:a] = _scaled(step)
    # along each text: what comes before and after each segment
    before, after = np.ones((len(start), k), np.float32), np.ones((len(start), k), np.float32)
    by_place = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[by_place], np.arange(int(place.max()) + 2))
    current = np.empty((n, k), np.float32)
    for p in range(len(cuts) - 1):
        own = by_place[cuts[p] : cuts[p + 1]]
        if p:
            before[own] = current[text[own]]
            current[text[own]] = _scaled(np.einsum("ij,ijk->ik", before[own], transfer[own]))
        else:  # the first word has a score of its own in place of a transition: run its segment by itself
            current[text[own]] = _first(scores, index, start[own], size[own], moves, begin)
    for p in range(len(cuts) - 2, 0, -1):
        own = by_place[cuts[p] : cuts[p + 1]]
        back = _scaled(np.einsum("ijk,ik->ij", transfer[own], after[own]))
        # the segment before this one of the same text
        ahead = by_place[cuts[p - 1] : cuts[p]]
        at = np.full(n, -1)
        at[text[ahead]] = ahead
        after[at[text[own]]] = back
    # within each segment
    forward = np.empty((int(size[0]), len(start), k), np.float32)
    for t in range(int(size[0])):
        a = lanes[t]
        if t:
            came = forward[t - 1, :a] @ moves
        else:
            came = before[:a] @ moves
            came[place[:a] == 0] = begin
        forward[t, :a] = _scaled(came * scores[index[start[:a] + t]])
    sums, back = np.zeros((len(start), k)), after
    for t in range(int(size[0]) - 1, -1, -1):
        a = lanes[t]
        sums[:a] += _scaled(forward[t, :a] * back[:a])
        back[:a] = _scaled((back[:a] * scores[index[start[:a] + t]]) @ moves.T)
    out = np.zeros((n, k))
    np.add.at(out, text, sums)
    return out


def _first(scores: np.ndarray, index: np.ndarray, start: np.ndarray, size: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Label weights of the last words of segments that begin a text."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    state = _scaled(begin * scores[index[start]])
    for t in range(1, int(size[0])):
        a = int(np.searchsorted(-size, -t, side="left"))
        state[:a] = _scaled((state[:a] @ moves) * scores[index[start[:a] + t]])
    out = np.empty_like(state)
    out[order] = state
    return out


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (language, text) pairs by stochastic gradients of the sequences' log likelihood."""
    languages = sorted({lang for lang, _ in texts})
    k = len(languages)
    if not k:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0), {})
    index, bounds, distinct = letters(pa.array([t for _, t in texts], pa.string()))
    words = distinct.to_pylist()
    label = np.repeat(np.array([languages.index(lang) for lang, _ in texts]), np.diff(bounds))
    counts = np.stack([np.bincount(index[label == j], minlength=len(words)) for j in range(k)], axis=1)
    rate = counts / np.maximum(counts.sum(axis=0), 1)
    own = rate * (rate >= 0.5 * rate.max(axis=1, keepdims=True))
    lexicons: dict[str, int] = {}
    for j in range(k):
        for i in np.argsort(-own[:, j], kind="stable")[:LEXICON]:
            if own[i, j] > 0:
                lexicons[words[i]] = lexicons.get(words[i], 0) | 1 << j
    model = Model(languages, np.zeros((BUCKETS + k, k)), np.zeros((k, k)), np.zeros(k), lexicons)
    # sequences of LENGTH words, drawn in turn from each language; of every third one, the second half comes from another text
    rng = np.random.default_rng(seed)
    length, drawn, turn = LENGTH, [], []
    if not len(index):
        return model
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    whole = np.arange(len(index)) < (bounds[:-1] + np.diff(bounds) // length * length)[text]
    for j in range(k):
        # short texts and the tails of others are run together, and filled up with the language's first words
        rest = np.flatnonzero((label == j) & ~whole)
        fill = np.resize(np.flatnonzero(label == j), -len(rest) % length)
        own = np.concatenate([np.flatnonzero((label == j) & whole), rest, fill]).reshape(-1, length)
        drawn.append(rng.permutation(own))
        turn.append(np.arange(len(own)))
    at = np.concatenate(drawn)[np.argsort(np.concatenate(turn), kind="stable")[:SEQUENCES]].astype(np.int64)
    at = rng.permutation(at)
    mixed = np.arange(len(at)) % 3 == 0
    at[mixed, length // 2 :] = rng.permutation(at[mixed])[:, length // 2 :]
    seq, gold = index[at], label[at]

    who, what = features(words)
    lex = [(i, BUCKETS + j) for i, w in enumerate(words) if w in lexicons for j in range(k) if lexicons[w] >> j & 1]
    who = np.concatenate([who, np.array([x for x, _ in lex], np.int64)])
    what = np.concatenate([what, np.array([y for _, y in lex], np.int64)])
    squares = [np.full(x.shape, 1e-2) for x in (model.weights, model.moves, model.begin)]
    for step in range(EPOCHS * -(-len(seq) // BATCH)):
        pick = np.arange(step * BATCH, (step + 1) * BATCH) % len(seq)
        s, g = seq[pick], gold[pick]
        score = np.stack([np.bincount(who, model.weights[what, j], len(words)) for j in range(k)], axis=1)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        moves, begin = np.exp(model.moves), np.exp(model.begin)
        forward = np.empty((length, len(s), k))
        forward[0] = _scaled(begin * score[s[:, 0]])
        for t in range(1, length):
            forward[t] = _scaled((forward[t - 1] @ moves) * score[s[:, t]])
        back = np.ones((len(s), k))
        by_word, by_move = np.zeros((len(words), k)), np.zeros((k, k))
        for t in range(length - 1, -1, -1):
            lead = -_scaled(forward[t] * back)
            lead[np.arange(len(s)), g[:, t]] += 1
            by_word += np.stack([np.bincount(s[:, t], lead[:, j], len(words)) for j in range(k)], axis=1)
            if t:
                ahead = back * score[s[:, t]]
                pair = _scaled(forward[t - 1][:, :, None] * moves * ahead[:, None, :])
                np.add.at(by_move, (g[:, t - 1], g[:, t]), 1)
                by_move -= pair.sum(axis=0)
                back = _scaled(ahead @ moves.T)
        slopes = [np.stack([np.bincount(what, by_word[who, j], BUCKETS + k) for j in range(k)], axis=1) / len(s), by_move / len(s), lead.sum(axis=0) / len(s)]
        for value, slope, square in zip((model.weights, model.moves, model.begin), slopes, squares, strict=True):
            slope -= 1e-5 * value
            square += slope * slope
            value += RATE * slope / np.sqrt(square)
    model.weights = model.weights.astype(np.float32)
    return model


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """A model from a sample of the labelled rows of ``docs`` whose bounds are this module's constants."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    short = F.octet_length("text") <= SAMPLE_BYTES
    counts = rows.groupBy("lang").agg(F.count_if(short).alias("short"), F.count(F.lit(1)).alias("all")).collect()
    if not counts:
        return fit([])
    # parts of 2^40, by language: of the short texts where there are any, else of all
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, DOCS_PER_LANGUAGE / (r["short"] or r["all"])) * (1 << 40)))])
    some = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], r["short"] > 0)])
    hashed = rows.withColumn("h", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)))
    chosen = hashed.where((F.col("h") < F.element_at(share, F.col("lang"))) & (short | ~F.element_at(some, F.col("lang"))))
    # copies have one hash: they count once, so that the sample stays as small as it is meant to be
    sample = chosen.select("lang", F.substring("text", 1, SAMPLE_BYTES).alias("text"), "h").dropDuplicates(["lang", "h"]).select("lang", "text").collect()
    return fit(sorted((r["lang"], r["text"]) for r in sample))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, shares (mean probability of each language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double, shares map<string,double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.languages)
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            index, bounds, words = letters(batch.column("text"))
            share = model.shares(index, bounds, words.to_pylist()) if k else np.zeros((batch.num_rows, 1))
            some = has_letter(batch.column("text")) & (k > 0)
            best = share.argmax(axis=1)
            names = pa.array([model.languages[i] if x else "und" for i, x in zip(best.tolist(), some.tolist(), strict=True)])
            score = np.where(some, np.clip(share.max(axis=1), 0, 1), 0.0)
            held = np.flatnonzero(some)
            offsets = np.concatenate([[0], np.cumsum(some) * k]).astype(np.int32)
            maps = pa.MapArray.from_arrays(pa.array(offsets), pa.array(model.languages * len(held), pa.string()), pa.array(share[held].ravel() if k else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names, pa.array(score), maps], ["doc_id", "lang_pred", "score", "shares"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), schema)


def accept(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known: not ``und``, and its score ``least`` at least."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, text_col)):
            texts = batch.column(text_col).cast(pa.string())
            index, bounds, words = letters(texts)
            k = len(shared.value.languages)
            share = shared.value.shares(index, bounds, words.to_pylist()) if k else np.zeros((batch.num_rows, 1))
            yield batch.filter(pa.array(has_letter(texts) & (share.max(axis=1) >= least)))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op9_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(id_fold("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
