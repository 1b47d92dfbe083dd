"""Fast exact encoding of many texts with a byte-level BPE of the tokenizers library.

Such a tokenizer splits a text before it merges bytes, and always splits before a space that follows a character other
than white space. So a text is cut there, each distinct piece of a batch is encoded once by the library, and the ids are
laid out again by index. Texts in which a space follows white space are encoded whole. A tokenizer that has GPT-2's split also
always splits before and after a single line feed between words, and between letters and the ASCII signs that end a word (but
an apostrophe): there the pieces are cut too, so that fewer of them are distinct.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on, and encoded, at a time; one longer text makes a batch of its own.
BATCH_BYTES, ENCODE_BYTES = 6 << 20, 12 << 20
#: Text bytes that the library is given at a time, or one longer text: until its results are dropped it holds some hundred bytes for each id.
GIVEN_BYTES = 1 << 18
#: Pieces whose ids are laid out at a time.
LAID = 1 << 16
#: White space, then a space.
AWKWARD = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\pZ] "
#: Words parted by single line feeds; letters (of Latin-1) with signs behind them; those signs.
LINES = "^[^\\t-\\r\\x{1c}-\\x{20}\\x{85}\\pZ]+(\\n[^\\t-\\r\\x{1c}-\\x{20}\\x{85}\\pZ]+)+$"
LETTERS, SIGNS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SIGNED = LETTERS + r"[!-&(-/:-@\[-`{-~]+$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def by_bytes(batch: pa.RecordBatch, text_col: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` text bytes each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0), dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 for each i in turn, and the bounds of the i."""
    bounds = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    out = np.repeat(starts - bounds[:-1], lengths)
    out += np.arange(bounds[-1])
    return out, bounds


def laid(flat: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat``, which have these lengths, in this order, and their bounds."""
    starts = np.cumsum(lengths) - lengths
    bounds = np.zeros(len(order) + 1, np.int64)
    np.cumsum(lengths[order], out=bounds[1:])
    out = np.empty(int(bounds[-1]), flat.dtype)
    for at in range(0, len(order), LAID):
        some = order[at : at + LAID]
        out[bounds[at] : bounds[at + len(some)]] = flat[ragged(starts[some], lengths[some])[0]]
    return out, bounds


@lru_cache(maxsize=4)
def byte_lengths(path: str) -> np.ndarray:
    """Bytes that each id stands for; in a byte-level vocabulary a character of a token is a byte."""
    vocabulary = tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, at in vocabulary.items():
        out[at] = len(token)
    return out


def _each(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each text, lengths): one text at a time."""
    found, given, size = [np.zeros(0, np.uint32)], [], 0

    def give() -> None:
        found.extend(np.array(e.ids, np.uint32) for e in tokenizer(path).encode_batch_fast(given, add_special_tokens=False))
        given.clear()

    for text in texts:
        own = len(text.encode())
        if given and size + own > GIVEN_BYTES:
            give()
            size = 0
        given.append(text)
        size += own
    give()
    return np.concatenate(found), np.fromiter(map(len, found[1:]), np.int64, len(texts))


@lru_cache(maxsize=4)
def cuts(path: str) -> bool:
    """Whether the tokenizer splits as GPT-2's does, and nothing comes before that."""
    told = json.loads(tokenizer(path).to_str())
    split = told["pre_tokenizer"] or {}
    return split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and told["normalizer"] is None and all(x["special"] for x in told["added_tokens"])


def _fresh(path: str, words: pa.Array, lead: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_each` for a space (``lead``) and each word. Words without white space are encoded many at a time: a tokenizer splits
    between them, and the ids' bytes tell where."""
    odd = np.asarray(pc.match_substring_regex(words, "^$|[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\pZ]"), dtype=bool)
    plain = words.filter(pa.array(~odd))
    texts = plain.to_pylist()
    runs = [lead + lead.join(texts[i : i + 256]) for i in range(0, len(texts), 256)]
    flat, _ = _each(path, runs)
    ends = np.cumsum(byte_lengths(path)[flat])
    word_ends = np.cumsum(np.asarray(pc.binary_length(plain), dtype=np.int64) + 1)
    upto = np.searchsorted(ends, word_ends, side="left") + 1
    if len(word_ends) and not (ends[upto - 1] == word_ends).all():
        raise ValueError("the tokenizer merges across a space or isn't byte-level")
    some, lengths = np.diff(upto, prepend=0), np.zeros(len(words), np.int64)
    lengths[~odd] = some
    rest, own = _each(path, [lead + x for x in words.filter(pa.array(odd)).to_pylist()])
    lengths[odd] = own
    starts = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), np.uint32)
    out[ragged(starts[~odd], some)[0]] = flat
    out[ragged(starts[odd], own)[0]] = rest
    return out, lengths


class Known:
    """Words whose ids a worker has found, so that a batch encodes new ones only. Bounded: it starts anew when full."""

    MOST = 1_500_000

    def __init__(self, lead: str = " ") -> None:
        self.lead = lead
        self.words, self.flat = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As :func:`_fresh`."""
        if len(self.words) + len(words) > self.MOST:
            kept = min(len(self.words), self.MOST // 4)  # the ones that came first are the frequent ones
            self.words, self.starts, self.lengths = self.words[:kept], self.starts[:kept], self.lengths[:kept]
            self.flat = self.flat[: int(self.lengths.sum())]
        at = pc.index_in(self.words, value_set=words)  # the batch's words are hashed, and not all that are known, which would take more and more memory
        place = np.full(len(words), -1)
        place[at.drop_null().to_numpy()] = np.flatnonzero(np.asarray(pc.is_valid(at), dtype=bool))
        new = place < 0
        flat, lengths = _fresh(path, words.filter(pa.array(new)), self.lead)
        place[new] = len(self.words) + np.arange(int(new.sum()))
        self.words = pa.concat_arrays([self.words, words.filter(pa.array(new))])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
        took, _ = ragged(self.starts[place], self.lengths[place])
        return self.flat[took], self.lengths[place]


@lru_cache(maxsize=4)
def _known(path: str, lead: str = " ") -> Known:
    return Known(lead)


def _composed(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_fresh`, from the known words of which each of ``words`` is made."""
    if not cuts(path):
        return _known(path).ids(path, words)
    lines = np.asarray(pc.match_substring_regex(words, LINES), dtype=bool)
    split = pc.split_pattern(words.filter(pa.array(lines)), "\n")
    count = np.ones(len(words), np.int64)
    count[lines] = np.asarray(pc.list_value_length(split), dtype=np.int64)
    at = np.cumsum(count) - count
    place = np.concatenate([at[~lines], ragged(at[lines], count[lines])[0]])
    order = np.empty(len(place), np.int64)
    order[place] = np.arange(len(place))
    pieces = pa.concat_arrays([words.filter(pa.array(~lines)), split.flatten()]).take(pa.array(order))
    first = np.zeros(len(pieces), bool)
    first[at] = True
    signed = pc.match_substring_regex(pieces, SIGNED)
    stems = pc.if_else(signed, pc.ascii_rtrim(pieces, SIGNS), pieces)
    tails = pc.replace_substring_regex(pieces.filter(signed), LETTERS, "").dictionary_encode()
    signed = np.asarray(signed, dtype=bool)
    # units of each piece: its letters, and the signs behind them
    units, base, found = np.empty(len(pieces), np.int64), 0, []
    for lead, some in ((" ", first), ("\n", ~first)):
        own = stems.filter(pa.array(some)).dictionary_encode()
        units[some] = base + own.indices.to_numpy()
        found.append(_known(path, lead).ids(path, own.dictionary))
        base += len(own.dictionary)
    found.append(_each(path, tails.dictionary.to_pylist()))
    ends = np.cumsum(1 + signed)
    sequence = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    sequence[ends - 1 - signed] = units
    sequence[ends[signed] - 1] = base + tails.indices.to_numpy()
    flat, lengths = (np.concatenate(x) for x in zip(*found, strict=True))
    ids, bounds = laid(flat, lengths, sequence)
    upto = np.concatenate([np.zeros(1, np.int64), ends])[np.concatenate([at, [len(pieces)]])]
    return ids, np.diff(bounds[upto])


def encode(path: str, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, bounds): text i has ids[bounds[i]:bounds[i + 1]]. Null counts as empty."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    awkward = np.asarray(pc.match_substring_regex(texts, AWKWARD), dtype=bool)
    plain = texts.filter(pa.array(~awkward))
    parts = pc.split_pattern(plain, " ")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    words = parts.flatten().dictionary_encode()
    index = words.indices.to_numpy().astype(np.int64)
    first = offsets[:-1] - offsets[0]  # a text has one part at least
    heads = words.dictionary.take(pa.array(index[first])).dictionary_encode() if len(first) else pa.array([], pa.string()).dictionary_encode()
    whole = texts.filter(pa.array(awkward))
    top, rest = heads.dictionary.to_pylist(), whole.to_pylist()
    (flat, lengths), (more, own) = _composed(path, words.dictionary), _each(path, top + rest)
    tail, flat, lengths = len(words.dictionary), np.concatenate([flat, more]), np.concatenate([lengths, own])
    index[first] = tail + heads.indices.to_numpy()
    # pieces of all texts in order: parts of the plain ones, one piece for each of the others
    count = np.ones(n, np.int64)
    count[~awkward] = np.diff(offsets)
    at = np.cumsum(count) - count
    order = index
    if len(rest):
        order = np.empty(int(count.sum()), np.int64)
        where, _ = ragged(at[~awkward], count[~awkward])
        order[where] = index
        order[at[awkward]] = tail + len(top) + np.arange(len(rest))
    ids, bounds = laid(flat, lengths, order)
    bounds = bounds[np.concatenate([at, [len(order)]])]
    if end_id is None:
        return ids, bounds
    out = np.empty(len(ids) + n, np.uint32)
    ends = bounds[1:] + np.arange(n)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = ids
    out[ends] = end_id
    return out, bounds + np.arange(n + 1)
