"""Words of many texts at once, as indices into the distinct words of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


#: What stands between words, and the bytes that never do: ASCII letters and digits, and those of other characters.
BETWEEN = "[^\\pL\\pM\\pN]+"
WITHIN = np.array([c > 127 or chr(c).isalnum() for c in range(256)])


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(index of each word, bounds of the texts, distinct words): lower-case A-Z, cut at ASCII white space. Null counts as empty."""
    return indexed(pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))), len(texts))


def letter_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As :func:`ascii_words`, but in lower case throughout, cut at whatever is neither a letter nor a digit."""
    texts = pc.fill_null(texts, "")
    found = _cut_by_bytes(texts)
    if found is None:
        return indexed(pc.split_pattern_regex(pc.utf8_lower(texts), BETWEEN), len(texts))
    words, bounds = found
    words = words.dictionary_encode()
    lower = pc.utf8_lower(words.dictionary).dictionary_encode()
    return lower.indices.to_numpy().astype(np.int64)[words.indices.to_numpy()], bounds, lower.dictionary


def _cut_by_bytes(texts: pa.Array) -> tuple[pa.Array, np.ndarray] | None:
    """(words of :func:`letter_words` before their lower case, bounds of the texts), by a table of the ASCII bytes; None where another character stands between words."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[-1] == ends[0]:
        return None
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    others = "".join(sorted(set(data[data > 127].tobytes().decode())))
    if pc.match_substring_regex(pa.scalar(others), BETWEEN).as_py():
        return None
    inside = WITHIN[data]
    first, last = inside.copy(), inside.copy()  # a word's first and last byte
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words.cast(pa.string()), np.searchsorted(starts, ends)


def indexed(parts: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0), dtype=bool)
    kept = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=kept[1:])
    words = flat.filter(pa.array(full)).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), kept[offsets - offsets[0]] if n else np.zeros(1, np.int64), words.dictionary


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads its input over all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Hash of values[i + o] for all offsets o, in order, at each i from which the last offset is in reach."""
    n = len(values) - max(offsets)
    out = np.zeros(max(n, 0), np.uint64)
    if n <= 0:
        return out
    for o in offsets:
        out = (out + values[o : o + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)
