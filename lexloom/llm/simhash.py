"""Near-duplicate detection by SimHash and meet-in-the-middle ball hashing.

Fingerprints of 64 bits that differ in three bits or fewer are linked. Two such fingerprints have a variant in common
that is half the radius from either: every fingerprint emits the variants within half of three, rounded up for those with
an even number of ones (two flips) and down for the others (one flip). By parity this is enough:

* an odd difference (1, 3) joins an even and an odd fingerprint; the odd one flips one bit, the even one none or two;
* a difference of two joins fingerprints of one parity, and each flips one bit.

The variants that meet thus tell the distance: all that one flip reaches from odd fingerprints, and the variant itself if
it is a fingerprint, are within the radius of one another and of the fingerprints two flips away; so the colliding pairs
need only a star, to one of them, and not all pairs of a group of copies. Fingerprints two flips away on both sides are not
linked by that variant; if they differ in two bits, they meet one flip away.

What is shuffled is a variant's leading bits: a fingerprint goes once to each value that its variants have there, with the
flips that are left, and the partition expands the rest of the variant. So 137 or 17 rows (for 16 leading bits) stand for 2,081 or 65 variants.
How many bits lead follows from the number of distinct fingerprints; where more rows share them than are expanded together, the partition parts these by further bits itself.
Each colliding pair is verified by its distance.

Defined results: a null text counts as empty and has the fingerprint zero; documents with one or two words have one
shingle; repeated rows and equal texts have one fingerprint and one component; a null id is never a component's id unless
it has no other; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import ROW, components, keyed, trimmed, write_scratch
from lexloom.llm.tokens import by_bytes, ragged
from lexloom.llm.words import ascii_words, hashes, mix, rolling

#: Seeds and bits of the fingerprints of words that find candidates for :func:`near_links`.
SEEDS, WORD_BITS = (1, 2, 3), 48
#: Part lengths are powers of ``STEP``, two of them a document: the longest within ``HALF`` of a document of ``LONG`` words or more, and within the whole of a shorter one
#: (up to ``SHORT`` words, so that documents on either side of the bound have lengths in common).
STEP, HALF, LONG, SHORT = 1.25, 0.55, 24, 40
#: Bits of the sketches that spare most comparisons of shingles, and how many may differ: the mean at a similarity of 0.8 is 25.6 with a deviation of 4.8.
SKETCH, SKETCH_RADIUS = 256, 52
#: Variants or pairs that are compared at a time, rows whose variants are expanded together, and rows that are sent to one prefix.
CHUNK, ROWS, SHARED = 1 << 19, 1 << 14, 1 << 20
#: Documents, and shingles of documents, of a group that meet in one place; of larger groups each pair of blocks does.
BLOCK, BLOCK_SHINGLES = 1 << 11, 1 << 20
#: Text bytes whose words are worked on at a time, and fingerprints that are sent to their prefixes at a time.
TEXT_BYTES, SENT = 2 << 20, 1 << 12


def shingle_fingerprint(words: list[bytes], size: int, seed: int) -> int:
    """Majority of the bits of the XXH64 of all shingles; zero for no words."""
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(text, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            found = [shingle_fingerprint(text.lower().split(), size, seed) for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, fp long")


def flips(bits: range, n: int) -> np.ndarray:
    """All masks with exactly ``n`` (0 to 2) of the given bits."""
    one = [1 << b for b in bits]
    masks = [[0], one, [x | y for i, x in enumerate(one) for y in one[:i]]][n]
    return np.array(masks, np.uint64)


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def prefixes(fp: np.ndarray, bits: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, leading bits): where each fingerprint's variants are to meet."""
    high = fp >> np.uint64(width - bits)
    even = np.flatnonzero(ones(fp) & 1 == 0)
    out = [(np.arange(len(fp)), high)]
    for n, who in ((1, np.arange(len(fp))), (2, even)):
        masks = flips(range(bits), n)
        out.append((np.repeat(who, len(masks)), (high[who, None] ^ masks).ravel()))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def variants(prefix: np.ndarray, fp: np.ndarray, n: int, bits: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(index, variant) for the variants with ``n`` flips whose leading bits are ``prefix``."""
    rest = np.uint64(width - bits)
    done = ones(prefix ^ (fp >> rest))
    low = np.uint64((1 << width - bits) - 1)
    out = []
    for f in range(n + 1):
        who = np.flatnonzero(done == f)
        masks = flips(range(width - bits), n - f)
        out.append((np.repeat(who, len(masks)), ((prefix[who, None] << rest) | (fp[who, None] & low) ^ masks).ravel()))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def star(fp: np.ndarray, who: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted variants with the fingerprint that is each variant's hub, and edges from the others that share it."""
    order = np.argsort(variant, kind="stable")
    variant, own = variant[order], fp[who[order]]
    new = np.r_[True, variant[1:] != variant[:-1]] if len(variant) else np.zeros(0, bool)
    hub = own[np.flatnonzero(new)]
    group = np.cumsum(new) - 1
    return variant[new], hub, own, hub[group] if len(group) else own


def meet(prefix: np.ndarray, fp: np.ndarray, bits: int, width: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges between fingerprints whose variants with these leading bits collide."""
    odd = ones(fp) & 1 == 1
    if not len(fp):
        return
    # variants of even parity: one flip of an odd fingerprint, none or two of an even one
    a, va = variants(prefix[odd], fp[odd], 1, bits, width)
    b, vb = variants(prefix[~odd], fp[~odd], 0, bits, width)
    index, hub, own, to = star(np.concatenate([fp[odd], fp[~odd]]), np.concatenate([a, b + odd.sum()]), np.concatenate([va, vb]))
    yield own, to
    even_p, even = prefix[~odd], fp[~odd]
    # a filter on 20 bits of the hubs' variants spares the search for most of the two-flip variants
    spread = np.uint64(0x9E3779B97F4A7C15)
    drop = np.uint64(64 - max(20, int(len(index)).bit_length() + 4))
    seen = np.zeros(1 << 64 - int(drop), bool)
    seen[index * spread >> drop] = True
    step = max(1, CHUNK // 1200)
    for at in range(0, len(even) if len(index) else 0, step):
        who, variant = variants(even_p[at : at + step], even[at : at + step], 2, bits, width)
        near = np.flatnonzero(seen[variant * spread >> drop])
        who, variant = who[near], variant[near]
        found = np.minimum(np.searchsorted(index, variant), len(index) - 1)
        hit = index[found] == variant
        yield even[at : at + step][who[hit]], hub[found[hit]]
    # variants of odd parity: one flip of an even fingerprint
    who, variant = variants(even_p, even, 1, bits, width)
    _, _, own, to = star(even, who, variant)
    yield own, to


def runs(prefix: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of a sorted array with about ``most`` rows that don't part equal values."""
    at = 0
    while at < len(prefix):
        to = len(prefix) if at + most >= len(prefix) else int(np.searchsorted(prefix, prefix[at + most], side="left"))
        if to <= at:
            to = int(np.searchsorted(prefix, prefix[at], side="right"))
        yield at, to
        at = to


def prefix_bits(n: int) -> int:
    """Leading bits of a variant by which it is shuffled: so many that ``SHARED`` rows or fewer have them in common, for ``n`` fingerprints."""
    bits = 8
    while n * (2 + 2 * bits + bits * (bits - 1) // 2) / 2 > SHARED << bits and bits < 28:
        bits += 1
    return bits


def narrowed(prefix: int, fp: np.ndarray, bits: int, width: int = 64) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bits, prefix, fingerprints): where variants with these leading bits meet by more of them, so many that ``ROWS`` rows or fewer share them."""
    if len(fp) <= ROWS or bits >= 28:
        yield bits, prefix, fp
        return
    most = 2 - (ones(fp) & 1)
    for longer in (2 * prefix, 2 * prefix + 1):
        flipped = ones(np.uint64(longer) ^ (fp >> np.uint64(width - bits - 1)))
        yield from narrowed(longer, fp[flipped <= most], bits + 1, width)


def links(fps: DataFrame, bits: int | None = None, radius: int = 3, width: int = 64) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp, each once): what they connect is what all pairs within the radius connect. A task gives a fingerprint one edge, to the least that it
    is connected with there, so a dense group gives no more rows for being dense."""
    if radius != 3:
        raise ValueError("the parity argument is made for a radius of three")
    bits = bits or prefix_bits(fps.count())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, SENT) for i in range(0, whole.num_rows, SENT)):
                fp = batch.column("fp").to_numpy().view(np.uint64)
                who, prefix = prefixes(fp, bits, width)
                yield pa.RecordBatch.from_arrays([pa.array(prefix.astype(np.int32)), pa.array(fp[who].view(np.int64))], ["prefix", "fp"])

    def met(prefix: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # by fingerprint within a prefix: variants that meet anywhere then agree on their hub where they can
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, prefix))
        prefix, fp = prefix[order].astype(np.uint64), fp[order]
        for i, j in runs(prefix, ROWS):
            if prefix[i] == prefix[j - 1]:
                found = (x for b, p, f in narrowed(int(prefix[i]), fp[i:j], bits, width) for x in meet(np.full(len(f), p, np.uint64), f, b, width))
            else:
                found = meet(prefix[i:j], fp[i:j], bits, width)
            for a, b in found:
                keep = (a != b) & (ones(a ^ b) <= radius)
                if keep.any():
                    yield joined(a[keep].view(np.int64), b[keep].view(np.int64))

    def whole_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in (x for x in batches if x.num_rows):
            held.append((batch.column("prefix").to_numpy(), batch.column("fp").to_numpy()))
            rows += batch.num_rows
            # rows come by prefix; the last one may go on in the next batch
            if rows >= ROWS and held[0][0][0] != held[-1][0][-1]:
                prefix, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.searchsorted(prefix, prefix[-1]))
                yield prefix[:whole], fp[:whole]
                held, rows = [(prefix[whole:], fp[whole:])], len(prefix) - whole
        if held:
            prefix, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            yield prefix, fp

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, n = np.zeros((2, 0), np.int64), [], 0
        for edges in (x for part in whole_prefixes(batches) for x in met(*part)):
            waiting.append(np.stack(edges))
            n += len(edges[0])
            if n > max(CHUNK, kept.shape[1]):
                kept, waiting, n = np.stack(joined(*np.concatenate([kept, *waiting], axis=1))), [], 0
        kept = np.stack(joined(*np.concatenate([kept, *waiting], axis=1)))
        for at in range(0, kept.shape[1], CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + CHUNK]) for x in kept], ["a", "b"])

    rows = fps.select("fp").mapInArrow(trimmed(emit), "prefix int, fp long")
    return rows.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(trimmed(match), "a long, b long").distinct()


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id that links reach)."""
    prints = write_scratch(fingerprints(docs, id_col, text_col), "fingerprints")
    least = write_scratch(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    found = write_scratch(links(least.select("fp")), "links")
    roots = write_scratch(components(found), "roots").withColumnRenamed("node", "fp")
    joined = least.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    # the distinct fingerprints of one component may be many: a join, which can be split, and not a window
    named = joined.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def part_lengths(n: int) -> list[int]:
    """The lengths of the parts, from either end, of a text of ``n`` words that get fingerprints. Of two texts, the longer with ``STEP`` times the
    other's words at most, there is a length that both have."""
    out = set()
    for share, fits in ((HALF, n >= LONG), (1.0, n < SHORT)):
        top = math.floor(math.log(share * n, STEP) + 1e-9) if fits and share * n >= 4 else 0
        out |= {int(STEP**k) for k in (top, top - 1) if STEP**k >= 4}
    return sorted(out)


def segment_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of the values have each of the first ``WORD_BITS`` bits, between each cut (ascending, the first is 0) and the next one or the end."""
    out = np.zeros((len(cuts), WORD_BITS), np.int64)
    for at in range(0, len(values), 1 << 16):
        first, last = int(np.searchsorted(cuts, at, side="right")) - 1, int(np.searchsorted(cuts, at + (1 << 16), side="left"))
        bits = np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)[:, : WORD_BITS // 8], axis=1, bitorder="little")
        out[first:last] += np.add.reduceat(bits, np.maximum(cuts[first:last] - at, 0), axis=0, dtype=np.int64)
    return out


def word_fingerprints(docs: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    """(doc, fp): for each seed a fingerprint of the text's distinct words weighed by the root of their counts, and one each, of pairs of words, for parts at its beginning and its
    end: edits that are spread over a text change few words of the whole, and those in one place leave one of its ends alone."""

    def whole_prints(words: pa.Array, text: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int) -> Iterator[np.ndarray]:
        ends = np.searchsorted(text, np.arange(n + 1)).tolist()
        for seed in seeds:
            bits = np.unpackbits(hashes(words, seed).view(np.uint8).reshape(-1, 8)[:, : WORD_BITS // 8], axis=1, bitorder="little")
            found = np.zeros((n, 64), bool)
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                sums = np.zeros(WORD_BITS, np.float32)
                for at in range(a, b, 1 << 16):
                    own = slice(at, min(b, at + (1 << 16)))
                    sums += weight[own] @ bits[word[own]]
                found[i, :WORD_BITS] = 2 * sums > weight[a:b].sum()
            yield np.packbits(found, axis=1, bitorder="little").view(np.int64).ravel()

    def part_prints(pairs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(bounds).tolist()
        lengths = {n: part_lengths(n) for n in set(sizes)}
        ends = [(i, a, b - 1) for i, n in enumerate(sizes) for x in lengths[n] for a, b in ((0, x), (n - x, n))]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, begin, end = (np.array(x, np.int64) for x in zip(*ends, strict=True))
        begin, end = bounds[who] + begin, bounds[who] + end
        cuts = np.unique(np.concatenate([[0], begin, end]))
        cuts = cuts[cuts < len(pairs)]
        sums = np.concatenate([np.zeros((1, WORD_BITS), np.int64), np.cumsum(segment_sums(pairs, cuts), axis=0)])
        found = np.zeros((len(who), 64), bool)
        found[:, :WORD_BITS] = 2 * (sums[np.searchsorted(cuts, end)] - sums[np.searchsorted(cuts, begin)]) > (end - begin)[:, None]
        return who, np.packbits(found, axis=1, bitorder="little").view(np.int64).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, "text", TEXT_BYTES)):
            n = batch.num_rows
            index, bounds, words = ascii_words(batch.column("text"))
            text = np.repeat(np.arange(n), np.diff(bounds))
            pairs, counts = np.unique(text * max(len(words), 1) + index, return_counts=True)
            text, word = pairs // max(len(words), 1), pairs % max(len(words), 1)
            prints = [*whole_prints(words, text, word, np.sqrt(counts).astype(np.float32), n)]
            who, parts = part_prints(rolling(hashes(words)[index], [0, 1]), bounds)
            doc = pa.array(np.concatenate([np.tile(np.arange(n), len(prints)), who]))
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(doc), pa.array(np.concatenate([*prints, parts]))], ["doc", "fp"])

    return docs.mapInArrow(trimmed(run), "doc long, fp long")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc and its distinct shingles as sorted 32-bit hashes; a shorter text is one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, "text", TEXT_BYTES)):
            index, bounds, words = ascii_words(batch.column("text"))
            values, out = hashes(words)[index], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                found = rolling(values[a:b], list(range(min(size, b - a)))) if b > a else np.zeros(1, np.uint64)
                out.append(np.unique((found >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.binary())], ["doc", "shingles"])

    return docs.mapInArrow(trimmed(run), "doc long, shingles binary")


def sketches(sets: DataFrame) -> DataFrame:
    """doc, the number of its shingles, and s0 to s3: a bit each of ``SKETCH`` least hashes. Of two documents as many bits differ as half of what they don't share."""
    turns = np.random.default_rng(0).integers(0, 1 << 63, SKETCH, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, SKETCH), bool)
            sizes = []
            for i, x in enumerate(batch.column("shingles")):
                own = np.frombuffer(x.as_buffer(), np.uint32)
                sizes.append(len(own))
                for at in range(0, SKETCH, 16):
                    least = np.full(16, np.uint64(0xFFFFFFFFFFFFFFFF))
                    for part in range(0, len(own), 1 << 16):
                        least = np.minimum(least, mix(own[part : part + (1 << 16), None].astype(np.uint64) ^ turns[at : at + 16]).min(axis=0))
                    out[i, at : at + 16] = least & np.uint64(1)
            longs = np.packbits(out, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), *(pa.array(longs[:, i].copy()) for i in range(4))], ["doc", "size", "s0", "s1", "s2", "s3"])

    return sets.mapInArrow(trimmed(run), "doc long, size long, s0 long, s1 long, s2 long, s3 long")


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node of the edges that isn't the least of those it is connected with; that one is its root."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def cells(members: DataFrame, key: str) -> DataFrame:
    """The members (``key``, doc, size, s0 to s3) of each group of two or more, where pairs of them meet: once, in the cell (low, high) 0, 0, or, if they are many or
    large, in a cell for each pair of blocks of the group."""
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.ceil(F.col("total") / F.lit(BLOCK_SHINGLES)))
    rows = members.join(sizes.select(key, blocks.alias("blocks")), key).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select(F.col(key).alias("key"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc", "size", "s0", "s1", "s2", "s3")


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell; they come in order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        at = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")], axis=1)
        starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            if i == j:
                continue
            if held and at[i].tolist() != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = at[i].tolist()
    if held:
        yield pa.Table.from_batches(held)


def close(cell: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of a cell whose sizes and sketches don't rule out this similarity, those with one first position together."""
    size, block = cell.column("size").to_numpy(), cell.column("block").to_numpy()
    sketch = np.stack([cell.column(f"s{i}").to_numpy().view(np.uint64) for i in range(SKETCH // 64)], axis=1)
    whole, step = cell.column("low")[0] == cell.column("high")[0], max(1, CHUNK // len(size))
    for at in range(0, len(size), step):
        to, rest = min(len(size), at + step), slice(at, None)
        differ = sum(ones(sketch[at:to, None, i] ^ sketch[None, rest, i]).astype(np.int16) for i in range(SKETCH // 64))
        near = (differ <= SKETCH_RADIUS) & (np.minimum(size[at:to, None], size[None, rest]) >= similarity * np.maximum(size[at:to, None], size[None, rest]))
        a, b = np.nonzero(near)
        keep = (a < b) if whole else (a < b) & (block[at:][a] != block[at:][b])
        yield a[keep] + at, b[keep] + at


def alike(docs: DataFrame, groups: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node, root): components of the documents that have this Jaccard similarity of shingles at least, among those of one group in ``groups`` (group, doc).

    All pairs of a group are held against one another, by their lengths and sketches. What these leave connected, in any group, is a family: there all pairs that they leave
    are held against one another by their shingles, but for those that are connected already. So a document's shingles are sent once, to its family,
    and a group or a family gives no more rows than it has members, however many pairs are alike."""
    sizes = groups.groupBy("group").count().where("count > 1").select("group")
    groups = write_scratch(groups.join(sizes, "group"), "groups")
    sets = write_scratch(shingle_sets(docs.join(groups.select("doc").distinct(), "doc", "left_semi"), size), "shingles")
    own = write_scratch(sketches(sets), "sketches")

    def akin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in by_cell(batches):
            doc, kept = cell.column("doc").to_numpy(), [np.zeros((2, 0), np.int64)]
            for a, b in close(cell, similarity):
                kept.append(np.stack(joined(doc[a], doc[b])))
            a, b = joined(*np.concatenate(kept, axis=1))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in by_cell(batches):
            doc, length = cell.column("doc").to_numpy(), cell.column("size").to_numpy()
            words = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in cell.column("shingles")])
            kinds, words = np.unique(words, return_inverse=True)
            starts, root = np.cumsum(length) - length, np.arange(len(doc))
            has = np.zeros(len(kinds), bool)
            for first, second in close(cell, similarity):
                begins = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else []
                for i, others in zip(first[begins].tolist(), np.split(second, begins[1:]), strict=True) if len(first) else ():
                    mine = words[starts[i] : starts[i] + length[i]]
                    has[mine] = True
                    others = others[root[others] != root[i]]
                    for part in np.split(others, np.flatnonzero(np.diff(np.cumsum(length[others]) // CHUNK)) + 1):
                        if len(part):
                            took, bounds = ragged(starts[part], length[part])
                            both = np.add.reduceat(has[words[took]], bounds[:-1], dtype=np.int64)
                            roots = np.unique(root[np.r_[i, part[both >= similarity * (length[i] + length[part] - both)]]])
                            if len(roots) > 1:
                                root[np.isin(root, roots)] = roots[0]
                    has[mine] = False
            other = np.flatnonzero(root != np.arange(len(doc)))
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array(doc[other]), pa.array(doc[root[other]])], ["a", "b"])

    dealt = lambda rows: rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    families = write_scratch(components(dealt(cells(groups.join(own, "doc"), "group")).mapInArrow(trimmed(akin), "a long, b long")), "families")
    members = cells(families.select(F.col("node").alias("doc"), F.col("root").alias("family")).join(own, "doc"), "family")
    return write_scratch(components(dealt(members.join(sets, "doc")).mapInArrow(trimmed(verified), "a long, b long")), "alike")


def near_links(docs: DataFrame, seeds: tuple[int, ...] = SEEDS, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, root): components of documents (doc, text) whose shingles of ``size`` words are alike and of which some fingerprints of words, of the whole or of a part, are
    within the radius, or connected by others."""
    prints = write_scratch(word_fingerprints(docs, seeds).distinct(), "word-fingerprints")
    distinct = write_scratch(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "distinct-word-fingerprints")
    roots = write_scratch(components(write_scratch(links(distinct.select("fp"), width=WORD_BITS), "word-links")), "word-roots").toDF("fp", "root")
    named = distinct.join(roots, "fp", "left").where("root IS NOT NULL OR n > 1").select("fp", F.coalesce("root", "fp").alias("group"))
    return alike(docs, prints.join(named, "fp").select("group", "doc").distinct(), size, similarity)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id, with all its columns; where ids are missing or
    repeated, the first row stays instead. Linked are the documents that :func:`near_links` finds: candidates come from ball hashing over fingerprints of
    words, since fingerprints of shingles differ in more than three bits for three pairs of four with a similarity of 0.8, and all candidates are verified."""
    docs, key = keyed(docs, id_col)
    narrow = docs.select(F.col(key).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    gone = write_scratch(near_links(narrow, similarity=similarity).where("node <> root").select(F.col("node").alias("__gone")), "gone")
    return docs.join(gone.hint("merge"), docs[key] == gone["__gone"], "left_anti").drop(ROW)


def op2_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components."""
    found = clusters(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
