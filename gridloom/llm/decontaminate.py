"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Documents and items are lower-cased words (`[^\\x20\\x09-\\x0D]+`); features are K-word shingles. An item of fewer words is one
shingle of all its words, and is compared with windows of as many words. A shingle weighs its inverse document frequency over all
items. For each item of n shingles, every window of n shingles of a document is fingerprinted: 64 bits, each the sign of a vote of the
window's shingles by the square root of their weights: so the vectors' cosine, on which the Hamming distance depends, is at least
2J / (1 + J) at weighted Jaccard similarity J where no shingle repeats (about 10 of 64 bits at 0.8).

Fingerprints are split into BLOCKS blocks of 16 bits. Two within RADIUS differ by at most RADIUS // BLOCKS = 4 bits in one of them, so
each window's blocks look up the items whose block is that near: every fingerprint within the radius is found, and of random ones one in
26 passes a block. Candidates within RADIUS are verified by the exact weighted Jaccard similarity of the multisets' supports: kept if
at least THRESHOLD.

Windows that share no shingle with any item have similarity 0 with all of them; they are recognised by one lookup per shingle and
skipped before fingerprinting, which loses nothing.

Defined results: null or empty texts hit nothing; items without words never match; a document with fewer words than an item is one
window of all its shingles; repeated documents each give their rows, repeated item_ids count as separate texts and the best similarity
is kept; a null doc_id is kept as null. Ties in similarity go to the first window. Whole texts are read, whatever their length. Extra
columns are ignored by find_hits and carried by without_hits; an empty table of documents or items gives no hits.

Scale: documents are never shuffled; items are sent to the tasks in blocks of at most ITEM_BLOCK rows, each block with a pass over
the documents. Shingles are counted over all items in one job before, so results don't depend on the blocks. A shingle of one item
weighs as much as one of none, so each pass gets the weights only of those that two items or more hold: 16 bytes for each of these,
which is all that grows with the number of items in what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shingle_sets, shingles, word_slices

K = 5
THRESHOLD = 0.8
#: Fingerprints within RADIUS are verified; BLOCKS blocks of BITS / BLOCKS bits each.
RADIUS, BLOCKS = 19, 4
ITEM_BLOCK = 20_000
BITS = 64


def votes(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of mixed shingle hashes."""
    bits = np.unpackbits(mix(h ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float64) * 2 - 1


def fingerprint(total: np.ndarray) -> np.ndarray:
    """The signs of the votes of each row, as 64 bits."""
    return np.packbits(total > 1e-9, axis=1).view(">u8").ravel().astype(np.uint64)


def block_codes(prints: np.ndarray, block: int) -> np.ndarray:
    """The bits of one block of each fingerprint."""
    width = BITS // BLOCKS
    return (prints >> np.uint64(block * width)) & np.uint64((1 << width) - 1)


class Items:
    """A block of benchmark items as shingle sets, weights, fingerprints and block tables.

    counted: the shingles that several items of the whole benchmark hold, ascending, how many hold each, and the number of items.
    Items of k words and more have k-word shingles (short = 0); shorter ones are kept apart by their number of words.
    """

    def __init__(self, ids: list, texts: list, counted: tuple[np.ndarray, np.ndarray, int], radius: int = RADIUS, k: int = K):
        import pyarrow as pa

        self.k, self.radius, self.ids, self.sets, self.short = k, radius, [], [], []
        for row, n, h, offsets, _, _ in word_slices(pa.array(texts, pa.string())):
            values, rows = shingles(h, offsets, k)
            for r in range(n):
                mine, words = values[rows == r] if n > 1 else values, int(offsets[r + 1] - offsets[r])
                if len(mine):
                    self.ids.append(ids[row + r])
                    self.sets.append(mine)
                    self.short.append(words if words < k else 0)
        # a sequence stays in order: fingerprints vote over all its shingles, similarity compares supports
        self.known = flat = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.common, df, n_items = counted
        self.weight = np.log1p(n_items / df)
        self.other = float(np.log1p(n_items))  # of shingles that one item has, or none
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.prints = np.array([fingerprint((votes(x) * np.sqrt(self.weigh(x))[:, None]).sum(axis=0)[None])[0] for x in self.sets], np.uint64)
        self.support = [np.unique(x) for x in self.sets]
        # the sizes of the items that hold each known shingle: only windows of those sizes can be like such an item
        pairs = sorted({(int(h), int(n)) for x, n in zip(self.support, self.sizes, strict=True) for h in x})
        self.size_of, self.size_at = np.array([n for _, n in pairs], np.int64), np.searchsorted(np.array([h for h, _ in pairs], np.uint64), np.append(flat, np.uint64(0)))
        self.size_at[-1:] = len(pairs)
        self.of_size = {int(n): np.flatnonzero(self.sizes == n) for n in np.unique(self.sizes)}
        self.near: dict[tuple[int, int, int], np.ndarray] = {}

    def lookup(self, size: int, block: int, code: int) -> np.ndarray:
        """Items of a size whose block is within radius // BLOCKS bits of code; remembered, as there are 2^16 codes at most."""
        key = (size, block, code)
        if key not in self.near:
            if len(self.near) > 200_000:
                self.near.clear()
            items = self.of_size[size]
            self.near[key] = items[np.bitwise_count(block_codes(self.prints[items], block) ^ np.uint64(code)) <= self.radius // BLOCKS]
        return self.near[key]

    def weigh(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.common, h), max(0, len(self.common) - 1))
        return np.where(self.common[at] == h, self.weight[at], self.other) if len(self.common) else np.full(len(h), self.other)

    def holds(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(h), bool)
        return self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h

    def similarity(self, item: int, window: np.ndarray) -> float:
        mine, other = self.support[item], np.unique(window)
        both = np.intersect1d(mine, other, assume_unique=True)
        common = self.weigh(both).sum()
        return float(common / (self.weigh(mine).sum() + self.weigh(other).sum() - common)) if len(mine) else 0.0

    def search(self, seq: np.ndarray, threshold: float) -> dict[int, tuple[float, int]]:
        """Best (similarity, first shingle) of each item that a window of the sequence reaches."""
        best: dict[int, tuple[float, int]] = {}
        hit = np.flatnonzero(self.holds(seq))
        if not len(hit):
            return best
        known = np.searchsorted(self.known, seq[hit])
        counts = self.size_at[known + 1] - self.size_at[known]
        at = np.repeat(hit, counts)
        sizes = self.size_of[np.repeat(self.size_at[known] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
        for size in np.unique(sizes).tolist():
            n, mine = min(size, len(seq)), at[sizes == size]
            for a, b in _runs(np.maximum(mine - n + 1, 0), np.minimum(mine, len(seq) - n)):  # runs of windows that hold such a shingle
                part = seq[a : b + n]
                total = np.zeros((len(part) + 1, BITS))
                np.cumsum(votes(part) * np.sqrt(self.weigh(part))[:, None], axis=0, out=total[1:])
                self._verify(fingerprint(total[n : n + b - a + 1] - total[: b - a + 1]), part, n, a, size, threshold, best)
        return best

    def _verify(self, prints, part, n, first, size, threshold, best) -> None:
        near: dict[int, set[int]] = {}
        for block in range(BLOCKS):
            for w, code in enumerate(block_codes(prints, block).tolist()):
                for item in self.lookup(size, block, code).tolist():
                    near.setdefault(item, set()).add(w)
        for item, windows in near.items():
            at = np.sort(np.fromiter(windows, np.int64, len(windows)))
            at = at[np.bitwise_count(prints[at] ^ self.prints[item]) <= self.radius]
            for w in at.tolist():
                s = self.similarity(item, part[w : w + n])
                if s >= threshold and (item not in best or (s, -(first + w)) > (best[item][0], -best[item][1])):
                    best[item] = (s, first + w)

    def sequences(self, h: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(shingles, their rows) of documents' words: of k words, and of as many as short items have."""
        yield shingles(h, offsets, self.k)
        for words in sorted(set(self.short) - {0}):
            values, rows = shingles(h, offsets, words)
            whole = np.diff(offsets)[rows] >= words
            yield values[whole], rows[whole]

    def hits(self, column, threshold: float) -> Iterator[tuple[int, int, float, int]]:
        """(row, item, similarity, first word) of a column of texts."""
        for row, _, h, offsets, _, _ in word_slices(column):
            for seq, rows in self.sequences(h, offsets):
                for r in np.unique(rows[self.holds(seq)]).tolist():
                    for item, (s, at) in self.search(seq[rows == r], threshold).items():
                        yield row + r, item, s, at


def _runs(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        elif b >= a:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(shared, threshold: float):
    def run(batches):
        import pyarrow as pa

        items: Items = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            found = [(ids[row].as_py(), items.ids[item], s, at) for row, item, s, at in items.hits(batch.column("text"), threshold)]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "first_word"])

    return run


def _keep(shared, threshold: float):
    """The rows whose text no item hits."""

    def run(batches):
        import pyarrow as pa

        items: Items = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, *_ in items.hits(batch.column("_text"), threshold)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _count(k: int):
    """Rows (shingle, items) of each batch of items; those of a null shingle count the items that have words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, _, values, offsets in shingle_sets(batch.column("text"), k):
                found, items = np.unique(values, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([*found.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(items, np.count_nonzero(np.diff(offsets))))], names=["shingle", "items"])

    return run


def count_shingles(benchmark: DataFrame, k: int = K) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles that several items hold, ascending, how many hold each, and the number of items that have words."""
    rows = benchmark.select("text").mapInArrow(_count(k), "shingle long, items long").groupBy("shingle").agg(F.sum("items").alias("items"))
    held = rows.where("shingle IS NULL OR items > 1").toArrow()
    shingle, items = held.column("shingle"), held.column("items").to_numpy()
    none = shingle.is_null().to_numpy()
    values = shingle.drop_null().to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], items[~none][order], int(items[none].sum())


HITS = "doc_id long, item_id long, similarity double, first_word long"


def _item_blocks(benchmark: DataFrame, radius: int, k: int) -> Iterator[Items]:
    """The items in blocks of at most ITEM_BLOCK; the driver holds one of these and one partition of items at a time."""
    counted = count_shingles(benchmark, k)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator()
    while block := list(islice(rows, ITEM_BLOCK)):
        yield Items([r["item_id"] for r in block], [r["text"] for r in block], counted, radius, k)


def find_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, k: int = K) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): each document's best window for each item that it reaches."""
    spark = docs.sparkSession
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], HITS)
    for items in _item_blocks(benchmark, radius, k):  # each block has its own pass over the documents
        found = found.union(ready.mapInArrow(_scan(spark.sparkContext.broadcast(items), threshold), HITS))
    best = F.max(F.struct("similarity", F.negative("first_word").alias("at"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), F.negative("best.at").alias("first_word"))


def without_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, k: int = K) -> DataFrame:
    """docs without the rows that hold a window like an item, told row by row; columns, also those of odd names, stay as they are."""
    spark = docs.sparkSession
    numbered = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns)]).alias("_row"), F.col("text").alias("_text"))
    kept = numbered
    for items in _item_blocks(benchmark, radius, k):
        kept = kept.mapInArrow(_keep(spark.sparkContext.broadcast(items), threshold), numbered.schema)
    return kept.select(*[F.col(f"_row.c{n}").alias(c) for n, c in enumerate(docs.columns)])
