"""N-gram Jaccard self-join by T-occurrence search with DivideSkip.

Documents are sets of k-word shingles (hashed to 64 bits); two link when den * |both| >= num * |either|. A partner of x holds at
least T = ceil(num |x| / den) of x's shingles. DivideSkip orders x's inverted lists by length, sets the L longest aside (L from T and
the longest list's length), merges the rest, of which a candidate must hold T - L, and decides candidates by binary probes for the
long lists. Short lists are merged by a heap that skips (MergeSkip) up to HEAP_ENTRIES entries, and by counting (ScanCount) beyond.

Spread over a cluster, this runs in five steps, none of which can lose a link:
1. Equal sets collapse to one class. Sets are dealt to size classes, and a class of sets is cut into segments by hash; sets that link
   differ in at most H elements, so of H + 1 + c segments at least 1 + c are equal. A set has a side for each size class from its own
   down to that of the least partner. Sets of which fewer segments occur in any other are done. (c is H / 4, so passages that many
   documents share don't keep a document alive.)
2. The inverted lists of the remaining classes are measured (document frequency, pre-aggregated). A class's prefix lists are its
   rarest |x| - T + 1: linked classes meet in one of them.
3. Stars: of the classes at the head of the lists it is in, each class is verified against the one it meets most often, in rows
   dealt by that class and a part. Large groups of near copies link up here, in work linear in their size.
4. Lists whose members are all connected by now lead to nothing new. Classes that meet in one of the others fall into one cluster
   (connected components); a cluster's sets meet once, in parts for large clusters (every pair of parts meets, up to SPREAD_PARTS of
   them, and beyond that as many as BLOCK_SHINGLES asks for), and the T-occurrence search runs there. Pairs that are already connected aren't verified again; no cap on lists or
   candidates.
5. Components of the links give each document the smallest doc_id it reaches.

Defined results: null and empty texts have no set and link with nothing; shorter texts than k words are one shingle; extra columns
are ignored; rows that repeat a doc_id each get the row of their own text; a null doc_id is never the smallest of others, but its text
links as any other; an empty table gives no rows. Texts are read whole. Equality of 64-bit hashes stands for equality of shingles and
segments; a class is told by two digests of 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK, Scratch, components, fresh, mix, shingle_sets, small_or_shuffled

SLACK, SPARE = 2, 4
BLOCK_SHINGLES = 2_000_000
#: Clusters from SPREAD_SHINGLES on are dealt in up to SPREAD_PARTS parts, so that many tasks share them.
SPREAD_SHINGLES, SPREAD_PARTS = 25_000, 16
#: Classes that a task verifies against one star.
STAR_ROWS = 500
#: The weight of a list's length in DivideSkip's choice of L, and the entries up to which lists are merged by heap.
MU, HEAP_ENTRIES = 0.0085, 2048


class Cuts:
    """Size classes and their numbers of segments for a threshold num / den."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("a threshold is over 0 and at most 1")
        self.num, self.den = num, den
        self.low = [max(1, -(-num // (den - num)))] if num < den else [1 << 40]  # smaller sets only link with equal ones
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 14 // 10))
        self.low_at = np.array(self.low)
        high = self.low_at[1:] - 1
        differ = high * (den - num) // num  # H
        self.spare = np.maximum(SLACK, differ // SPARE)
        self.segments = differ + 1 + self.spare
        own, least = self.of(np.concatenate([self.low_at, self.low_at - 1]))
        self.sides = int((own - least).max()) + 1  # the most that any size has

    def of(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own size class of each size (-1: none), and the least class that can hold a partner."""
        own = np.searchsorted(self.low_at, n, "right") - 1
        least = np.searchsorted(self.low_at, -(-n * self.num // self.den), "right") - 1
        return own, np.minimum(np.maximum(least, 0), np.maximum(own, 0))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.uint64)


def signatures(values: np.ndarray, offsets: np.ndarray, cuts: Cuts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row's own size class and for each smaller one down to its least partner's: (signatures, their rows, how many a row
    must share with others).

    Equal segments of rows in one size class get equal signatures. Empty segments have none, and lessen what must be shared; only
    rows with more empty segments than the spare ones show these too. Such a row must share just one: with a partner that shows no
    empty ones, what both leave empty isn't counted.
    """
    n = np.diff(offsets)
    own, lowest = cuts.of(n)
    mixed = mix(values + np.uint64(0x2545F4914F6CDD1D))
    sides = []
    for shift in range(cuts.sides):
        picked, needs = np.flatnonzero((own >= 0) & (own - shift >= lowest)), np.zeros(len(n), np.int32)
        if not len(picked):
            sides.append((np.zeros(0, np.uint64), np.zeros(0, np.int64), needs))
            continue
        cls = own[picked] - shift
        m, spare = cuts.segments[cls], cuts.spare[cls]
        at = np.repeat(offsets[picked], n[picked]) + _ramp(n[picked])
        row = np.repeat(np.arange(len(picked)), n[picked])
        segment = ((values[at] >> np.uint64(32)) * m[row].astype(np.uint64)) >> np.uint64(32)  # rises with the value
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])
        first = np.flatnonzero(new)
        salt = mix(cls[row[first]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + segment[first])
        out, rows = [mix(_sums(mixed[at], first) ^ salt)], [picked[row[first]]]
        empty = m - np.bincount(row[first], minlength=len(picked))
        needs[picked] = np.maximum(1, 1 + spare - empty)
        for r in np.flatnonzero(empty > spare):
            missing = np.setdiff1d(np.arange(m[r], dtype=np.uint64), segment[first][row[first] == r])
            out.append(mix(mix(np.uint64(int(cls[r]) * 0x9E3779B97F4A7C15 & MASK) + missing) ^ np.uint64(0x632BE59BD9B4E019)))
            rows.append(np.full(len(missing), picked[r]))
        sides.append((np.concatenate(out), np.concatenate(rows), needs))
    return sides


def _ramp(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def set_digests(values: np.ndarray, offsets: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit digest of each row's set; 0 for empty ones."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = mix(_sums(mix(values ^ np.uint64(0xA0761D6478BD642F + salt)), offsets[full]) + n[full].astype(np.uint64))
    return out


def _digest_pair(values: np.ndarray, offsets: np.ndarray):
    """Columns class and check: two digests of each row's set."""
    import pyarrow as pa

    return [pa.array(set_digests(values, offsets, salt).view(np.int64)) for salt in (0, 0x7F4A7C15)]


FEATURES = "n_shingles long, class long, check long, signatures array<long>, ends array<int>, needs array<int>"


def _features(k: int, num: int, den: int):
    """n_shingles, the digests, the signatures of all sides, where each side ends and what it must share; other columns as they are."""

    def run(batches):
        import pyarrow as pa

        cuts = Cuts(num, den)
        for batch in batches:
            keep = [c for c in batch.schema.names if c != "text"]
            for row, n, values, offsets in shingle_sets(batch.column("text"), k):
                sides = signatures(values, offsets, cuts)
                sig, rows = (np.concatenate([s[i] for s in sides]) for i in (0, 1))
                order = np.argsort(rows, kind="stable")  # a row's own side first
                ends = np.searchsorted(rows[order], np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig[order].view(np.int64)))
                counts = np.cumsum([np.bincount(s[1], minlength=n) for s in sides], axis=0)
                per_row = pa.array(np.arange(n + 1, dtype=np.int32) * len(sides))
                tables = [pa.ListArray.from_arrays(per_row, pa.array(np.ascontiguousarray(t.T).ravel().astype(np.int32))) for t in (counts, np.array([s[2] for s in sides]))]
                columns = [batch.column(c).slice(row, n) for c in keep] + [pa.array(np.diff(offsets)), *_digest_pair(values, offsets), lists, *tables]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(x.split(" ")[0] for x in FEATURES.split(", "))])

    return run


#: Bits of the filter of shared signatures (16 MB), whatever the data; what passes it by chance is removed by the join after it.
FILTER_BITS = 27


def _filter(shared: DataFrame):
    """A bitmap of the signatures' low bits, as a broadcast: words of it are combined in the cluster, not signatures gathered."""
    bit = F.col("signature").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))
    words = shared.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(one).alias("bits"))

    def pack(pdf):  # a page is 4096 words
        import pandas as pd

        page = np.zeros(4096, "<u4")
        page[pdf["word"].to_numpy() & 4095] = pdf["bits"].to_numpy()
        return pd.DataFrame({"page": [int(pdf["word"].iloc[0]) >> 12], "words": [page.tobytes()]})

    bitmap = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    pages = words.groupBy(F.shiftright("word", 12).alias("p")).applyInPandas(pack, "page long, words binary").toArrow()  # at most 16 MB
    for page, held in zip(pages.column("page").to_pylist(), pages.column("words"), strict=True):
        bitmap[page * 4096 : (page + 1) * 4096] = np.frombuffer(held.as_buffer(), "<u4")
    return shared.sparkSession.sparkContext.broadcast(bitmap)


def in_pieces(batches, rows: int = 1024) -> Iterator:
    """Batches of at most so many rows, none empty: what a task holds of their lists beside a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _likely(shared):
    """Rows (class, side, need, signature) of the signatures that the bitmap holds."""

    def run(batches):
        import pyarrow as pa

        bitmap = shared.value
        for batch in in_pieces(batches):
            lists = batch.column("signatures")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            sig = lists.flatten().to_numpy(zero_copy_only=False)
            low = sig & ((1 << FILTER_BITS) - 1)
            keep = np.flatnonzero((bitmap[low >> 5] >> (low & 31).astype(np.uint32)) & np.uint32(1))
            row = np.repeat(np.arange(len(n)), n)[keep]
            at = keep - (np.cumsum(n) - n)[row]
            ends, needs = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1) for c in ("ends", "needs"))
            side = np.zeros(len(row), np.int32)
            for j in range(ends.shape[1] - 1):
                side += at >= ends[row, j]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("class").to_numpy()[row]), pa.array(side), pa.array(needs[row, side]), pa.array(sig[keep])], names=["class", "side", "need", "signature"])

    return run


def _sets(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row, n, values, offsets in shingle_sets(batch.column("text"), k):
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), *_digest_pair(values, offsets), pa.array(np.diff(offsets)), lists], names=["doc_id", "class", "check", "n", "tokens"])

    return run


# ---------------------------------------------------------------- the search within a cluster
def merge_skip(lists: list[np.ndarray], need: int) -> Iterator[tuple[int, int]]:
    """(member, count) of those that `need` of the sorted lists hold, by a heap of the lists' heads.

    When the least head is on fewer than `need` lists, the need - 1 least heads go and their lists skip, by binary search, to the next
    head: whatever lies before it is on these lists only.
    """
    heap = [(int(a[0]), i, 0) for i, a in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= need:
        head, out = heap[0][0], []
        while heap and heap[0][0] == head:
            out.append(heapq.heappop(heap))
        if len(out) >= need:
            yield head, len(out)
            to = head + 1
        else:
            while heap and len(out) < need - 1:
                out.append(heapq.heappop(heap))
            if not heap:
                return
            to = heap[0][0]
        for _, i, at in out:
            at += int(np.searchsorted(lists[i][at:], to))
            if at < len(lists[i]):
                heapq.heappush(heap, (int(lists[i][at]), i, at))


def merged(lists: list[np.ndarray], need: int) -> list[tuple[int, int]]:
    """(member, count) of those that `need` of the sorted lists hold: by heap, or for many entries by counting."""
    if len(lists) < need:
        return []
    if sum(map(len, lists)) <= HEAP_ENTRIES:
        return list(merge_skip(lists, need))
    flat = np.concatenate(lists)
    low = int(flat.min())
    count = np.bincount(flat - low)
    found = np.flatnonzero(count >= need)
    return list(zip((found + low).tolist(), count[found].tolist(), strict=True))


def set_aside(t: int, longest: int) -> int:
    """L: how many of the longest lists are left to probing."""
    return min(t - 1, int(t / (MU * np.log2(max(longest, 2)) + 1)))


def t_occurrence_links(sets: list[np.ndarray], num: int, den: int, apart: np.ndarray | None = None, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect all linked pairs of sets.

    apart: part of each set; only pairs of different parts are wanted. joined: sets of one number are connected already.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), size[order])
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    by_length = np.argsort(count, kind="stable")
    rank = np.empty(len(count), np.int64)
    rank[by_length] = np.arange(len(count))
    token, length = rank[token], count[by_length]
    listed = np.argsort(token, kind="stable")  # owners rise within a list
    members, begin = owner[listed], np.concatenate([[0], np.cumsum(length)])
    size = size[order]
    at = np.concatenate([[0], np.cumsum(size)])
    ranked = np.sort(token + owner * len(count)) - owner * len(count)  # each set's lists, shortest first
    group = np.arange(len(order)) if joined is None else np.unique(np.asarray(joined)[order], return_inverse=True)[1]
    part = None if apart is None else np.asarray(apart)[order]

    links = []
    for x in range(1, len(order)):
        mine = ranked[at[x] : at[x + 1]]
        t = -(-num * len(mine) // den)
        least = int(np.searchsorted(size, t))
        if least >= x or len(mine) - int(np.searchsorted(length[mine], 2)) < t:
            continue
        aside = set_aside(t, int(length[mine[-1]]))
        short, long = mine[: len(mine) - aside], mine[len(mine) - aside :]
        lists = []
        for r in short[length[short] > 1].tolist():
            a = members[begin[r] : begin[r + 1]]
            a = a[np.searchsorted(a, least) : np.searchsorted(a, x)]
            a = a[group[a] != group[x] if part is None else (group[a] != group[x]) & (part[a] != part[x])]
            if len(a):
                lists.append(a)
        for y, c in merged(lists, t - aside):
            if group[x] == group[y]:
                continue
            need = -(-num * (len(mine) + int(size[y])) // (num + den))
            if c + len(long) < need:
                continue
            other = ranked[at[y] : at[y + 1]]
            # y is in the list of r just when r is among y's: one binary probe for each long list
            c += int(np.count_nonzero(other[np.minimum(np.searchsorted(other, long), len(other) - 1)] == long))
            if c >= need:
                group[group == group[y]] = group[x]
                links.append((int(order[x]), int(order[y])))
    return links


def key_runs(batches, keys: list[str]) -> Iterator[list]:
    """Batches of rows sorted by keys, as a list of batch slices for each run of equal keys."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield held
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _link(num: int, den: int):
    def run(batches):
        import pyarrow as pa

        found: tuple[list, list] = ([], [])
        for run_of in key_runs(batches, ["cluster", "left", "right"]):
            ids, parts, joined = (np.concatenate([g.column(c).to_numpy() for g in run_of]) for c in ("class", "part", "joined"))
            cross = int(run_of[0].column("left")[0].as_py()) != int(run_of[0].column("right")[0].as_py())
            sets = []
            for g in run_of:
                tokens = g.column("tokens")
                flat, n = tokens.flatten().to_numpy(), tokens.value_lengths().to_numpy()
                sets += np.split(flat, np.cumsum(n)[:-1])
            for i, j in t_occurrence_links(sets, num, den, parts if cross else None, joined) if len(sets) > 1 else ():
                found[0].append(ids[i])
                found[1].append(ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return run


def _verify_stars(num: int, den: int):
    """Rows sorted by (star, part, own): a star's set, then the sets that it is verified with."""

    def run(batches):
        import pyarrow as pa

        star, centre = None, np.zeros(0, np.int64)
        for batch in in_pieces(batches):
            stars, own, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("star", "own", "class"))
            tokens = batch.column("tokens")
            n = tokens.value_lengths().to_numpy()
            flat, at = tokens.flatten().to_numpy(), np.cumsum(n) - n
            found: tuple[list, list] = ([], [])
            cuts = [0, *(np.flatnonzero((own[1:] == 0) | (stars[1:] != stars[:-1])) + 1).tolist(), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if own[a] == 0:
                    star, centre = stars[a], np.sort(flat[at[a] : at[a] + n[a]])
                    a += 1
                if a == b or star != stars[a]:
                    continue
                held = centre[np.minimum(np.searchsorted(centre, flat[at[a] : at[b - 1] + n[b - 1]]), len(centre) - 1)] == flat[at[a] : at[b - 1] + n[b - 1]]
                both = np.add.reduceat(held, at[a:b] - at[a], dtype=np.int64)
                linked = np.flatnonzero(den * both >= num * (len(centre) + n[a:b] - both))
                found[0].extend(ids[a:b][linked].tolist())
                found[1].extend([star] * len(linked))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return run


def short_lists(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(class, token): the lists among each class's rarest n - T + 1 that another class is in. sets: (class, n, tokens)."""
    postings = sets.select("class", "n", F.explode("tokens").alias("token"))
    lengths = postings.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    lists = postings.join(lengths, "token").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("length", "token"))).alias("lists"))
    # lists of length 1 come first in the order and lead nowhere
    short = F.col("n") - F.ceil(F.col("n") * num / den).cast("long") + 1 - (F.col("n") - F.size("lists"))
    return lists.select("class", F.explode(F.slice("lists", F.lit(1), F.greatest(short, F.lit(0)).cast("int"))).alias("l")).select("class", F.col("l.token").alias("token"))


def star_links(sets: DataFrame, meets: DataFrame, key: str, num: int, den: int) -> DataFrame:
    """(a, b): verified links of each class with the least class of the keys it meets it in, of several the most frequent one."""
    least = meets.groupBy(key).agg(F.min("class").alias("b"), F.max("class").alias("_top")).where("b < _top").select(key, "b")
    met = meets.join(least, key).where("class <> b").groupBy(F.col("class").alias("a"), "b").agg(F.count("*").alias("n"))
    best = met.groupBy("a").agg(F.min(F.struct(F.negative("n").alias("n"), "b")).alias("s")).select(F.col("a").alias("class"), F.col("s.b").alias("star"))
    parts = best.groupBy("star").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"))
    many = small_or_shuffled(parts.where("parts > 1"))
    part = F.pmod(F.xxhash64("class"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    asked = sets.join(best, "class").join(many, "star", "left").select("star", part, F.lit(1).alias("own"), "class", "tokens")
    centres = sets.join(parts.withColumnRenamed("star", "class"), "class").select(F.col("class").alias("star"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("own"), "class", "tokens")
    dealt = centres.union(asked).repartition("star", "part").sortWithinPartitions("star", "part", "own")
    return dealt.mapInArrow(_verify_stars(num, den), "a long, b long")


def star_edges(rows: DataFrame, key: str, node: str) -> DataFrame:
    """(a, b): each node of a key with the key's least node; keys of one node give none."""
    least = rows.groupBy(key).agg(F.min(node).alias("b"), F.max(node).alias("_top")).where("b < _top").select(key, "b")
    return rows.join(least, key).select(F.col(node).alias("a"), "b").where("a <> b").distinct()


def links_in_clusters(sets: DataFrame, edges: DataFrame, num: int, den: int, scratch: Scratch, joined: DataFrame | None = None, block: int = BLOCK_SHINGLES, spread: int = SPREAD_SHINGLES) -> DataFrame:
    """(a, b): verified links that connect all linked classes within the clusters that edges span; joined: (class, joined) known before."""
    label = components(edges, scratch, "cluster").select(F.col("node").alias("class"), F.col("component").alias("cluster"))
    placed = sets.join(small_or_shuffled(label), "class")
    placed = placed.join(small_or_shuffled(joined), "class", "left").withColumn("joined", F.coalesce("joined", "class")) if joined is not None else placed.withColumn("joined", F.col("class"))
    placed = scratch.save(placed.select("class", "n", "tokens", "cluster", "joined"), "placed")
    parts = placed.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / block), F.least(F.ceil(F.sum("n") / spread), F.lit(SPREAD_PARTS))).cast("int").alias("parts")).where("parts > 1")
    dealt = placed.join(small_or_shuffled(parts), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("cluster", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", "class", "joined", "tokens")
    met = dealt.repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right", "class")
    return met.mapInArrow(_link(num, den), "a long, b long")


def verified_links(sets: DataFrame, meets: DataFrame, key: str, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(a, b): links that connect all linked classes that meet in a key; sets (class, n, tokens) and meets (class, key) are tables."""
    stars = scratch.save(star_links(sets, meets, key, num, den), "star-links")
    joined = components(stars, scratch, "stars").select(F.col("node").alias("class"), F.col("component").alias("joined"))
    named = meets.join(small_or_shuffled(joined), "class", "left").withColumn("joined", F.coalesce("joined", "class"))
    mixed = named.groupBy(key).agg(F.min("joined").alias("low"), F.max("joined").alias("top")).where("low < top").select(key)
    edges = scratch.save(star_edges(meets.join(small_or_shuffled(mixed), key, "left_semi"), key, "class"), "edges")
    links = scratch.save(links_in_clusters(sets, edges, num, den, scratch, joined), "cluster-links")
    scratch.drop("edges", "placed")
    return stars.union(links)


def _told_apart(df: DataFrame, collided: DataFrame) -> DataFrame:
    """df with the classes that stand for sets of several checks split by these."""
    hit = collided.select(F.col("class").alias("_class"))
    apart = df.join(small_or_shuffled(hit), F.col("class") == F.col("_class"), "left")
    return apart.withColumn("class", F.when(F.col("_class").isNotNull(), F.xxhash64("class", "check")).otherwise(F.col("class"))).drop("_class")


def _classes(rows: DataFrame, keyed: bool) -> DataFrame:
    """A row for each class: its least doc_id, its rows, the range of its checks; keyed: also its first row."""
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key") if keyed else F.lit(None)
    return rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("check").alias("low"), F.max("check").alias("top"), F.min(first).alias("row"))


def _joined(docs: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """docs: (doc_id, text) or (doc_id, key, text). Gives its rows (doc_id, key, n_shingles, class) and classes (class, first, copies,
    row, component): component is the least class reached by links."""
    rest, keyed = [c for c in docs.columns if c != "text"], "key" in docs.columns
    schema = ", ".join([*(f"{c} {t}" for c, t in docs.select(*rest).dtypes), FEATURES])
    features = scratch.save(docs.mapInArrow(_features(k, num, den), schema), "features")
    classes = scratch.save(_classes(features, keyed), "classes")
    collided = classes.where("low < top").select("class")
    some = not collided.isEmpty()
    if some:
        features = scratch.save(_told_apart(features, collided), "features-apart")
        classes = scratch.save(_classes(features, keyed), "classes-apart")
    apart = (lambda df: _told_apart(df, collided)) if some else lambda df: df
    rows = scratch.save(features.select(*rest, "n_shingles", "class"), "rows")

    posted = features.select("class", F.explode("signatures").alias("signature"))
    shared = posted.groupBy("signature").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("signature")
    shared = scratch.save(shared, "shared")
    likely = features.select("class", "signatures", "ends", "needs").mapInArrow(_likely(_filter(shared)), "class long, side int, need int, signature long")
    met = likely.join(shared, "signature", "left_semi").groupBy("class", "side", "need").agg(F.count("*").alias("hits"))
    met = scratch.save(met, "met")
    scratch.drop("features", "features-apart", "shared")
    alive = met.join(classes, "class").where(F.col("hits") >= F.col("need") * F.col("copies")).select("class", F.col("first").alias("_first")).distinct()
    owners = scratch.save(alive.withColumnRenamed("class", "_class"), "owners")

    texts = docs.select("doc_id", "text").join(small_or_shuffled(owners.select(F.col("_first").alias("doc_id")).distinct()), "doc_id", "left_semi")
    nameless = not owners.where("_first IS NULL").isEmpty()  # classes of null doc_ids alone
    texts = texts.unionByName(docs.select("doc_id", "text").where("doc_id IS NULL")) if nameless else texts
    sets = apart(texts.mapInArrow(_sets(k), "doc_id long, class long, check long, n long, tokens array<long>"))
    sets = sets.join(small_or_shuffled(owners), (F.col("class") == F.col("_class")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi").select("class", "n", "tokens")
    sets = scratch.save(sets, "sets")
    if nameless or _repeats(docs, owners):
        sets = scratch.save(sets.dropDuplicates(["class"]), "sets-once")

    meets = scratch.save(short_lists(sets, num, den), "short")
    links = verified_links(sets, meets, "token", num, den, scratch)
    found = components(links, scratch, "join").select(F.col("node").alias("class"), "component")
    scratch.drop("met", "sets", "sets-once", "short")
    return rows, scratch.save(classes.join(small_or_shuffled(found), "class", "left").withColumn("component", F.coalesce("component", "class")).drop("low", "top"), "joined")


def join_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id long, text)."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows, classes = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, num, den, scratch)
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    # the classes of several rows or links need telling; others are their own row's
    named = classes.join(least, "component").where("n > 1 OR copies > 1").select("class", "component_id")
    named = scratch.save(named, "named")
    own = rows.join(small_or_shuffled(named.withColumn("_named", F.lit(True))), "class", "left")
    return own.select("doc_id", "n_shingles", F.when(F.col("_named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the rows that another row of their group of near copies stands for; all columns are kept.

    Of a group stays the row of least doc_id (null after all others), of several the one whose text's digest is least; of rows that
    agree in both, one. Rows are told by doc_id and text, so a doc_id on several texts loses only the text that is a copy. Texts
    without words are in no group and all stay.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    rows, classes = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "text"), k, num, den, scratch)
    groups = classes.groupBy("component").agg(F.min("row").alias("row"), F.sum("copies").alias("n")).where("n > 1")
    stay = scratch.save(classes.join(groups.select("component", F.col("row").alias("stay")), "component").select("class", "stay.doc_id", "stay.key"), "stay")
    stay = small_or_shuffled(stay.select(F.col("class").alias("_class"), F.col("doc_id").alias("_id"), F.col("key").alias("_key")))
    grouped = rows.where("n_shingles > 0").join(stay, F.col("class") == F.col("_class"))
    stays = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    gone = scratch.save(grouped.where(~stays).select("doc_id", "key").distinct(), "gone")
    twice = scratch.save(grouped.where(stays).groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "twice")

    id_, key_ = fresh(docs, "near_id"), fresh(docs, "near_key")
    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(key_, key)

    def drop(df: DataFrame, found: DataFrame, how: str) -> DataFrame:
        of_id, of_key = fresh(keyed, "of_id"), fresh(keyed, "of_key")
        found = small_or_shuffled(found.select(F.col("doc_id").alias(of_id), F.col("key").alias(of_key)))
        return df.join(found, F.col(id_).eqNullSafe(F.col(of_id)) & (F.col(key_) == F.col(of_key)), how)

    kept = drop(keyed, gone, "left_anti")
    if not twice.isEmpty():  # rows that repeat doc_id and text
        kept = drop(kept, twice, "left_anti").unionByName(drop(kept, twice, "left_semi").dropDuplicates([id_, key_]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _repeats(docs: DataFrame, owners: DataFrame) -> bool:
    """Whether a doc_id that stands for a class is on several rows, so its set may come twice."""
    ids = docs.select("doc_id").join(small_or_shuffled(owners.select(F.col("_first").alias("doc_id")).distinct()), "doc_id", "left_semi")
    return not ids.groupBy("doc_id").count().where("count > 1").isEmpty()
