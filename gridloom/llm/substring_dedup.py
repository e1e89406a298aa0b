"""Substring dedup by paragraph MinHash banding.

Two kinds of paragraphs are compared over the whole corpus:
- lines of at least MIN_LINE words, by MinHash of their K-word shingles in BANDS bands of ROWS rows: at similarity 0.8 a pair
  collides with probability 1 - (1 - 0.8^ROWS)^BANDS = 0.997. Equal lines are one class, and only classes are banded. Colliding
  classes are verified by their exact Jaccard similarity (NUM / DEN or more), against stars first and then by T-occurrence search in
  clusters; components of verified links are the clusters of removals. A class is a component also without links where two documents
  hold it;
- passages amid lines have no bounds that a MinHash could compare, so texts are also cut into segments where a hash of the words is
  least among its neighbours: a passage that many documents share is cut alike wherever it stands. A segment's one band holds all its
  words in order, so segments that collide are equal (similarity 1) and form a component; a chance collision of 64 bits would have to
  come twice in a row to make a passage of short segments.

The first occurrence of a component (least doc_id, then position) stays and the others are `removed`. Neighbouring segments of one
fate are given as one passage; passages of fewer than MIN_PASSAGE words are left alone.

Result: (doc_id, kind, first_word, n_words, component_id, removed), word positions in `[^\\x20\\x09-\\x0D]+` words. component_id is
the least doc_id of the component (of a passage: the least among its segments').

Defined results: only repetition across documents counts; rows that repeat doc_id and text count once, and a null doc_id takes no
part; null and empty texts have no paragraphs; extra columns are ignored; an empty table gives no rows; whole texts are read, whatever
their length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, mix, shingles, small_or_shuffled, utf8, word_slices
from .ngram_join import verified_links

K, NUM, DEN = 5, 80, 100
ROWS, BANDS = 3, 8
MIN_LINE = 20
MIN_PASSAGE = 16
REACH = 4

_rng = np.random.default_rng(5)
_MUL = _rng.integers(1, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64)


def line_starts(data: np.ndarray, base: np.ndarray, starts: np.ndarray, word_rows: np.ndarray) -> np.ndarray:
    """True at the first word of each line: data are all bytes of the column, base the offset of each word's row."""
    new = np.ones(len(starts), bool)
    if len(starts) > 1:
        at = base + starts
        low = at[0]
        breaks = np.cumsum(data[low : at[-1] + 1] == 0x0A)
        new[1:] = (word_rows[1:] != word_rows[:-1]) | (breaks[at[1:] - low] != breaks[at[:-1] - low])
    return new


def segment_starts(h: np.ndarray, word_rows: np.ndarray) -> np.ndarray:
    """True at the first word of each segment: the first of a row, and words whose hash with the next one is a strict local minimum."""
    g = h.copy()
    g[:-1] += h[1:] * np.uint64(0x9E3779B97F4A7C15)
    g = mix(g)
    new = np.ones(len(h), bool)
    for d in range(1, min(REACH, len(h) - 1) + 1):
        new[d:] &= g[d:] < g[:-d]
        new[: len(h) - d] &= g[: len(h) - d] < g[d:]
    first = np.ones(len(h), bool)
    first[1:] = word_rows[1:] != word_rows[:-1]
    return new | first


def minhash_bands(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS keys for each run of shingles."""
    out = np.zeros((len(starts), BANDS), np.uint64)
    for j in range(ROWS * BANDS):
        least = np.minimum.reduceat(mix(values * _MUL[j] + _ADD[j]), starts)
        band = j // ROWS
        out[:, band] = mix(out[:, band] * np.uint64(0xFF51AFD7ED558CCD) + least + np.uint64(band + 1))
    return out


def _digests(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A digest of the words of each run, in order."""
    place = np.arange(len(h)) - np.repeat(starts, sizes)
    mixed = mix(h ^ mix(place.astype(np.uint64) + np.uint64(0x7F4A7C15)))
    return mix(np.add.reduceat(mixed, starts) + sizes.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)


UNITS = "doc_id long, uid long, n_words int, segment_key array<long>, segment_at array<int>, line_key array<long>, line_at array<int>, line_words array<int>, bands array<array<long>>"


def _units(batches):
    import pyarrow as pa

    for batch in batches:
        data, at = utf8(batch.column("text"))
        for row, n, h, offsets, start, _ in word_slices(batch.column("text")):
            words = np.diff(offsets)
            rows = np.repeat(np.arange(n), words)
            seg = np.flatnonzero(segment_starts(h, rows)) if len(h) else np.zeros(0, np.int64)
            line = np.flatnonzero(line_starts(data, at[row + rows], start, rows)) if len(h) else np.zeros(0, np.int64)
            seg_size, line_size = np.diff(np.append(seg, len(h))), np.diff(np.append(line, len(h)))
            seg_key = _digests(h, seg, seg_size)
            long = line_size >= MIN_LINE
            values, of = shingles(h, np.append(line, len(h)), K)
            wanted = long[of] & (of < len(line)) if len(of) else np.zeros(0, bool)
            values, of = values[wanted], of[wanted]
            order = np.argsort(of, kind="stable")
            values, of = values[order], of[order]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
            bands = minhash_bands(values, first) if len(first) else np.zeros((0, BANDS), np.uint64)
            line_key = _digests(h, line, line_size)[long] if len(line) else np.zeros(0, np.uint64)
            line, line_size = line[long], line_size[long]

            def lists(values, owners, n=n):
                return pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(n + 1)).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))

            seg_row, line_row = rows[seg] if len(seg) else seg, rows[line] if len(line) else line
            uid = mix(np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.uint64(1)))])[offsets[1:]] - np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.uint64(1)))])[offsets[:-1]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(row, n), pa.array(uid.view(np.int64)), pa.array(words.astype(np.int32)), lists(seg_key.view(np.int64), seg_row), lists((seg - offsets[seg_row]).astype(np.int32), seg_row),
                    lists(line_key.view(np.int64), line_row), lists((line - offsets[line_row]).astype(np.int32), line_row), lists(line_size.astype(np.int32), line_row), lists(pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64))), line_row),
                ],
                names=[x.split(" ")[0] for x in UNITS.split(", ")],
            )


def _line_sets(batches):
    """Shingle sets of the lines that `wanted` lists by their first word."""
    import pyarrow as pa

    for batch in batches:
        data, at = utf8(batch.column("text"))
        wanted = batch.column("wanted").to_pylist()
        for row, n, h, offsets, start, _ in word_slices(batch.column("text")):
            rows = np.repeat(np.arange(n), np.diff(offsets))
            line = np.flatnonzero(line_starts(data, at[row + rows], start, rows)) if len(h) else np.zeros(0, np.int64)
            size = np.diff(np.append(line, len(h)))
            keys, sets, counts = [], [], []
            for r in range(n):
                for w in wanted[row + r] or ():
                    i = int(np.searchsorted(line, offsets[r] + w))
                    if i >= len(line) or line[i] != offsets[r] + w or size[i] < MIN_LINE:
                        continue  # a row that repeats the doc_id with another text
                    own = h[line[i] : line[i] + size[i]]
                    values = np.unique(shingles(own, np.array([0, len(own)]), K)[0])
                    keys.append(_digests(own, np.array([0]), np.array([len(own)]))[0])
                    sets.append(values)
                    counts.append(len(values))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(counts, np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["class", "n", "tokens"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """The repeated passages and lines of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    units = scratch.save(docs.mapInArrow(_units, UNITS), "units")
    return _segments(units, scratch).unionByName(_lines(docs, units, scratch))


def _segments(units: DataFrame, scratch: Scratch) -> DataFrame:
    each = units.select("doc_id", "uid", "n_words", F.arrays_zip(F.col("segment_key").alias("key"), F.col("segment_at").alias("at")).alias("s"), "segment_at")
    each = each.select("doc_id", "uid", F.posexplode("s").alias("i", "s"), "n_words", "segment_at")
    each = each.select("doc_id", "uid", "i", F.col("s.key").alias("key"), F.col("s.at").alias("at"), (F.coalesce(F.get("segment_at", F.col("i") + 1), F.col("n_words")) - F.col("s.at")).alias("words"))
    shared = each.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("top"), F.min(F.struct("doc_id", "at")).alias("first")).where("owner < top").select("key", "owner", F.col("first.at").alias("first_at"))
    shared = scratch.save(shared, "shared")
    found = each.join(shared, "key").withColumn("removed", ~((F.col("doc_id") == F.col("owner")) & (F.col("at") == F.col("first_at"))))
    order = Window.partitionBy("doc_id", "uid").orderBy("i")
    found = found.withColumn("before", F.lag(F.struct("i", "removed")).over(order)).where(F.col("before").isNull() | (F.col("before.i") < F.col("i")))
    fresh = F.col("before").isNull() | (F.col("before.i") != F.col("i") - 1) | (F.col("before.removed") != F.col("removed"))
    runs = found.withColumn("run", F.sum(fresh.cast("int")).over(order)).groupBy("doc_id", "uid", "run", "removed")
    passages = runs.agg(F.min("at").alias("first_word"), F.sum("words").cast("int").alias("n_words"), F.min("owner").alias("component_id")).where(F.col("n_words") >= MIN_PASSAGE)
    return passages.select("doc_id", F.lit("passage").alias("kind"), "first_word", "n_words", "component_id", "removed")


def _lines(docs: DataFrame, units: DataFrame, scratch: Scratch) -> DataFrame:
    each = F.arrays_zip(F.col("line_key").alias("class"), F.col("line_at").alias("at"), F.col("line_words").alias("words"), F.col("bands").alias("bands"))
    lines = units.select("doc_id", F.explode(each).alias("l")).select("doc_id", "l.*")
    # copies collapse before they are banded: a row for each class, pre-aggregated
    banding = [F.min(F.col("bands")[j]).alias(f"b{j}") for j in range(BANDS)]
    classes = scratch.save(lines.groupBy("class").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top"), *banding), "line-classes")
    banded = classes.select("class", F.explode(F.array(*[f"b{j}" for j in range(BANDS)])).alias("band"))
    held = banded.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("top")).where("low < top").select("band")
    meets = scratch.save(banded.join(small_or_shuffled(scratch.save(held, "bands")), "band"), "line-meets")
    alive = scratch.save(meets.select("class").distinct(), "alive")
    owners = lines.select("class", "doc_id", "at").join(small_or_shuffled(alive), "class", "left_semi").groupBy("class").agg(F.min(F.struct("doc_id", "at")).alias("o"))
    # a row for each document that owns a line, with the places of its lines
    wanted = scratch.save(owners.groupBy(F.col("o.doc_id").alias("doc_id")).agg(F.collect_set("o.at").alias("wanted")), "wanted")
    texts = docs.join(small_or_shuffled(wanted.select("doc_id")), "doc_id", "left_semi").join(wanted, "doc_id")
    sets = texts.select("text", "wanted").mapInArrow(_line_sets, "class long, n long, tokens array<long>")
    sets = scratch.save(sets.join(small_or_shuffled(alive), "class", "left_semi").dropDuplicates(["class"]), "sets")
    links = verified_links(sets, meets, "band", NUM, DEN, scratch)
    found = scratch.save(components(links, scratch, "lines").select(F.col("node").alias("class"), "component"), "linked")
    scratch.drop("bands", "line-meets", "alive", "wanted", "sets")
    equal = classes.where("low < top").select("class", F.col("class").alias("component"))
    found = scratch.save(found.union(equal.join(small_or_shuffled(found), "class", "left_anti")), "found")
    scratch.drop("line-classes", "linked")
    placed = scratch.save(lines.select("doc_id", "class", "at", "words").join(small_or_shuffled(found), "class").dropDuplicates(["doc_id", "class", "at"]), "near")
    first = placed.groupBy("component").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("top")).where("first.doc_id < top")
    kept = placed.join(small_or_shuffled(first), "component")
    removed = ~((F.col("doc_id") == F.col("first.doc_id")) & (F.col("at") == F.col("first.at")))
    return kept.select("doc_id", F.lit("line").alias("kind"), F.col("at").alias("first_word"), F.col("words").alias("n_words"), F.col("first.doc_id").alias("component_id"), removed.alias("removed"))
