"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A text is lower-cased, runs of white space become one space, and a space is put at either end; its features are the distinct
character n-grams of ORDERS, hashed to BUCKETS. Each feature's value is the log-count ratio of its smoothed document counts in
toxic and other texts; a logistic regression on these values gives the weights. The score is the probability of label 1.

Log-count ratios count every labelled training row, in one distributed pass: each task emits the buckets it has seen, which are
summed in the JVM; the pass has at most COUNT_TASKS tasks for each core, so what is shuffled grows with the cluster and not with the
data. The regression is fitted on the driver on at most TRAIN_ROWS rows of each class (those with the least hash of doc_id; of a
doc_id's rows of one label the text that sorts first), weighted back to the classes' true shares; features that fewer than MIN_DOCS
training rows of the sample hold get no weight of their own. A score only reads the text.

Defined results: null text is empty; empty texts get the score of the intercept; repeated rows and doc_ids each get a row;
labels that are null or not 0 or 1 don't train; a doc_id with labels of both kinds trains as both; without training rows of both
classes every score is the share of the class seen (0.5 with none); extra columns are carried, but one of the score's name is replaced; an
empty table gives no rows. Texts are read whole, long ones in overlapping pieces.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, small_or_shuffled

ORDERS = (3, 4, 5)
BUCKETS = 1 << 20
TRAIN_ROWS = 1000
COUNT_TASKS = 3
MIN_DOCS = 6
ALPHA = 0.5
RIDGE = 1.0
STEPS = 100
PIECE = 1 << 18

_SPACES = re.compile(r"\s+")
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def ngrams(text: str) -> np.ndarray:
    """The distinct hashed n-grams of a text, ascending."""
    text = f" {_SPACES.sub(' ', text.lower()).strip()} "
    found = [_piece(text[i : i + PIECE + max(ORDERS) - 1]) for i in range(0, len(text), PIECE)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _piece(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    seen, acc = np.zeros(0, np.uint32), np.zeros(len(code), np.uint64)
    parts = []
    for j in range(max(ORDERS)):
        if len(code) <= j:
            break
        acc = acc[: len(code) - j] + code[j:] * _MUL[j]
        if j + 1 in ORDERS:
            h = acc * np.uint64(0x9FB21C651E98DF25) + np.uint64(j)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            parts.append((h >> np.uint64(44)).astype(np.uint32))
    return np.unique(np.concatenate(parts)) if parts else seen


def _count(batches):
    """Rows (bucket, other, toxic) of one task: how many rows of either label hold each bucket seen; bucket -1 counts the rows."""
    import pyarrow as pa

    counts = np.zeros((2, BUCKETS + 1), np.int64)
    for batch in batches:
        texts, labels = batch.column("text"), batch.column("label").to_pylist()
        for i, label in enumerate(labels):
            counts[label][ngrams(texts[i].as_py() or "")] += 1
            counts[label][BUCKETS] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(seen), 1 << 16):
        part = seen[at : at + (1 << 16)]
        bucket = np.where(part == BUCKETS, -1, part).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), *(pa.array(counts[label][part]) for label in (0, 1))], names=["bucket", "other", "toxic"])


def _featurise(batches):
    import pyarrow as pa

    for batch in batches:
        texts = batch.column("text")
        out = [ngrams(texts[i].as_py() or "").astype("<u4").tobytes() for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("label"), pa.array(out, pa.binary())], names=["rank", "label", "features"])


class Model:
    """weights by bucket (log-count ratios already multiplied in) and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, text: str) -> float:
        z = self.intercept + float(self.weights[ngrams(text)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-max(-700.0, min(700.0, z)))))


def train(labelled: DataFrame, scratch: Scratch | None = None) -> Model:
    """labelled: (doc_id, text, label), label 0 or 1."""
    scratch = scratch or Scratch(labelled.sparkSession, "toxicity")
    labelled = labelled.select("doc_id", "text", F.col("label").cast("int").alias("label"))
    tasks = COUNT_TASKS * labelled.sparkSession.sparkContext.defaultParallelism
    sums = labelled.select("text", "label").coalesce(tasks).mapInArrow(_count, "bucket int, other long, toxic long")
    got = sums.groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()  # at most BUCKETS + 1 rows
    counts = np.zeros((2, BUCKETS + 1))
    counts[:, got.column("bucket").to_numpy()] = [got.column(c).to_numpy() for c in ("other", "toxic")]
    counts, rows = counts[:, :-1], counts[:, -1].copy()  # bucket -1 is the last
    del got
    if not rows.all():
        share = float(rows[1] / rows.sum()) if rows.any() else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    counts += ALPHA
    ratio = np.log(counts[1] / counts[1].sum() / (counts[0] / counts[0].sum()))
    del counts

    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # the sample is drawn from the narrow rows; only its texts (one for each of at most 2 * TRAIN_ROWS doc_ids and labels) are read again
    narrow = labelled.select(order.alias("rank"), "label")
    drawn = [narrow.where(F.col("label") == label).distinct().orderBy("rank").limit(TRAIN_ROWS) for label in (0, 1)]
    drawn = F.broadcast(drawn[0].union(drawn[1]))  # at most 2 * TRAIN_ROWS rows of two numbers
    texts = labelled.withColumn("rank", order).join(drawn, ["rank", "label"]).groupBy("rank", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    drawn = texts.mapInArrow(_featurise, "rank long, label int, features binary")
    # a task's rows at a time: the driver holds the sample's features once
    got = sorted(((r["label"], r["rank"], bytes(r["features"])) for r in drawn.toLocalIterator()), reverse=True)
    y = np.array([r[0] for r in got[::-1]], float)
    seen = np.zeros(BUCKETS, np.int32)
    for r in got:
        seen[np.frombuffer(r[2], "<u4")] += 1
    used = np.flatnonzero(seen >= MIN_DOCS)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    sets = []
    while got:
        x = place[np.frombuffer(got.pop()[2], "<u4")]
        sets.append(x[x >= 0])
    del seen, place
    share = rows / rows.sum()
    weight = np.where(y == 1, share[1] / max((y == 1).sum(), 1), share[0] / max((y == 0).sum(), 1))
    w, b = _fit(sets, y, weight, ratio[used])
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w * ratio[used]
    return Model(weights, b)


def _fit(sets: list[np.ndarray], y: np.ndarray, weight: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge by accelerated gradient descent; a row's features are ratio[its set]."""
    n, blocks, first = len(ratio), [], 0
    while first < len(sets):  # blocks of about 250 thousand entries bound the temporaries
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 1 << 18):
            size += len(sets[last])
            last += 1
        blocks.append((first, last, np.concatenate(sets[first:last]), np.array([len(x) for x in sets[first:last]])))
        sets[first:last] = [None] * (last - first)
        first = last

    def forward(v: np.ndarray) -> np.ndarray:
        scaled = v * ratio
        return np.concatenate([np.bincount(np.repeat(np.arange(b - a), sizes), weights=scaled[flat], minlength=b - a) for a, b, flat, sizes in blocks])

    def backward(d: np.ndarray) -> np.ndarray:
        total = np.zeros(n)
        for a, b, flat, sizes in blocks:
            total += np.bincount(flat, weights=np.repeat(d[a:b], sizes), minlength=n)
        return total * ratio

    w, b = np.zeros(n), float(np.log(max(weight[y == 1].sum(), 1e-9) / max(weight[y == 0].sum(), 1e-9)))
    v, top = np.ones(n + 1) / np.sqrt(n + 1), 1.0
    for _ in range(8):  # a bound of the curvature: a quarter of the greatest weighted eigenvalue, by power iteration
        p = forward(v[:n]) + v[n]
        v = np.append(backward(weight * p), (weight * p).sum())
        top = max(float(np.linalg.norm(v)), 1e-12)
        v /= top
    rate = 1 / (0.3 * top + RIDGE / len(y))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        d = weight * (1 / (1 + np.exp(-np.clip(forward(vw) + vb, -500, 500))) - y)
        nw, nb = vw - rate * (backward(d) + RIDGE / len(y) * vw), vb - rate * d.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the score of `text` in a double column (replaced if there is one). The model is BUCKETS floats, whatever the data."""
    weights, intercept = docs.sparkSession.sparkContext.broadcast(model.weights), model.intercept
    docs = docs.drop(column)
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns)]).alias("row"), "text")
    schema = StructType([whole.schema["row"], StructField("score", DoubleType())])

    def run(batches):
        import pyarrow as pa

        own = Model(weights.value, intercept)
        for batch in batches:
            texts = batch.column("text")
            scores = pa.array([own.score(texts[i].as_py() or "") for i in range(len(texts))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), scores], names=["row", "score"])

    return whole.mapInArrow(run, schema).select(*[F.col(f"row.c{n}").alias(c) for n, c in enumerate(docs.columns)], F.col("score").alias(column))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, text, label) of the rows that may train: crc32(doc_id as text) mod 3 is not 1."""
    known = labels.where(F.col(label).isin(0, 1)).where(~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("label")).distinct()
    # labels are a row of two numbers a document: sent to the tasks if counting shows them few, so texts aren't shuffled for them
    return docs.select("doc_id", "text").join(small_or_shuffled(known, 1_000_000), "doc_id")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
