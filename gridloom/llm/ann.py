"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact cosine.

Vectors are scaled to length 1 (so Euclidean order is cosine order) and hashed in TABLES tables by floor((a.v + b) / WIDTH),
a normal, M projections each. A query visits, in each table, its own bucket and then perturbed ones in the order of their
estimated success: the least sum of squared distances to the boundaries that a perturbation crosses. What a query meets in a
bucket is reranked at once by the exact cosine of the original vectors in double precision, and each task sends on each query's
K best; the best of all tables are merged.

M grows with the logarithm of the number of rows. The number of probes is fitted, alike at every size: on the SAMPLE rows of least
hashed vec_id (the only rows used for fitting; all rows of a smaller table), the fewest probes that find TARGET of the true
neighbours, or else a smaller M, down to 1. Neighbours lie closer in the whole table than in a sample, so recall on the table is
higher; tests measure it against brute force. Every row is indexed, and a query that found fewer than K rows is searched again
against all rows, in blocks. (Only if no M reaches TARGET within MAX_PROBES is every row put into one bucket.)

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; vectors only meet vectors of
equal length; ties go to the smaller vec_id; rows repeating a vec_id count once, with the vector that sorts first; null vec_ids
take no part; other columns are ignored; an empty table gives no rows; a table of one row finds nothing. Vectors are scaled by powers
of two before lengths and products are taken, so components of any finite size neither overflow nor vanish. Of equal vectors only the K + 1 smallest vec_ids are indexed: others can't be among any row's K nearest.

Skew: buckets of over BLOCK rows are split by hashed vec_id into blocks of about that size, each visited by every query of the
bucket, so a bucket that holds a third of all rows is spread over many tasks and no task holds more than one block at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MASK, Scratch, mix, small_or_shuffled

TABLES = 4
WIDTH = 2.0
SAMPLE = 2048
TARGET = 0.94
MAX_PROBES = 256
BLOCK = 4096
SEED = 11


def projections(m: int, dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, table, m, dim])
    return rng.standard_normal((dim, m)), rng.uniform(0, WIDTH, m)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their greatest component into [0.5, 1): exact, and free of overflow when squared."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def hashes(x: np.ndarray, m: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells, and distances to their lower boundaries, of the rows of x."""
    a, b = projections(m, x.shape[1], table)
    at = unit(x) @ a + b
    cell = np.floor(at / WIDTH)
    return cell.astype(np.int64), at - cell * WIDTH


def bucket_ids(cells: np.ndarray, table: int, dim: int) -> np.ndarray:
    acc = np.full(len(cells), (table * 0x9E3779B97F4A7C15 + dim) & MASK, np.uint64)
    for j in range(cells.shape[1]):
        acc = mix(acc * np.uint64(0xFF51AFD7ED558CCD) + cells[:, j].astype(np.uint64))
    return acc.view(np.int64)


def perturbations(distance: np.ndarray, probes: int) -> Iterator[tuple[int, ...]]:
    """The first `probes` sets of crossed boundaries in order of estimated success; i < m steps down, i >= m steps up."""
    m = len(distance)
    cost = np.concatenate([distance, WIDTH - distance]) ** 2
    order = np.argsort(cost, kind="stable")
    cost = cost[order].tolist()
    axis, order = (order % m).tolist(), order.tolist()
    yield ()
    sent, heap = 1, [(cost[0], (0,))] if m else []
    while heap and sent < probes:
        c, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*chosen, last + 1)))
        if len({axis[i] for i in chosen}) == len(chosen):
            yield tuple(order[i] for i in chosen)
            sent += 1


def probe_cells(cell: np.ndarray, distance: np.ndarray, probes: int) -> np.ndarray:
    m, out = len(cell), []
    for chosen in perturbations(distance, probes):
        c = cell.copy()
        for i in chosen:
            c[i % m] += -1 if i < m else 1
        out.append(c)
    return np.array(out).reshape(len(out), m)


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of q with the rows of v, in double precision; equal vectors get equal scores wherever they lie."""
    q, v = scaled(q), scaled(v)
    return (v * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(axis=1)))


def fit(sample: np.ndarray, rows: int, k: int) -> tuple[int, int]:
    """(projections, probes) for a table of `rows` vectors."""
    if len(sample) < 2:
        return 1, 1
    q = np.arange(0, len(sample), max(1, len(sample) // 100))
    at = unit(sample)
    near = at[q] @ at.T
    near[np.arange(len(q)), q] = -2
    truth = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    for m in range(max(2, round(np.log2(rows) / 2 - 1)), 0, -1):
        found = np.full(truth.shape, MAX_PROBES)
        for table in range(TABLES):
            cells, distance = hashes(sample, m, table)
            for j, i in enumerate(q):
                seen = {tuple(c): n for n, c in reversed(list(enumerate(probe_cells(cells[i], distance[i], MAX_PROBES).tolist())))}
                found[j] = np.minimum(found[j], [seen.get(tuple(c), MAX_PROBES) for c in cells[truth[j]].tolist()])
        need = int(np.sort(found, axis=None)[min(found.size - 1, int(np.ceil(TARGET * found.size)) - 1)])
        if need < MAX_PROBES:
            return m, need + 1
    return 0, 1


def _vectors(batch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, positions, matrix) for each length of the vectors in a batch."""
    raw = batch.column("vec").to_pylist()
    sizes = np.array([len(x) for x in raw], np.int64)
    width = np.dtype(kind).itemsize
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n) // width, at, np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)


def _spread(m: int, probes: int, tables: int, kind: str):
    """Rows (bucket, id, vec): once for each table and probe."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                ids, raw = batch.column("vec_id").to_pylist(), batch.column("vec").to_pylist()
                buckets, rows = [], []
                for dim, at, x in _vectors(batch, kind):
                    for table in range(tables):
                        cells, distance = hashes(x, m, table)
                        if probes == 1 or not m:
                            buckets.append(bucket_ids(cells, table, dim))
                            rows.append(at)
                        else:
                            each = [probe_cells(c, d, probes) for c, d in zip(cells, distance, strict=True)]
                            buckets.append(bucket_ids(np.concatenate(each), table, dim))
                            rows.append(np.repeat(at, [len(e) for e in each]))
                buckets, rows = np.concatenate(buckets), np.concatenate(rows).tolist()
                for a in range(0, len(rows), 4096):
                    part = rows[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(buckets[a : a + 4096]), pa.array([ids[i] for i in part], pa.int64()), pa.array([raw[i] for i in part], pa.binary())], names=["bucket", "vec_id", "vec"])

    return run


def _best(q: np.ndarray, qid: int, rough: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    rough = np.where(ids == qid, -np.inf, rough)
    if len(rough) > k:
        keep = np.flatnonzero(rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9)
    else:
        keep = np.arange(len(rough))
    keep = keep[ids[keep] != qid]
    score = exact_scores(q, v[keep])
    order = np.lexsort((ids[keep], -score))[:k]
    return [(qid, int(ids[keep[i]]), float(score[i])) for i in order]


def _search(k: int, kind: str):
    """Reads rows sorted by (bucket, part, asks): a block's candidates, then the queries that visit it."""

    def run(batches):
        import pyarrow as pa

        now, raw, ids, v, length_1 = None, [], [], None, None
        out: list[tuple[int, int, float]] = []
        settled = 0

        def settle() -> None:
            """Keeps each query's k best of what this task has found."""
            out.sort(key=lambda r: (r[0], -r[2], r[1]))
            kept, n, last = [], 0, None
            for r in out:
                n = 0 if last is None or r[0] != last[0] else n
                if n < k and (last is None or r[:2] != last[:2]):
                    kept.append(r)
                    n += 1
                last = r
            out[:] = kept

        def send():
            settle()
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            bucket, part, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "part", "asks"))
            all_ids, vec = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("vec")
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(part) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                if b <= a:
                    continue
                key = (int(bucket[a]), int(part[a]))
                if key != now:
                    now, raw, ids, v = key, [], [], None
                got = vec.slice(a, b - a).to_pylist()
                if not asks[a]:
                    raw += got
                    ids += all_ids[a:b].tolist()
                    continue
                if not raw:
                    continue
                if v is None:
                    v, known = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64), np.array(ids)
                    length_1 = unit(v)
                for c in range(0, b - a, 256):
                    q = np.frombuffer(b"".join(got[c : c + 256]), kind).reshape(-1, v.shape[1]).astype(np.float64)
                    rough = unit(q) @ length_1.T
                    for i in range(len(q)):
                        out += _best(q[i], int(all_ids[a + c + i]), rough[i], v, known, k)
                    if len(out) > settled + 50_000:
                        settle()
                        settled = len(out)
                    if settled > 200_000:
                        yield send()
                        settled = 0
        yield send()

    return run


def _meet(index: DataFrame, asked: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score): the k best of every bucket that a query visits."""
    sizes = index.groupBy("bucket").count().where(F.col("count") > BLOCK).select(F.col("bucket").alias("_hot"), F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    sizes = small_or_shuffled(sizes)
    parts = F.coalesce("parts", F.lit(1))
    rows = index.join(sizes, F.col("bucket") == F.col("_hot"), "left").select("bucket", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"), F.lit(False).alias("asks"), "vec_id", "vec")
    visits = asked.join(sizes, F.col("bucket") == F.col("_hot"), "left").select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("asks"), "vec_id", "vec")
    dealt = rows.union(visits).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "asks", "vec_id")
    return dealt.mapInArrow(_search(k, kind), "query_id long, vec_id long, score double")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) of the rows that take part: vec holds the components as little-endian floats of their own width."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ok = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda c: c != 0))
    kind = _kind(vectors)

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column("embedding")
            flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(kind), column.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(at)
            raw = [flat[e - n : e].tobytes() for n, e in zip(at, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], names=["vec_id", "vec"])

    packed = ok.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(pack, "vec_id long, vec binary")
    return packed.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _kind(vectors: DataFrame) -> str:
    return "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest to each row that is_query (of vec_id) selects."""
    spark, kind = vectors.sparkSession, _kind(vectors)
    scratch = Scratch(spark, "ann")
    all_rows = scratch.save(usable(vectors), "vectors")
    copies = Window.partitionBy("vec").orderBy("vec_id")
    index = scratch.save(all_rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n"), "index")
    queries = all_rows.where(is_query)
    drawn = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").collect()
    length = max((len(r["vec"]) for r in drawn), key=[len(r["vec"]) for r in drawn].count, default=0)
    sample = np.array([np.frombuffer(r["vec"], kind) for r in drawn if len(r["vec"]) == length], np.float64).reshape(-1, max(1, length // np.dtype(kind).itemsize))
    m, probes = fit(sample, index.count(), k)
    schema = "bucket long, vec_id long, vec binary"
    tables = TABLES if m else 1
    met = _meet(index.mapInArrow(_spread(m, 1, tables, kind), schema), queries.mapInArrow(_spread(m, probes, tables, kind), schema), k, kind)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = scratch.save(met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "found")
    if m:  # queries whose buckets held fewer than k rows: all rows, in blocks
        short = queries.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
        if not short.isEmpty():
            again = _meet(index.mapInArrow(_spread(0, 1, 1, kind), schema), short.mapInArrow(_spread(0, 1, 1, kind), schema), k, kind)
            pairs = found.select("query_id", "vec_id", "score").union(again).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            found = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
