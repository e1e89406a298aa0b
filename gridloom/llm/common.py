"""Helpers shared by the text operators: shared-folder scratch tables, vectorised word hashing, components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

MASK = (1 << 64) - 1
SLICE_BYTES = 1 << 20


# ---------------------------------------------------------------- scratch tables
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). A temporary one only where all tasks run in the driver's process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it as long as df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


RELEASE_SECONDS = 2.0
_released = [-1e9]
_made: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_made() -> int:
    """How many scratch folders this process has made."""
    return len(_made)


def discard_scratch(spark: SparkSession, since: int) -> None:
    """Deletes the scratch folders made since; for when what was computed from them has been written."""
    for root in _made[since:]:
        _delete(spark, root)
    del _made[since:]


class Scratch:
    """Parquet tables under the shared folder; writing one cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _made.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        self.release()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of finished steps now, not when the driver next collects its garbage; steps
        that end within RELEASE_SECONDS of the last time wait for the next."""
        if time.monotonic() - _released[0] > RELEASE_SECONDS:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            _released[0] = time.monotonic()

    def drop(self, *names: str) -> None:
        """Deletes tables that no step will read again."""
        for name in names:
            _delete(self.spark, self.path(name))


#: Rows and bytes of values that a broadcast may hold; as a hash table of longs about 40 MB on each executor.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 48 << 20


def value_bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, StructType):
        return reduce(lambda a, b: a + b, [value_bytes(value[f.name], f.dataType) for f in kind.fields], F.lit(8))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | StructType | ArrayType):
            return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(24).cast("long"), lambda a, x: a + value_bytes(x, kind.elementType))
        return F.greatest(F.size(value), F.lit(0)) * 8 + 24
    return F.lit(8)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if counting rows and bytes shows it small, else df as it is (a shuffle join, split by AQE where skewed)."""
    each = reduce(lambda a, b: a + b, [value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(0).cast("long"))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


# ---------------------------------------------------------------- words
def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters are hashed by tables of random numbers, one for each of PLACES places in a word; upper-case A-Z as lower-case.
PLACES = 64
_TABLES = np.random.default_rng(0x67726964).integers(0, MASK, (PLACES, 256), np.uint64, endpoint=True)
_TABLES[:, 65:91] = _TABLES[:, 97:123]
_TABLES = _TABLES.ravel()


def _hash_piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in data (at most SLICE_BYTES); a word also ends where breaks says so.

    A word's hash mixes the sum of its letters' table entries. A letter beyond the first PLACES has its entry mixed with the number
    of its run of PLACES letters, so no sum cancels by the letters' places.
    """
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1] | breaks[1:]
    last = ~space
    last[:-1] &= space[1:] | breaks[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    place = np.zeros(len(data), np.int32)
    place[start] = start
    place = np.arange(len(data), dtype=np.int32) - np.maximum.accumulate(place)
    value = _TABLES[((place & (PLACES - 1)) << 8) | data]
    if len(start) and int((end - start).max()) > PLACES:
        far = np.flatnonzero(place >= PLACES)
        value[far] = mix(value[far] + (place[far] // PLACES).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix(total[end] - total[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def word_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Yields (first row, rows, word hashes, word offsets of the rows, starts, ends) over slices of at most `limit` bytes.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Starts and ends are byte positions in the row's text. A longer
    text is a slice of its own, hashed in pieces that end at white space; a single word longer than a piece is hashed from
    the hashes of its pieces.
    """
    data, at = utf8(column)
    row, n = 0, len(at) - 1
    while row < n:
        stop = int(np.searchsorted(at, at[row] + limit, "right")) - 1
        if stop <= row:
            yield (row, 1, *_long_words(data[at[row] : at[row + 1]], limit))
            row += 1
            continue
        piece = data[at[row] : at[stop]]
        breaks = np.zeros(len(piece) + 1, bool)
        local = at[row : stop + 1] - at[row]
        breaks[local] = True
        h, start, end = _hash_piece(piece, breaks[:-1]) if len(piece) else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        offsets = np.searchsorted(start, local)
        base = np.repeat(local[:-1], np.diff(offsets))
        yield row, stop - row, h, offsets, start - base, end - base
        row = stop


def _long_words(data: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pos, open_word = 0, False
    while pos < len(data):
        stop = min(len(data), pos + limit)
        if stop < len(data):
            gaps = np.flatnonzero(_SPACE[data[pos:stop]])
            stop = pos + int(gaps[-1]) + 1 if len(gaps) else stop
        piece = data[pos:stop]
        h, start, end = _hash_piece(piece, np.zeros(len(piece), bool))
        start, end = start + pos, end + pos
        if open_word and len(start) and start[0] == pos:
            before, h0 = got[-1], h[:1]
            joined = mix(before[0][-1:] * np.uint64(0xD6E8FEB86659FD93) + h0)
            got[-1] = (np.concatenate([before[0][:-1], joined]), before[1], np.concatenate([before[2][:-1], end[:1]]))
            h, start, end = h[1:], start[1:], end[1:]
        got.append((h, start, end)) if len(h) or not got else None
        open_word = bool(len(piece)) and not _SPACE[piece[-1]]
        pos = stop
    parts = [np.concatenate(x) for x in zip(*got, strict=True)]
    return parts[0], np.array([0, len(parts[0])]), parts[1], parts[2]


def shingles(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and the row of each; a row with fewer words has its whole sequence as one."""
    n = np.diff(offsets)
    rows = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
    if len(h) >= k:
        acc = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            acc = acc * np.uint64(0xFF51AFD7ED558CCD) + h[j : len(h) - k + 1 + j]
        first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))[:-1]]), np.maximum(n - k + 1, 0))
        out = mix(acc[np.arange(len(rows)) + first]) if len(rows) else np.zeros(0, np.uint64)
    else:
        out = np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = []
        for r in short:
            acc = int(n[r])
            for x in h[offsets[r] : offsets[r + 1]].tolist():
                acc = (acc * 0xFF51AFD7ED558CCD + x) & MASK
            extra.append(acc)
        out = np.concatenate([out, mix(np.array(extra, np.uint64))])
        rows = np.concatenate([rows, short])
    return out, rows


def shingle_sets(column: pa.Array, k: int):
    """Yields (first row, rows, values, offsets): each row's distinct shingles, ascending."""
    for row, n, h, offsets, _, _ in word_slices(column):
        values, rows = shingles(h, offsets, k)
        order = np.lexsort((values, rows))
        values, rows = values[order], rows[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        values, rows = values[new], rows[new]
        yield row, n, values, np.searchsorted(rows, np.arange(n + 1))


# ---------------------------------------------------------------- components
#: Edges that one task joins at a time: 8 MB as arrays.
BLOCK_EDGES = 500_000


def block_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the edges (a, b) as stars: each node but the least one, and the least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        open_ = x != y
        x, y = x[open_], y[open_]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def _contract(batches):
    """Stars (a, b) of each block of at most BLOCK_EDGES edges."""

    def stars(held):
        a, b = block_stars(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, BLOCK_EDGES - n))
            at, n = at + held[-1].num_rows, n + held[-1].num_rows
            if n == BLOCK_EDGES:
                yield stars(held)
                held, n = [], 0
    if held:
        yield stars(held)


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 60, block: int = BLOCK_EDGES) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) join to each node; nodes are long.

    Blocks of at most `block` edges are joined within tasks first and leave a star for each of their components; if one block held
    all edges, that is the answer. Else large-star and small-star (Kiveris et al.) join the stars of different blocks: each round is
    two grouped minima, pre-aggregated before their shuffle, keeps the number of edges, and takes O(log^2) rounds. Each round's
    edges are written to the shared folder.
    """
    now, before = scratch.save(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"), f"{name}0"), None
    for i in range(1, rounds + 1):
        n = now.count()
        stars = now.coalesce(max(1, -(-n // block))).mapInArrow(_contract, "a long, b long")
        if n <= min(block, BLOCK_EDGES):
            now = scratch.save(stars, f"{name}{i}")
            break
        now, gone = scratch.save(stars, f"{name}{i}-stars"), f"{name}{i - 1}"
        scratch.drop(gone)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").selectExpr("b a", "m b")  # every larger neighbour to the least one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("CASE WHEN b = m THEN a ELSE b END a", "m b").where("a <> b").distinct()
        now = scratch.save(small, f"{name}{i}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{i}-stars")
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components: no fixed point")
    # now each edge joins a node to its component's least node
    return now.selectExpr("a node", "b component").union(now.selectExpr("b node", "b component").distinct())
