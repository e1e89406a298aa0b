"""Block layout, domain decomposition, halos, comparison and statistics on cell frames."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import morton, morton_axis

# ---------------------------------------------------------------- block layout


def _flat(coords: list[Column], extents: list[int]) -> Column:
    """Row-major number; the first axis is contiguous."""
    total, stride = F.lit(0).cast("long"), 1
    for c, n in zip(coords, extents, strict=True):
        total, stride = total + c * stride, stride * n
    return total


def to_blocks(cells: DataFrame, axes: list[str], edge: int) -> DataFrame:
    """(b<axis>..., v array): the values of each block in row-major order. A block is edge^rank values, whatever the data; a missing cell
    is null, so every value keeps its place; of repeated coordinates the greatest value stays."""
    size = edge ** len(axes)
    local = _flat([F.pmod(F.col(a), F.lit(edge)) for a in axes], [edge] * len(axes))
    keys = [f"b{a}" for a in axes]
    placed = cells.select(*[F.floor(F.col(a) / edge).alias(k) for a, k in zip(axes, keys, strict=True)], local.cast("int").alias("p"), "v")
    # dealt by block once: both groupings keep that partitioning
    once = placed.repartition(*keys).groupBy(*keys, "p").agg(F.max("v").alias("v"))
    gathered = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("c"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda n: F.array_max(F.transform(F.filter("c", lambda x: x["p"] == n), lambda x: x["v"])))
    return gathered.select(*keys, F.when(F.size("c") == size, F.transform("c", lambda x: x["v"])).otherwise(filled).alias("v"))


def from_blocks(blocks: DataFrame, axes: list[str], edge: int) -> DataFrame:
    """The cells of blocks; nulls are missing cells."""
    each = blocks.select(*[f"b{a}" for a in axes], F.posexplode("v").alias("p", "v")).where("v IS NOT NULL")
    return each.select(*_cell(axes, edge), "v")


def _cell(axes: list[str], edge: int) -> list[Column]:
    """Coordinates of position p of a block."""
    return [(F.col(f"b{a}") * edge + F.pmod(F.floor(F.col("p") / edge**n), F.lit(edge))).cast("long").alias(a) for n, a in enumerate(axes)]


def paired(cells: DataFrame, blocks: DataFrame, axes: list[str], edge: int) -> DataFrame:
    """(axes, a, b): the value of each owned cell in the array form and in the block form; what one form lacks is null there."""
    return cells.select(*axes, F.col("v").alias("a")).join(from_blocks(blocks, axes, edge).withColumnRenamed("v", "b"), axes, "full")


def each_pair(cells: DataFrame, blocks: DataFrame, axes: list[str], edge: int, f) -> DataFrame:
    """f(a, b), a Column function, of each pair of elements that both forms have."""
    return paired(cells, blocks, axes, edge).where("a IS NOT NULL AND b IS NOT NULL").select(*axes, f(F.col("a"), F.col("b")).alias("out"))


def compare_blocks(cells: DataFrame, blocks: DataFrame, axes: list[str], edge: int) -> DataFrame:
    """(axes, a, b, close): the array form against the block form."""
    return paired(cells, blocks, axes, edge).withColumn("close", close(F.col("a"), F.col("b")))


def numbered_blocks(blocks: DataFrame, axes: list[str], extents: list[int]) -> DataFrame:
    """blocks with block_id, from 1, row-major in a grid of `extents` blocks."""
    return blocks.withColumn("block_id", (_flat([F.col(f"b{a}") for a in axes], extents) + 1).cast("long"))


def neighbor_blocks(blocks: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(block_id, dir, neighbor_id, v): the whole neighbour in each direction of `adjacent`, joined through the adjacency table."""
    links = adjacent.where("neighbor_id > 0")
    return links.join(blocks.select(F.col("block_id").alias("neighbor_id"), "v"), "neighbor_id").join(blocks.select("block_id"), "block_id", "left_semi").select("block_id", "dir", "neighbor_id", "v")


def read_across(blocks: DataFrame, adjacent: DataFrame, axes: list[str], edge: int, offset: list[int]) -> DataFrame:
    """(block_id, p, dir, q, v): for position p of each block, the value at local index plus offset, each index in [-edge, 2 edge).

    dir is the adjacency slot, base 3 by axis, of the block that holds it, and q the position there; v is null outside the grid.
    """
    if any(abs(d) > edge for d in offset):
        raise ValueError("an offset reaches a neighbouring block at most")
    each = blocks.select("block_id", F.posexplode("v").alias("p", "own")).where("own IS NOT NULL")
    at = [F.pmod(F.floor(F.col("p") / edge**n), F.lit(edge)) + d for n, d in enumerate(offset)]
    slot = reduce(lambda a, b: a + b, [(F.floor(x / edge) + 1) * 3**n for n, x in enumerate(at)])
    place = _flat([F.pmod(x, F.lit(edge)) for x in at], [edge] * len(axes))
    asked = each.select("block_id", "p", slot.cast("int").alias("dir"), place.cast("int").alias("q"))
    links = adjacent.where(F.col("dir").isin(*_slots(edge, offset)))
    found = asked.join(links, ["block_id", "dir"], "left").join(blocks.select(F.col("block_id").alias("neighbor_id"), F.col("v").alias("held")), "neighbor_id", "left")
    return found.select("block_id", "p", "dir", "q", F.get("held", F.col("q")).alias("v"))


def _slots(edge: int, offset: list[int]) -> list[int]:
    """The adjacency slots that an offset can reach."""
    reach = [{(x + d) // edge + 1 for x in range(edge)} for d in offset]
    return [sum(s * 3**n for n, s in enumerate(c)) for c in product(*reach)]


def adjacency(spark: SparkSession, extents: list[int], per_axis: bool = True) -> DataFrame:
    """(block_id, dir, neighbor_id) of a row-major block grid; ids from 1, 0 where there is no neighbour.

    per_axis tests each axis's range; otherwise only the linear position is tested, so a row's end meets the next row's start.
    """
    d, n = len(extents), reduce(lambda a, b: a * b, extents, 1)
    ids, links = spark.range(n).withColumnRenamed("id", "p"), F.explode(F.sequence(F.lit(0), F.lit(3**d - 1))).alias("dir")
    df = ids.select("p", links)
    inside, target, stride = F.lit(True), F.col("p"), 1
    for axis, size in enumerate(extents):
        step = F.pmod(F.floor(F.col("dir") / 3**axis), F.lit(3)) - 1
        at = F.pmod(F.floor(F.col("p") / stride), F.lit(size)) + step
        inside, target, stride = inside & (at >= 0) & (at < size), target + step * stride, stride * size
    ok = inside if per_axis else (target >= 0) & (target < n)
    return df.select((F.col("p") + 1).alias("block_id"), "dir", F.when(ok, target + 1).otherwise(0).cast("long").alias("neighbor_id"))


def block_average(blocks: DataFrame, axes: list[str]) -> DataFrame:
    """Per position, the mean of a block and its 2d face neighbours (absent ones count 0)."""
    keys, d = [f"b{a}" for a in axes], len(axes)
    sent = [F.struct(*[(F.col(k) + (s if n == axis else 0)).alias(k) for n, k in enumerate(keys)], F.lit(False).alias("own")) for axis in range(d) for s in (-1, 1)]
    sent.append(F.struct(*[F.col(k).alias(k) for k in keys], F.lit(True).alias("own")))
    each = blocks.select("v", F.explode(F.array(*sent)).alias("t")).select(*[F.col(f"t.{k}").alias(k) for k in keys], F.col("t.own").alias("own"), F.posexplode("v").alias("p", "x"))
    sums = each.where("x IS NOT NULL").groupBy(*keys, "p").agg((F.sum("x") / (2 * d + 1)).alias("v"), F.max("own").alias("own"))
    return sums.where("own").select(*keys, "p", "v")


def add_blocks(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), keys).select(*keys, F.zip_with("v", "w", lambda x, y: x + y).alias("v"))


# ---------------------------------------------------------------- directions and regions


def directions(d: int) -> list[tuple[int, ...]]:
    """The 3^d signed direction sets, each axis positive, absent, negative in turn; entry 3^d - 1 - n is the negation of n."""
    return [tuple(a * s for a, s in zip(range(d, 0, -1), signs, strict=True) if s) for signs in product((1, 0, -1), repeat=d)]


#: The surface orders. `normal` counts through the signs with axis 1 fastest; `bad` puts an empty set between neighbours.
SURFACE_GOOD = (
    (1,), (1, -3), (1, 2, -3), (1, 2), (1, 2, 3), (2, 3), (2,), (2, -3), (-1, 2, -3), (-1, 2), (-1, 2, 3), (-1, 3), (-1,), (-3,),
    (-1, -3), (-1, -2, -3), (-1, -2), (-1, -2, 3), (-2, 3), (-2,), (-2, -3), (1, -2, -3), (1, -2), (1, -2, 3), (1, 3), (3,),
)


def surface_order(name: str, d: int = 3) -> list[tuple[int, ...]]:
    if name == "good":
        return list(SURFACE_GOOD)
    if name == "default":
        return [s for s in directions(d) if s]
    counted = [tuple(a * s for a, s in zip(range(d, 0, -1), signs, strict=True) if s) for signs in product((-1, 0, 1), repeat=d)]
    if name == "normal":
        return counted
    full = [s for s in counted if s]
    return [x for s in full for x in (s, ())][:-1]


def direction_frame(spark: SparkSession, sets: list[tuple[int, ...]]) -> DataFrame:
    rows = spark.createDataFrame([(n, sorted(s)) for n, s in enumerate(sets)], "ord int, dirs array<int>")
    return rows


def surface_runs(spark: SparkSession, order: list[tuple[int, ...]], d: int) -> DataFrame:
    """(axes, runs): for each neighbour, how many contiguous runs of the order it needs (one message each)."""
    skin = direction_frame(spark, order)
    ends = direction_frame(spark, [s for s in directions(d) if s]).select(F.col("dirs").alias("neighbor"))
    met = ends.join(F.broadcast(skin), F.size(F.array_except(F.transform("neighbor", lambda p: -p), "dirs")) == 0)  # both fixed: 3^d rows
    run = F.col("ord") - F.row_number().over(Window.partitionBy("neighbor").orderBy("ord"))
    return met.withColumn("run", run).groupBy("neighbor").agg(F.countDistinct("run").alias("runs")).select(F.size("neighbor").alias("axes"), "runs").groupBy("axes").agg(F.sum("runs").alias("runs"), F.count("*").alias("neighbors"))


def region_layout(spark: SparkSession, extents: list[int], depth: int, order: list[tuple[int, ...]]) -> DataFrame:
    """(ord, kind, dirs, pos, len) in blocks: the null block, the interior, the surface in its order, the ghosts by neighbour."""
    d = len(extents)
    if any(n < 2 * depth for n in extents):
        raise ValueError("each extent takes at least twice the ghost depth")

    def volume(s: tuple[int, ...], own: bool) -> int:
        out = 1
        for axis, n in enumerate(extents, 1):
            out *= depth if axis in s or -axis in s else n - 2 * depth if own else n
        return out

    rows = [(0, "null", [], 1), (1, "interior", [], volume((), True))]
    rows += [(0, "surface", sorted(s), volume(s, True)) for s in order if s]
    for s in (s for s in directions(d) if s):  # a ghost region holds what its neighbour's surface sends: all sections that contain -s
        rows.append((0, "ghost", sorted(s), volume(s, False)))
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "ord int, kind string, dirs array<int>, len long")
    upto = F.sum("len").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))  # a fixed few rows
    return df.select("ord", "kind", F.array_join("dirs", ",").alias("dirs"), (upto - F.col("len")).alias("pos"), "len")


def section_owner(ids: DataFrame, total: int, ranks: int) -> DataFrame:
    """Near-equal contiguous runs of Morton ids: the first total % ranks ranks have one more."""
    if ranks > total:
        raise ValueError("more ranks than subdomains")
    q, r = divmod(total, ranks)
    cut = r * (q + 1)
    rank = F.when(F.col("sub_id") < cut, F.floor(F.col("sub_id") / (q + 1))).otherwise(r + F.floor((F.col("sub_id") - cut) / q))
    start = F.when(rank < r, rank * (q + 1)).otherwise(cut + (rank - r) * q)
    return ids.withColumn("rank", rank.cast("int")).withColumn("local_idx", (F.col("sub_id") - start).cast("int"))


def neighbor_owner(spark: SparkSession, side: int, ranks: int) -> DataFrame:
    """(sub_id, dir, neighbor, rank): periodic neighbours of the subdomains of a side^3 grid and who owns them."""
    subs = spark.range(side**3).select(F.col("id").alias("sub_id"), F.explode(F.sequence(F.lit(0), F.lit(26))).alias("dir"))
    at = [F.pmod(morton_axis(F.col("sub_id"), n, 3) + (F.pmod(F.floor(F.col("dir") / 3**n), F.lit(3)) - 1), F.lit(side)) for n in range(3)]
    linked = subs.select(F.col("sub_id").alias("of"), "dir", morton(at).alias("sub_id"))
    return section_owner(linked, side**3, ranks).select(F.col("of").alias("sub_id"), "dir", F.col("sub_id").alias("neighbor"), "rank")


# ---------------------------------------------------------------- halos


def halo_put(cells: DataFrame, axes: list[str], extents: list[int], depth: int) -> DataFrame:
    """Owned cells and their periodic ghosts: each cell goes directly to every ghost position that copies it. No shuffle."""
    df = cells
    for a, n in zip(axes, extents, strict=True):
        copies = F.array_compact(F.array(F.col(a), F.when(F.col(a) < depth, F.col(a) + n), F.when(F.col(a) >= n - depth, F.col(a) - n)))
        df = df.withColumn(a, F.explode(copies))
    return df


def halo_shift(cells: DataFrame, axes: list[str], extents: list[int], depth: int) -> DataFrame:
    """The same in a stage for each axis, in which ghosts of earlier stages are forwarded."""
    df = cells
    for a, n in zip(axes, extents, strict=True):
        up = df.where(F.col(a) < depth).withColumn(a, F.col(a) + n)
        down = df.where(F.col(a) >= n - depth).withColumn(a, F.col(a) - n)
        df = df.unionByName(up).unionByName(down)
    return df


def section(axes: list[str], extents: list[int], depth: int, dirs: tuple[int, ...], inner: bool = True) -> Column:
    """Cells of the owned surface towards dirs; with inner, other axes keep off their own surfaces."""
    ok = F.lit(True)
    for n, (a, size) in enumerate(zip(axes, extents, strict=True), 1):
        if n in dirs:
            ok &= F.col(a) >= size - depth
        elif -n in dirs:
            ok &= F.col(a) < depth
        elif inner:
            ok &= (F.col(a) >= depth) & (F.col(a) < size - depth)
    return ok


def interior(cells: DataFrame, axes: list[str], extents: list[int], depth: int) -> DataFrame:
    """The cells at least `depth` from the box's faces; an axis of extent None has none."""
    for a, n in zip(axes, extents, strict=True):
        cells = cells.where(F.col(a).between(depth, n - 1 - depth)) if n is not None else cells
    return cells


def _bounds(extents: list[int], depth: int, dirs: tuple[int, ...], inner: bool) -> list[tuple[int, int]]:
    """[low, high) of the owned surface towards dirs, on each axis."""
    out = []
    for n, size in enumerate(extents, 1):
        out.append((size - depth, size) if n in dirs else (0, depth) if -n in dirs else (depth, size - depth) if inner else (0, size))
    return out


def section_count(extents: list[int], depth: int, dirs: tuple[int, ...], inner: bool = True) -> int:
    """Cells of a section."""
    return reduce(lambda a, b: a * b, [b - a for a, b in _bounds(extents, depth, dirs, inner)], 1)


def pack(cells: DataFrame, axes: list[str], extents: list[int], depth: int, dirs: tuple[int, ...], inner: bool = True) -> DataFrame:
    """(pos, v): a section as a run of values, row-major; a filter, without a shuffle."""
    bounds = _bounds(extents, depth, dirs, inner)
    pos = _flat([F.col(a) - low for a, (low, _) in zip(axes, bounds, strict=True)], [b - a for a, b in bounds])
    return cells.where(section(axes, extents, depth, dirs, inner)).select(pos.alias("pos"), "v")


def unpack(packed: DataFrame, axes: list[str], extents: list[int], depth: int, dirs: tuple[int, ...], inner: bool = True) -> DataFrame:
    """The ghost cells of the neighbour that a packed section towards dirs is for: there they lie beyond the opposite faces."""
    out, stride = [], 1
    for n, (a, (low, high), size) in enumerate(zip(axes, _bounds(extents, depth, dirs, inner), extents, strict=True), 1):
        shift = -size if n in dirs else size if -n in dirs else 0
        out.append((F.pmod(F.floor(F.col("pos") / stride), F.lit(high - low)) + low + shift).cast("long").alias(a))
        stride *= high - low
    return packed.select(*out, "v")


def halo_subdomains(cells: DataFrame, axes: list[str], extents: list[int], edge: int, depth: int) -> DataFrame:
    """(sub_id, axes, v): each subdomain of edge^rank cells with its periodic ghosts, in its own coordinates, from -depth on. A cell goes
    to every subdomain whose padded box holds it, without a shuffle; sub_id is the subdomain's Morton code."""
    if any(n % edge for n in extents) or depth > edge:
        raise ValueError("extents are whole subdomains, and halos no deeper than one")
    df = cells
    for a, n in zip(axes, extents, strict=True):
        own, last = F.floor(F.col(a) / edge).cast("int"), n // edge - 1
        at = F.col(a) - own * edge
        low, high = F.when(at < depth, F.struct((own - 1).alias("s"), (at + edge).alias("x"))), F.when(at >= edge - depth, F.struct((own + 1).alias("s"), (at - edge).alias("x")))
        df = df.withColumn("_t", F.explode(F.array_compact(F.array(F.struct(own.alias("s"), at.alias("x")), low, high))))
        df = df.withColumn(f"_s{a}", F.pmod(F.col("_t.s"), F.lit(last + 1))).withColumn(a, F.col("_t.x").cast("long")).drop("_t")
    return df.select(morton([F.col(f"_s{a}") for a in axes]).alias("sub_id"), *axes, "v")


# ---------------------------------------------------------------- comparison and statistics

TOLERANCE = 1e-6


def close(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.coalesce((d < TOLERANCE) | (d < (F.abs(a) + F.abs(b)) * TOLERANCE), F.lit(False))


def compare(a: DataFrame, b: DataFrame, axes: list[str]) -> DataFrame:
    """(axes, a, b, close): a cell that either side lacks isn't close."""
    return a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), axes, "full").select(*axes, "a", "b", close(F.col("a"), F.col("b")).alias("close"))


def validity(df: DataFrame, rank: Column, ok: Column) -> DataFrame:
    """(rank, valid, every_rank): whether ok holds for all of a rank's rows, and for those of every rank."""
    ranks = df.groupBy(rank.alias("rank")).agg(F.every(ok).alias("valid"))
    return ranks.join(F.broadcast(df.agg(F.every(ok).alias("every_rank"))))  # one row


def stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """min, avg, max and sample deviation (0 for one row)."""
    s = df.groupBy(*by).agg(F.min(value).alias("min"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sigma"))
    return s


def stats_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.format_string("[%.3f, %.3f, %.3f] (σ: %.3f)", "min", "avg", "max", "sigma"))


def timed(run, seconds: float = 1.0) -> tuple[int, float]:
    """(repetitions, seconds): run() once to warm up, then in doubling numbers until a batch takes `seconds`."""
    import time

    run()
    n = 1
    while True:
        began = time.perf_counter()
        for _ in range(n):
            run()
        took = time.perf_counter() - began
        if took >= seconds:
            return n, took
        n *= 2


def derived_metrics(df: DataFrame) -> DataFrame:
    """GStencil/s, GB/s and MB moved, of rows (elements, calc, pack, call, wait, bytes); the parts are seconds."""
    spent = F.col("calc") + F.col("pack") + F.col("call") + F.col("wait")
    return df.select("*", (F.col("elements") * 1e-9 / spent).alias("gstencil_s"), (F.col("bytes") * 1e-9 / (F.col("call") + F.col("wait"))).alias("gb_s"), (F.col("bytes") * 1e-6).alias("mb"))


def throughput(elements: int, seconds: dict[str, float]) -> float:
    """GStencil/s of a step of so many elements and its parts' seconds."""
    return elements * 1e-9 / sum(seconds.values())
