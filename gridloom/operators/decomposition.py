"""Decomposition of a domain into blocks with ghosts, as small relational tables: regions in storage order, exchanges, block ids, ranks.

A region is told by its owner (the empty set for the domain itself, else the direction of the neighbour that owns it) and by the
surface it lies on (a set of directions, empty inside). All tables have at most 5^d rows, but for the index of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _flat, directions, section_owner
from ..functions import morton, morton_axis

Dirs = tuple[int, ...]


def _product(numbers) -> int:
    out = 1
    for n in numbers:
        out *= n
    return out


@dataclass
class Decomposition:
    """extents and depth in cells, blocks of edge^d cells; `page` blocks fill a page, and regions begin and end at pages."""

    extents: list[int]
    depth: int
    edge: int
    order: list[Dirs]
    page: int = 1
    blocks: list[int] = field(init=False)
    ghost: int = field(init=False)

    def __post_init__(self):
        if self.depth % self.edge:
            raise ValueError("the ghost depth is a whole number of blocks")
        if any(n % self.edge for n in self.extents):
            raise ValueError("each extent is a whole number of blocks")
        if any(n < 2 * self.depth for n in self.extents):
            raise ValueError("each extent takes at least twice the ghost depth")
        if self.page < 1:
            raise ValueError("a page holds one block or more")
        self.blocks, self.ghost = [n // self.edge for n in self.extents], self.depth // self.edge

    def volume(self, region: Dirs) -> int:
        """Blocks of a region."""
        return _product(self.ghost if n in region or -n in region else size - 2 * self.ghost for n, size in enumerate(self.blocks, 1))

    def padding(self, region: Dirs) -> int:
        """Blocks that bring a region to whole pages."""
        return -self.volume(region) % self.page

    def pads_first(self) -> list[bool]:
        """Whether each surface region's padding goes before it: on the side of the neighbour with which it shares fewer directions."""
        ends = [(), *self.order, ()]
        return [len(set(a) & set(b)) < len(set(b) & set(c)) for a, b, c in zip(ends, ends[1:], ends[2:])]

    def segments(self) -> list[tuple[str, Dirs, Dirs, int, int, int, int]]:
        """(kind, owner, region, start, pos, len, end) in storage order: what is stored from start to end, its blocks from pos on."""
        out, at, first = [], self.page, self.pads_first()

        def store(kind: str, owner: Dirs, region: Dirs, pad: bool) -> None:
            nonlocal at
            size, padding = self.volume(region), self.padding(region)
            out.append((kind, owner, region, at, at + padding * pad, size, at + size + padding))
            at += size + padding

        store("interior", (), (), False)
        for region, pad in zip(self.order, first, strict=True):
            if region:
                store("surface", (), region, pad)
        for n in directions(len(self.extents)):
            for region, pad in zip(self.order, first, strict=True):
                if n and region and {-p for p in n} <= set(region):
                    store("ghost", n, region, pad)
        return out

    def layout(self, spark: SparkSession) -> DataFrame:
        """(ord, kind, owner, region, start, pos, len, stop)."""
        rows = [(n, k, sorted(o), sorted(r), *rest) for n, (k, o, r, *rest) in enumerate(self.segments())]
        return spark.createDataFrame(rows, "ord int, kind string, owner array<int>, region array<int>, start long, pos long, len long, stop long")

    def separators(self) -> tuple[int, int, int]:
        """Where the interior, the surface and the ghosts end."""
        ends = {}
        for kind, *_, end in self.segments():
            ends[kind] = end
        return ends["interior"], ends["surface"], ends["ghost"]

    def exchanges(self, spark: SparkSession) -> DataFrame:
        """(ord, neighbor, skin_st, skin_ed, surface_pos, ghost_pos, len): one row for each contiguous run, which is a message of its own."""
        stored = {(owner, region): (start, end) for _, owner, region, start, _, _, end in self.segments()}
        rows = []
        for n in directions(len(self.extents)):
            held = [{-p for p in n} <= set(region) for region in self.order]
            for wanted, run in groupby(range(len(held)), key=held.__getitem__):
                run = list(run)
                if n and wanted:
                    first, last = self.order[run[0]], self.order[run[-1]]
                    rows.append((len(rows), sorted(n), run[0], run[-1] + 1, stored[(), first][0], stored[n, first][0], stored[n, last][1] - stored[n, first][0]))
        return spark.createDataFrame(rows, "ord int, neighbor array<int>, skin_st int, skin_ed int, surface_pos long, ghost_pos long, len long")

    def index(self, spark: SparkSession) -> DataFrame:
        """(b0, b1, ..., block_id) of every block of the padded grid, ghosts at negative coordinates and beyond the extents."""
        d, g = len(self.extents), self.ghost
        padded = [n + 2 * g for n in self.blocks]
        df, left = spark.range(_product(padded)), F.col("id")
        owner, region, rank, stride = F.lit(0), F.lit(0), F.lit(0).cast("long"), F.lit(1).cast("long")
        cols: list[Column] = []
        for n, size in enumerate(self.blocks):
            at = F.pmod(left, F.lit(padded[n])) - g
            left = F.floor(left / padded[n])
            side = F.when(at < 0, 2).when(at >= size, 1).otherwise(0)  # whose it is
            own = F.pmod(at, F.lit(size))
            edge = F.when(own < g, 2).when(own >= size - g, 1).otherwise(0)  # which of the owner's surfaces
            within = F.when(edge == 2, own).when(edge == 1, own - (size - g)).otherwise(own - g)
            owner, region = owner + side * 3**n, region + edge * 3**n
            rank, stride = rank + within * stride, stride * F.when(edge == 0, size - 2 * g).otherwise(g)
            cols.append(at.cast("long").alias(f"b{n}"))
        code = lambda s: sum((1 if n + 1 in s else 2 if -n - 1 in s else 0) * 3**n for n in range(d))
        starts = spark.createDataFrame([(code(o), code(r), pos) for _, o, r, _, pos, *_ in self.segments()], "owner int, region int, pos long")
        placed = df.select(*cols, owner.cast("int").alias("owner"), region.cast("int").alias("region"), rank.alias("rank"))
        return placed.join(F.broadcast(starts), ["owner", "region"]).select(*[f"b{n}" for n in range(d)], (F.col("pos") + F.col("rank")).alias("block_id"))


def neighbor_ranks(spark: SparkSession, grid: list[int]) -> DataFrame:
    """(rank, dirs, neighbor): the rank next to each one of a periodic process grid. Ranks count with the last coordinate fastest; axis n
    of a direction is coordinate d - n, and its positive side the lower coordinate."""
    d, sets = len(grid), directions(len(grid))
    total = _product(grid)
    table = spark.createDataFrame([(sorted(s), [(-1 if d - c in s else 1 if c - d in s else 0) for c in range(d)]) for s in sets], "dirs array<int>, step array<int>")
    df = spark.range(total).select(F.col("id").alias("rank")).join(F.broadcast(table))  # 3^d rows
    neighbor, stride = F.lit(0).cast("long"), 1
    for c in reversed(range(d)):
        neighbor = neighbor + F.pmod(F.floor(F.col("rank") / stride) % grid[c] + F.get("step", F.lit(c)), F.lit(grid[c])) * stride
        stride *= grid[c]
    return df.select("rank", "dirs", neighbor.alias("neighbor"))


def uneven_split(spark: SparkSession, extents: list[int], edge: int, grid: list[int]) -> DataFrame:
    """(rank, axis, cells, start): the share of each rank on each axis in whole blocks, the first ones a block more where it doesn't divide."""
    d, total, rows = len(extents), _product(grid), spark.range(_product(grid)).select(F.col("id").alias("rank"))
    parts, stride = [], 1
    for c in reversed(range(d)):  # axis n is dealt along coordinate d - 1 - n
        n = d - 1 - c
        at = (F.floor(F.col("rank") / stride) % grid[c]).cast("long")
        stride *= grid[c]
        each, more = divmod(extents[n] // edge, grid[c])
        cells = (each + F.when(at < more, 1).otherwise(0)) * edge
        parts.append(F.struct(F.lit(n).alias("axis"), cells.cast("long").alias("cells"), ((at * each + F.least(at, F.lit(more))) * edge).cast("long").alias("start")))
    assert stride == total
    return rows.select("rank", F.inline(F.array(*parts)))


def region_links(spark: SparkSession, side: int, ranks: int, decomposition: Decomposition) -> DataFrame:
    """(rank, source, local, region_id, uses, blocks): the surface regions that each rank's subdomains take their ghosts from.

    Subdomains of a periodic side^3 grid are dealt to ranks in Morton order. Ghosts whose source is the same rank are links to its surface;
    of others each region (the source's Morton code and the region's place in the order) is received once, however many ghosts use it.
    """
    skins = [(n, j, decomposition.volume(s) + decomposition.padding(s)) for n, t in enumerate(directions(3)) for j, s in enumerate(decomposition.order) if t and s and {-p for p in t} <= set(s)]
    steps = [(n, *[1 if a in t else -1 if -a in t else 0 for a in (1, 2, 3)]) for n, t in enumerate(directions(3))]
    table = spark.createDataFrame(steps, "ord int, x int, y int, z int").join(spark.createDataFrame(skins, "ord int, skin int, blocks long"), "ord")
    near = spark.range(side**3).select(F.col("id").alias("sub_id")).join(F.broadcast(table))  # a fixed few hundred rows
    at = [F.pmod(morton_axis(F.col("sub_id"), n, 3) + F.col(c), F.lit(side)) for n, c in enumerate("xyz")]
    source = section_owner(near.select(F.col("sub_id").alias("of"), "skin", "blocks", morton(at).alias("sub_id")), side**3, ranks)
    source = source.select("of", "skin", "blocks", F.col("sub_id").alias("from"), F.col("rank").alias("source"))
    mine = section_owner(source.withColumnRenamed("of", "sub_id"), side**3, ranks)
    found = mine.select("rank", "source", (F.col("from") * 32 + F.col("skin")).cast("long").alias("region_id"), "blocks")
    return found.groupBy("rank", "source", (F.col("rank") == F.col("source")).alias("local"), "region_id").agg(F.count("*").alias("uses"), F.max("blocks").alias("blocks"))
