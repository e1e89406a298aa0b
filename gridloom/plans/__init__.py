"""Interchangeable physical plans of a neighbour computation, and the choice between them.

All take a cell frame: a long column for each axis and a value column for each grid of full rank, named as the grid. Grids of lower rank
are `operands`: frames with the axes they have and a value column of their name, joined on those axes. Missing cells read 0, also in
operands. All plans give the same rows: one for each cell of the frame. Boundaries: `zero` (cells outside read 0), `interior` (only cells
that have all their neighbours), `periodic` (needs extents) and `clamp` (nearest cell of the box; needs extents; join plan only).
Coordinates must be unique; of repeated ones the gather and window plans take the greatest value.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dsl import Expr, Ref, linear, radius, reads, to_column

Offsets = tuple[tuple[int, int], ...]
Names = dict[tuple[str, Offsets], str]
#: Rows of an operand that are sent to every task; larger ones are joined by a shuffle.
OPERAND_ROWS = 100_000
#: Cells of a pencil that one window holds.
PENCIL = 64


def _name(grid: str, offsets: Offsets) -> str:
    return f"n_{grid}_" + ("_".join(f"{a}{'p' if d > 0 else 'm'}{abs(d)}" for a, d in offsets) or "0")


def _fields(cells: DataFrame, axes: list[str], outputs: dict[str, Expr]) -> tuple[list[Ref], list[Ref]]:
    """The reads of grids of full rank, which must be columns of cells, and those of lower rank."""
    found = reads(*outputs.values())
    full, low = [r for r in found if r.grid.rank == len(axes)], [r for r in found if r.grid.rank < len(axes)]
    for r in full:
        if r.grid.name not in cells.columns:
            raise ValueError(f"the cells have no column for grid {r.grid.name}")
    return full, low


def _operands(cells: DataFrame, axes: list[str], low: list[Ref], operands: dict[str, DataFrame] | None, boundary: str, extents: list[int] | None) -> tuple[DataFrame, Names]:
    """cells with a column for each read of a grid of lower rank, joined on the axes that it has."""
    names: Names = {}
    for r in low:
        if r.grid.name not in (operands or {}):
            raise ValueError(f"no operand for grid {r.grid.name}")
        other, name = operands[r.grid.name], _name(r.grid.name, r.offsets)
        names[r.grid.name, r.offsets] = name
        shift, mine = dict(r.offsets), [axes[i.axis] for i in r.at]
        on = F.lit(True)
        other = other.select(*[F.col(a).alias(f"_{a}") for a in mine], F.col(r.grid.name).alias(name))
        for a in mine:
            on &= _moved(F.col(a), shift.get(axes.index(a), 0), boundary, extents and extents[axes.index(a)]) == F.col(f"_{a}")
        small = other.limit(OPERAND_ROWS + 1).count() <= OPERAND_ROWS
        cells = cells.join(F.broadcast(other) if small else other, on, "left").drop(*[f"_{a}" for a in mine])
    return cells, names


def _moved(at: Column, d: int, boundary: str, extent: int | None) -> Column:
    """The coordinate d further on."""
    if not d:
        return at
    if boundary == "periodic":
        return F.pmod(at + d, F.lit(extent)).cast("long")
    if boundary == "clamp":
        return F.least(F.greatest(at + d, F.lit(0)), F.lit(extent - 1)).cast("long")
    return (at + d).cast("long")


def _finish(df: DataFrame, axes: list[str], outputs: dict[str, Expr], params: dict, names: Names, boundary: str, c_int_division: bool = False) -> DataFrame:
    shifted = [n for (_, o), n in names.items() if o]
    if boundary == "interior" and shifted:
        df = df.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in shifted]))

    def read(r: Ref) -> Column:
        name = names.get((r.grid.name, r.offsets), r.grid.name)
        return F.coalesce(F.col(name), F.lit(0)) if name != r.grid.name else F.col(name)

    return df.select(*axes, *[to_column(e, read, params, c_int_division).alias(n) for n, e in outputs.items()])


def by_gather(cells: DataFrame, axes: list[str], outputs: dict[str, Expr], params: dict | None = None, boundary: str = "zero", extents: list[int] | None = None, operands: dict[str, DataFrame] | None = None, c_int_division: bool = False) -> DataFrame:
    """Each cell sends its values to every cell that reads it; a target's row has a column for each read. One shuffle, combined before
    it by hash aggregation: neighbours that lie in one task meet there, so little more than a row for each cell is shuffled."""
    full, low = _fields(cells, axes, outputs)
    if not any(r.offsets for r in full):  # nothing comes from other cells
        df, names = _operands(cells, axes, low, operands, boundary, extents)
        return _finish(df, axes, outputs, params or {}, names, boundary, c_int_division)
    slots = {(): 0}
    for r in full:
        slots.setdefault(r.offsets, len(slots))
    fields = sorted({r.grid.name for r in full})
    names: Names = {(r.grid.name, r.offsets): _name(r.grid.name, r.offsets) for r in full if r.offsets}
    sent = [F.struct(*[_moved(F.col(a), -dict(o).get(n, 0), boundary, extents and extents[n]).alias(a) for n, a in enumerate(axes)], F.lit(s).alias("_slot"), *fields) for o, s in slots.items()]
    got = [F.max(F.when(F.col("_slot") == slots[o], F.col(g))).alias(n) for (g, o), n in names.items()]
    own = [F.max(F.when(F.col("_slot") == 0, F.col(g))).alias(g) for g in fields]
    met = cells.select(F.inline(F.array(*sent))).groupBy(*axes).agg(*got, *own, F.min("_slot").alias("_own")).where("_own = 0")
    met, more = _operands(met, axes, low, operands, boundary, extents)
    return _finish(met, axes, outputs, params or {}, names | more, boundary, c_int_division)


def by_window(cells: DataFrame, axes: list[str], outputs: dict[str, Expr], params: dict | None = None, boundary: str = "zero", operands: dict[str, DataFrame] | None = None, c_int_division: bool = False) -> DataFrame:
    """One-row range frames along each axis's pencils, for star stencils. Pencils are cut into pieces of PENCIL cells; cells near a cut
    are lent to the piece beyond it, so a window holds at most PENCIL cells and twice the radius, however long the axis is."""
    full, low = _fields(cells, axes, outputs)
    names: Names = {}
    columns: dict[int, list[Ref]] = {}
    for r in full:
        if len(r.offsets) > 1:
            raise ValueError("a window reads along one axis only")
        if r.offsets:
            names[r.grid.name, r.offsets] = _name(r.grid.name, r.offsets)
            columns.setdefault(r.offsets[0][0], []).append(r)
    df = cells
    for n, found in sorted(columns.items()):
        a, reach = axes[n], max(abs(r.offsets[0][1]) for r in found)
        piece = F.sequence(F.floor((F.col(a) - reach) / PENCIL), F.floor((F.col(a) + reach) / PENCIL))
        lent = df.withColumn("_piece", F.explode(piece))
        over = Window.partitionBy(*[x for x in axes if x != a], "_piece").orderBy(a)
        got = [F.max(r.grid.name).over(over.rangeBetween(r.offsets[0][1], r.offsets[0][1])).alias(names[r.grid.name, r.offsets]) for r in found]
        df = lent.select("*", *got).where(F.col("_piece") == F.floor(F.col(a) / PENCIL)).drop("_piece")
    df, more = _operands(df, axes, low, operands, boundary, None)
    return _finish(df, axes, outputs, params or {}, names | more, boundary, c_int_division)


def by_join(cells: DataFrame, axes: list[str], outputs: dict[str, Expr], params: dict | None = None, boundary: str = "zero", extents: list[int] | None = None, operands: dict[str, DataFrame] | None = None, c_int_division: bool = False) -> DataFrame:
    """A left equi-join for each distinct offset, on shifted coordinates. For any reads and boundaries."""
    full, low = _fields(cells, axes, outputs)
    names: Names = {(r.grid.name, r.offsets): _name(r.grid.name, r.offsets) for r in full if r.offsets}
    df = cells
    for offsets in dict.fromkeys(o for _, o in names):
        at = [_moved(F.col(a), dict(offsets).get(n, 0), boundary, extents and extents[n]).alias(f"_{a}") for n, a in enumerate(axes)]
        other = cells.select(*[F.col(a).alias(f"_{a}") for a in axes], *[F.col(g).alias(n) for (g, o), n in names.items() if o == offsets])
        df = df.select("*", *at).join(other, [f"_{a}" for a in axes], "left").drop(*[f"_{a}" for a in axes])
    df, more = _operands(df, axes, low, operands, boundary, extents)
    return _finish(df, axes, outputs, params or {}, names | more, boundary, c_int_division)


def by_scatter(cells: DataFrame, axes: list[str], weights: dict[Offsets, float], name: str = "out", boundary: str = "zero", extents: list[int] | None = None, value: str = "v") -> DataFrame:
    """Each cell gives its weighted value to every cell that reads it; sums are pre-aggregated, then one shuffle. For weighted sums."""
    targets = []
    for offsets, w in weights.items():
        shift = dict(offsets)
        at = [(F.pmod(F.col(a) - shift.get(n, 0), F.lit(extents[n])) if boundary == "periodic" else F.col(a) - shift.get(n, 0)).cast("long").alias(a) for n, a in enumerate(axes)]
        targets.append(F.struct(*at, (F.col(value) * w).alias("w"), F.lit(not offsets).alias("own")))
    sums = cells.select(F.inline(F.array(*targets))).groupBy(*axes).agg(F.sum("w").alias(name), F.count("*").alias("_n"), F.max("own").alias("_own"))
    wanted = F.col("_own") if boundary != "interior" else F.col("_own") & (F.col("_n") == len(weights))
    return sums.where(wanted).select(*axes, name)


def by_blocks(cells: DataFrame, axes: list[str], weights: dict[Offsets, float], extents: list[int], steps: int = 1, block: int = 16, name: str = "out", boundary: str = "zero", kind: str = "double", value: str = "v") -> DataFrame:
    """Blocks with a halo of radius * steps, a numpy kernel run `steps` times on each: one shuffle for all steps. For weighted sums.

    A block is at most (block + 2 halo)^rank cells, whatever the data. The halo of a block is copied from its neighbours (the
    volume grows by ((block + 2 halo) / block)^rank). Outside the box `zero` cells stay 0 in every step.
    """
    rank = len(axes)
    halo = steps * max((abs(d) for o in weights for _, d in o), default=0)
    if boundary == "periodic" and any(halo > n for n in extents):
        raise ValueError("a periodic halo must not be wider than the box")
    placed = cells.select(*axes, F.col(value).alias("v"))
    for n, a in enumerate(axes):  # each cell goes to every block whose halo box holds it
        reach = []
        for wrap in ((-1, 0, 1) if boundary == "periodic" and halo else (0,)):
            at = F.col(a) + wrap * extents[n]
            low, high = F.ceil((at - halo - block + 1) / block), F.floor((at + halo) / block)
            last = (extents[n] - 1) // block
            low, high = F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(last)).cast("int")
            found = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            reach.append(F.arrays_zip(found.alias("b"), F.array_repeat(at, F.size(found)).alias("at")))
        placed = placed.withColumn("_r", F.explode(F.concat(*reach))).withColumn(f"b_{a}", F.col("_r.b")).withColumn(f"at_{a}", F.col("_r.at")).drop("_r")
    side = block + 2 * halo

    def run(pdf):
        import pandas as pd

        first = [int(pdf[f"b_{a}"].iloc[0]) * block for a in axes]
        box = np.zeros((side,) * rank, np.int64 if kind == "long" else np.float64)
        mask = np.zeros((side,) * rank, bool)
        where = tuple(pdf[f"at_{a}"].to_numpy() - f + halo for a, f in zip(axes, first, strict=True))
        box[where] = pdf["v"].to_numpy()
        mask[where] = True
        for _ in range(steps):
            nxt = np.zeros_like(box)
            for offsets, w in weights.items():
                shift = dict(offsets)
                to = tuple(slice(max(0, -shift.get(n, 0)), side - max(0, shift.get(n, 0))) for n in range(rank))
                of = tuple(slice(max(0, shift.get(n, 0)), side - max(0, -shift.get(n, 0))) for n in range(rank))
                nxt[to] += w * box[of]
            box = np.where(mask, nxt, 0)
        inner = tuple(slice(halo, halo + block) for _ in axes)
        own = mask[inner].copy()
        for n, f in enumerate(first):  # an edge block may also hold wrapped copies beyond the box
            own[tuple(slice(extents[n] - f, None) if m == n else slice(None) for m in range(rank))] = False
        at = np.nonzero(own)
        return pd.DataFrame({**{a: at[n] + first[n] for n, a in enumerate(axes)}, name: box[inner][at]})

    schema = ", ".join([*(f"{a} long" for a in axes), f"{name} {kind}"])
    return placed.groupBy(*[f"b_{a}" for a in axes]).applyInPandas(run, schema)


def _weights(outputs: dict[str, Expr], params: dict, axes: list[str]) -> dict[Offsets, float] | None:
    """The weights of the one output if it is a weighted sum of one grid of full rank."""
    if len(outputs) != 1 or any(r.grid.rank < len(axes) for r in reads(*outputs.values())):
        return None
    return linear(next(iter(outputs.values())), params)


def choose(outputs: dict[str, Expr], params: dict, axes: list[str], steps: int = 1, boundary: str = "zero", extents: list[int] | None = None, exact: bool = False) -> str:
    """blocks for wide or repeated sums in a known box, scatter for sums that are exact in any order (integers), join for clamped reads,
    gather for all else, which evaluates each expression in its own order. None puts an axis in one task."""
    if boundary == "clamp":
        return "join"
    weights = _weights(outputs, params, axes)
    wide = steps > 1 or radius(*outputs.values()) > 2 or len(reads(*outputs.values())) > 27
    if weights is not None and wide and extents and boundary != "interior":
        return "blocks"
    whole = weights is not None and all(isinstance(w, int) for w in weights.values())
    return "scatter" if exact and whole and not wide and radius(*outputs.values()) else "gather"


def apply(
    cells: DataFrame, axes: list[str], outputs: dict[str, Expr], params: dict | None = None, boundary: str = "zero", extents: list[int] | None = None,
    strategy: str | None = None, operands: dict[str, DataFrame] | None = None, block: int = 16, c_int_division: bool = False,
) -> DataFrame:
    """The outputs at every cell. Hints: the plan by name (else the chosen one), the block's edge, and integer division of literals."""
    params = params or {}
    if not strategy:
        held = dict(cells.dtypes)
        exact = all(held.get(r.grid.name) in ("tinyint", "smallint", "int", "bigint") for r in reads(*outputs.values()))
        strategy = choose(outputs, params, axes, 1, boundary, extents, exact)
    if strategy == "gather":
        return by_gather(cells, axes, outputs, params, boundary, extents, operands, c_int_division)
    if strategy == "window":
        return by_window(cells, axes, outputs, params, boundary, operands, c_int_division)
    if strategy == "join":
        return by_join(cells, axes, outputs, params, boundary, extents, operands, c_int_division)
    if (weights := _weights(outputs, params, axes)) is None:
        raise ValueError(f"the {strategy} plan takes one weighted sum of one grid")
    name, value = next(iter(outputs)), reads(*outputs.values())[0].grid.name
    if strategy == "scatter":
        return by_scatter(cells, axes, weights, name, boundary, extents, value)
    if strategy == "blocks":
        return by_blocks(cells, axes, weights, extents, 1, block, name, boundary, dict(cells.dtypes)[value].replace("bigint", "long"), value)
    raise ValueError(f"no plan {strategy}")
