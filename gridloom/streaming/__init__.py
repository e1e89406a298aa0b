"""Bounded time stepping; steps are a batch loop, or fused in deep halos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl import Expr, linear
from ..plans import by_blocks, by_gather


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by checkpoint() to the folder that all executors share."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("long iterations cut their lineage: set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def iterate(
    cells: DataFrame, axes: list[str], expr: Expr | list[Expr], steps: int, params: dict | None = None, checkpoint_every: int = 8,
    extents: list[int] | None = None, per_exchange: int = 4, block: int = 16, kind: str = "long",
) -> DataFrame:
    """The expressions in turn, `steps` times over, each reading what the one before gave.

    A single weighted sum in a known box runs `per_exchange` steps in one shuffle, with halos as deep as these reach; anything else
    has a shuffle for each expression. Lineage is cut after every checkpoint_every shuffles.
    """
    parts, shuffles = expr if isinstance(expr, list) else [expr], 0
    weights = linear(parts[0], params or {}) if len(parts) == 1 and extents else None
    done = 0
    while done < steps:
        n = min(per_exchange, steps - done) if weights else 1
        done += n
        for part in parts:
            cells = by_blocks(cells, axes, weights, extents, n, block, "v", "zero", kind) if weights else by_gather(cells, axes, {"v": part}, params)
            shuffles += 1
            if shuffles % checkpoint_every == 0 and done < steps:
                cells = checkpointed(cells)
    return cells


def iterate_deep(cells: DataFrame, axes: list[str], expr: Expr, steps: int, extents: list[int], params: dict | None = None, block: int = 16, boundary: str = "zero", kind: str = "long") -> DataFrame:
    """All steps in one shuffle: halos as deep as they reach."""
    return by_blocks(cells, axes, linear(expr, params or {}), extents, steps, block, "v", boundary, kind)


def shrinking(cells: DataFrame, axes: list[str], expr: Expr, steps: int, params: dict | None = None) -> DataFrame:
    """Steps without a halo exchange: a step's result is valid where all its reads were, so the region shrinks by the radius."""
    for _ in range(steps):
        cells = by_gather(cells, axes, {"v": expr}, params, "interior").withColumn("v", F.col("v"))
    return cells
