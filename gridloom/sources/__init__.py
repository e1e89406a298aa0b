"""Grids from tables, and generated ones. A cell frame has a long column for each axis and value columns."""

from __future__ import annotations

import hashlib
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morton

AXES = ("i", "j", "k", "l")


def decode(key: Column, extents: list[int]) -> list[Column]:
    """Coordinates of a row-major key; the last axis is unbounded."""
    out, left = [], key
    for n in extents:
        out.append(F.pmod(left, F.lit(n)))
        left = F.floor(left / n)
    return [*out, left]


def from_key(df: DataFrame, key: str, extents: list[int], value: Column) -> DataFrame:
    """Rows with a dense 0-based key as cells. The last plane may be ragged: its missing cells are outside the grid, as those beyond
    its edges are."""
    return df.select(*[c.cast("long").alias(a) for a, c in zip(AXES, decode(F.col(key), extents), strict=False)], value.alias("v"))


def cells(spark: SparkSession, extents: list[int], value: Column | float = 0.0, start: int = 0) -> DataFrame:
    """All cells of a box; value may use the column `id`, the row-major key."""
    n = reduce(lambda a, b: a * b, extents, 1)
    value = F.lit(value) if isinstance(value, (int, float)) else value
    return spark.range(n).select(*[(c + start).cast("long").alias(a) for a, c in zip(AXES, decode(F.col("id"), extents[:-1]), strict=False)], value.alias("v"))


def random_cells(spark: SparkSession, extents: list[int], seed: int = 42) -> DataFrame:
    """Uniform numbers in [0, 1), the same for the same seed and key however the rows are dealt."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "id")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return cells(spark, extents, u)


def coefficients(n: int = 129, seed: int = 11) -> list[float]:
    """Uniform numbers in [0, 1) by position, to be passed as a parameter `coeff` and read as coeff[0], coeff[1], ..."""
    return [int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) / float(1 << 52) for i in range(n)]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where all tasks run in the driver's process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or f"file://{tempfile.mkdtemp(prefix='gridloom-')}").rstrip("/")


def write_cells(cells: DataFrame, axes: list[str], path: str, edge: int = 16, bits: int = 16) -> None:
    """Cells as Parquet, dealt and sorted by the Morton code of their block, so files and row groups hold compact boxes."""
    z = morton([F.pmod(F.floor(F.col(a) / edge), F.lit(1 << bits)) for a in axes], bits)
    cells.withColumn("z", z).repartitionByRange("z").sortWithinPartitions("z", *reversed(axes)).write.mode("overwrite").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("z")


def load_stencil(path: str):
    """What a stencil script calls STENCIL."""
    scope: dict = {}
    with open(path) as f:
        exec(compile(f.read(), path, "exec"), scope)  # noqa: S102
    return scope["STENCIL"]
