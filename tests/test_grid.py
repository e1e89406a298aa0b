"""Expressions, plan equivalence, properties of stencils and the queries against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import operators as op
from gridloom import queries as q
from gridloom import stencils as st
from gridloom.dsl import Func, Grid, If, Index, Lit, linear, radius, walk
from gridloom.operators.decomposition import Decomposition
from gridloom.plans import apply, by_blocks, by_gather, by_join, by_scatter, by_window, choose
from gridloom.sources import cells
from gridloom.streaming import iterate, iterate_deep

SF = "/root/testdata/sf0.001"
A3 = ["i", "j", "k"]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def cube(spark):
    return cells(spark, [6, 6, 6], F.pmod(F.col("id") * 7919, F.lit(1024)).cast("long")).cache()


def test_expression_errors():
    i, g = Index(0), Grid("g", 1)
    with pytest.raises(ValueError):
        Func("max", 2)(1)
    with pytest.raises(ValueError):
        g(i, i)
    g(i + 1).assign(3)  # offsets on the left say nothing
    with pytest.raises(ValueError):
        g(i + 1)
    with pytest.raises(TypeError):
        i * 2  # noqa: B018


def test_division_is_not_distributed():
    v = Grid("v", 1)
    assert linear((v(Index(0)) + v(Index(0) + 1)) / 4, {}) == {(): 0.25, ((0, 1),): 0.25}
    assert radius(If(v(Index(0) - 3) > 0, 1, 2)) == 3


def test_plans_agree(spark, cube):
    expr = st.star(3, [4, 1])
    w = linear(expr, {})
    want = rows(by_window(cube, A3, {"out": expr}), *A3, "out")
    assert rows(by_gather(cube, A3, {"out": expr}), *A3, "out") == want
    assert rows(by_join(cube, A3, {"out": expr}), *A3, "out") == want
    assert rows(by_scatter(cube, A3, w), *A3, "out") == want
    assert rows(by_blocks(cube, A3, w, [6, 6, 6], block=4, kind="long"), *A3, "out") == want


def test_periodic_plans_and_mass(cube):
    w = linear(st.star(3, [4, 1]), {})
    a = rows(by_join(cube, A3, {"out": st.star(3, [4, 1])}, boundary="periodic", extents=[6, 6, 6]), *A3, "out")
    assert a == rows(by_gather(cube, A3, {"out": st.star(3, [4, 1])}, boundary="periodic", extents=[6, 6, 6]), *A3, "out")
    assert a == rows(by_scatter(cube, A3, w, boundary="periodic", extents=[6, 6, 6]), *A3, "out")
    assert a == rows(by_blocks(cube, A3, w, [6, 6, 6], block=4, boundary="periodic", kind="long"), *A3, "out")
    assert sum(r[3] for r in a) == 10 * sum(r["v"] for r in cube.collect())


def test_deep_halo_equals_steps(cube):
    a = iterate(cube, A3, st.star(3, [4, 1]), 3).withColumn("v", F.col("v").cast("long"))
    assert rows(a, *A3, "v") == rows(iterate_deep(cube, A3, st.star(3, [4, 1]), 3, [6, 6, 6], block=4), *A3, "v")


def test_numpy_125(cube):
    x = np.zeros((10, 10, 10), np.int64)
    for r in cube.collect():
        x[r["i"] + 2, r["j"] + 2, r["k"] + 2] = r["v"]
    want = sum(w * np.roll(x, [-dict(o).get(n, 0) for n in range(3)], (0, 1, 2)) for o, w in st.cube125().items())
    got = by_blocks(cube, A3, st.cube125(), [6, 6, 6], block=4, kind="long").collect()
    assert all(want[r["i"] + 2, r["j"] + 2, r["k"] + 2] == r["out"] for r in got) and len(got) == 216
    assert sum(st.cube125().values()) == 1000


def test_sparse_axis(spark):
    line = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (3, 0, 5)], "i long, j long, v long")
    g = Grid("v", 2)
    out = by_window(line, ["i", "j"], {"out": g(Index(0), Index(1)) + g(Index(0) + 1, Index(1))})
    assert rows(out, "i", "out") == [(0, 3), (1, 2), (3, 5)]


def test_two_grids_are_two_columns(spark):
    v, u, i = Grid("v", 1), Grid("u", 1), Index(0)
    line = spark.createDataFrame([(n, 1, 10) for n in range(5)], "i long, v long, u long")
    both = {"out": v(i) + u(i) * 100 + u(i + 1) * 1000}
    assert linear(v(i) + v(i), {}) == {(): 2} and linear(v(i) + u(i), {}) is None
    want = [(n, 1001 + (10_000 if n < 4 else 0)) for n in range(5)]
    for plan in ("gather", "window", "join"):
        assert rows(apply(line, ["i"], both, strategy=plan), "i", "out") == want
    with pytest.raises(ValueError):
        apply(line, ["i"], both, strategy="scatter")
    with pytest.raises(ValueError):
        apply(line, ["i"], {"out": Grid("w", 1)(i)})


def test_no_plan_puts_an_axis_in_one_task(spark):
    line = spark.range(300).selectExpr("id i", "id * id v")
    g, i = Grid("v", 1), Index(0)
    out = {"out": g(i + 2) - g(i - 1)}
    want = [(n, ((n + 2) ** 2 if n < 298 else 0) - ((n - 1) ** 2 if n else 0)) for n in range(300)]
    assert choose(out, {}, ["i"]) == "gather"
    for plan in ("gather", "window"):
        df = apply(line, ["i"], out, strategy=plan)
        assert rows(df, "i", "out") == want
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_operands_in_every_plan(spark, cube):
    w = spark.createDataFrame([(n, 10 + n) for n in range(6)], "j long, w long")
    expr = {"out": Grid("v", 3)(*st.AXES3) * Grid("w", 1)(Index(1) + 1)}
    want = sorted((r["i"], r["j"], r["k"], r["v"] * (11 + r["j"] if r["j"] < 5 else 0)) for r in cube.collect())
    for plan in ("gather", "window", "join"):
        assert rows(apply(cube, A3, expr, strategy=plan, operands={"w": w}), *A3, "out") == want
    wrapped = apply(cube, A3, expr, boundary="periodic", extents=[6, 6, 6], operands={"w": w})
    assert rows(wrapped, *A3, "out") == sorted((r["i"], r["j"], r["k"], r["v"] * (10 + (r["j"] + 1) % 6)) for r in cube.collect())


def test_blocks_keep_places(spark):
    missing = spark.createDataFrame([(0, 0, 5), (1, 1, 7), (1, 1, 3), (3, 0, None)], "i long, j long, v long")
    blocks = op.to_blocks(missing, ["i", "j"], 2)
    assert {(r.bi, r.bj): r.v for r in blocks.collect()} == {(0, 0): [5, None, None, 7], (1, 0): [None] * 4}
    assert rows(op.from_blocks(blocks, ["i", "j"], 2), "i", "j", "v") == [(0, 0, 5), (1, 1, 7)]


def test_decomposition_objects(spark):
    with pytest.raises(ValueError):
        Decomposition([64, 64, 64], 8, 16, op.surface_order("good"))
    with pytest.raises(ValueError):
        Decomposition([60, 64, 64], 8, 8, op.surface_order("good"))
    with pytest.raises(ValueError):
        Decomposition([8, 64, 64], 8, 8, op.surface_order("good"))
    d = Decomposition([64, 64, 64], 8, 8, op.surface_order("good"))
    assert d.separators() == (217, 513, 1001)
    ids = [r.block_id for r in d.index(spark).collect()]
    assert sorted(ids) == list(range(1, 1001))
    for name, runs in (("good", 42), ("normal", 62), ("bad", 98)):
        d = Decomposition([64, 64, 64], 8, 8, op.surface_order(name), 4)
        assert d.exchanges(spark).count() == runs
        assert all(r.start % 4 == 0 and r.stop % 4 == 0 for r in d.layout(spark).collect())


def test_timing_and_walk():
    calls = []
    n, took = op.timed(lambda: calls.append(1), 0.001)
    assert n & (n - 1) == 0 and took >= 0.001 and len(calls) >= n + 1
    assert sum(1 for _ in walk(If(Lit(1) > 0, Lit(2), -Lit(3)))) == 7


def test_long_iterations_need_a_shared_folder(cube, monkeypatch):
    g = Grid("v", 3)(*st.AXES3)
    once = iterate(cube, A3, [g + 1], 3, checkpoint_every=2)
    assert rows(once, *A3, "v") == sorted((r["i"], r["j"], r["k"], r["v"] + 3) for r in cube.collect())


def test_decomposition(spark, cube):
    for name, runs in (("good", 42), ("normal", 62), ("bad", 98)):
        assert sum(r["runs"] for r in op.surface_runs(spark, op.surface_order(name), 3).collect()) == runs
    assert sum(r["runs"] for r in op.surface_runs(spark, op.surface_order("default", 4), 4).collect()) == 312
    d = op.directions(3)
    assert d[13] == () and all(tuple(-p for p in d[n]) == d[26 - n] for n in range(27))
    layout = op.region_layout(spark, [8, 8, 8], 1, op.surface_order("good"))
    size = {r["kind"]: r["n"] for r in layout.groupBy("kind").agg(F.sum("len").alias("n")).collect()}
    assert size == {"null": 1, "interior": 216, "surface": 296, "ghost": 488}
    adj = {(r["block_id"], r["dir"]): r["neighbor_id"] for r in op.adjacency(spark, [4, 4, 4]).collect()}
    assert len(adj) == 1728 and sum(v == 0 for v in adj.values()) == 728
    assert all(adj[v, 26 - s] == b for (b, s), v in adj.items() if v)
    assert rows(op.halo_put(cube, A3, [6, 6, 6], 2), *A3, "v") == rows(op.halo_shift(cube, A3, [6, 6, 6], 2), *A3, "v")
    assert rows(op.from_blocks(op.to_blocks(cube, A3, 3), A3, 3), *A3, "v") == rows(cube, *A3, "v")


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "embeddings", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.queries()[name](spark, SF)
    r = con.execute(q.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda t: tuple(round(x, 9) if isinstance(x, float) else x for x in t)
    assert sorted((key(x) for x in r.fetchall()), key=repr) == sorted((key(x[n] for n in names) for x in df.collect()), key=repr)
