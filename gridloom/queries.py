"""The engine's own queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from . import stencils as st
from .dsl import Func, Grid, If, Lit, linear, reads, to_sql
from .functions import direction_mask, direction_text, is_subset, morton, morton_axis, morton_set, negate, symmetric_difference
from .plans import apply, by_blocks, by_gather, by_join, by_scatter, by_window
from .sources import cells, from_key, random_cells
from .streaming import iterate, iterate_deep, shrinking

A3, A4 = ["i", "j", "k"], ["i", "j", "k", "l"]
CENTS = "CAST(ROUND(value*100) AS BIGINT)"
#: Events as cells; the last plane is ragged, and what it lacks lies outside the grid.
G3_SQL = f"g AS (SELECT event_id%16 i, (event_id//16)%16 j, event_id//256 k, {CENTS} v FROM events)"
G4_SQL = f"g AS (SELECT event_id%8 i, (event_id//8)%8 j, (event_id//64)%8 k, event_id//512 l, {CENTS} v FROM events)"
COEFF = {"coeff": [5, 1, 2, 3, 4, 6, 7], "shift": 25000}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def g3(spark: SparkSession, d: str) -> DataFrame:
    return from_key(table(spark, d, "events"), "event_id", [16, 16], F.round(F.col("value") * 100).cast("long"))


def g4(spark: SparkSession, d: str) -> DataFrame:
    return from_key(table(spark, d, "events"), "event_id", [8, 8, 8], F.round(F.col("value") * 100).cast("long"))


def planes(spark: SparkSession, d: str, plane: int = 256) -> int:
    """The planes of events, the ragged one too: its row count is in the files' footers."""
    return -(-table(spark, d, "events").count() // plane)


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def offsets_sql(weights: dict, axes: list[str], grid: str, divide: str = "", boundary: str = "zero") -> str:
    """A weighted sum as a join with a table of offsets: another form than any of the plans."""
    rank = len(axes)
    rows = ", ".join("(" + ", ".join(str(dict(o).get(n, 0)) for n in range(rank)) + f", {w})" for o, w in weights.items())
    names = ", ".join([f"d{a}" for a in axes] + ["w"])
    if boundary == "periodic":
        on = " AND ".join(f"n.{a} = (c.{a} + d{a} + 8 * m{a}) % m{a}" for a in axes)
        size = "s AS (SELECT " + ", ".join(f"max({a})+1 m{a}" for a in axes) + " FROM g), "
        return f"WITH {grid}, {size} o({names}) AS (VALUES {rows}) SELECT {', '.join('c.' + a for a in axes)}, CAST(sum(w * n.v) AS BIGINT){divide} AS out FROM g c CROSS JOIN o CROSS JOIN s JOIN g n ON {on} GROUP BY ALL"
    on = " AND ".join(f"n.{a} = c.{a} + d{a}" for a in axes)
    having = f" HAVING count(n.v) = {len(weights)}" if boundary == "interior" else ""
    return f"WITH {grid}, o({names}) AS (VALUES {rows}) SELECT {', '.join('c.' + a for a in axes)}, CAST(sum(w * coalesce(n.v, 0)) AS BIGINT){divide} AS out FROM g c CROSS JOIN o LEFT JOIN g n ON {on} GROUP BY {', '.join('c.' + a for a in axes)}{having}"


def reads_sql(outputs: dict, axes: list[str], grid: str, params: dict | None = None) -> str:
    """Any expressions, with a left join for each distinct read."""
    found = [r for r in reads(*outputs.values()) if r.offsets]
    name = {r.offsets: f"n{n}" for n, r in enumerate(found)}
    joins = " ".join(f"LEFT JOIN g {name[r.offsets]} ON " + " AND ".join(f"{name[r.offsets]}.{a} = c.{a} + ({dict(r.offsets).get(n, 0)})" for n, a in enumerate(axes)) for r in found)
    read = lambda r: f"coalesce({name[r.offsets]}.v, 0)" if r.offsets else "c.v"
    return f"WITH {grid} SELECT {', '.join('c.' + a for a in axes)}, " + ", ".join(f"{to_sql(e, read, params)} AS {n}" for n, e in outputs.items()) + f" FROM g c {joins}"


def _star(shells: list[int], rank: int = 3) -> dict:
    return linear(st.star(rank, shells), {})


def _scaled(df: DataFrame, by: float) -> DataFrame:
    return df.withColumn("out", F.col("out").cast("long") / by)


SEVEN = {"out": st.seven_weighted()}
query("stencil_7pt_weighted", offsets_sql(linear(SEVEN["out"], COEFF), A3, G3_SQL))(lambda s, d: apply(g3(s, d), A3, SEVEN, COEFF).withColumn("out", F.col("out").cast("long")))
query("stencil_7pt_sym", offsets_sql(_star([4, 1]), A3, G3_SQL, " / 10.0"))(lambda s, d: _scaled(apply(g3(s, d), A3, {"out": st.star(3, [4, 1])}), 10.0))
query("stencil_7pt_interior", offsets_sql(_star([4, 1]), A3, G3_SQL, " / 10.0", "interior"))(lambda s, d: _scaled(apply(g3(s, d), A3, {"out": st.star(3, [4, 1])}, boundary="interior"), 10.0))
query("stencil_cond", reads_sql({"out": st.conditional()}, A3, G3_SQL, COEFF))(lambda s, d: apply(g3(s, d), A3, {"out": st.conditional()}, COEFF))
query("stencil_27pt_true", offsets_sql(st.cube27(), A3, G3_SQL))(lambda s, d: by_scatter(g3(s, d), A3, st.cube27()))
query("stencil_27pt_fidelity", offsets_sql(st.cube27(True), A3, G3_SQL))(lambda s, d: by_scatter(g3(s, d), A3, st.cube27(True)))
query("stencil_13pt", offsets_sql(_star([40, 7, 3]), A3, G3_SQL, " / 100.0"))(lambda s, d: _scaled(apply(g3(s, d), A3, {"out": st.star(3, [40, 7, 3])}), 100.0))
_25 = [100, 60, 45, 30, 15]
query("stencil_25pt", offsets_sql(_star(_25), A3, G3_SQL, " / 1000.0"))(lambda s, d: _scaled(by_blocks(g3(s, d), A3, _star(_25), [16, 16, planes(s, d)], block=16, kind="long"), 1000.0))
query("stencil_125pt", offsets_sql(st.cube125(), A3, G3_SQL, " / 1000.0"))(lambda s, d: _scaled(by_blocks(g3(s, d), A3, st.cube125(), [16, 16, planes(s, d)], block=16, kind="long"), 1000.0))
query("stencil_4d_9pt", offsets_sql(_star([2, 1], 4), A4, G4_SQL, " / 10.0"))(lambda s, d: _scaled(apply(g4(s, d), A4, {"out": st.star(4, [2, 1])}), 10.0))
query("stencil_periodic_7pt", offsets_sql(_star([4, 1]), A3, G3_SQL, "", "periodic"))(lambda s, d: by_join(g3(s, d), A3, {"out": st.star(3, [4, 1])}, boundary="periodic", extents=[16, 16, planes(s, d)]).withColumn("out", F.col("out").cast("long")))
query("stencil_scatter_7pt", offsets_sql(_star([4, 1]), A3, G3_SQL))(lambda s, d: by_scatter(g3(s, d), A3, _star([4, 1])))

G2_SQL = "e AS (SELECT vec_id, unnest(embedding) x, generate_subscripts(embedding, 1) - 1 i FROM embeddings), g AS (SELECT CAST(i AS BIGINT) i, vec_id j, CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) v FROM e)"
G1_SQL = "g AS (SELECT o_orderkey i, CAST(round(o_totalprice * 100) AS BIGINT) v FROM orders)"


@query("stencil_2d_embeddings", offsets_sql(_star([4, 1], 2), ["i", "j"], G2_SQL))
def _embeddings(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("j"), F.posexplode("embedding").alias("i", "x"))
    grid = e.select(F.col("i").cast("long").alias("i"), "j", F.round(F.col("x").cast("double") * 1000000).cast("long").alias("v"))
    return by_gather(grid, ["i", "j"], {"out": st.star(2, [4, 1])}).withColumn("out", F.col("out").cast("long"))


@query("stencil_1d_orders", offsets_sql({(): 2, ((0, 1),): 1, ((0, -1),): 1}, ["i"], G1_SQL))
def _orders(s, d):
    # one axis has no other to be dealt by: the gather plan deals by cell, so no task holds the axis
    grid = table(s, d, "orders").select(F.col("o_orderkey").alias("i"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    g = Grid("v", 1)
    return apply(grid, ["i"], {"out": 2 * g(st.I) + g(st.I + 1) + g(st.I - 1)}).withColumn("out", F.col("out").cast("long"))


@query("window_1d_orders", offsets_sql({(): 2, ((0, 1),): 1, ((0, -1),): 1}, ["i"], G1_SQL))
def _orders_window(s, d):
    """The same by windows over pieces of the axis."""
    grid = table(s, d, "orders").select(F.col("o_orderkey").alias("i"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    g = Grid("v", 1)
    out = apply(grid, ["i"], {"out": 2 * g(st.I) + g(st.I + 1) + g(st.I - 1)}, strategy="window")
    return out.withColumn("out", F.col("out").cast("long"))


def _outputs() -> dict:
    g, mid = Grid("v", 3), Grid("mid", 3)
    first = g(*st.AXES3) * 2 + g(st.I + 1, st.J, st.K)
    mid(*st.AXES3).assign(first)
    return {"mid": first, "out": mid(*st.AXES3) + g(st.I - 1, st.J, st.K) * 3}


def _one(*parts) -> dict:
    return dict(parts)


V = Grid("v", 3)(*st.AXES3)
RIGHT = Grid("v", 3)(st.I + 1, st.J, st.K)
ARITH = _one(("a", (V + 7) * 3 - V), ("b", (V - RIGHT) / 4), ("c", V % 1000), ("d", -V + 1), ("e", (V * 2 + RIGHT) / 8))
BITS = _one(("a", V & 255), ("b", V | 1024), ("c", V ^ 4095), ("d", V << 3), ("e", V >> 2), ("f", ~V))
TESTS = _one(("a", If((V > 25000).logical_and(RIGHT > 25000), 1, 0)), ("b", If((V < 100).logical_or((V == RIGHT).logical_not()), V, RIGHT)), ("c", If(V & 1, V, -V)), ("d", If((V >= 1000).logical_and(V != 2000), 1, If(V <= 10, 2, 3))))
CALLS = _one(("a", Func("max", 2)(V, RIGHT)), ("b", Func("min", 2)(V - 25000, 0)), ("c", Func("abs", 1)(V - RIGHT)), ("d", Func("floor", 1)(V / 8)), ("e", Func("sqrt", 1)((V % 100) * (V % 100))))
X = V / 10000 + "0.1"
ROUND = Func("round", 2)
MATH = _one(
    ("a", ROUND(Func("exp", 1)(X / 8), 6)), ("b", ROUND(Func("log", 1)(X), 6)), ("c", ROUND(Func("sin", 1)(X), 6)), ("d", ROUND(Func("cos", 1)(X), 6)), ("e", ROUND(Func("tan", 1)(X / 100), 6)),
    ("f", ROUND(Func("pow", 2)(X, "1.37"), 5)), ("g", Func("ceil", 1)(V / 8)), ("h", Func("fabs", 1)(V - 25000)), ("m", Func("fmax", 2)(V, RIGHT)), ("n", Func("fmin", 2)(V, RIGHT)),
)
NAMED = _one(("a", ROUND(Func("atan2", 2)(V, RIGHT + 1), 6)), ("b", ROUND(Func("cbrt", 1)(V), 6)))
for _n, _o in (("multi_output", _outputs()), ("expr_arith", ARITH), ("expr_bitwise", BITS), ("expr_compare_logical", TESTS), ("expr_functions", CALLS), ("expr_math", MATH), ("expr_named_function", NAMED)):
    query(_n, reads_sql(_o, A3, G3_SQL))(lambda s, d, o=_o: apply(g3(s, d), A3, o))
query("plan_window_7pt", offsets_sql(_star([4, 1]), A3, G3_SQL))(lambda s, d: apply(g3(s, d), A3, {"out": st.star(3, [4, 1])}, strategy="window").withColumn("out", F.col("out").cast("long")))
query("plan_join_13pt", offsets_sql(_star([40, 7, 3]), A3, G3_SQL))(lambda s, d: apply(g3(s, d), A3, {"out": st.star(3, [40, 7, 3])}, strategy="join").withColumn("out", F.col("out").cast("long")))
DIVIDED = _one(("a", V * (Lit(7) / Lit(2))), ("b", V + Lit(-7) / Lit(2)))
query("expr_int_division", f"WITH {G3_SQL} SELECT i, j, k, v * 3 AS a, v - 3 AS b FROM g")(lambda s, d: apply(g3(s, d), A3, DIVIDED, c_int_division=True))


W1_SQL = "w AS (SELECT p_size % 16 i, CAST(sum(p_size) AS BIGINT) w FROM part GROUP BY 1)"


def _w(s, d):
    return table(s, d, "part").groupBy((F.col("p_size") % 16).cast("long").alias("i")).agg(F.sum("p_size").alias("w"))


@query("lower_rank_coeff", f"WITH {G3_SQL}, {W1_SQL} SELECT g.i, g.j, g.k, g.v * coalesce(w.w, 0) AS out FROM g LEFT JOIN w ON w.i = g.i")
def _lower(s, d):
    return apply(g3(s, d), A3, {"out": V * Grid("w", 1)(st.I)}, operands={"w": _w(s, d)})


LOWER = {"out": V * Grid("w", 1)(st.I + 1) + RIGHT * Grid("u", 2)(st.J, st.K - 1)}


@query(
    "lower_rank_join",
    f"""WITH {G3_SQL}, {W1_SQL}, u AS (SELECT j, k, max(v) u FROM g GROUP BY j, k)
SELECT g.i, g.j, g.k, g.v * coalesce(w.w, 0) + coalesce(r.v, 0) * coalesce(u.u, 0) AS out
FROM g LEFT JOIN w ON w.i = g.i + 1 LEFT JOIN g r ON r.i = g.i + 1 AND r.j = g.j AND r.k = g.k LEFT JOIN u ON u.j = g.j AND u.k = g.k - 1""",
)
def _lower_join(s, d):
    grid = g3(s, d)
    return apply(grid, A3, LOWER, strategy="join", operands={"w": _w(s, d), "u": grid.groupBy("j", "k").agg(F.max("v").alias("u"))})


def g3_two(s, d):
    """Two fields on one grid."""
    return g3(s, d).withColumn("u", F.col("v") % 1000 + F.col("i"))


U = Grid("u", 3)
TWO = {"a": st.star(3, [4, 1]) + 1000 * st.star(3, [2, 3], "u"), "b": V + U(*st.AXES3) * 100, "c": st.star(3, [0, 1], "u")}
TWO_SQL = G3_SQL.replace("g AS (", "h AS (") + ", g AS (SELECT *, v % 1000 + i u FROM h)"


def _two_sql() -> str:
    near = [(n, s) for n in range(3) for s in (1, -1)]
    on = lambda n, s: " AND ".join(f"n{n}{'p' if s > 0 else 'm'}.{a} = c.{a}{f' + {s}' if s > 0 and m == n else f' - {-s}' if m == n else ''}" for m, a in enumerate(A3))
    joins = " ".join(f"LEFT JOIN g n{n}{'p' if s > 0 else 'm'} ON {on(n, s)}" for n, s in near)
    total = lambda f: " + ".join(f"coalesce(n{n}{'p' if s > 0 else 'm'}.{f}, 0)" for n, s in near)
    return f"WITH {TWO_SQL} SELECT c.i, c.j, c.k, 4 * c.v + {total('v')} + 1000 * (2 * c.u + 3 * ({total('u')})) AS a, c.v + c.u * 100 AS b, {total('u')} AS c FROM g c {joins}"


for _n in ("gather", "window", "join"):
    query("two_fields_7pt" + ("" if _n == "gather" else f"_{_n}"), _two_sql())(lambda s, d, n=_n: apply(g3_two(s, d), A3, TWO, strategy=n))


def _steps_sql(steps: int, weights: dict, whole: bool = False) -> str:
    """whole: only cells that had all their neighbours in the step before."""
    having = f" HAVING count(n.v) = {len(weights)}" if whole else ""
    rows = ", ".join("(" + ", ".join(str(dict(o).get(n, 0)) for n in range(3)) + f", {w})" for o, w in weights.items())
    text = f"WITH {G3_SQL}, o(di, dj, dk, w) AS (VALUES {rows}), s0 AS (SELECT * FROM g)"
    for n in range(steps):
        text += f", s{n + 1} AS (SELECT c.i, c.j, c.k, CAST(sum(w * coalesce(n.v, 0)) AS BIGINT) v FROM s{n} c CROSS JOIN o LEFT JOIN s{n} n ON n.i = c.i + di AND n.j = c.j + dj AND n.k = c.k + dk GROUP BY c.i, c.j, c.k{having})"
    return text + f" SELECT i, j, k, v FROM s{steps}"


query("iterate_7pt_x4", _steps_sql(4, _star([4, 1])))(lambda s, d: iterate(g3(s, d), A3, st.star(3, [4, 1]), 4, extents=[16, 16, planes(s, d)], per_exchange=2))
query("iterate_7pt_x2_gather", _steps_sql(2, _star([4, 1])))(lambda s, d: iterate(g3(s, d), A3, st.star(3, [4, 1]), 2).withColumn("v", F.col("v").cast("long")))
query("iterate_deep_halo_x4", _steps_sql(4, _star([4, 1])))(lambda s, d: iterate_deep(g3(s, d), A3, st.star(3, [4, 1]), 4, [16, 16, planes(s, d)]))
query("iterate_shrinking_x2", _steps_sql(2, _star([4, 1]), True))(lambda s, d: shrinking(g3(s, d), A3, st.star(3, [4, 1]), 2).withColumn("v", F.col("v").cast("long")))


def _two_exchanges_sql() -> str:
    """Two steps of a 7-point and a 13-point stencil in turn, an exchange before each."""
    text = _steps_sql(0, {}).replace(", o(di, dj, dk, w) AS (VALUES )", "").replace(" SELECT i, j, k, v FROM s0", "")
    for n in range(4):
        weights = _star([4, 1]) if n % 2 == 0 else _star([5, 1, 1])
        rows = ", ".join("(" + ", ".join(str(dict(o).get(a, 0)) for a in range(3)) + f", {w})" for o, w in weights.items())
        text += f", o{n}(di, dj, dk, w) AS (VALUES {rows}), s{n + 1} AS (SELECT c.i, c.j, c.k, CAST(sum(w * coalesce(n.v, 0)) AS BIGINT) v FROM s{n} c CROSS JOIN o{n} LEFT JOIN s{n} n ON n.i = c.i + di AND n.j = c.j + dj AND n.k = c.k + dk GROUP BY c.i, c.j, c.k)"
    return text + " SELECT i, j, k, v FROM s4"


query("iterate_two_exchanges_x2", _two_exchanges_sql())(lambda s, d: iterate(g3(s, d), A3, [st.star(3, [4, 1]), st.star(3, [5, 1, 1])], 2).withColumn("v", F.col("v").cast("long")))

BLOCKED = "WITH " + G3_SQL + ", b AS (SELECT i//4 bi, j//4 bj, k//4 bk, (i%4) + 4*(j%4) + 16*(k%4) p, v FROM g)"
query("to_blocks", BLOCKED + " SELECT bi, bj, bk, string_agg(CAST(v AS VARCHAR), ',' ORDER BY p) AS vals FROM b GROUP BY bi, bj, bk")(lambda s, d: op.to_blocks(g3(s, d), A3, 4).select("bi", "bj", "bk", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("vals")))


query("blocks_roundtrip", f"WITH {G3_SQL} SELECT i, j, k, v FROM g")(lambda s, d: op.from_blocks(op.to_blocks(g3(s, d), A3, 4), A3, 4))
query(
    "block_average",
    "WITH " + G3_SQL + """, b AS (SELECT i//4 bi, j//4 bj, k//4 bk, (i%4)+4*(j%4)+16*(k%4) p, v FROM g),
o(x, y, z) AS (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1))
SELECT c.bi, c.bj, c.bk, c.p, sum(coalesce(n.v, 0)) / 7.0 AS v
FROM b c CROSS JOIN o LEFT JOIN b n ON n.bi = c.bi + x AND n.bj = c.bj + y AND n.bk = c.bk + z AND n.p = c.p GROUP BY c.bi, c.bj, c.bk, c.p""",
)(lambda s, d: op.block_average(op.to_blocks(g3(s, d), A3, 4), A3).withColumn("p", F.col("p").cast("long")))
query("block_add", BLOCKED + " SELECT bi, bj, bk, string_agg(CAST(2 * v AS VARCHAR), ',' ORDER BY p) AS vals FROM b GROUP BY bi, bj, bk")(
    lambda s, d: op.add_blocks(b := op.to_blocks(g3(s, d), A3, 4), b, ["bi", "bj", "bk"]).select("bi", "bj", "bk", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("vals"))
)
_ADJ = "WITH p AS (SELECT range p FROM range(64)), x AS (SELECT p, d AS dir, p%4 + d%3 - 1 a, (p//4)%4 + (d//3)%3 - 1 b, p//16 + d//9 - 1 c FROM p CROSS JOIN range(27) t(d))"
query("block_adjacency", _ADJ + " SELECT p + 1 AS block_id, CAST(dir AS INT) AS dir, CASE WHEN a BETWEEN 0 AND 3 AND b BETWEEN 0 AND 3 AND c BETWEEN 0 AND 3 THEN a + 4*b + 16*c + 1 ELSE 0 END AS neighbor_id FROM x")(lambda s, d: op.adjacency(s, [4, 4, 4]))
query("block_adjacency_linear", _ADJ + " SELECT p + 1 AS block_id, CAST(dir AS INT) AS dir, CASE WHEN a + 4*b + 16*c BETWEEN 0 AND 63 THEN a + 4*b + 16*c + 1 ELSE 0 END AS neighbor_id FROM x")(lambda s, d: op.adjacency(s, [4, 4, 4], per_axis=False))

Z_SQL = "WITH " + G3_SQL + ", z AS (SELECT i, j, k, CAST((SELECT sum((((i>>b)&1) << (3*b)) + (((j>>b)&1) << (3*b+1)) + (((k>>b)&1) << (3*b+2))) FROM range(16) t(b)) AS BIGINT) z FROM g)"
query("zorder_encode", Z_SQL + " SELECT i, j, k, z FROM z")(lambda s, d: g3(s, d).select("i", "j", "k", morton([F.col(a) for a in A3]).alias("z")))
query("zorder_decode", Z_SQL + " SELECT z, i, j, k FROM z")(lambda s, d: g3(s, d).select(morton([F.col(a) for a in A3]).alias("z")).select("z", *[morton_axis(F.col("z"), n, 3).alias(a) for n, a in enumerate(A3)]))
query("zorder_set_axis", Z_SQL.replace("((j>>b)", "((5>>b)") + " SELECT i, j, k, z FROM z")(lambda s, d: g3(s, d).select("i", "j", "k", morton_set(morton([F.col(a) for a in A3]), 1, F.lit(5), 3).alias("z")))

_DIRS = ", ".join(f"({n}, [{', '.join(map(str, sorted(s)))}]::INT[])" for n, s in enumerate(op.directions(3)))
_SIGNS = lambda c, n: f"(CASE {c} WHEN 1 THEN '{n}+' WHEN -1 THEN '{n}-' ELSE '' END)"
query(
    "directions",
    f"""SELECT CAST(9*(1-c) + 3*(1-b) + (1-a) AS INT) AS ord, '{{' || {_SIGNS('a', 1)} || {_SIGNS('b', 2)} || {_SIGNS('c', 3)} || '}}' AS dirs
FROM (VALUES (-1),(0),(1)) x(a), (VALUES (-1),(0),(1)) y(b), (VALUES (-1),(0),(1)) z(c)""",
)(lambda s, d: op.direction_frame(s, op.directions(3)).select("ord", direction_text(F.col("dirs")).alias("dirs")))


@query(
    "direction_sets",
    f"""WITH t(ord, dirs) AS (VALUES {_DIRS}), p AS (SELECT a.ord a, b.ord b, a.dirs x, b.dirs y, len(list_intersect(a.dirs, b.dirs)) n FROM t a CROSS JOIN t b)
SELECT a, b, CAST(n AS INT) AS both, CAST(len(x) + len(y) - n AS INT) AS either, CAST(len(x) + len(y) - 2 * n AS INT) AS apart, n = len(x) AS inside,
CAST(coalesce(list_sum(list_transform(x, lambda p: CASE WHEN p > 0 THEN 1::BIGINT << p ELSE 1::BIGINT << (31 - p) END)), 0) AS BIGINT) AS mask,
array_to_string(list_sort(list_transform(x, lambda p: -p)), ',') AS negated FROM p""",
)
def _direction_sets(s, d):
    t, x, y = op.direction_frame(s, op.directions(3)), F.col("x"), F.col("y")
    pairs = t.select(F.col("ord").alias("a"), F.col("dirs").alias("x")).crossJoin(t.select(F.col("ord").alias("b"), F.col("dirs").alias("y")))  # 27 by 27
    return pairs.select(
        "a", "b", F.size(F.array_intersect(x, y)).alias("both"), F.size(F.array_union(x, y)).alias("either"), F.size(symmetric_difference(x, y)).alias("apart"),
        is_subset(x, y).alias("inside"), direction_mask(x).alias("mask"), F.array_join(negate(x), ",").alias("negated"),
    )


def _runs_sql(order: list, d: int) -> str:
    cols = "abcd"[:d]
    rows = ", ".join(f"({n}, " + ", ".join(str(1 if x in s else -1 if -x in s else 0) for x in range(1, d + 1)) + ")" for n, s in enumerate(order))
    dirs = ", ".join(f"(VALUES (-1),(0),(1)) {c}_(n{c})" for c in cols)
    some = " OR ".join(f"n{c} <> 0" for c in cols)
    fits = " AND ".join(f"(n{c} = 0 OR s.{c} = -n{c})" for c in cols)
    names = ", ".join(f"n{c}" for c in cols)
    size = " + ".join(f"abs(n{c})" for c in cols)
    return f"""WITH s(pos, {', '.join(cols)}) AS (VALUES {rows}),
m AS (SELECT {names}, pos - row_number() OVER (PARTITION BY {names} ORDER BY pos) r FROM {dirs}, s WHERE ({some}) AND {fits}),
c AS (SELECT {names}, count(DISTINCT r) runs FROM m GROUP BY {names})
SELECT CAST({size} AS INT) AS axes, CAST(sum(runs) AS BIGINT) AS runs, count(*) AS neighbors FROM c GROUP BY 1"""


for _n, _d in (("good", 3), ("normal", 3), ("bad", 3), ("default", 4)):
    query(f"surface_runs_{_n}" + ("_4d" if _d == 4 else ""), _runs_sql(op.surface_order(_n, _d), _d))(lambda s, d, n=_n, r=_d: op.surface_runs(s, op.surface_order(n, r), r))

_GOOD = ", ".join(f"({n}, [{', '.join(map(str, sorted(s)))}]::INT[])" for n, s in enumerate(op.SURFACE_GOOD))
_GHOST = ", ".join(f"({n}, [{', '.join(map(str, sorted(s)))}]::INT[])" for n, s in enumerate([x for x in op.directions(3) if x]))
query(
    "region_layout",
    f"""WITH s(n, dirs) AS (VALUES {_GOOD}), h(n, dirs) AS (VALUES {_GHOST}),
r AS (SELECT 0 ord, 'null' kind, []::INT[] dirs, 1 len UNION ALL SELECT 1, 'interior', []::INT[], 216
UNION ALL SELECT 2 + n, 'surface', dirs, 6 ** (3 - len(dirs)) FROM s UNION ALL SELECT 28 + n, 'ghost', dirs, 8 ** (3 - len(dirs)) FROM h)
SELECT ord, kind, array_to_string(dirs, ',') AS dirs, CAST(sum(len) OVER (ORDER BY ord) - len AS BIGINT) AS pos, CAST(len AS BIGINT) AS len FROM r""",
)(lambda s, d: op.region_layout(s, [8, 8, 8], 1, op.surface_order("good")))
@query(
    "region_sizes",
    f"""WITH {G3_SQL}, m AS (SELECT max(k) + 1 n FROM g)
SELECT CASE WHEN i < 2 THEN -1 WHEN i >= 14 THEN 1 ELSE 0 END a, CASE WHEN j < 2 THEN -1 WHEN j >= 14 THEN 1 ELSE 0 END b,
CASE WHEN k < 1 THEN -1 WHEN k >= n - 1 THEN 1 ELSE 0 END c, count(*) AS cells FROM g, m GROUP BY ALL""",
)
def _region_sizes(s, d):
    side = lambda x, depth, size: F.when(F.col(x) < depth, -1).when(F.col(x) >= size - depth, 1).otherwise(0)
    keys = [side("i", 2, 16).alias("a"), side("j", 2, 16).alias("b"), side("k", 1, planes(s, d)).alias("c")]
    return g3(s, d).groupBy(*keys).agg(F.count("*").alias("cells"))


_OWNER = "CASE WHEN {z} < 4 * 13 THEN {z} // 13 ELSE 4 + ({z} - 4 * 13) // 12 END"
query(
    "section_owner",
    f"""WITH s AS (SELECT range sub_id FROM range(64)), r AS (SELECT sub_id, {_OWNER.format(z='sub_id')} AS rank FROM s)
SELECT sub_id, CAST(rank AS INT) AS rank, CAST(row_number() OVER (PARTITION BY rank ORDER BY sub_id) - 1 AS INT) AS local_idx FROM r""",
)(lambda s, d: op.section_owner(s.range(64).withColumnRenamed("id", "sub_id"), 64, 5))
_AX = lambda n: f"((z>>{n})&1) + 2*((z>>{n + 3})&1)"
_ENC = "((x&1) | ((y&1)<<1) | ((w&1)<<2) | ((x>>1)<<3) | ((y>>1)<<4) | ((w>>1)<<5))"
query(
    "neighbor_owner",
    f"""WITH z AS (SELECT range z FROM range(64)),
n AS (SELECT z, d, ({_AX(0)} + d%3 + 3) % 4 x, ({_AX(1)} + (d//3)%3 + 3) % 4 y, ({_AX(2)} + d//9 + 3) % 4 w FROM z CROSS JOIN range(27) t(d)),
e AS (SELECT z, d, {_ENC} m FROM n)
SELECT z AS sub_id, CAST(d AS INT) AS dir, m AS neighbor, CAST({_OWNER.format(z='m')} AS INT) AS rank FROM e""",
)(lambda s, d: op.neighbor_owner(s, 4, 5))

_HALO = f"""WITH {G3_SQL}, m AS (SELECT max(k) + 1 n FROM g), t AS (SELECT range - 2 a FROM range(20)), u AS (SELECT range - 2 a FROM range((SELECT n + 4 FROM m)))
SELECT x.a i, y.a j, z.a k, g.v FROM t x CROSS JOIN t y CROSS JOIN u z CROSS JOIN m JOIN g ON g.i = (x.a + 16) % 16 AND g.j = (y.a + 16) % 16 AND g.k = (z.a + n) % n"""
query("halo_put", _HALO)(lambda s, d: op.halo_put(g3(s, d), A3, [16, 16, planes(s, d)], 2))
query("halo_shift", _HALO)(lambda s, d: op.halo_shift(g3(s, d), A3, [16, 16, planes(s, d)], 2))
query("pack_region", f"WITH {G3_SQL} SELECT i, j, k, v FROM g WHERE i >= 14 AND j < 2")(lambda s, d: g3(s, d).where(op.section(A3, [16, 16, planes(s, d)], 2, (1, -2), inner=False)))
query("interior_cells", f"WITH {G3_SQL} SELECT i, j, k, v FROM g WHERE i BETWEEN 2 AND 13 AND j BETWEEN 2 AND 13")(lambda s, d: op.interior(g3(s, d), A3, [16, 16, None], 2))

_CMP = f"WITH {G3_SQL}, x AS (SELECT i, j, k, CAST(v AS DOUBLE) a, CAST(CASE WHEN v % 97 = 0 THEN v + 1 ELSE v END AS DOUBLE) b FROM g), y AS (SELECT *, coalesce(abs(a-b) < 1e-6 OR abs(a-b) < (abs(a)+abs(b))*1e-6, false) c FROM x)"


def _two(s, d):
    a = g3(s, d).withColumn("v", F.col("v").cast("double"))
    b = g3(s, d).withColumn("v", F.when(F.col("v") % 97 == 0, F.col("v") + 1).otherwise(F.col("v")).cast("double"))
    return op.compare(a, b, A3)


query("tolerance_compare", _CMP + " SELECT bool_and(c) AS same, count(*) AS cells, count(*) FILTER (NOT c) AS wrong FROM y")(lambda s, d: _two(s, d).agg(F.every("close").alias("same"), F.count("*").alias("cells"), F.count_if(~F.col("close")).alias("wrong")))
query("mismatch_list", _CMP + " SELECT i, j, k, a, b FROM y WHERE NOT c")(lambda s, d: _two(s, d).where(~F.col("close")).select("i", "j", "k", "a", "b"))
@query("rank_stats", f"WITH {G3_SQL} SELECT k AS rank, CAST(min(v) AS DOUBLE) AS min, round(avg(v), 6) AS avg, CAST(max(v) AS DOUBLE) AS max, round(coalesce(stddev_samp(v), 0), 4) AS sigma FROM g GROUP BY k")
def _rank_stats(s, d):
    found = op.stats(g3(s, d).withColumn("v", F.col("v").cast("double")).withColumnRenamed("k", "rank"), "v", ["rank"])
    return found.select("rank", "min", F.round("avg", 6).alias("avg"), "max", F.round("sigma", 4).alias("sigma"))


query("zero_grid", "SELECT a.range i, b.range j, c.range k, 0.0::DOUBLE v FROM range(16) a, range(16) b, range(16) c")(lambda s, d: cells(s, [16, 16, 16], 0.0))
query("random_grid", "WITH x AS (SELECT range id FROM range(4096)) SELECT id%16 i, (id//16)%16 j, id//256 k, ('0x' || substr(md5('42:' || id), 1, 13))::BIGINT / 4503599627370496.0 v FROM x")(lambda s, d: random_cells(s, [16, 16, 16]))
query("copy_grid", f"WITH {G3_SQL} SELECT i, j, k, v AS out FROM g")(lambda s, d: apply(g3(s, d), A3, {"out": V}))


_METRICS = "(1, 262144, 0.5, 0.05, 0.02, 0.03, 1048576), (2, 16777216, 1.25, 0.25, 0.125, 0.0, 33554432)"


@query(
    "derived_metrics",
    f"""WITH t(step, elements, calc, pack, call, wait, bytes) AS (VALUES {_METRICS}),
c AS (SELECT step, elements::BIGINT elements, calc::DOUBLE calc, pack::DOUBLE pack, call::DOUBLE call, wait::DOUBLE wait, bytes::BIGINT bytes FROM t)
SELECT *, elements * 1e-9 / (calc + pack + call + wait) AS gstencil_s, bytes * 1e-9 / (call + wait) AS gb_s, bytes * 1e-6 AS mb FROM c""",
)
def _derived(s, d):
    rows = [(1, 262144, 0.5, 0.05, 0.02, 0.03, 1048576), (2, 16777216, 1.25, 0.25, 0.125, 0.0, 33554432)]
    return op.derived_metrics(s.createDataFrame(rows, "step int, elements long, calc double, pack double, call double, wait double, bytes long"))


@query("throughput_metrics")
def _throughput(s, d):
    """Measured now: seconds and GStencil/s of one 7-point step."""
    import time

    grid, began = g3(s, d), time.time()
    n = apply(grid, A3, {"out": st.star(3, [4, 1])}).agg(F.count("out")).first()[0]
    took = time.time() - began
    return s.createDataFrame([("7pt", n, took, op.throughput(n, {"calc": took}))], "stencil string, cells long, seconds double, gstencil_s double")


from . import layout_queries  # noqa: E402, F401 - registers its queries


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
