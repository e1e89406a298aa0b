"""Queries of the block layout, the decomposition and the exchange between subdomains, with their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from . import operators as op
from .dsl import Const, Grid
from .functions import direction_parse, direction_text, flip, holds, is_superset
from .operators import decomposition as dec
from .plans import apply
from .queries import A3, G3_SQL, g3, planes, query
from .sources import cells, coefficients, load_stencil, read_cells, shared_folder, write_cells
from .stencils import AXES3

# ---------------------------------------------------------------- arrays and blocks
_PAIR = f"WITH {G3_SQL}, b AS (SELECT i, j, k, CASE WHEN v % 89 = 0 THEN v + 1 ELSE v END w FROM g WHERE v % 83 <> 0)"


def _both(s, d):
    grid = g3(s, d).withColumn("v", F.col("v").cast("double"))
    other = grid.where("CAST(v AS BIGINT) % 83 <> 0").withColumn("v", F.when(F.col("v").cast("long") % 89 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return grid, op.to_blocks(other, A3, 4)


query("paired_cells", _PAIR + " SELECT g.i, g.j, g.k, g.v::DOUBLE AS a, b.w::DOUBLE AS b FROM g LEFT JOIN b USING (i, j, k)")(lambda s, d: op.paired(*_both(s, d), A3, 4))
query("paired_lambda", _PAIR + " SELECT g.i, g.j, g.k, g.v * 2.0 - b.w AS out FROM g JOIN b USING (i, j, k)")(lambda s, d: op.each_pair(*_both(s, d), A3, 4, lambda a, b: a * 2 - b))
query(
    "compare_array_blocks",
    _PAIR + """, c AS (SELECT g.v::DOUBLE a, b.w::DOUBLE b FROM g LEFT JOIN b USING (i, j, k))
SELECT count(*) AS cells, count(*) FILTER (NOT coalesce(abs(a - b) < 1e-6 OR abs(a - b) < (abs(a) + abs(b)) * 1e-6, false)) AS wrong FROM c""",
)(lambda s, d: op.compare_blocks(*_both(s, d), A3, 4).agg(F.count("*").alias("cells"), F.count_if(~F.col("close")).alias("wrong")))


def _numbered(s, d):
    extents = [4, 4, -(-planes(s, d) // 4)]
    return op.numbered_blocks(op.to_blocks(g3(s, d), A3, 4), A3, extents), op.adjacency(s, extents)


_NUM = "WITH " + G3_SQL + ", b AS (SELECT 1 + i//4 + 4*(j//4) + 16*(k//4) block_id, (i%4) + 4*(j%4) + 16*(k%4) p, * FROM g)"
for _n, (_x, _y, _z) in enumerate(((1, -2, 3), (4, 0, -4), (0, 0, 0))):
    query(
        f"read_across_{_n}",
        _NUM + f""" SELECT c.block_id, CAST(c.p AS INT) AS p,
CAST((c.i%4 + {_x} + 4)//4 + 3*((c.j%4 + {_y} + 4)//4) + 9*((c.k%4 + {_z} + 4)//4) AS INT) AS dir,
CAST((c.i + {_x} + 16)%4 + 4*((c.j + {_y} + 16)%4) + 16*((c.k + {_z} + 16)%4) AS INT) AS q, n.v
FROM b c LEFT JOIN g n ON n.i = c.i + {_x} AND n.j = c.j + {_y} AND n.k = c.k + {_z}""",
    )(lambda s, d, o=(_x, _y, _z): op.read_across(*_numbered(s, d), A3, 4, list(o)))
query(
    "neighbor_blocks",
    _NUM + """, s AS (SELECT block_id, min(i//4) x, min(j//4) y, min(k//4) z, sum(v) total FROM b GROUP BY block_id), d AS (SELECT range dir FROM range(27))
SELECT c.block_id, CAST(dir AS INT) AS dir, n.block_id AS neighbor_id, CAST(n.total AS BIGINT) AS total
FROM s c CROSS JOIN d JOIN s n ON n.x = c.x + dir%3 - 1 AND n.y = c.y + (dir//3)%3 - 1 AND n.z = c.z + dir//9 - 1""",
)(lambda s, d: op.neighbor_blocks(*_numbered(s, d)).select("block_id", "dir", "neighbor_id", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("total")))


@query("sink_roundtrip", f"WITH {G3_SQL} SELECT i, j, k, v FROM g")
def _sink(s, d):
    """Written in Morton order to the shared folder, and read again."""
    path = f"{shared_folder(s)}/cells-{uuid.uuid4().hex[:12]}"
    write_cells(g3(s, d), A3, path, 4)
    return read_cells(s, path)


@query("stencil_script", f"WITH {G3_SQL} SELECT c.i, c.j, c.k, 3 * c.v + coalesce(r.v, 0) - coalesce(b.v, 0) AS out FROM g c LEFT JOIN g r ON r.i = c.i + 1 AND r.j = c.j AND r.k = c.k LEFT JOIN g b ON b.i = c.i AND b.j = c.j AND b.k = c.k - 2")
def _script(s, d):
    """A stencil from a script that defines STENCIL."""
    return apply(g3(s, d), A3, load_stencil(os.path.join(os.path.dirname(__file__), "scripts", "upwind.py")))


_HEX = "('0x' || substr(md5('11:' || range), 1, 13))::BIGINT / 4503599627370496.0"
query("coefficients_129", f"SELECT CAST(range AS INT) AS idx, {_HEX} AS w FROM range(129)")(lambda s, d: s.createDataFrame(list(enumerate(coefficients())), "idx int, w double"))
query(
    "stencil_coefficients",
    f"WITH {G3_SQL}, w AS (SELECT range n, {_HEX} w FROM range(129)) SELECT c.i, c.j, c.k, round(c.v * (SELECT w FROM w WHERE n = 128) + coalesce(r.v, 0) * (SELECT w FROM w WHERE n = 5), 6) AS out FROM g c LEFT JOIN g r ON r.i = c.i + 1 AND r.j = c.j AND r.k = c.k",
)(
    lambda s, d: apply(g3(s, d), A3, {"out": Grid("v", 3)(*AXES3) * Const("coeff[128]") + Grid("v", 3)(AXES3[0] + 1, *AXES3[1:]) * Const("coeff[5]")}, {"coeff": coefficients()}).withColumn("out", F.round("out", 6))
)

# ---------------------------------------------------------------- direction sets
_D3 = ", ".join(f"({n}, [{', '.join(map(str, sorted(s)))}]::INT[])" for n, s in enumerate(op.directions(3)))
_TEXT = "'{' || coalesce(array_to_string(list_transform(list_sort(list_transform(dirs, lambda p: abs(p) * 10 + CASE WHEN p > 0 THEN 1 ELSE 0 END)), lambda q: (q // 10)::VARCHAR || CASE WHEN q % 10 = 1 THEN '+' ELSE '-' END), ''), '') || '}'"
query(
    "direction_algebra",
    f"""WITH t(ord, dirs) AS (VALUES {_D3}) SELECT ord, {_TEXT} AS text, array_to_string(dirs, ',') AS parsed,
array_to_string(list_sort(CASE WHEN list_contains(dirs, 2) THEN list_filter(dirs, lambda p: p <> 2) ELSE list_append(dirs, 2) END), ',') AS flipped,
list_contains(dirs, -3) AS holds, list_contains(dirs, 1) AND list_contains(dirs, -3) AS above, CAST(len(dirs) AS INT) AS size FROM t""",
)(
    lambda s, d: op.direction_frame(s, op.directions(3)).withColumn("text", direction_text(F.col("dirs"))).select(
        "ord", "text", F.array_join(direction_parse(F.col("text")), ",").alias("parsed"), F.array_join(flip(F.col("dirs"), 2), ",").alias("flipped"),
        holds(F.col("dirs"), -3).alias("holds"), is_superset(F.col("dirs"), F.array(F.lit(1), F.lit(-3))).alias("above"), F.size("dirs").alias("size"),
    )
)

# ---------------------------------------------------------------- decomposition
_SHAPE, _EDGE = [64, 48, 32], 8
_BLOCKS = [n // _EDGE for n in _SHAPE]


def _decomposition(page: int, order: str = "good") -> dec.Decomposition:
    return dec.Decomposition(_SHAPE, _EDGE, _EDGE, op.surface_order(order), page)


def _layout_ctes(page: int, order: str) -> str:
    """q: the surface regions with their sizes and padding; seg: every stored region from `start` on."""
    rows = ", ".join(f"({n}, [{', '.join(map(str, sorted(s)))}]::INT[])" for n, s in enumerate(op.surface_order(order)))
    size = " * ".join(f"(CASE WHEN list_contains(dirs, {a}) OR list_contains(dirs, -{a}) THEN 1 ELSE {n - 2} END)" for a, n in enumerate(_BLOCKS, 1))
    inner = 1
    for n in _BLOCKS:
        inner *= n - 2
    return f"""s(n, dirs) AS (VALUES {rows}), d(n, dirs) AS (VALUES {_D3}),
f AS (SELECT *, len(list_intersect(coalesce(lag(dirs) OVER w, []), dirs)) < len(list_intersect(dirs, coalesce(lead(dirs) OVER w, []))) AS pad_first, {size} AS len FROM s WINDOW w AS (ORDER BY n)),
q AS (SELECT *, ({page} - len % {page}) % {page} AS pad FROM f WHERE len(dirs) > 0),
u AS (SELECT 0 AS kind, -1 AS a, -1 AS b, []::INT[] AS owner, []::INT[] AS region, {inner} AS len, {-inner % page} AS pad, false AS pad_first
UNION ALL SELECT 1, -1, n, [], dirs, len, pad, pad_first FROM q
UNION ALL SELECT 2, d.n, q.n, d.dirs, q.dirs, q.len, q.pad, q.pad_first FROM d, q WHERE len(d.dirs) > 0 AND len(list_intersect(list_transform(d.dirs, lambda p: -p), q.dirs)) = len(d.dirs)),
seg AS (SELECT *, {page} + coalesce(sum(len + pad) OVER (ORDER BY kind, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)"""


_KINDS = "CASE kind WHEN 0 THEN 'interior' WHEN 1 THEN 'surface' ELSE 'ghost' END"
for _page, _order in ((1, "good"), (4, "good"), (4, "bad"), (3, "normal")):
    query(
        f"layout_{_order}_page{_page}",
        f"WITH {_layout_ctes(_page, _order)} SELECT CAST(row_number() OVER (ORDER BY kind, a, b) - 1 AS INT) AS ord, {_KINDS} AS kind, array_to_string(owner, ',') AS owner, array_to_string(region, ',') AS region, CAST(start AS BIGINT) AS start, CAST(start + CASE WHEN pad_first THEN pad ELSE 0 END AS BIGINT) AS pos, CAST(len AS BIGINT) AS len, CAST(start + len + pad AS BIGINT) AS stop FROM seg",
    )(lambda s, d, p=_page, o=_order: _decomposition(p, o).layout(s).withColumn("owner", F.array_join("owner", ",")).withColumn("region", F.array_join("region", ",")))
    query(
        f"exchanges_{_order}_page{_page}",
        f"""WITH {_layout_ctes(_page, _order)}, g AS (SELECT *, b - row_number() OVER (PARTITION BY a ORDER BY b) AS run FROM seg WHERE kind = 2),
r AS (SELECT a, owner, min(b) AS st, max(b) + 1 AS ed, min(start) AS ghost_pos, sum(len + pad) AS len FROM g GROUP BY a, owner, run)
SELECT CAST(row_number() OVER (ORDER BY r.a, st) - 1 AS INT) AS ord, array_to_string(r.owner, ',') AS neighbor, CAST(st AS INT) AS skin_st, CAST(ed AS INT) AS skin_ed,
CAST(f.start AS BIGINT) AS surface_pos, CAST(ghost_pos AS BIGINT) AS ghost_pos, CAST(r.len AS BIGINT) AS len FROM r JOIN seg f ON f.kind = 1 AND f.b = r.st""",
    )(lambda s, d, p=_page, o=_order: _decomposition(p, o).exchanges(s).withColumn("neighbor", F.array_join("neighbor", ",")))


def _index_sql(page: int, order: str) -> str:
    code = lambda column: "CAST(coalesce(list_sum(list_transform(" + column + ", lambda p: (CASE WHEN p > 0 THEN 1 ELSE 2 END) * CAST(3 ** (abs(p) - 1) AS INT))), 0) AS INT)"
    at, side, part = [], [], []
    for n, size in enumerate(_BLOCKS):
        at.append(f"(SELECT range - 1 b{n} FROM range({size + 2})) t{n}")
        side.append(f"{3**n} * (CASE WHEN b{n} < 0 THEN 2 WHEN b{n} >= {size} THEN 1 ELSE 0 END)")
        part.append(f"{3**n} * (CASE WHEN (b{n} + {size}) % {size} < 1 THEN 2 WHEN (b{n} + {size}) % {size} >= {size - 1} THEN 1 ELSE 0 END)")
    return f"""WITH {_layout_ctes(page, order)}, x AS (SELECT b0, b1, b2, {' + '.join(side)} AS o, {' + '.join(part)} AS r FROM {', '.join(at)}),
y AS (SELECT {code('owner')} AS o, {code('region')} AS r, start + CASE WHEN pad_first THEN pad ELSE 0 END AS pos FROM seg)
SELECT b0, b1, b2, CAST(pos + row_number() OVER (PARTITION BY x.o, x.r ORDER BY b2, b1, b0) - 1 AS BIGINT) AS block_id FROM x JOIN y ON y.o = x.o AND y.r = x.r"""


query("block_index", _index_sql(1, "good"))(lambda s, d: _decomposition(1).index(s))
query("block_index_page4", _index_sql(4, "good"))(lambda s, d: _decomposition(4).index(s))

# ---------------------------------------------------------------- ranks
query(
    "neighbor_ranks",
    f"""WITH r AS (SELECT range rank, range // 10 x, (range // 5) % 2 y, range % 5 z FROM range(30)), d(n, dirs) AS (VALUES {_D3}),
c AS (SELECT n, dirs, [CASE WHEN list_contains(dirs, a) THEN -1 WHEN list_contains(dirs, -a) THEN 1 ELSE 0 END for a in [3, 2, 1]] AS t FROM d)
SELECT rank, array_to_string(dirs, ',') AS dirs, CAST((x + t[1] + 3) % 3 * 10 + (y + t[2] + 2) % 2 * 5 + (z + t[3] + 5) % 5 AS BIGINT) AS neighbor FROM r, c""",
)(lambda s, d: dec.neighbor_ranks(s, [3, 2, 5]).withColumn("dirs", F.array_join("dirs", ",")))
query(
    "uneven_split",
    """WITH r AS (SELECT range rank, [range % 5, (range // 5) % 2, range // 10] ats FROM range(30)), e(axis, blocks, parts) AS (VALUES (0, 13, 5), (1, 7, 2), (2, 8, 3))
SELECT rank, axis, CAST((blocks // parts + CASE WHEN ats[axis + 1] < blocks % parts THEN 1 ELSE 0 END) * 8 AS BIGINT) AS cells,
CAST((ats[axis + 1] * (blocks // parts) + least(ats[axis + 1], blocks % parts)) * 8 AS BIGINT) AS start FROM r, e""",
)(lambda s, d: dec.uneven_split(s, [104, 56, 64], 8, [3, 2, 5]))
query(
    "region_counts",
    f"""WITH d(n, dirs) AS (VALUES {_D3}), x AS (SELECT a.range i, b.range j, c.range k FROM range(12) a, range(10) b, range(8) c), m AS (SELECT unnest([true, false]) AS inside),
h AS (SELECT n, inside, count(*) AS cells FROM d, m, x WHERE """
    + " AND ".join(f"(CASE WHEN list_contains(dirs, {n}) THEN {a} >= {size - 2} WHEN list_contains(dirs, -{n}) THEN {a} < 2 ELSE NOT inside OR {a} BETWEEN 2 AND {size - 3} END)" for n, (a, size) in enumerate(zip(A3, (12, 10, 8), strict=True), 1))
    + " GROUP BY n, inside) SELECT CAST(n AS INT) AS ord, inside AS inner_only, cells FROM h",
)(lambda s, d: s.createDataFrame([(n, inner, op.section_count([12, 10, 8], 2, t, inner)) for n, t in enumerate(op.directions(3)) for inner in (True, False)], "ord int, inner_only boolean, cells long"))
query(
    "pack_unpack",
    f"WITH {G3_SQL} SELECT i - 16 AS i, j + 16 AS j, k, v FROM g WHERE i >= 14 AND j < 2",
)(lambda s, d: op.unpack(op.pack(g3(s, d), A3, e := [16, 16, planes(s, d)], 2, (1, -2), False), A3, e, 2, (1, -2), False))

# ---------------------------------------------------------------- subdomains
_CUBE = "WITH c AS (SELECT range % 16 i, (range // 16) % 16 j, range // 256 k, (range * 7919) % 1024 v FROM range(4096))"
_Z2 = lambda c: " + ".join(f"(((({c}{n}) >> {b}) & 1) << {3 * b + n})" for n in range(3) for b in range(2))


def _cube(s):
    return cells(s, [16, 16, 16], F.pmod(F.col("id") * 7919, F.lit(1024)).cast("long"))


query(
    "subdomain_exchange",
    _CUBE + f""", s AS (SELECT a.range s0, b.range s1, c.range s2 FROM range(4) a, range(4) b, range(4) c), o AS (SELECT a.range - 1 x, b.range - 1 y, c.range - 1 z FROM range(6) a, range(6) b, range(6) c)
SELECT CAST({_Z2('s')} AS BIGINT) AS sub_id, x AS i, y AS j, z AS k, v FROM s CROSS JOIN o JOIN c ON c.i = (s0 * 4 + x + 16) % 16 AND c.j = (s1 * 4 + y + 16) % 16 AND c.k = (s2 * 4 + z + 16) % 16""",
)(lambda s, d: op.halo_subdomains(_cube(s), A3, [16, 16, 16], 4, 1))


def _step(s):
    """A 7-point step in each subdomain on its own cells and received ghosts."""
    local = op.halo_subdomains(_cube(s), A3, [16, 16, 16], 4, 1)
    whole = apply(local, ["sub_id", *A3], {"out": sum((Grid("v", 4)(*[x + (o if m == n else 0) for m, x in enumerate(_AX4)]) for n in (1, 2, 3) for o in (1, -1)), 4 * Grid("v", 4)(*_AX4))})
    return whole.where(" AND ".join(f"{a} BETWEEN 0 AND 3" for a in A3)).withColumn("out", F.col("out").cast("long"))


_AX4 = [type(AXES3[0])(n) for n in range(4)]
query(
    "subdomain_step",
    _CUBE + f""", o(x, y, z, w) AS (VALUES (0,0,0,4),(1,0,0,1),(-1,0,0,1),(0,1,0,1),(0,-1,0,1),(0,0,1,1),(0,0,-1,1)), t AS (SELECT i, j, k, i // 4 s0, j // 4 s1, k // 4 s2 FROM c)
SELECT CAST({_Z2('s')} AS BIGINT) AS sub_id, t.i % 4 AS i, t.j % 4 AS j, t.k % 4 AS k, CAST(sum(w * n.v) AS BIGINT) AS out
FROM t CROSS JOIN o JOIN c n ON n.i = (t.i + x + 16) % 16 AND n.j = (t.j + y + 16) % 16 AND n.k = (t.k + z + 16) % 16 GROUP BY ALL""",
)(lambda s, d: _step(s))

_OWN = "CASE WHEN {z} < 4 * 13 THEN {z} // 13 ELSE 4 + ({z} - 52) // 12 END"
_AX = lambda n: f"((z >> {n}) & 1) + 2 * ((z >> {n + 3}) & 1)"
query(
    "region_links",
    f"""WITH {_layout_ctes(4, 'good')}, z AS (SELECT range z FROM range(64)), p AS (SELECT n, dirs, {', '.join(f"CASE WHEN list_contains(dirs, {a}) THEN 1 WHEN list_contains(dirs, -{a}) THEN -1 ELSE 0 END AS t{a - 1}" for a in (1, 2, 3))} FROM d WHERE len(dirs) > 0),
k AS (SELECT z, q.n AS skin, q.len + q.pad AS blocks, {', '.join(f"({_AX(n)} + t{n} + 4) % 4 AS s{n}" for n in range(3))} FROM z, p JOIN q ON len(list_intersect(list_transform(p.dirs, lambda x: -x), q.dirs)) = len(p.dirs)),
e AS (SELECT *, {_Z2('s')} AS m FROM k), r AS (SELECT CAST({_OWN.format(z='z')} AS INT) AS rank, CAST({_OWN.format(z='m')} AS INT) AS source, CAST(m * 32 + skin AS BIGINT) AS region_id, blocks FROM e)
SELECT rank, source, rank = source AS local, region_id, count(*) AS uses, CAST(max(blocks) AS BIGINT) AS blocks FROM r GROUP BY rank, source, region_id""",
)(lambda s, d: dec.region_links(s, 4, 5, _decomposition(4)))

# ---------------------------------------------------------------- validity and statistics
query(
    "rank_validity",
    f"""WITH {G3_SQL}, r AS (SELECT k % 5 AS rank, bool_and(v % 9973 <> 0) AS valid FROM g GROUP BY 1)
SELECT rank, valid, (SELECT bool_and(valid) FROM r) AS every_rank FROM r""",
)(lambda s, d: op.validity(g3(s, d), F.col("k") % 5, F.col("v") % 9973 != 0))
query(
    "stats_text",
    f"WITH {G3_SQL} SELECT k AS rank, printf('[%.3f, %.3f, %.3f] (σ: %.3f)', min(v)::DOUBLE, floor(avg(v)), max(v)::DOUBLE, floor(stddev_samp(v))) AS text FROM g GROUP BY k HAVING count(*) > 1",
)(lambda s, d: op.stats_text(op.stats(g3(s, d).withColumn("v", F.col("v").cast("double")), "v", ["k"]).withColumn("avg", F.floor("avg").cast("double")).withColumn("sigma", F.floor("sigma").cast("double"))).select(F.col("k").alias("rank"), "text"))
