"""The shipped stencils as expressions, with weights scaled to integers (so sums are exact in any order)."""

from __future__ import annotations

from .dsl import Const, Func, Grid, If, Index

I, J, K, L = (Index(n) for n in range(4))
AXES3 = (I, J, K)


def star(rank: int, shells: list[str | int], grid: str = "v"):
    """shells[0] times the centre plus shells[r] times the 2 * rank cells at distance r along the axes."""
    g, axes = Grid(grid, rank), (I, J, K, L)[:rank]
    total = shells[0] * g(*axes) if not isinstance(shells[0], str) else Const(shells[0]) * g(*axes)
    for r, w in enumerate(shells[1:], 1):
        for n in range(rank):
            for s in (r, -r):
                total = total + (Const(w) if isinstance(w, str) else w) * g(*[a + (s if m == n else 0) for m, a in enumerate(axes)])
    return total


def seven_weighted():
    """Weights coeff[0..6]: the centre, then +i, -i, +j, -j, +k, -k."""
    g = Grid("v", 3)
    at = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    return sum((Const(f"coeff[{n}]") * g(I + a, J + b, K + c) for n, (a, b, c) in list(enumerate(at))[1:]), Const("coeff[0]") * g(I, J, K))


def conditional():
    """The weighted sum of the reads' positive parts, then its magnitude by a condition; `shift` moves the values' zero."""
    g, top = Grid("v", 3), Func("max", 2)
    at = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    parts = [Const(f"coeff[{n}]") * top(g(I + a, J + b, K + c) - Const("shift"), 0) for n, (a, b, c) in enumerate(at)]
    total = sum(parts[1:], parts[0]) - Const("shift") * 8
    return If(total > 0, total, -total)


def cube27(fidelity: bool = False) -> dict:
    """{offsets: weight} with weights 1..27 in (k, j, i) order; in the fidelity form slot 16 reads (k+1, j+1, i)."""
    out: dict = {}
    for n, (c, b, a) in enumerate((c, b, a) for c in (-1, 0, 1) for b in (-1, 0, 1) for a in (-1, 0, 1)):
        if fidelity and n == 16:
            c = 1
        key = tuple((x, d) for x, d in enumerate((a, b, c)) if d)
        out[key] = out.get(key, 0) + n + 1
    return out


#: The 125-point stencil's weights in thousandths by the sorted magnitudes of an offset.
CLASS_WEIGHTS = {(0, 0, 0): 100, (0, 0, 1): 40, (0, 0, 2): 30, (0, 1, 1): 10, (0, 1, 2): 6, (0, 2, 2): 4, (1, 1, 1): 5, (1, 1, 2): 2, (1, 2, 2): 3, (2, 2, 2): 1}


def cube125() -> dict:
    return {tuple((x, d) for x, d in enumerate(o) if d): CLASS_WEIGHTS[tuple(sorted(map(abs, o)))] for o in ((a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3))}
