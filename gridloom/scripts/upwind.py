"""A stencil script: STENCIL maps output names to expressions."""

from gridloom.dsl import Grid, Index

i, j, k = (Index(n) for n in range(3))
v = Grid("v", 3)

STENCIL = {"out": 3 * v(i, j, k) + v(i + 1, j, k) - v(i, j, k - 2)}
