"""Stencil expressions: immutable nodes built by operator overloading, and their translation to Columns and SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class Expr:
    """A node; comparison operators build nodes, so nodes are told apart by identity."""

    __hash__ = object.__hash__

    def __add__(self, o): return Bin("+", self, lift(o))
    def __radd__(self, o): return Bin("+", lift(o), self)
    def __sub__(self, o): return Bin("-", self, lift(o))
    def __rsub__(self, o): return Bin("-", lift(o), self)
    def __mul__(self, o): return Bin("*", self, lift(o))
    def __rmul__(self, o): return Bin("*", lift(o), self)
    def __truediv__(self, o): return Bin("/", self, lift(o))
    def __rtruediv__(self, o): return Bin("/", lift(o), self)
    def __mod__(self, o): return Bin("%", self, lift(o))
    def __rmod__(self, o): return Bin("%", lift(o), self)
    def __and__(self, o): return Bin("&", self, lift(o))
    def __or__(self, o): return Bin("|", self, lift(o))
    def __xor__(self, o): return Bin("^", self, lift(o))
    def __lshift__(self, o): return Bin("<<", self, lift(o))
    def __rshift__(self, o): return Bin(">>", self, lift(o))
    def __neg__(self): return Un("-", self)
    def __pos__(self): return self
    def __invert__(self): return Un("~", self)
    def __lt__(self, o): return Bin("<", self, lift(o))
    def __le__(self, o): return Bin("<=", self, lift(o))
    def __gt__(self, o): return Bin(">", self, lift(o))
    def __ge__(self, o): return Bin(">=", self, lift(o))
    def __eq__(self, o): return Bin("==", self, lift(o))
    def __ne__(self, o): return Bin("!=", self, lift(o))
    def logical_and(self, o): return Bin("&&", self, lift(o))
    def logical_or(self, o): return Bin("||", self, lift(o))
    def logical_not(self): return Un("!", self)


@dataclass(frozen=True, eq=False)
class Lit(Expr):
    value: int | float


@dataclass(frozen=True, eq=False)
class Const(Expr):
    """A named parameter, or a number in text; resolved when the stencil is applied."""

    text: str


@dataclass(frozen=True, eq=False)
class Bin(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True, eq=False)
class Un(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True, eq=False)
class If(Expr):
    """`then` where the condition holds (a number holds if not 0)."""

    cond: Expr
    then: Expr
    other: Expr

    def __post_init__(self):
        for name in ("cond", "then", "other"):
            object.__setattr__(self, name, lift(getattr(self, name)))


@dataclass(frozen=True, eq=False)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Func:
    """A scalar function by name: a known one, or one registered with the session."""

    name: str
    arity: int

    def __call__(self, *args):
        if len(args) != self.arity:
            raise ValueError(f"{self.name} takes {self.arity} arguments, not {len(args)}")
        return Call(self.name, tuple(lift(a) for a in args))


@dataclass(frozen=True)
class Index:
    """Axis n (0: contiguous), plus an integer offset."""

    axis: int
    offset: int = 0

    def __add__(self, n): return Index(self.axis, self.offset + _whole(n))
    __radd__ = __add__
    def __sub__(self, n): return Index(self.axis, self.offset - _whole(n))


def _whole(n) -> int:
    if not isinstance(n, int):
        raise ValueError("an index takes integer offsets of one axis only")
    return n


@dataclass(frozen=True, eq=False)
class Ref(Expr):
    grid: Grid
    at: tuple[Index, ...]

    def assign(self, value) -> Grid:
        """Gives the grid its value at its own cell; offsets on the left say nothing, as every cell is computed alike."""
        self.grid.value = lift(value)
        return self.grid

    @property
    def offsets(self) -> tuple[tuple[int, int], ...]:
        """(axis, offset) of the axes that are shifted."""
        return tuple(sorted((i.axis, i.offset) for i in self.at if i.offset))


class Grid:
    """A symbolic grid; of lower rank than the domain it is constant along the axes it lacks."""

    def __init__(self, name: str, rank: int):
        self.name, self.rank, self.value = name, rank, None

    def __call__(self, *at):
        if len(at) != self.rank:
            raise ValueError(f"{self.name} has {self.rank} axes, not {len(at)}")
        if not all(isinstance(i, Index) for i in at) or len({i.axis for i in at}) != len(at):
            raise ValueError("each position takes one axis of its own")
        if self.value is not None:
            if any(i.offset for i in at):
                raise ValueError(f"{self.name} is an output: it can only be read at its own cell")
            return self.value
        return Ref(self, tuple(at))


def lift(x) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, str):
        return Const(x)
    if isinstance(x, (bool, int, float)):
        return Lit(int(x) if isinstance(x, bool) else x)
    raise TypeError(f"no expression: {x!r}")


def walk(e: Expr):
    yield e
    for child in {Bin: lambda: (e.left, e.right), Un: lambda: (e.arg,), If: lambda: (e.cond, e.then, e.other), Call: lambda: e.args}.get(type(e), tuple)():
        yield from walk(child)


def reads(*outputs: Expr) -> list[Ref]:
    """One reference for each distinct (grid, offsets)."""
    return list({(r.grid.name, r.offsets): r for e in outputs for r in walk(e) if isinstance(r, Ref)}.values())


def radius(*outputs: Expr) -> int:
    return max((abs(d) for r in reads(*outputs) for _, d in r.offsets), default=0)


def constant(text: str, params: dict[str, float]) -> float | int:
    if text in params:
        return params[text]
    if m := re.fullmatch(r"(\w+)\[(\d+)\]", text):
        if m[1] in params:
            return params[m[1]][int(m[2])]
    try:
        return float(text) if re.search(r"[.eE]", text) else int(text)
    except ValueError:
        raise ValueError(f"no value for {text!r}") from None


def linear(e: Expr, params: dict) -> dict[tuple[tuple[int, int], ...], float] | None:
    """{offsets: weight} if e is a weighted sum of reads of one grid, else None: sums over several grids have no single set of weights."""
    if len({(r.grid.name, r.grid.rank) for r in reads(e)}) > 1:
        return None
    if isinstance(e, Ref):
        return {e.offsets: 1}
    if isinstance(e, Un) and e.op == "-" and (a := linear(e.arg, params)) is not None:
        return {k: -w for k, w in a.items()}
    if isinstance(e, Bin) and e.op in "+-":
        a, b = linear(e.left, params), linear(e.right, params)
        if a is None or b is None:
            return None
        out = dict(a)
        for k, w in b.items():
            out[k] = out.get(k, 0) + (w if e.op == "+" else -w)
        return out
    if isinstance(e, Bin) and e.op in "*/":
        for x, y in ((e.left, e.right), (e.right, e.left)):
            if isinstance(x, (Lit, Const)) and (a := linear(y, params)) is not None and (e.op == "*" or y is e.left):
                c = x.value if isinstance(x, Lit) else constant(x.text, params)
                return {k: w * c if e.op == "*" else w / c for k, w in a.items()}
    return None


#: Functions by name as Columns and in SQL.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "max": F.greatest, "min": F.least, "fmax": F.greatest, "fmin": F.least, "abs": F.abs, "fabs": F.abs, "sqrt": F.sqrt, "exp": F.exp,
    "log": F.ln, "sin": F.sin, "cos": F.cos, "tan": F.tan, "pow": F.pow, "floor": F.floor, "ceil": F.ceil,
}
SQL_NAMES = {"max": "greatest", "min": "least", "fmax": "greatest", "fmin": "least", "fabs": "abs", "log": "ln"}
_BOOLEAN = {"<", "<=", ">", ">=", "==", "!=", "&&", "||", "!"}


def is_boolean(e: Expr) -> bool:
    return isinstance(e, (Bin, Un)) and e.op in _BOOLEAN


def to_column(e: Expr, read: Callable[[Ref], Column], params: dict | None = None, c_int_division: bool = False) -> Column:
    """e as a Column; division by 0 gives an infinity or NaN as in C, not an error."""
    params = params or {}
    go = lambda x: to_column(x, read, params, c_int_division)
    truth = lambda x: go(x) if is_boolean(x) else go(x) != 0
    number = lambda x: go(x).cast("int") if is_boolean(x) else go(x)
    if isinstance(e, Ref):
        return read(e)
    if isinstance(e, Lit):
        return F.lit(e.value)
    if isinstance(e, Const):
        return F.lit(constant(e.text, params))
    if isinstance(e, If):
        return F.when(truth(e.cond), number(e.then)).otherwise(number(e.other))
    if isinstance(e, Call):
        args = [number(a) for a in e.args]
        return FUNCTIONS[e.name](*args) if e.name in FUNCTIONS else F.call_function(e.name, *args)
    if isinstance(e, Un):
        return {"-": lambda: -number(e.arg), "~": lambda: F.bitwise_not(number(e.arg).cast("long")), "!": lambda: ~truth(e.arg)}[e.op]()
    if e.op in ("&&", "||"):
        a, b = truth(e.left), truth(e.right)
        return a & b if e.op == "&&" else a | b
    a, b = number(e.left), number(e.right)
    if e.op == "/":
        if c_int_division and isinstance(e.left, Lit) and isinstance(e.right, Lit) and isinstance(e.left.value, int) and isinstance(e.right.value, int):
            if e.right.value:  # towards 0, as in C; nothing is folded where C leaves the result open
                return F.lit(abs(e.left.value) // abs(e.right.value) * (1 if (e.left.value < 0) == (e.right.value < 0) else -1))
        a, b = a.cast("double"), b.cast("double")
        return F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * float("inf"))
    if e.op in ("<<", ">>"):
        return F.call_function("shiftleft" if e.op == "<<" else "shiftright", a.cast("long"), b.cast("int"))
    return {
        "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b, "&": lambda: a.cast("long").bitwiseAND(b.cast("long")),
        "|": lambda: a.cast("long").bitwiseOR(b.cast("long")), "^": lambda: a.cast("long").bitwiseXOR(b.cast("long")), "<": lambda: a < b,
        "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "==": lambda: a == b, "!=": lambda: a != b,
    }[e.op]()


def to_sql(e: Expr, read: Callable[[Ref], str], params: dict | None = None) -> str:
    """e as SQL text, in brackets throughout; shared by Spark and other engines."""
    params = params or {}
    go = lambda x: to_sql(x, read, params)
    truth = lambda x: go(x) if is_boolean(x) else f"({go(x)} <> 0)"
    number = lambda x: f"CAST({go(x)} AS INT)" if is_boolean(x) else go(x)
    if isinstance(e, Ref):
        return read(e)
    if isinstance(e, (Lit, Const)):
        v = e.value if isinstance(e, Lit) else constant(e.text, params)
        return f"({v!r})" if v < 0 else repr(v)
    if isinstance(e, If):
        return f"(CASE WHEN {truth(e.cond)} THEN {number(e.then)} ELSE {number(e.other)} END)"
    if isinstance(e, Call):
        return f"{SQL_NAMES.get(e.name, e.name)}({', '.join(number(a) for a in e.args)})"
    if isinstance(e, Un):
        return {"-": lambda: f"(-{number(e.arg)})", "~": lambda: f"(~CAST({number(e.arg)} AS BIGINT))", "!": lambda: f"(NOT {truth(e.arg)})"}[e.op]()
    if e.op in ("&&", "||"):
        return f"({truth(e.left)} {'AND' if e.op == '&&' else 'OR'} {truth(e.right)})"
    a, b = number(e.left), number(e.right)
    if e.op == "^":
        return f"xor(CAST({a} AS BIGINT), CAST({b} AS BIGINT))"
    if e.op in ("&", "|", "<<", ">>"):
        return f"(CAST({a} AS BIGINT) {e.op} {b})"
    return f"({a} { {'==': '=', '!=': '<>'}.get(e.op, e.op)} {b})" if e.op != "/" else f"(CAST({a} AS DOUBLE) / {b})"
