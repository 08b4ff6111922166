"""Factor expressions as small nodes over columns.

Windows on windowed columns need a level each. A node knows its inputs; `materialize` gives equal nodes one column, and adds
columns level by level, so each level is one pass over the same partitioning and order. Recursive averages of a level share
one grouped scan. Planning stays with Catalyst: a node is only a Column that waits for its inputs.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from . import ops


EPS = 1e-12


class Node:
    def __init__(self, name: str, make: Callable | None, args: tuple, kind: str = "plain"):
        self.name, self.make, self.args, self.kind = name, make, args, kind
        self.key = (name, *[a.key if isinstance(a, Node) else a for a in args])
        below = max([a.level for a in args if isinstance(a, Node)], default=0)
        self.level = below + (kind != "plain")

    def _two(self, other, name, f):
        return Node(name, f, (self, other))

    def __add__(self, x):
        return self._two(x, "+", lambda a, b: a + b)

    def __radd__(self, x):
        return self + x

    def __sub__(self, x):
        return self._two(x, "-", lambda a, b: a - b)

    def __rsub__(self, x):
        return self._two(x, "r-", lambda a, b: b - a)

    def __mul__(self, x):
        return self._two(x, "*", lambda a, b: a * b)

    def __rmul__(self, x):
        return self * x

    def __truediv__(self, x):
        """By a number as it is; by a node with EPS added, as published formulas avoid empty ranges."""
        if isinstance(x, Node):
            return self._two(x + EPS, "/", lambda a, b: F.try_divide(ops.col(a), ops.col(b)))
        return self * (1.0 / x)

    def __rtruediv__(self, x):
        return Node("/", lambda a, b: F.try_divide(ops.col(a), ops.col(b)), (x, self + EPS))

    def __pow__(self, x):
        return self._two(x, "^", lambda a, b: F.pow(ops.col(a), ops.col(b)))

    def __neg__(self):
        return self * -1

    def __gt__(self, x):
        return self._two(x, ">", lambda a, b: a > b)

    def __lt__(self, x):
        return self._two(x, "<", lambda a, b: a < b)

    def __ge__(self, x):
        return self._two(x, ">=", lambda a, b: a >= b)

    def __le__(self, x):
        return self._two(x, "<=", lambda a, b: a <= b)

    def same(self, x):
        return self._two(x, "=", lambda a, b: a == b)

    def __and__(self, x):
        return self._two(x, "and", lambda a, b: a & b)

    __hash__ = object.__hash__


def leaf(name: str) -> Node:
    return Node(name, lambda: F.col(name), ())


def _plain(name, f):
    return lambda *args: Node(name, f, args)


def _window(name, f):
    return lambda *args: Node(name, f, args, "window")


delay, delta = _window("delay", lambda x, n: ops.delay(x, n)), _window("delta", lambda x, n: ops.delta(x, n))
mean, total, std = _window("mean", lambda x, n: ops.mean(x, n)), _window("sum", lambda x, n: ops.ts_sum(x, n)), _window("std", lambda x, n: ops.std(x, n))
ts_max, ts_min = _window("ts_max", lambda x, n: ops.ts_max(x, n)), _window("ts_min", lambda x, n: ops.ts_min(x, n))
corr, cov = _window("corr", lambda x, y, n: F.round(ops.corr(x, y, n), 8)), _window("cov", lambda x, y, n: F.round(ops.cov(x, y, n), 12))
decay, wma = _window("decay", lambda x, n: ops.decay_linear(x, n)), _window("wma", lambda x, n: ops.wma(x, n))
slope, residual = _window("slope", lambda x, n: ops.slope(x, n)), _window("residual", lambda y, x, n: ops.residual(y, n, x))
_array = _window("array", lambda x, n: ops.window_array(x, n))
log, absolute, sign = _plain("log", lambda x: F.round(F.ln(x), 12)), _plain("abs", lambda x: F.abs(x)), _plain("sign", lambda x: F.signum(x))
tidy = _plain("tidy", lambda x: F.round(x, 6))  # sums of the same bars in another order are equal then
least, greatest = _plain("least", lambda a, b: F.least(ops.col(a), ops.col(b))), _plain("greatest", lambda a, b: F.greatest(ops.col(a), ops.col(b)))
where = _plain("where", lambda c, a, b: F.when(c, ops.col(a)).otherwise(ops.col(b)))  # the latter where c is null, too
nothing = Node("null", lambda: F.lit(None).cast("double"), ())


def rank(x: Node, scope: str = "series") -> Node:
    return Node("rank", lambda c, s: ops.rank(c, s), (x, scope), "window")


def ts_rank(x: Node, n: int) -> Node:
    return Node("ts_rank", lambda a: ops.ts_rank(a), (_array(x, n),))


def since_max(x: Node, n: int) -> Node:
    """Bars since the first of the window's largest values."""
    return Node("since_max", lambda a: ops.bars_since_max(a), (_array(x, n),))


def since_min(x: Node, n: int) -> Node:
    return Node("since_min", lambda a: ops.bars_since_min(a), (_array(x, n),))


def count(cond: Node, n: int) -> Node:
    return total(where(cond, 1.0, 0.0), n)


def sma(x: Node, n: int, m: int) -> Node:
    """y = (m / n) x + (1 - m / n) y before, seeded by the first value that isn't null."""
    return Node("sma", None, (x, n, m), "scan")


def materialize(df: DataFrame, named: dict[str, Node]) -> DataFrame:
    """df with each node as a column of its name."""
    nodes: dict[tuple, Node] = {}

    def visit(n: Node):
        if n.key not in nodes:
            for a in n.args:
                if isinstance(a, Node):
                    visit(a)
            nodes[n.key] = n

    for n in named.values():
        visit(n)
    names = {k: f"_n{i}" for i, (k, n) in enumerate(nodes.items()) if n.kind != "plain"}

    def column(n: Node, inner: bool = True) -> Column:
        if inner and n.key in names:
            return F.col(names[n.key])
        return n.make(*[column(a) if isinstance(a, Node) else a for a in n.args])

    before = df.columns
    for level in range(1, max((n.level for n in nodes.values()), default=0) + 1):
        here = [n for k, n in nodes.items() if k in names and n.level == level]
        df = df.withColumns({names[n.key]: column(n, False) for n in here if n.kind == "window"})
        if scans := [n for n in here if n.kind == "scan"]:
            from ..operators.scans import ewm, scan

            df = df.withColumns({f"{names[n.key]}x": column(n.args[0]) for n in scans})
            steps = [(names[n.key], n.args[2] / n.args[1]) for n in scans]
            df = scan(df, ", ".join(f"{c} double" for c, _ in steps), lambda t, steps=steps: {c: ewm(t[f"{c}x"].to_numpy(float), a) for c, a in steps})
    return df.select(*before, *[column(n).cast("double").alias(k) for k, n in named.items()])
