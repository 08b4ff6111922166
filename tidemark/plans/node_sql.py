"""SQL of factor expressions: the same nodes, written out level by level, for another engine to compute."""
from __future__ import annotations

from ..functions.nodes import Node

#: A power of two, so that no decimal value lies half way between two steps.
STEPS = 131072.0
_ORD = "(partition by symbol order by start_time)"


def _w(n: int) -> str:
    return f"(partition by symbol order by start_time rows between {n - 1} preceding and current row)"


def _full(value: str, x: str, n: int) -> str:
    return f"case when count({x}) over {_w(n)} >= {n} then {value} end"


def _lags(x: str, weights: list[float]) -> str:
    return "(" + " + ".join(f"lag({x}, {k}) over {_ORD} * {w!r}" if k else f"{x} * {w!r}" for k, w in enumerate(weights)) + ")"


def _window(name: str, a: list) -> str:
    x, n = a[0], a[-1]
    if name in ("delay", "delta"):
        return f"lag({x}, {n}) over {_ORD}" if name == "delay" else f"{x} - lag({x}, {n}) over {_ORD}"
    if name in ("mean", "sum", "ts_max", "ts_min"):
        return _full(f"{ {'mean': 'avg', 'sum': 'sum', 'ts_max': 'max', 'ts_min': 'min'}[name] }({x}) over {_w(n)}", x, n)
    if name == "std":
        return f"case when max({x}) over {_w(n)} = min({x}) over {_w(n)} then {_full('0.0', x, max(2, n))} else {_full(f'stddev_samp({x}) over {_w(n)}', x, n)} end"
    if name in ("corr", "cov"):
        p, q = f"(case when {a[1]} is not null then {x} end)", f"(case when {x} is not null then {a[1]} end)"
        cov = f"covar_samp({p}, {q}) over {_w(n)}"
        if name == "cov":
            return f"round({_full(cov, p, n)}, 12)"
        flat = f"max({p}) over {_w(n)} = min({p}) over {_w(n)} or max({q}) over {_w(n)} = min({q}) over {_w(n)}"
        return f"round({_full(f'case when not ({flat}) then {cov} / nullif(stddev_samp({p}) over {_w(n)} * stddev_samp({q}) over {_w(n)}, 0) end', p, n)}, 8)"
    if name in ("decay", "wma"):
        w = [(n - k) / (n * (n + 1) / 2) for k in range(n)] if name == "decay" else [0.9**k / sum(0.9**i for i in range(n)) for k in range(n)]
        return _lags(x, w)
    if name == "slope":
        return _full(f"covar_samp({x}, case when {x} is not null then t end) over {_w(n)} / nullif(var_samp(case when {x} is not null then t end) over {_w(n)}, 0)", x, n)
    if name == "residual":
        p, q = f"(case when {a[1]} is not null then {x} end)", f"(case when {x} is not null then {a[1]} end)"
        return f"{x} - avg({x}) over {_w(n)} - {_full(f'covar_samp({p}, {q}) over {_w(n)} / nullif(var_samp({q}) over {_w(n)}, 0)', p, n)} * ({a[1]} - avg({a[1]}) over {_w(n)})"
    if name == "array":
        return _full(f"list({x}) over {_w(n)}", x, n)
    if name == "rank":
        return f"case when {x} is not null then (rank() over (partition by symbol order by {x} asc nulls last) + (count(*) over (partition by symbol, {x}) - 1) / 2.0) / count({x}) over (partition by symbol) end"
    if name == "sma":
        share = a[2] / a[1]
        return f"case when {x} is not null then list_reduce(list({x}) filter (where {x} is not null) over {_ORD}, lambda p, q: p + {share!r} * (q - p)) end"
    raise ValueError(name)


def _plain(name: str, a: list[str]) -> str:
    if name in ("+", "-", "*", ">", "<", ">=", "<=", "=", "and"):
        return f"({a[0]} {name} {a[1]})"
    forms = {
        "r-": "({1} - {0})", "/": "({0} / nullif({1}, 0))", "^": "pow({0}, {1})", "log": "round(case when {0} > 0 then ln({0}) end, 12)", "tidy": "round({0}, 6)", "abs": "abs({0})", "sign": "cast(sign({0}) as double)", "least": "least({0}, {1})", "greatest": "greatest({0}, {1})",
        "where": "(case when {0} then {1} else {2} end)", "null": "null::double", "since_max": "(len({0}) - list_position({0}, list_max({0})))", "since_min": "(len({0}) - list_position({0}, list_min({0})))",
        "ts_rank": "((len(list_filter({0}, lambda v: v < {0}[-1])) + (len(list_filter({0}, lambda v: v = {0}[-1])) + 1) / 2.0) / len({0}))",
    }
    return forms[name].format(*a) if name in forms else name


def node_sql(bars: str, named: dict[str, Node]) -> str:
    """Columns of the nodes over the bars that the SQL `bars` gives, in steps of 1 / STEPS and single precision; values of
    1e30 and more are left out."""
    nodes: dict[tuple, Node] = {}

    def visit(n: Node):
        if n.key not in nodes:
            for x in n.args:
                if isinstance(x, Node):
                    visit(x)
            nodes[n.key] = n

    for n in named.values():
        visit(n)
    names = {k: f"n{i}" for i, (k, n) in enumerate(nodes.items()) if n.kind != "plain"}

    def text(n, inner: bool = True) -> str:
        if not isinstance(n, Node):
            return repr(float(n)) if isinstance(n, float) else str(n)
        if inner and n.key in names:
            return names[n.key]
        if n.kind == "plain":
            return _plain(n.name, [text(x) for x in n.args])
        return _window(n.name, [text(x) if isinstance(x, Node) else x for x in n.args])

    ctes, last = [f"b as ({bars})", f"l0 as (select *, amount / (volume + 1e-12) as vwap, row_number() over {_ORD} as t from b)"], "l0"
    for level in range(1, max((n.level for n in nodes.values()), default=0) + 1):
        here = [n for k, n in nodes.items() if k in names and n.level == level]
        # a window takes plain columns, so what it takes is computed before
        ctes.append(f"l{level} as (select *, " + ", ".join(f"{text(n, False)} as {names[n.key]}" for n in here) + f" from {last})")
        last = f"l{level}"
    cols = ", ".join(f'cast(round(case when abs({text(n)}) < 1e30 then {text(n)} end * {STEPS}) / {STEPS} + 0.0 as float) as "{k}"' for k, n in named.items())
    return "with " + ",\n".join(ctes) + f"\nselect symbol, start_time, {cols} from {last}"
