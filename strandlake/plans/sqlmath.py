"""Statistics that DuckDB lacks, written in SQL for the queries' comparison: normal and chi-square tails, their inverse, Fisher's test, medians' lambda."""

from __future__ import annotations

MEDIAN = 0.4549364231195724


def tail(z: str) -> str:
    """Two-sided normal tail of z: below 1.5 from the series of the middle part, beyond it by the continued fraction z + 1 / (z + 2 / (z + ...))."""
    odd, product = [], 1.0
    for k in range(25):
        product *= 2 * k + 1
        odd.append(f"pow(abs({z}), {2 * k + 1}) / {product!r}")
    bell = f"(exp(-pow({z}, 2) / 2) * sqrt(2 / pi()))"
    fraction = f"list_reduce([CAST(200 - k AS DOUBLE) for k in range(200)], lambda f, k: greatest(abs({z}), 1.5e0) + k / f)"
    return f"(CASE WHEN abs({z}) < 1.5 THEN 1 - {bell} * ({' + '.join(odd)}) ELSE {bell} / {fraction} END)"


def isf(p: str) -> str:
    """The chi-square value of one degree of freedom with upper tail p, by halving an interval of the deviation 50 times."""
    middle = "((s[1] + s[2]) / 2)"
    steps = "list_concat([[0.0e0, 12.0e0]], [[CAST(k AS DOUBLE), 0.0e0] for k in range(50)])"
    return f"pow(list_reduce({steps}, lambda s, x: CASE WHEN {tail(middle)} > {p} THEN [{middle}, s[2]] ELSE [s[1], {middle}] END)[1], 2)"


def lambdas(source: str, by: str, p: str, least: int = 10) -> str:
    """SELECT of by, n and lam: the chi-square values of the one or two middle p-values of a group over the distribution's median."""
    return f"""SELECT {by}, n, CASE WHEN n >= {least} THEN avg({isf("mid")}) / {MEDIAN} END AS lam FROM (SELECT {by}, {p} AS mid, row_number() OVER (PARTITION BY {by} ORDER BY {p}) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {p} > 0 AND {p} <= 1) WHERE i IN ((n + 1) // 2, n // 2 + 1) GROUP BY {by}, n"""


def fisher(a: str, b: str, c: str, d: str) -> str:
    """Two-sided Fisher test of a table: all tables no likelier than it."""
    choose = lambda x, y: f"(lgamma({x} + 1.0e0) - lgamma({y} + 1.0e0) - lgamma({x} - {y} + 1.0e0))"
    row, col, n = f"({a} + {b})", f"({a} + {c})", f"({a} + {b} + {c} + {d})"
    chance = lambda k: f"exp({choose(row, k)} + {choose(f'({n} - {row})', f'({col} - {k})')} - {choose(n, col)})"
    return f"least(1.0e0, list_sum([CASE WHEN {chance('k')} <= {chance(a)} * (1 + 1e-7) THEN {chance('k')} ELSE 0 END for k in range(greatest(0, {col} - ({n} - {row})), least({row}, {col}) + 1)]))"
