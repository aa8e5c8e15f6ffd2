"""DuckDB text of linear walk-forward models, written independently of the moment algebra they check.

Training rows stay rows. Covariances are aggregates over them, principal components come from cyclic Jacobi rotations and fits
from Gauss-Jordan elimination, both as recursive tables whose rows hold a flattened matrix. Scores, cubes and held-out errors are
formed row by row.
"""

from __future__ import annotations

from ..operators.walkforward import Design

SWEEPS = 9
#: Ridge penalties are 30 powers of ten from -5 to 5; place 30 is their median, used when there is too little to tune on.
N_ALPHA = 30


def _grid() -> str:
    powers = ", ".join(f"pow(10e0, -5e0 + {i}*10e0/{N_ALPHA - 1}e0)" for i in range(N_ALPHA))
    return f"SELECT i AS al, a[i + 1] AS alpha FROM (SELECT list_append(a, (a[15] + a[16]) / 2) AS a FROM (SELECT [{powers}] AS a)), range({N_ALPHA + 1}) g(i)"


def _covariances(xs: list[str], ys: list[str]) -> str:
    """Flattened covariances of every x with every y; a pair is written in one order, so that it is computed once."""
    return "[" + ", ".join(f"covar_pop({min(x, y)}, {max(x, y)})" for x in xs for y in ys) + "]"


def _means(xs: list[str]) -> str:
    return "[" + ", ".join(f"avg({x})" for x in xs) + "]"


def _deviations(p: int) -> str:
    """Standard deviations from flattened covariances c; one for a constant column."""
    return f"[CASE WHEN c[j*{p} + j + 1] > 1e-14 * list_max([c[k*{p} + k + 1] for k in range({p})]) THEN sqrt(c[j*{p} + j + 1]) ELSE 1e0 END for j in range({p})]"


def _jacobi(name: str, base: str, p: int) -> str:
    """Recursive table of ``base`` (i, m, whole, a): after all sweeps a is diagonal and the columns of v are the eigenvectors."""
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    at = lambda x, i, j: f"{x}[({i})*{p} + {j} + 1]"
    cols = lambda x: (
        f"[CASE k % {p} WHEN p THEN c*{at(x, f'k // {p}', 'p')} - s*{at(x, f'k // {p}', 'q')} "
        f"WHEN q THEN s*{at(x, f'k // {p}', 'p')} + c*{at(x, f'k // {p}', 'q')} ELSE {x}[k + 1] END for k in range({p * p})]"
    )
    rows = (
        f"[CASE k // {p} WHEN p THEN c*{at('b', 'p', f'k % {p}')} - s*{at('b', 'q', f'k % {p}')} "
        f"WHEN q THEN s*{at('b', 'p', f'k % {p}')} + c*{at('b', 'q', f'k % {p}')} ELSE b[k + 1] END for k in range({p * p})]"
    )
    first, second = ([pair[n] for pair in pairs] for n in (0, 1))
    return f"""{name} AS (
        SELECT i, m, whole, 0 AS step, a, [CASE WHEN k // {p} = k % {p} THEN 1e0 ELSE 0e0 END for k in range({p * p})] AS v FROM ({base})
        UNION ALL
        SELECT i, m, whole, step, {rows} AS a, v FROM (
          SELECT i, m, whole, step + 1 AS step, p, q, c, s, {cols('a')} AS b, {cols('v')} AS v FROM (
            SELECT *, cos(phi) AS c, sin(phi) AS s FROM (
              SELECT *, CASE WHEN {at('a', 'p', 'q')} = 0 THEN 0e0 WHEN {at('a', 'p', 'p')} = {at('a', 'q', 'q')} THEN pi() / 4
                        ELSE atan(2 * {at('a', 'p', 'q')} / ({at('a', 'q', 'q')} - {at('a', 'p', 'p')})) / 2 END AS phi
              FROM (SELECT *, {first}[step % {len(pairs)} + 1] AS p, {second}[step % {len(pairs)} + 1] AS q FROM {name} WHERE step < {SWEEPS * len(pairs)})))))"""


def _elimination(name: str, base: str, keys: str, n: int, width: int) -> str:
    """Recursive table of ``base`` (keys, a): after n steps the last columns of a hold the solutions."""
    return f"""{name} AS (
        SELECT {keys}, 0 AS step, a FROM {base}
        UNION ALL
        SELECT {keys}, step + 1, [CASE WHEN k // {width} = step THEN a[k + 1] / a[step*{width} + step + 1]
                 ELSE a[k + 1] - a[k // {width} * {width} + step + 1] * a[step*{width} + k % {width} + 1] / a[step*{width} + step + 1] END for k in range({n * width})]
        FROM {name} WHERE step < {n})"""


def linear_model_sql(
    layout: Design, steps: list[tuple], start: str, gap: int, kind: str = "ols", every: int = 1, tune: int = 1,
    cubic: tuple[int, ...] | None = None,
) -> str:
    """Forecasts (date, target, y_hat) of every target from the rows of fx_z (date, m, z, y, ok).

    ``steps`` and ``kind`` (ols or ridge) as in the operator. ``cubic`` lists the components of the last step to use; the cube of
    the first follows it.
    """
    goals = [t for t in layout.targets if not t.startswith("_")]
    y_at = lambda t: f"y[{layout.target(t) - layout.width + 1}]"
    own = any(s[0] == "cp" and s[2] is None for s in steps)
    ridge = kind == "ridge"
    tables = [
        f"""org AS MATERIALIZED (
        SELECT date, m, first, t0 + (m - t0) // {every} * {every} AS fit_m, t0 + (m - t0) // {every * tune} * {every * tune} AS tune_m
        FROM fx_z, (SELECT min(m) AS first, year(DATE '{start}')*12 + month(DATE '{start}') AS t0 FROM fx_z) WHERE date >= DATE '{start}')""",
        f"""span AS MATERIALIZED (
        SELECT DISTINCT fit_m AS m, 1 AS whole, fit_m - {gap + 1} AS hi, fit_m + {every - 1} AS upto FROM org"""
        + (f"""
        UNION ALL SELECT DISTINCT tune_m, 0, first + CAST(floor((tune_m - {gap} - first) * 0.85e0) AS BIGINT) - 1, tune_m - {gap + 1} FROM org""" if ridge else "")
        + ")",
        "tr AS MATERIALIZED (SELECT s.m, s.whole, r.z, r.y FROM span s JOIN fx_z r ON r.ok AND r.m <= s.hi)",
    ]
    values, joins, groups = [], [], {}
    for i, step in enumerate(steps):
        cols = [f"z[{c + 1}]" for c in step[1]]
        p = len(cols)
        if step[0] == "raw":
            values += [f"r.{c}" for c in cols]
            continue
        point = "[1e0, " + ", ".join(f"r.{c}" for c in cols) + "]"
        if step[0] == "cp":
            n_y = len(layout.targets)
            ys = [f"y[{t + 1}]" for t in range(n_y)]
            tables.append(f"""cb{i} AS MATERIALIZED (SELECT m, whole, {_means(cols)} AS mx, {_means(ys)} AS my,
        [{', '.join(_covariances([x], [*cols, *ys])[1:-1] for x in cols)}] AS a FROM tr GROUP BY m, whole)""")
            tables.append(_elimination(f"ce{i}", f"cb{i}", "m, whole", p, p + n_y))
            slopes = f"[e.a[j*{p + n_y} + {p} + t + 1] for j in range({p})]"
            tables.append(f"""cp{i} AS MATERIALIZED (SELECT m, whole, [list_concat([my[t + 1] - list_dot_product(b[t + 1], mx)], b[t + 1]) for t in range({n_y})] AS f
        FROM (SELECT e.m, e.whole, mx, my, [{slopes} for t in range({n_y})] AS b FROM ce{i} e JOIN cb{i} USING (m, whole) WHERE e.step = {p}))""")
            joins.append(f"JOIN cp{i} ON cp{i}.m = b.m AND cp{i}.whole = b.whole")
            which = "b.t" if step[2] is None else str(step[2] - layout.width + 1)
            values.append(f"list_dot_product(cp{i}.f[{which}], {point})")
            continue
        sd = _deviations(p) if step[3] else f"[1e0 for j in range({p})]"
        tables.append(f"""pb{i} AS MATERIALIZED (SELECT {i} AS i, m, whole, mu, sd, [c[k + 1] / (sd[k // {p} + 1] * sd[k % {p} + 1]) for k in range({p * p})] AS a
        FROM (SELECT *, {sd} AS sd FROM (SELECT m, whole, {_means(cols)} AS mu, {_covariances(cols, cols)} AS c FROM tr GROUP BY m, whole)))""")
        groups.setdefault(p, []).append((i, step[2]))
        joins.append(f"JOIN ld{i} ON ld{i}.m = b.m AND ld{i}.whole = b.whole")
        values += [f"list_dot_product(ld{i}.f[{k + 1}], {point})" for k in range(step[2])]
    for p, members in groups.items():
        tables.append(_jacobi(f"jac{p}", " UNION ALL ".join(f"SELECT i, m, whole, a FROM pb{i}" for i, _ in members), p))
        for i, k in members:
            tables.append(f"""ld{i} AS MATERIALIZED (SELECT m, whole, [list_concat([-list_dot_product(x, mu)], x) for x in w] AS f FROM (
          SELECT m, whole, mu, [[v[j*{p} + e.d + 1] / sd[j + 1] for j in range({p})] for e in top[1:{k}]] AS w FROM (
            SELECT b.m, b.whole, b.mu, b.sd, j.v, list_reverse_sort([{{'e': j.a[d*{p} + d + 1], 'd': d}} for d in range({p})]) AS top
            FROM jac{p} j JOIN pb{i} b USING (i, m, whole) WHERE j.step = {SWEEPS * p * (p - 1) // 2})))""")
    if cubic:
        lead, factors = values[: -steps[-1][2]], values[-steps[-1][2]:]
        values = [*lead, factors[cubic[0]], f"pow({factors[cubic[0]]}, 3)", *[factors[c] for c in cubic[1:]]]
    p, targets = len(values), ["y[t]"] if own else [y_at(g) for g in goals]
    r = len(targets)
    width = p + r
    xs = [f"x[{j + 1}]" for j in range(p)]
    each = f"SELECT s.*, t FROM span s, range(1, {len(goals) + 1}) g(t)" if own else "SELECT s.*, 0 AS t FROM span s"
    tables += [
        f"""feat AS MATERIALIZED (SELECT b.m, b.whole, b.t, r.m AS rm, r.y, r.m <= b.hi AS fit, [{', '.join(values)}] AS x
        FROM ({each}) b {' '.join(joins)} JOIN fx_z r ON r.m <= b.upto WHERE CASE WHEN b.whole = 0 OR r.m <= b.hi THEN r.ok ELSE r.m >= b.m END)""",
        f"""mom AS MATERIALIZED (SELECT *, {_deviations(p)} AS sd FROM (
          SELECT m, whole, t, count(*) AS n, {_means(xs)} AS mx, {_means(targets)} AS my, {_covariances(xs, xs)} AS c, {_covariances(xs, targets)} AS d
          FROM feat WHERE fit GROUP BY m, whole, t))""",
        f"pen AS MATERIALIZED ({_grid() if ridge else 'SELECT 0 AS al, 0e0 AS alpha'})",
        f"""base AS (SELECT m, whole, t, al, [CASE WHEN k % {width} < {p}
          THEN c[k // {width} * {p} + k % {width} + 1] / (sd[k // {width} + 1] * sd[k % {width} + 1]) + CASE WHEN k // {width} = k % {width} THEN alpha / n ELSE 0e0 END
          ELSE d[k // {width} * {r} + k % {width} - {p} + 1] / sd[k // {width} + 1] END for k in range({p * width})] AS a
        FROM mom, pen WHERE whole = 1 OR al < {N_ALPHA})""",
        _elimination("solved", "base", "m, whole, t, al", p, width),
        f"""coef AS MATERIALIZED (SELECT m, whole, t, al, g, n, list_concat([my[g + 1] - list_dot_product(b, mx)], b) AS cf FROM (
          SELECT s.m, s.whole, s.t, s.al, mom.n, mom.my, mom.mx, g, [s.a[j*{width} + {p} + g + 1] / mom.sd[j + 1] for j in range({p})] AS b
          FROM solved s JOIN mom USING (m, whole, t), range({r}) q(g) WHERE s.step = {p}))""",
    ]
    if ridge:
        y_of = "f.y[c.t]" if own else "CASE c.g " + " ".join(f"WHEN {k} THEN f.{y_at(g)}" for k, g in enumerate(goals)) + " END"
        tables.append(f"""best AS MATERIALIZED (SELECT m, t, g, CASE WHEN any_value(n) >= 10 AND any_value(held) >= 3 THEN arg_min(al, sse) ELSE {N_ALPHA} END AS al FROM (
          SELECT c.m, c.t, c.g, c.al, any_value(c.n) AS n, count(f.rm) AS held, sum(pow({y_of} - list_dot_product(c.cf, list_concat([1e0], f.x)), 2)) AS sse
          FROM coef c LEFT JOIN feat f ON f.m = c.m AND f.whole = 0 AND f.t = c.t AND NOT f.fit WHERE c.whole = 0 GROUP BY 1, 2, 3, 4) GROUP BY m, t, g)""")
    names = "[" + ", ".join(f"'{g}'" for g in goals) + "]"
    chosen = "JOIN best b ON b.m = o.tune_m AND b.t = c.t AND b.g = c.g AND b.al = c.al" if ridge else ""
    return f"""WITH RECURSIVE {''',
     '''.join(tables)}
    SELECT o.date, {names}[{'c.t' if own else 'c.g + 1'}] AS target, round(list_dot_product(c.cf, list_concat([1e0], f.x)), 6) + 0 AS y_hat
    FROM org o JOIN coef c ON c.m = o.fit_m AND c.whole = 1 {chosen} JOIN feat f ON f.m = o.fit_m AND f.whole = 1 AND f.t = c.t AND f.rm = o.m"""
