"""Half-sweeps of the factorizations with two components as SQL: closed forms, one chain of table expressions."""

from __future__ import annotations

LETTERS = "abc"


def _gram_sql(name, a, b):
    return f"(SELECT sum(f{a} * f{b}) FROM {name})"


def _half_sweep(kind, mode, names, new, sweep, keys="ijk", base="t", extra=None):
    """CTEs that compute factor ``new`` of one mode from the current factors."""
    others = [m for m in range(3) if m != mode]
    x, y = (names[m] for m in others)
    value = f"{base}.v" if extra is None else extra
    joins = " ".join(f"JOIN {names[m]} ON {names[m]}.idx = {base}.{keys[m]}" for m in (others if extra is None else range(3)))
    sums = ", ".join(f"sum(({value}) * {x}.f{c} * {y}.f{c}) AS m{c}" for c in range(2))
    out = [f"{new}_m AS MATERIALIZED (SELECT {base}.{keys[mode]} AS idx, {sums} FROM {base} {joins} GROUP BY 1)"]
    h = {ab: f"{_gram_sql(x, *ab)} * {_gram_sql(y, *ab)}" for ab in ((0, 0), (0, 1), (1, 1))}
    out.append(f"{new}_h AS MATERIALIZED (SELECT {h[0, 0]} AS h00, {h[0, 1]} AS h01, {h[1, 1]} AS h11)")
    free = "(m0 * h11 - m1 * h01) / (h00 * h11 - h01 * h01) AS u0, (m1 * h00 - m0 * h01) / (h00 * h11 - h01 * h01) AS u1"
    if kind == "cp":
        out.append(f"{new}_u AS MATERIALIZED (SELECT idx, {free} FROM {new}_m, {new}_h)")
        size = "sqrt(sum(u{c} * u{c}))" if sweep == 0 else "greatest(max(u{c}), 1.0)"
        out.append(f"{new}_l AS MATERIALIZED (SELECT {size.format(c=0)} AS l0, {size.format(c=1)} AS l1 FROM {new}_u)")
        out.append(f"{new} AS MATERIALIZED (SELECT idx, u0 / l0 AS f0, u1 / l1 AS f1 FROM {new}_u, {new}_l)")
    elif kind == "ntf":
        out.append(f"{new}_u AS MATERIALIZED (SELECT idx, m0, m1, h00, h01, h11, {free} FROM {new}_m, {new}_h)")
        first = "h01 * greatest(m0 / h00, 0) - m1 >= 0"
        out.append(f"""{new} AS MATERIALIZED (SELECT idx, CASE WHEN u0 >= 0 AND u1 >= 0 THEN u0 WHEN {first} THEN greatest(m0 / h00, 0) ELSE 0 END AS f0,
          CASE WHEN u0 >= 0 AND u1 >= 0 THEN u1 WHEN {first} THEN 0 ELSE greatest(m1 / h11, 0) END AS f1 FROM {new}_u)""")
    elif kind == "beta2":
        out.append(f"{new} AS MATERIALIZED (SELECT o.idx, f0 * (1e-15 + coalesce(m0, 0)) / (1e-15 + f0 * h00 + f1 * h01) AS f0, f1 * (1e-15 + coalesce(m1, 0)) / (1e-15 + f0 * h01 + f1 * h11) AS f1 FROM {names[mode]} o LEFT JOIN {new}_m USING (idx), {new}_h)")
    elif kind == "beta1":
        d = [f"(SELECT sum(f{c}) FROM {x}) * (SELECT sum(f{c}) FROM {y})" for c in range(2)]
        out.append(f"{new} AS MATERIALIZED (SELECT o.idx, " + ", ".join(
            f"f{c} * (1e-15 + coalesce(m{c}, 0)) / (1e-15 + {d[c]}) AS f{c}" for c in range(2))
            + f" FROM {names[mode]} o LEFT JOIN {new}_m USING (idx))")
    return out
