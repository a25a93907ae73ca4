"""SQL for a logistic regression by Newton's method, as an independent check of the fitted models.

The iterations are written out: sums of the weighted cross products in a table of their own, then one
nested sweep per unknown on that single row.
"""

from __future__ import annotations

# The step after the last iteration also gives the standard errors.
ITERATIONS = 8


def cells(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def newton_tables(rows: str, size: int, weight: str = "1.0") -> dict[str, str]:
    """Tables ``fitted`` (b0.., s0..: coefficients and standard errors) and ``deviances``.

    ``rows`` is a table with the outcome y and the terms x0.., x0 being 1.
    """
    tables = {"b_0": "SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(size))}
    score = " + ".join(f"b{i} * x{i}" for i in range(size))
    for k in range(1, ITERATIONS + 2):
        sums = [f"sum(w * mu * (1 - mu) * x{i} * x{j}) AS a{i}_{j}" for i, j in cells(size)]
        sums += [f"sum(w * (y - mu) * x{i}) AS a{i}_{size}" for i in range(size)]
        kept = ", ".join(f"any_value(b{i}) AS b{i}" for i in range(size))
        tables[f"n_{k}"] = f"""SELECT {", ".join(sums)}, 0.0::DOUBLE AS a{size}_{size}, {kept} FROM
            (SELECT *, {weight} AS w, 1 / (1 + exp(-({score}))) AS mu FROM {rows}, b_{k - 1})"""
        last = f"n_{k}"
        for pivot in range(size):
            last = f"({sweep(last, size, pivot)})"
        new = ", ".join(f"b{i} + a{i}_{size} AS b{i}" for i in range(size))
        errors = ", ".join(f"sqrt(-a{i}_{i}) AS s{i}" for i in range(size))
        tables["fitted" if k > ITERATIONS else f"b_{k}"] = f"SELECT {new}, {errors} FROM {last}"
    mu = f"1 / (1 + exp(-({score})))"
    tables["deviances"] = f"""SELECT
        -2 * sum(w * (y * ln(mu) + (1 - y) * ln(1 - mu))) AS deviance,
        -2 * sum(w * (y * ln(share) + (1 - y) * ln(1 - share))) AS null_deviance
        FROM (SELECT y, {weight} AS w, {mu} AS mu, share
              FROM {rows}, fitted, (SELECT sum(y * {weight}) / sum({weight}) AS share FROM {rows}))"""
    return {name: f"MATERIALIZED {text}" for name, text in tables.items()}


def sweep(table: str, size: int, pivot: int) -> str:
    """Sweep a symmetric matrix, bordered by the right-hand side, on one pivot.

    After all pivots the border holds the solution and the rest the negative inverse.
    """

    def cell(i: int, j: int) -> str:
        return f"a{min(i, j)}_{max(i, j)}"

    p = cell(pivot, pivot)
    columns = []
    for i, j in cells(size + 1):
        if i == pivot and j == pivot:
            value = f"-1 / {p}"
        elif pivot in (i, j):
            value = f"{cell(i, j)} / {p}"
        else:
            value = f"{cell(i, j)} - {cell(i, pivot)} * {cell(pivot, j)} / {p}"
        columns.append(f"{value} AS {cell(i, j)}")
    return f"SELECT {', '.join(columns)}, {', '.join(f'b{i}' for i in range(size))} FROM {table}"


def two_sided_p(z: str) -> str:
    """Two-sided normal p-value of a non-negative z by a rational approximation (error below 2e-7)."""
    t = f"(1 / (1 + 0.3275911 * ({z}) / sqrt(2)))"
    series = (
        f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741"
        f" + {t} * (-1.453152027 + {t} * 1.061405429))))"
    )
    return f"({series} * exp(-({z}) * ({z}) / 2))"
