"""Tail probabilities and repeatable draws as DuckDB expressions, for the SQL that queries must agree with."""

from __future__ import annotations


def erfc(y: str) -> str:
    """Complementary error function of y >= 0: Simpson's rule over the seven units in which its integrand dies away."""
    weight = "CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(2 / sqrt(pi()) * 0.0035 / 3 * list_sum(list_transform(range(0, 2001), lambda k: {weight} * exp(-power({y} + k * 0.0035::DOUBLE, 2)))))"


def chi2_tail(stat: str, dof: str) -> str:
    """Chi-square tail for whole degrees of freedom: a sum of Poisson weights, after an error function if they are odd."""
    h = f"(({stat}) / 2.0)"
    even = f"list_sum(list_transform(range(0, ({dof}) // 2), lambda k: exp(-{h} + k * ln({h}) - lgamma(k + 1.0::DOUBLE))))"
    odd = (
        f"{erfc(f'sqrt({h})')} + coalesce(list_sum(list_transform(range(1, ({dof} + 1) // 2), "
        f"lambda k: exp(-{h} + (k - 0.5::DOUBLE) * ln({h}) - lgamma(k + 0.5::DOUBLE)))), 0)"
    )
    return f"(CASE WHEN {stat} IS NULL THEN NULL WHEN {stat} <= 0 THEN 1.0 WHEN {dof} <= 0 THEN 0.0 WHEN ({dof}) % 2 = 0 THEN {even} ELSE {odd} END)"


def t_tail(t: str, dof: str) -> str:
    """Two-sided tail of Student's law for whole degrees of freedom: finite sums of powers of the cosine."""
    x, s = f"(1 / (1 + ({t}) * ({t}) / ({dof})))", f"(abs({t}) / sqrt(({dof}) + ({t}) * ({t})))"
    even = f"1 - {s} * list_sum(list_transform(range(0, ({dof}) // 2), lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE) + k * ln({x}))))"
    angle = f"atan(abs({t}) / sqrt({dof}))"
    odd = (
        f"1 - 2 / pi() * ({angle} + CASE WHEN {dof} = 1 THEN 0 ELSE {s} * sqrt({x}) * list_sum(list_transform(range(0, ({dof} - 1) // 2), "
        f"lambda k: exp(lgamma(k + 1.0::DOUBLE) + lgamma(1.5::DOUBLE) - lgamma(k + 1.5::DOUBLE) + k * ln({x})))) END)"
    )
    return f"(CASE WHEN {t} IS NULL OR {dof} < 1 THEN NULL WHEN ({dof}) % 2 = 0 THEN {even} ELSE {odd} END)"


def draw(keys: list[str], seed: int = 0) -> str:
    """The number that `functions.columns.draw` gives a row."""
    text = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"CAST('0x' || substr(md5(concat_ws('|', {text}, '{seed}')), 1, 15) AS BIGINT)"
