"""Tail probabilities as SQL, by Simpson's rule: a second way to the numbers the fractions of `functions.tails` give.

Each distribution is integrated where its density is smooth and bounded: Student's t and F over an angle, chi-square over a root.
"""

from __future__ import annotations

NODES = 4_000


def simpson(at: str, low: str, high: str, nodes: int = NODES) -> str:
    """The integral from low to high of `at`, an expression of the node `t`. Low and high are columns or constants."""
    node = f"({low} + ({high} - {low}) * i / {nodes}.0)"
    weight = f"CASE WHEN i = 0 OR i = {nodes} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({high} - {low}) / {3 * nodes}.0 * list_sum(list_transform(range(0, {nodes + 1}), lambda i: {weight} * {at.replace('{t}', node)})))"


def t_two_sided(t: str, df: str) -> str:
    """P(|T| > |t|): twice the tail beyond the angle atan(|t| / sqrt(df))."""
    area = simpson(f"power(cos({{t}}), {df} - 1.0)", "0.0", f"atan(abs({t}) / sqrt({df}))")
    return f"(1.0 - 2.0 * exp(lgamma(({df} + 1.0) / 2) - lgamma({df} / 2.0)) / sqrt(pi()) * {area})"


def f_upper(f: str, d1: str, d2: str) -> str:
    """P(F > f), the density's powers of sine and cosine taken as logarithms, as they may be thousands."""
    log = f"lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0)"
    at = f"CASE WHEN i = 0 THEN 0.0 ELSE exp({log} + ({d2} - 1.0) * ln(sin({{t}})) + ({d1} - 1.0) * ln(cos({{t}}))) END"
    return f"(2.0 * {simpson(at, '0.0', f'asin(sqrt({d2} / ({d2} + {d1} * {f})))', 20_000)})"


def chi2_upper(x: str, df: str) -> str:
    """P(X > x): over the root of half of x."""
    at = f"CASE WHEN i > 0 THEN exp(({df} - 1.0) * ln({{t}}) - {{t}} * {{t}} - lgamma({df} / 2.0)) WHEN {df} = 1 THEN exp(-lgamma(0.5)) ELSE 0.0 END"
    return f"(1.0 - 2.0 * {simpson(at, '0.0', f'sqrt({x} / 2.0)')})"


def t_quantile(p: float, z: float, df: str) -> str:
    """The quantile at p of Student's t: Newton's steps from the normal quantile z, which lies below it."""
    scale = f"exp(lgamma(({df} + 1.0) / 2) - lgamma({df} / 2.0))"
    below = f"(0.5 + {scale} / sqrt(pi()) * {simpson(f'power(cos({{t}}), {df} - 1.0)', '0.0', f'atan(x / sqrt({df}))')})"
    density = f"({scale} / sqrt(pi() * {df}) * power(1 + x * x / {df}, -({df} + 1.0) / 2))"
    return f"list_reduce([{z}, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10], lambda x, step: x + ({p} - {below}) / {density})"


def t_power(d: str, n1: str, n2: str, edge: str) -> str:
    """Two-sided power of the pooled t test: the square of a non-central t is a non-central F, a Poisson mixture of beta integrals."""
    v, half = f"({n1} + {n2} - 2.0)", f"({d} * {d} * {n1} * {n2} / ({n1} + {n2}) / 2.0)"
    weight = f"exp(j * ln({half}) - {half} - lgamma(j + 1.0) + lgamma(j + 0.5 + {v} / 2) - lgamma(j + 0.5) - lgamma({v} / 2))"
    mixed = f"list_sum(list_transform(range(0, 60), lambda j: {weight} * power(sin({{t}}), 2 * j)))"
    return f"(1.0 - 2.0 * {simpson(f'{mixed} * power(cos({{t}}), {v} - 1.0)', '0.0', f'atan({edge} / sqrt({v}))', 600)})"
