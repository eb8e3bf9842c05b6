"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def category_code(c: Column, codes: dict[str, int], unknown: int = -1) -> Column:
    """The fixed number of a category; ``unknown`` for others and NULL."""
    table = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), F.lit(unknown))


def flag(condition: Column) -> Column:
    """1 or 0; NULL counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def entropy(shares: Column, eps: float = 1e-9) -> Column:
    """-sum p ln(p + eps) over an array's non-NULL shares; NULL if all are NULL."""
    some = F.filter(shares, lambda p: p.isNotNull())
    return F.when(F.size(some) > 0, -F.aggregate(some, F.lit(0.0), lambda a, p: a + p * F.ln(p + eps)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hashed_unit(c: Column, factor: int = 2654435761, bits: int = 32) -> Column:
    """A multiplicative hash of a whole number, in [0, 1)."""
    return F.pmod(c.cast("long") * F.lit(factor), F.lit(1 << bits)) / float(1 << bits)


def smallest_denominator(rate: Column, most: int = 160, tolerance: float = 5e-6) -> Column:
    """The least whole number n up to ``most`` for which rate * n is whole to within tolerance * n; NULL if none."""
    return F.get(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: F.abs(rate * n - F.rint(rate * n)) <= tolerance * n), 0)


def common_denominator(rates: list[Column], most: int = 160, tolerance: float = 5e-6) -> Column:
    """The least whole number n up to ``most`` for which every rate * n is whole to within tolerance * n; NULL if none, or if a rate is NULL."""

    def whole(n: Column) -> Column:
        fits = F.lit(True)
        for r in rates:
            fits = fits & (F.abs(r * n - F.rint(r * n)) <= tolerance * n)
        return F.coalesce(fits, F.lit(False))

    return F.get(F.filter(F.sequence(F.lit(1), F.lit(most)), whole), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def softmax(xs: Column) -> Column:
    """Shares in proportion to exp(x), shifted by the greatest x."""
    e = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def bhattacharyya(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.sqrt(a * b)), F.lit(0.0), lambda s, x: s + x)


def piecewise_linear(x: Column, edges: list[float]) -> Column:
    """clip((x - b0) / (b1 - b0), 0, 1) for each bin of the edges; NULL stays NULL."""
    return F.array(*(F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))) for a, b in zip(edges, edges[1:], strict=False)))


def parse_date(c: Column, formats: list[str]) -> Column:
    """A date in the first format that fits; NULL if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats)).cast("date")


def tanh_cap(x: Column, cap: float) -> Column:
    """cap * tanh(x / cap): near x for small x, never beyond the cap."""
    return cap * F.tanh(x / cap)


def gelu(x: Column) -> Column:
    """Gaussian error linear unit by the tanh form."""
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * F.pow(x, 3))))


def normal_cdf(x: Column) -> Column:
    """Cumulative normal distribution by a rational approximation of erf, absolute error below 2e-7."""
    z = F.abs(x) / (2**0.5)
    t = 1 / (1 + 0.3275911 * z)
    # The coefficients of the approximation (Abramowitz and Stegun 7.1.26).
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
    return F.when(x >= 0, 1 - tail / 2).otherwise(tail / 2)


def normal_cdf_series(x: Column, terms: int = 160) -> Column:
    """Cumulative normal distribution to about 1e-15: a power series up to 4 deviations, a continued fraction beyond."""
    z = F.abs(x)
    density = F.exp(-z * z / 2) / (2 * math.pi) ** 0.5
    start = F.struct(z.alias("term"), z.alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, lambda s, k: F.struct((s["term"] * z * z / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * z * z / (2 * k + 1)).alias("total")))
    tail = F.aggregate(F.sequence(F.lit(100), F.lit(1), F.lit(-1)), z, lambda f, k: z + k / f)
    upper = F.when(z <= 4, 0.5 - density * series["total"]).otherwise(density / tail)
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def normal_quantile(p: Column, steps: int = 60) -> Column:
    """The x whose cumulative normal distribution is p, to about 1e-12, by bisection on [-9, 9]; NULL outside (0, 1)."""
    ends = F.struct(F.lit(-9.0).alias("lo"), F.lit(9.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        low = normal_cdf_series(middle) < p
        return F.struct(F.when(low, middle).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(middle).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ends, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when((p > 0) & (p < 1), found)


def marcum_q1(a: Column, b: Column, terms: int = 400) -> Column:
    """Chance that a point normal around distance ``a`` from the centre (unit deviation, two dimensions) lies beyond ``b``.

    This is 1 less the non-central chi-square distribution with two degrees of freedom at b squared: Poisson weights of
    central ones, whose tails are partial sums of an exponential series.
    """
    u, v = a * a / 2, b * b / 2
    start = F.struct(F.exp(-u).alias("w"), F.exp(-v).alias("t"), F.exp(-v).alias("s"), (F.exp(-u) * F.exp(-v)).alias("q"), F.exp(-u).alias("all"))

    def step(x: Column, k: Column) -> Column:
        w, t = x["w"] * u / k, x["t"] * v / k
        s = x["s"] + t
        return F.struct(w.alias("w"), t.alias("t"), s.alias("s"), (x["q"] + w * s).alias("q"), (x["all"] + w).alias("all"))

    # What is left of the weights belongs to tails that are 1.
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda x: F.least(F.lit(1.0), x["q"] + F.greatest(F.lit(0.0), 1 - x["all"])))
