"""Column expressions for the arithmetic of the learners; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: float) -> Column:
    return F.lit(float(x))


def erf(x: Column) -> Column:
    """Rational approximation of the error function, to about 1.5e-7."""
    # The published coefficients of the approximation.
    coefficients = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = _d(1) / (_d(1) + _d(0.3275911) * F.abs(x))
    poly = _d(0)
    for c in reversed(coefficients):
        poly = (poly + _d(c)) * t
    return F.signum(x) * (_d(1) - poly * F.exp(-x * x))


def entropy_terms(n: Column, total: Column) -> Column:
    """One class's part of the entropy; 0 for an empty class."""
    p = n / total
    return F.when((n > 0) & (total > 0), -p * F.log2(p)).otherwise(_d(0))


def deviation(weight: Column, m2: Column) -> Column:
    """Standard deviation with frequency weights; 0 up to weight 1."""
    return F.when(weight > 1, F.sqrt(m2 / (weight - 1))).otherwise(_d(0))


def gaussian_pdf(x: Column, weight: Column, mean: Column, m2: Column) -> Column:
    s = deviation(weight, m2)
    density = F.exp(-(x - mean) * (x - mean) / (_d(2) * s * s)) / (s * F.sqrt(_d(2) * F.pi()))
    point = F.when(F.abs(x - mean) < 1e-10, _d(1)).otherwise(_d(0))
    return F.when(weight <= 1, _d(0)).when(s < 1e-10, point).otherwise(density)


def gaussian_below(x: Column, weight: Column, mean: Column, m2: Column) -> Column:
    s = deviation(weight, m2)
    step = F.when(x >= mean, _d(1)).otherwise(_d(0))
    return F.when(weight <= 0, _d(0)).when(s < 1e-10, step).otherwise((_d(1) + erf((x - mean) / (s * F.sqrt(_d(2))))) / 2)


def hoeffding_bound(delta: Column, n: Column) -> Column:
    return F.sqrt(F.ln(_d(1) / delta) / (_d(2) * n))


def adwin_bound(n0: Column, n1: Column, delta: Column) -> Column:
    n = n0 + n1
    return F.sqrt((_d(1) / n0 + _d(1) / n1) * F.ln(_d(4) * n * n / delta) / 2)


def log_mean_exp(a: Column, b: Column) -> Column:
    """ln((e^a + e^b) / 2) without overflow."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return hi + F.ln((_d(1) + F.exp(lo - hi)) / 2)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for positive numbers: Stirling's series from x + 8 on, to about 1e-13 of the larger terms."""
    y = x + 8
    series = sum((_d(c) / F.pow(y, _d(2 * i + 1)) for i, c in enumerate((1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188))), _d(0))
    shift = x
    for i in range(1, 8):
        shift = shift * (x + i)
    return (y - 0.5) * F.ln(y) - y + F.ln(F.lit(2.0) * F.pi()) / 2 + series - F.ln(shift)


def leaf_probability(count: Column, total: Column, alpha: Column, n_classes: Column) -> Column:
    return (count + alpha) / (total + alpha * n_classes)


def box_extension(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - x, x - high, _d(0))


def split_point(low: Column, high: Column, i: Column, n: int) -> Column:
    """The i-th (from 0) of n thresholds evenly inside a range."""
    return low + (high - low) / (n + 1) * (i + 1)


def scores_to_votes(scores: Column, n_classes: int) -> Column:
    """Shares of the positive scores of an array; uniform if there is none."""
    positive = F.transform(scores, lambda s: F.greatest(s, _d(0)))
    total = F.aggregate(positive, _d(0), lambda a, s: a + s)
    return F.when(total > 0, F.transform(positive, lambda s: s / total)).otherwise(F.array_repeat(_d(1 / n_classes), n_classes))


def argmax_last(votes: Column) -> Column:
    """0-based place of the largest element, the last of equals."""
    return F.size(votes) - F.array_position(F.reverse(votes), F.array_max(votes)).cast("int")


def pseudo_random(*parts: tuple[Column, int]) -> Column:
    """A number from 0 to below 1 from a linear congruence; SQL engines agree on it."""
    total = sum((c.cast("long") * F.lit(k).cast("long") for c, k in parts), F.lit(0).cast("long"))
    return (total % 2147483648).cast("double") / _d(2147483648)


def poisson_from_uniform(u: Column, thresholds: tuple[float, ...]) -> Column:
    """The number of thresholds of a cumulative distribution at or below a uniform number."""
    return sum(((u >= t).cast("int") for t in map(_d, thresholds)), F.lit(0))
