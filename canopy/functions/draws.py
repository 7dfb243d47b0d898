"""Random draws without state: functions of an id, a stream and a salt, so that any row can be drawn anywhere, again and in any order.

`uniform_sql` is text that Spark and DuckDB read alike, `uniform` the same arithmetic in Python; all stay below 2^62.  An id is mixed by
two squarings modulo the prime 2^31 - 1, after which streams that differ by one don't resemble each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2**31 - 1


def uniform_sql(row: str, stream: str, salt: int) -> str:
    """A number from 0 to below 1."""
    at = f"((CAST({row} AS BIGINT) % {PRIME} + {PRIME}) % {PRIME})"
    a = f"(({at} * 1103515245 + (CAST({stream} AS BIGINT) % {PRIME}) * 22695477 + {salt * 69069 % PRIME}) % {PRIME})"
    b = f"(({a} * {a} + {a} * 16807 + 12345) % {PRIME})"
    c = f"(({b} * 48271 + {at}) % {PRIME})"
    return f"(CAST(({c} * {c} + {a}) % {PRIME} AS DOUBLE) / {PRIME})"


def uniform(row: int, stream: int, salt: int) -> float:
    at = row % PRIME
    a = (at * 1103515245 + (stream % PRIME) * 22695477 + salt * 69069 % PRIME) % PRIME
    c = ((a * a + a * 16807 + 12345) % PRIME * 48271 + at) % PRIME
    return ((c * c + a) % PRIME) / PRIME


def uniform_column(row: str, stream: str, salt: int) -> Column:
    """`row` and `stream` are expressions of whole numbers."""
    return F.expr(uniform_sql(row, stream, salt))


def exponential(u: Column, rate: Column) -> Column:
    return -F.ln(F.lit(1.0) - u) / rate


def poisson_thresholds(mean: float) -> tuple[float, ...]:
    """Cumulative shares of a Poisson distribution, to within 1e-9 of all."""
    term = total = math.exp(-mean)
    out, k = [total], 0
    while total < 1 - 1e-9 and k < 10 * mean + 100:
        k += 1
        term *= mean / k
        total += term
        out.append(total)
    return tuple(out)


def poisson_sql(u: str, mean: float) -> str:
    return "(" + " + ".join(f"CAST({u} >= CAST({t!r} AS DOUBLE) AS INT)" for t in poisson_thresholds(mean)) + ")"


def discrete(u: Column, weights: Column) -> Column:
    """A place in an array of weights, drawn in proportion to them; the last for no weight at all."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("sums"))
    add = lambda a, w: F.struct((a["sum"] + w).alias("sum"), F.array_append(a["sums"], a["sum"] + w).alias("sums"))
    run = F.aggregate(weights, zero, add)
    return F.least(F.size(F.filter(run["sums"], lambda s: s <= u * run["sum"])), F.size(weights) - 1)


def subset(n: int, size: int, stream: int, salt: int) -> tuple[int, ...]:
    """`size` of the numbers below n, ascending: those with the smallest draws."""
    return tuple(sorted(sorted(range(n), key=lambda i: (uniform(i, stream, salt), i))[:size]))


def subset_sql(n: int, size: int, stream: str, salt: int, number: str) -> str:
    """Whether `number`, of the numbers below n, is among the `size` of smallest draws."""
    own = uniform_sql(number, stream, salt)
    before = " + ".join(f"CAST({uniform_sql(str(i), stream, salt)} < {own} OR ({uniform_sql(str(i), stream, salt)} = {own} AND {i} < {number}) AS INT)" for i in range(n))
    return f"({before} < {size})"
