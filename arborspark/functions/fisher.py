"""Fisher's exact test, two-sided, as a column expression.

Factorials come from Stirling's series, exact to double precision from 16 on, and
from a short table below; nothing grows with the universe of items.  The
p-value is the sum of the probabilities of all tables with the same margins that
are no likelier than the observed one, within a factor of 1 + 1e-7.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SMALL = 16


def log_factorial(n: Column) -> Column:
    """ln n! of whole numbers."""
    x = n.cast("double")
    y = F.greatest(x, F.lit(float(_SMALL)))
    series = y * F.ln(y) - y + 0.5 * F.ln(2 * math.pi * y) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    table = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(_SMALL)))
    return F.when(n < _SMALL, F.get(table, n.cast("int"))).otherwise(series)


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The p-value of the table [[a, b], [c, d]] of whole counts.

    Each table's probability follows from the one before by their ratio.  Tables are
    summed up to twelve deviations and fifty counts beyond the observed one, or beyond
    twelve deviations from the mean, on either side: what lies farther is below the
    last digit of the sum.
    """
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    row, column, total = a + b, a + c, a + b + c + d
    rest = total - row - column
    fixed = log_factorial(row) + log_factorial(total - row) + log_factorial(column) + log_factorial(total - column) - log_factorial(total)

    def log_p(x: Column) -> Column:
        return fixed - log_factorial(x) - log_factorial(row - x) - log_factorial(column - x) - log_factorial(rest + x)

    some = F.greatest(total, F.lit(1)).cast("double")
    mean = row * (column / some)
    spread = F.sqrt(F.greatest(mean * ((total - row) / some) * ((total - column) / F.greatest(some - 1, F.lit(1.0))), F.lit(0.0)))
    reach = F.greatest(F.abs(a - mean), 12 * spread) + 12 * spread + 50
    low = F.greatest(F.lit(0), -rest, F.floor(mean - reach))
    high = F.greatest(low, F.least(row, column, F.ceil(mean + reach)))
    at = F.struct(log_p(low).alias("now"), (log_p(a) + math.log1p(1e-7)).alias("limit"), F.lit(0.0).alias("sum"))

    def add(state: Column, x: Column) -> Column:
        here = F.when(state["now"] <= state["limit"], F.exp(state["now"])).otherwise(0.0)
        step = (row - x).cast("double") * (column - x) / ((x + 1).cast("double") * (rest + x + 1))
        return F.struct((state["now"] + F.ln(step)).alias("now"), state["limit"].alias("limit"), (state["sum"] + here).alias("sum"))

    return F.least(F.lit(1.0), F.aggregate(F.sequence(low, high), at, add, lambda state: state["sum"]))
