"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(hits: Column, total: Column) -> Column:
    """hits / total; null on zero."""
    return hits / F.when(total != 0, total)


def pstdev(value: str) -> Column:
    """Population deviation; null below two values."""
    return F.when(F.count(value) >= 2, F.stddev_pop(value))


def coefficient_of_variation(value: str) -> Column:
    """Deviation over mean; null below two values or where the mean is not positive."""
    return F.when((F.count(value) >= 2) & (F.avg(value) > 0), F.stddev_pop(value) / F.avg(value))


def exclusive_quartile(sorted_values: Column, i: int) -> Column:
    """Quartile i (1 or 3) of a short sorted array, with exclusive positions i*(n+1)/4; null below four values. Of large groups: ``ordering.placed``."""
    n = F.size(sorted_values)
    place = F.lit(i) * (n + 1)
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor(place / 4).cast("int")))
    d = place - 4 * j
    return F.when(n >= 4, (F.get(sorted_values, j - 1) * (4 - d) + F.get(sorted_values, j) * d) / 4)


def exact_mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p of b against c discordant pairs; 1 if there is none.

    Terms of the binomial tail are summed as logarithms, so large counts are exact enough too.
    """
    n, k = b + c, F.least(b, c)
    start = F.struct((n.cast("double") * F.log(F.lit(0.5))).alias("t"), F.lit(0.0).alias("s"))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")),
        start,
        lambda a, i: F.struct(
            (a["t"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")
        ),
        lambda a: a["s"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))
