"""Rates, their intervals and nearest-rank percentiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of the 95 % interval.
Z = 1.96


def rate(hits: Column, n: Column) -> Column:
    """Share of hits, null where n is 0."""
    return F.when(n > 0, hits / n)


def wilson(hits: Column, n: Column, upper: bool) -> Column:
    """A bound of the Wilson interval, within [0, 1]; null where n is 0."""
    p, sign = hits / n, 1 if upper else -1
    middle = p + Z * Z / (2 * n)
    half = Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)
    return F.when(n > 0, F.greatest(F.least((middle + sign * half) / (1 + Z * Z / n), F.lit(1.0)), F.lit(0.0)))


def wilson_sql(hits: str, n: str, upper: bool) -> str:
    p, sign = f"({hits})::DOUBLE / ({n})", "+" if upper else "-"
    return f"CASE WHEN ({n}) > 0 THEN greatest(least((({p}) + {Z * Z} / (2 * ({n})) {sign} {Z} * sqrt((({p}) * (1 - ({p})) + {Z * Z} / (4 * ({n}))) / ({n}))) / (1 + {Z * Z} / ({n})), 1.0), 0.0) END"


def nearest_rank(counts: Column, total: Column, q: float) -> Column:
    """Value at index min(n - 1, floor(q * n)) of sorted (value, count) pairs; 0 without values.

    counts is an array of structs (value, n) sorted by value: distinct values stand for all
    rows, so a group's rows never meet in one place.
    """
    index = F.least(F.floor(q * total), total - 1)
    step = F.aggregate(
        counts,
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("value")),
        lambda a, c: F.struct((a["seen"] + c["n"]).alias("seen"), F.when(a["value"].isNull() & (index < a["seen"] + c["n"]), c["value"].cast("double")).otherwise(a["value"]).alias("value")),
        lambda a: a["value"],
    )
    return F.coalesce(step, F.lit(0.0))
