"""Running totals within groups of any size.

A window over a group runs in one task, however large the group. Here a group
is cut into buckets that lie one after the other in the order asked for: totals
run within a bucket, and what the buckets before it hold is added from a small
table of one row for each group and bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality of columns where null equals null."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def even_buckets(df: DataFrame, by: list[str], value: str, name: str = "_bucket", down: bool = False) -> DataFrame:
    """Adds a bucket of ``value`` within its group: equal steps from the least to the greatest, null first.

    Values that crowd in one step are still ranked in one task; draws and ids
    are spread evenly.
    """
    span = df.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(
        F.min(value).cast("double").alias("_least"), F.max(value).cast("double").alias("_most")
    )
    keys = [(c, f"_g{i}") for i, c in enumerate(by)]
    joined = df.join(span, null_safe(df, span, keys), "left").drop(*[k for _, k in keys])
    share = F.try_divide(F.col(value).cast("double") - F.col("_least"), F.col("_most") - F.col("_least"))
    step = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    return joined.withColumn(name, -step if down else step).drop("_least", "_most")


def running_totals(
    df: DataFrame, by: list[str], order: list, totals: dict[str, Column], bucket: str = "_bucket", inclusive: bool = True
) -> DataFrame:
    """Adds the running total of each of ``totals`` in the order (bucket, order) of its group.

    ``inclusive`` counts the row itself. ``<name>_all`` is the total of the
    group. The bucket column must agree with the order and is dropped.
    """
    parts = {f"_t{i}": c.cast("long") for i, c in enumerate(totals.values())}
    rows = df.withColumns(parts)
    keys = [(c, f"_g{i}") for i, c in enumerate([*by, bucket])]
    names = [g for _, g in keys]
    held = rows.groupBy(*[F.col(c).alias(g) for c, g in keys]).agg(*[F.sum(t).alias(f"_h{t}") for t in parts])
    group = Window.partitionBy(*names[:-1])
    before = group.orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(
        *names,
        *[F.coalesce(F.sum(f"_h{t}").over(before), F.lit(0)).alias(f"_o{t}") for t in parts],
        *[F.sum(f"_h{t}").over(group).alias(f"_a{t}") for t in parts],
    )
    joined = rows.join(offsets, null_safe(rows, offsets, keys)).drop(*names)
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = {}
    for name, t in zip(totals, parts, strict=True):
        out[name] = F.coalesce(F.sum(t).over(inside), F.lit(0)) + F.col(f"_o{t}")
        out[f"{name}_all"] = F.col(f"_a{t}")
    spent = [f"{p}{t}" for t in parts for p in ("", "_o", "_a")]
    return joined.withColumns(out).drop(bucket, *spent)
