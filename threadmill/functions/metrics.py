"""Agreement statistics from confusion counts, as column expressions.

All take columns ``tp, fp, tn, fn``; a zero denominator gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(_d(a), _d(b)), F.lit(0.0))


def accuracy(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    return ratio(tp + tn, tp + fp + tn + fn)


def precision(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def kappa(tp: Column, fp: Column, tn: Column, fn: Column, degenerate: float = 1.0) -> Column:
    """Cohen's kappa; 0 without rows, ``degenerate`` where chance agreement is complete."""
    n = _d(tp + fp + tn + fn)
    observed = F.try_divide(_d(tp + tn), n)
    chance = F.try_divide(_d(tp + fp) * _d(tp + fn) + _d(fn + tn) * _d(fp + tn), n * n)
    value = F.when(chance == 1.0, F.lit(degenerate)).otherwise(F.try_divide(observed - chance, 1.0 - chance))
    return F.when(n == 0, 0.0).otherwise(value)


def macro_f1(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    return (f1(tp, fp, tn, fn) + f1(tn, fn, tp, fp)) / 2.0


def balanced_accuracy(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    return (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2.0


STATISTICS = {
    "accuracy": accuracy,
    "precision": precision,
    "recall": recall,
    "f1": f1,
    "kappa": kappa,
    "macro_f1": macro_f1,
    "balanced_accuracy": balanced_accuracy,
}


def statistics(names: list[str] | None = None, digits: int | None = None) -> list[Column]:
    """Named statistics of the columns ``tp, fp, tn, fn``, rounded if asked."""
    cells = [F.col(c) for c in ("tp", "fp", "tn", "fn")]
    out = []
    for name in names or list(STATISTICS):
        value = STATISTICS[name](*cells)
        out.append((F.round(value, digits) if digits is not None else value).alias(name))
    return out


def chi_square(b: Column, c: Column) -> Column:
    """McNemar's statistic with continuity correction; 0 without discordant pairs."""
    return F.coalesce(F.try_divide(F.pow(F.abs(b - c) - 1.0, 2), _d(b + c)), F.lit(0.0))
