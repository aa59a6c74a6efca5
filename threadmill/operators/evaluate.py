"""Prediction tables to agreement statistics.

A prediction table has ``label``, ``prediction`` (``True``, ``False`` or
anything else, which is unparseable), and optionally ``confidence``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions import metrics as M
from threadmill.operators.ordered import even_buckets, null_safe, running_totals


def outcomes(strict: bool = True) -> dict[str, Column]:
    """The conditions of ``tp, fp, tn, fn, unparseable``, of which one holds for a row.

    Strictly, everything but ``True`` and ``False`` is unparseable; otherwise
    only null and ``unparseable`` are, and other text counts as a vote to keep.
    Labels other than ``removed`` are negative.
    """
    positive = F.coalesce(F.col("label") == "removed", F.lit(False))
    yes = F.coalesce(F.col("prediction") == "True", F.lit(False))
    if strict:
        valid = F.coalesce(F.col("prediction").isin("True", "False"), F.lit(False))
    else:
        valid = F.coalesce(F.col("prediction") != "unparseable", F.lit(False))
    return {
        "tp": valid & yes & positive,
        "fp": valid & yes & ~positive,
        "tn": valid & ~yes & ~positive,
        "fn": valid & ~yes & positive,
        "unparseable": ~valid,
    }


def confusion(df: DataFrame, by: list[str], strict: bool = True) -> DataFrame:
    """``tp, fp, tn, fn, unparseable`` of each run, see :func:`outcomes`: one aggregate, map-side combined."""
    return df.groupBy(*by).agg(*[F.count_if(holds).alias(name) for name, holds in outcomes(strict).items()])


def scores(df: DataFrame, by: list[str], names: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Statistics of each run from its confusion counts."""
    return confusion(df, by).select(*by, "tp", "fp", "tn", "fn", "unparseable", *M.statistics(names, digits))


def metric_bundle(df: DataFrame, by: list[str], runs: int = 2000, seed: int = 42) -> DataFrame:
    """Everything reported of a run in one row: counts, statistics, AUROC and four intervals.

    ``total_evaluated`` are the parseable rows, ``total_attempted`` all.
    Statistics have four digits; the intervals are those of
    :func:`resample.bootstrap_ci`; AUROC is null without both classes.
    """
    from threadmill.operators.resample import bootstrap_ci

    counts = confusion(df, by)
    names = ["f1", "precision", "recall", "accuracy"]
    bounds = bootstrap_ci(counts, by, names, runs, seed=seed)
    pick = lambda n, c: F.max(F.when(F.col("metric") == n, F.col(c))).alias(f"{n}_{c[3:]}")
    wide = bounds.groupBy(*by).agg(*[pick(n, c) for n in names for c in ("ci_low", "ci_high")])
    evaluated = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    base = counts.select(
        *by, "tp", "fp", "tn", "fn", "unparseable", evaluated.alias("total_evaluated"),
        (evaluated + F.col("unparseable")).alias("total_attempted"), *M.statistics([*names, "kappa"], 4),
    )
    area = auroc(df, by).withColumn("auroc", F.round("auroc", 4))
    for side in (area, wide):
        right = side.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *[c for c in side.columns if c not in by])
        same = null_safe(base, right, [(c, f"_g{i}") for i, c in enumerate(by)])
        base = base.join(right, same, "left").drop(*[f"_g{i}" for i in range(len(by))])
    return base


def macro_means(per_group: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Unweighted means over groups."""
    means = [F.avg(n).alias(n) for n in names]
    return per_group.groupBy(*by).agg(*means) if by else per_group.agg(*means)


def auroc(df: DataFrame, by: list[str], confidence: str = "confidence") -> DataFrame:
    """Area under the ROC curve with ties averaged; null without both classes.

    Rows are first counted by distinct score, so only those move and are
    sorted: the area is the sum of p * (negatives before + half of the equal ones).
    """
    positive = F.coalesce(F.col("label") == "removed", F.lit(False))
    cells = (
        df.where(F.col(confidence).isNotNull())
        .groupBy(*by, F.col(confidence).alias("c"))
        .agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    )
    ranked = running_totals(even_buckets(cells, by, "c"), by, ["c"], {"under": F.col("n")}, inclusive=False)
    area = F.sum(F.col("p") * (F.col("under") * 2 + F.col("n")))
    pairs = (F.sum("p") * F.sum("n") * 2).cast("double")
    return ranked.groupBy(*by).agg(F.try_divide(area.cast("double"), pairs).alias("auroc"))


def roc_curve(df: DataFrame, by: list[str], confidence: str = "confidence") -> DataFrame:
    """Cumulative true and false positives at each distinct score, from the highest."""
    positive = F.coalesce(F.col("label") == "removed", F.lit(False))
    cells = (
        df.where(F.col(confidence).isNotNull())
        .groupBy(*by, F.col(confidence).alias("threshold"))
        .agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    )
    cut = even_buckets(cells, by, "threshold", down=True)
    curve = running_totals(cut, by, [F.desc("threshold")], {"tp": F.col("p"), "fp": F.col("n")})
    return curve.select(*by, "threshold", "tp", "fp")


def auroc_by_rows(df: DataFrame, by: list[str], order: str, confidence: str = "confidence", least: int = 10) -> DataFrame:
    """Trapezoid area with one step for each row, ties in the order of ``order``;
    null below ``least`` scored rows or with one class."""
    positive = F.coalesce(F.col("label") == "removed", F.lit(False)).cast("long")
    rows = df.where(F.col(confidence).isNotNull()).withColumn("_p", positive)
    cut = even_buckets(rows, by, confidence, down=True)
    seen = running_totals(cut, by, [F.desc(confidence), order], {"_tp": F.col("_p")})
    # Only a negative row moves the curve to the right, at the height reached.
    area = F.sum(F.when(F.col("_p") == 0, F.col("_tp")).otherwise(0))
    p, n = F.sum("_p"), F.count_if(F.col("_p") == 0)
    value = F.try_divide(area.cast("double"), (p * n).cast("double"))
    return seen.groupBy(*by).agg(F.when(F.count("*") >= least, value).alias("auroc"))


def confidence_stats(df: DataFrame, by: list[str], confidence: str = "confidence") -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(confidence).alias("mean"), F.min(confidence).alias("min"),
        F.max(confidence).alias("max"), F.count(confidence).alias("n"),
    )


def paired(a: DataFrame, b: DataFrame, order: str, key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, keep..., label, pred_a, pred_b)`` of the ids that two models share.

    Of repeated ids the last by ``order`` counts on either side; label and the
    columns to keep are the first model's. A null id pairs with nothing.
    """
    last = lambda df, *cols: (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_row")).select(key, "_row.*")
    )
    left = last(a, *keep, "label", F.col("prediction").alias("pred_a"))
    return left.join(last(b, F.col("prediction").alias("pred_b")), key)


def _correct(label: Column, prediction: Column) -> Column:
    want = F.when(label == "removed", "True").otherwise("False")
    return F.coalesce(prediction == want, F.lit(False))


def mcnemar(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``b`` (first right, second wrong), ``c`` (the reverse), chi-square and significance.

    An unparseable prediction is wrong. Without discordant pairs chi-square is
    0 and nothing is significant.
    """
    right_a, right_b = _correct(F.col("label"), F.col("pred_a")), _correct(F.col("label"), F.col("pred_b"))
    counts = pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(right_a & ~right_b).alias("b"),
        F.count_if(~right_a & right_b).alias("c"),
    )
    return counts.withColumn("chi2", M.chi_square(F.col("b"), F.col("c"))).withColumns(
        {"significant_05": F.col("chi2") > 3.841458820694124, "significant_01": F.col("chi2") > 6.634896601021213}
    )


def chi_square_tail(df: DataFrame, column: str = "chi2", name: str = "p_value") -> DataFrame:
    """Adds P(chi-square with one degree of freedom > x) through ``erfc``; 1 for x <= 0."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v > 0 else 1.0, na_action="ignore")

    return df.withColumn(name, tail(F.col(column)))


def predicted_shares(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of rows predicted ``True``."""
    return df.groupBy(*by).agg(
        F.avg(F.when(F.col("prediction") == "True", 1.0).otherwise(0.0)).alias("share_true"),
        F.count("*").alias("n"),
    )


def density_histogram(df: DataFrame, by: str, confidence: str = "confidence", bins: int = 40, peak: float = 0.7) -> DataFrame:
    """Densities of the scores of the two classes over ``[0, 1]``, scaled so that the higher peak is ``peak``."""
    slot = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(confidence).between(0, 1) & F.col("label").isin("removed", "approved"))
    counts = rows.groupBy(by, "label", slot.alias("bin")).agg(F.count("*").alias("n"))
    # At most 2 * bins rows for each group from here.
    total = F.sum("n").over(Window.partitionBy(by, "label"))
    density = counts.withColumn("density", F.col("n") * float(bins) / total)
    top = F.max("density").over(Window.partitionBy(by))
    return density.withColumn("height", F.col("density") / top * peak)


def compare_baseline(ours: DataFrame, theirs: DataFrame, key: str, metrics: dict[str, list[str]]) -> DataFrame:
    """Left join of a baseline with differences; of several names of a metric the first that is not 0 counts."""
    picked = theirs.select(
        key, *[F.coalesce(*[F.nullif(F.col(n), F.lit(0.0)) for n in names]).alias(f"{m}_base") for m, names in metrics.items()]
    )
    joined = ours.join(picked, key, "left")
    return joined.withColumns({f"{m}_delta": F.round(F.col(m) - F.col(f"{m}_base"), 4) for m in metrics})


def ablation_table(per_condition: DataFrame, condition: str, names: list[str], by: list[str], base: str = "baseline") -> DataFrame:
    """Statistics of each condition less those of the baseline of the same group."""
    reference = per_condition.where(F.col(condition) == base).select(*by, *[F.col(n).alias(f"{n}_0") for n in names])
    joined = per_condition.join(reference, by, "left") if by else per_condition.crossJoin(F.broadcast(reference))
    return joined.withColumns({f"{n}_delta": F.col(n) - F.col(f"{n}_0") for n in names}).drop(*[f"{n}_0" for n in names])


# What each condition hides, and the constants put in its place.
MASKS = {
    "baseline": {},
    "post_metadata": {"post_title": ""},
    "structural": {"is_top_level": False, "parent_body": ""},
    "author_history": {"account_age_days": -1.0, "author_is_first": False},
    "all_masked": {
        "post_title": "", "is_top_level": False, "parent_body": "", "account_age_days": -1.0, "author_is_first": False,
    },
}


def mask_features(df: DataFrame, masks: dict[str, dict] | None = None) -> DataFrame:
    """Every row once for each condition, with the condition's fields set to constants: one pass, no join."""
    masks = masks or MASKS
    expanded = df.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in masks])))
    fields = {f for m in masks.values() for f in m if f in df.columns}
    out = {}
    for f in fields:
        value = F.col(f)
        for name, mask in masks.items():
            if f in mask:
                value = F.when(F.col("condition") == name, F.lit(mask[f])).otherwise(value)
        out[f] = value
    return expanded.withColumns(out)
