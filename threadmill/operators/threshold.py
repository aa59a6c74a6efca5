"""Length baseline: the word-count threshold that separates the classes best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.operators.evaluate import scores

DIRECTIONS = ("short_is_removed", "long_is_removed")


def length_histogram(df: DataFrame, by: list[str], length: Column) -> DataFrame:
    """Rows of each class by length: all that the fit needs, however many rows there are."""
    positive = F.coalesce(F.col("label") == "removed", F.lit(False))
    return df.groupBy(*by, length.cast("long").alias("len")).agg(
        F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")
    )


def fit_threshold(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Threshold and direction with the largest balanced accuracy; ties go to the short direction,
    then to the smaller threshold.

    ``short_is_removed`` predicts removal below the threshold, ``long_is_removed``
    from it on. Balanced accuracy changes only just above an observed length,
    so those thresholds and 1 are enough: O(lengths), not O(rows * lengths).
    Differences below four digits decide, where a rounded comparison would not.
    """
    upto = Window.partitionBy(*by).orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    steps = histogram.select(
        *by,
        (F.col("len") + 1).alias("threshold"),
        F.sum("p").over(upto).alias("p_below"),
        F.sum("n").over(upto).alias("n_below"),
        F.sum("p").over(whole).alias("p_all"),
        F.sum("n").over(whole).alias("n_all"),
    )
    first = steps.groupBy(*by, "p_all", "n_all").agg(F.min("threshold").alias("_m"))
    start = first.where("_m > 1").select(
        *by, F.lit(1).cast("long").alias("threshold"), F.lit(0).cast("long").alias("p_below"),
        F.lit(0).cast("long").alias("n_below"), "p_all", "n_all",
    )
    steps = steps.unionByName(start)
    short = dict(tp="p_below", fp="n_below", tn="n_all - n_below", fn="p_all - p_below")
    long = dict(tp="p_all - p_below", fp="n_all - n_below", tn="n_below", fn="p_below")
    both = [
        steps.select(*by, "threshold", F.lit(k).alias("rank"), F.lit(d).alias("direction"),
                     *[F.expr(f"CAST({e} AS BIGINT)").alias(c) for c, e in cells.items()])
        for k, (d, cells) in enumerate(zip(DIRECTIONS, (short, long), strict=True))
    ]
    cands = both[0].unionByName(both[1])
    # Compare as an integer ratio's double: tp/P + tn/N.
    bal = (F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
           + F.coalesce(F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp")), F.lit(0.0))) / 2.0
    cands = cands.withColumn("bal_acc", bal)
    best = F.struct(F.col("bal_acc"), -F.col("rank"), -F.col("threshold"))
    row = F.struct("threshold", "direction", "bal_acc", "tp", "fp", "tn", "fn")
    return cands.groupBy(*by).agg(F.max_by(row, best).alias("r")).select(*by, "r.*")


def apply_threshold(df: DataFrame, fitted: DataFrame, by: list[str], length: Column) -> DataFrame:
    """Adds ``prediction`` by each group's rule; the fitted table has one row for each group."""
    rule = fitted.select(*by, F.col("threshold").alias("_t"), F.col("direction").alias("_d"))
    short = (F.col("_d") == DIRECTIONS[0]) & (length < F.col("_t"))
    long = (F.col("_d") == DIRECTIONS[1]) & (length >= F.col("_t"))
    return df.join(rule, by).withColumn("prediction", F.when(short | long, "True").otherwise("False")).drop("_t", "_d")


def length_baseline(train: DataFrame, test: DataFrame, by: list[str], length: Column) -> DataFrame:
    """Fit on one part, statistics on the other."""
    fitted = fit_threshold(length_histogram(train, by, length), by)
    got = scores(apply_threshold(test, fitted, by, length), by)
    return got.join(fitted.select(*by, "threshold", "direction"), by)
