"""Counts that audit a comment set: classes, filters, presence, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.comment import filters, keep_comment, removal_class

CLASSES = ("captured_removed", "captured_deleted", "removed_no_text", "deleted_no_text", "approved")


def classify(df: DataFrame, variant: str = "stream") -> DataFrame:
    """Adds ``category`` from body and ``_meta``."""
    return df.withColumn(
        "category",
        removal_class(F.col("body"), F.col("_meta.removal_type"), F.col("_meta.was_deleted_later"), variant),
    )


def category_counts(df: DataFrame, by: str = "subreddit") -> DataFrame:
    """Rows of each class for each community, their total and the usable share."""
    counts = [F.count_if(F.col("category") == c).alias(c) for c in CLASSES]
    return (
        df.groupBy(by)
        .agg(*counts, F.count("*").alias("total"))
        .withColumn("usable", F.col("captured_removed") / F.col("total").cast("double"))
    )


def category_shares(df: DataFrame) -> DataFrame:
    """Rows of each class over all communities and their share."""
    counts = df.groupBy("category").agg(F.count("*").alias("n"))
    # One row for each class; the window is over those few rows.
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", F.col("n") / total.cast("double"))


def filter_breakdown(df: DataFrame, by: str) -> DataFrame:
    """How many rows each filter reason holds for, independent of the others, and how many stay."""
    cols = [F.col("author"), F.col("body"), F.col("distinguished")]
    reasons = filters(*cols)
    return df.groupBy(by).agg(
        F.count("*").alias("total"),
        *[F.count_if(test).alias(name) for name, test in reasons.items()],
        F.count_if(keep_comment(*cols)).alias("kept"),
    )


def kept_comments(df: DataFrame) -> DataFrame:
    return df.where(keep_comment(F.col("author"), F.col("body"), F.col("distinguished")))


def dataset_stats(df: DataFrame, by: str = "split") -> DataFrame:
    """Rows, distinct authors and classes of each split."""
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("author").alias("n_authors"),
        F.count_if(F.col("label") == "removed").alias("n_removed"),
        F.count_if(F.col("label") == "approved").alias("n_approved"),
    )


def presence_counts(df: DataFrame, tests: dict[str, Column], by: str | None = None) -> DataFrame:
    """Rows for which each named test holds, and the percentage."""
    grouped = df.groupBy(by) if by else df.groupBy()
    aggs = [F.count("*").alias("total")] + [F.count_if(t).alias(n) for n, t in tests.items()]
    out = grouped.agg(*aggs)
    share = {
        f"{n}_pct": F.coalesce(F.try_divide(100.0 * F.col(n), F.col("total").cast("double")), F.lit(0.0))
        for n in tests
    }
    return out.withColumns(share)


def missing_values(df: DataFrame, by: str | None = None) -> DataFrame:
    """Rows without a title, and rows whose author should have a history but has none."""
    gone = (F.col("author_n_prior") == 0) & ~F.col("author_is_first")
    return (df.groupBy(by) if by else df.groupBy()).agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("post_title", F.lit("")) == "").alias("missing_titles"),
        F.count_if(gone).alias("missing_author"),
    )


def parsed_predictions(df: DataFrame, prediction: str = "prediction") -> tuple[DataFrame, DataFrame]:
    """Rows with a prediction, and one row ``(n_kept, n_failed)``: how many have one and how many do not."""
    has = F.coalesce(~F.col(prediction).isin("", "unparseable"), F.lit(False))
    return df.where(has), df.agg(F.count_if(has).alias("n_kept"), F.count_if(~has).alias("n_failed"))


def author_overlap(df: DataFrame, left: str, right: str, split_col: str = "split") -> DataFrame:
    """Authors that occur in both of two splits: one pass, no join."""
    flags = (
        df.where(F.col("author").isNotNull() & F.col(split_col).isin(left, right))
        .groupBy("author")
        .agg(F.bool_or(F.col(split_col) == left).alias("l"), F.bool_or(F.col(split_col) == right).alias("r"))
    )
    return flags.agg(F.count_if(F.col("l") & F.col("r")).alias("n_shared"), F.count("*").alias("n_authors"))


def coverage(requested: DataFrame, archive: DataFrame, key: str = "id", by: str = "subreddit") -> DataFrame:
    """Requested and recovered ids for each group and in all (null group)."""
    found = archive.select(key).distinct().withColumn("found", F.lit(1))
    joined = requested.select(by, key).distinct().join(found, key, "left")
    return (
        joined.rollup(by)
        .agg(F.count("*").alias("requested"), F.count("found").alias("recovered"))
        .withColumn("coverage", F.coalesce(F.try_divide(F.col("recovered").cast("double"), F.col("requested")), F.lit(0.0)))
    )


def token_costs(df: DataFrame, model: str, tokens: list[str], prefixes: list[str]) -> DataFrame:
    """Token sums by the prefix of a model's name, the first that fits."""
    name = F.coalesce(*[F.when(F.col(model).startswith(p), F.lit(p)) for p in prefixes], F.lit("other"))
    return df.groupBy(name.alias("model")).agg(*[F.sum(t).alias(t) for t in tokens])
