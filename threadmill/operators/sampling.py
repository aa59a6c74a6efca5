"""Deterministic samples and splits: random order is the order of a keyed MD5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.operators.ordered import running_totals

SEED = 42


def draw(key: str | Column, seed: int = SEED, tag: str = "") -> Column:
    """A random order that depends on the row's key, the seed and a tag only."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", F.lit(f"{seed}{tag}"), column.cast("string")))


def _rank(by: list[str], key: str, seed: int, tag: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(draw(key, seed, tag), key))


def drawn_ranks(df: DataFrame, by: list[str], key: str, seed: int = SEED, tag: str = "") -> DataFrame:
    """Adds ``_r``, the rank of a row in the random order of its group, and ``_r_all``, the group's size.

    Rows are ranked within (group, leading hex digits of the draw) and offset
    by the counts before, so that a hot group is cut over 256 tasks.
    """
    rows = df.withColumn("_draw", draw(key, seed, tag)).withColumn("_bucket", F.substring("_draw", 1, 2))
    return running_totals(rows, by, ["_draw", key], {"_r": F.lit(1)}).drop("_draw")


def bottom_k(df: DataFrame, by: list[str], key: str, k: int, seed: int = SEED, tag: str = "") -> DataFrame:
    """``k`` rows of each group with equal chances; a rank filter that Spark limits before its shuffle."""
    return df.withColumn("_r", _rank(by, key, seed, tag)).where(F.col("_r") <= k).drop("_r")


def reservoir(df: DataFrame, by: str, key: str, size: int, keep: Column, seed: int = SEED) -> DataFrame:
    """All rows for which ``keep`` holds and a sample of ``size`` of the others of each group."""
    keep = F.coalesce(keep, F.lit(False))
    others = bottom_k(df.where(~keep), [by], key, size, seed, "reservoir")
    return df.where(keep).unionByName(others)


def cap_and_balance(
    df: DataFrame, by: str, label: str, key: str, cap: int = 5000, seed: int = SEED
) -> DataFrame:
    """Each class of a group cut to the cap and to the smaller of its two classes."""
    sizes = df.groupBy(by).agg(
        F.least(F.count_if(F.col(label) == "removed"), F.count_if(F.col(label) == "approved"), F.lit(cap)).alias("_most")
    )
    ranked = bottom_k(df.where(F.col(label).isin("removed", "approved")), [by, label], key, cap, seed, "balance")
    ranked = ranked.withColumn("_r", _rank([by, label], key, seed, "balance"))
    return ranked.join(sizes, by).where("_r <= _most").drop("_r", "_most")


def stratified_sample(df: DataFrame, label: str, key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows of each class; an error where a class has fewer."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_have"))
    checked = sizes.withColumn(
        "_ok", F.assert_true(F.col("_have") >= n, F.concat(F.lit("too few rows of class "), F.col(label)))
    )
    sample = bottom_k(df, [label], key, n, seed, "strata")
    return sample.join(checked, label).where("_ok is null").drop("_have", "_ok")


def random_split(
    df: DataFrame, by: str, key: str, test_share: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Adds ``split``: the first ``int(n * (1 - share))`` rows of a group in random order train.

    Exact sizes need ranks, see :func:`drawn_ranks`.
    """
    ranked = drawn_ranks(df, [by], key, seed, "split")
    cut = F.floor(F.col("_r_all") * F.lit(1 - test_share) + 1e-9)
    return ranked.withColumn("split", F.when(F.col("_r") <= cut, "train").otherwise("test")).drop("_r", "_r_all")


def author_split(
    df: DataFrame, by: str, author: str = "author", test_share: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Adds ``split`` with no author in both parts: authors in random order fill the test part
    until it has ``int(n * share)`` rows, the last one whole. A missing author is ``unknown``."""
    who = F.coalesce(F.nullif(F.col(author), F.lit("")), F.lit("unknown"))
    rows = df.withColumn("_a", who)
    totals = rows.groupBy(by, "_a").agg(F.count("*").alias("_c"))
    totals = totals.withColumns({"_d": draw("_a", seed, "author")}).withColumn("_b", F.substring("_d", 1, 2))
    held = totals.groupBy(by, "_b").agg(F.sum("_c").alias("_h"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(
        by, "_b",
        F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_o"),
        F.sum("_h").over(Window.partitionBy(by)).alias("_n"),
    )
    inside = Window.partitionBy(by, "_b").orderBy("_d", "_a").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("_c").over(inside), F.lit(0)) + F.col("_o")
    chosen = totals.join(offsets, [by, "_b"]).select(
        by, "_a",
        F.when(filled < F.floor(F.col("_n") * F.lit(test_share) + 1e-9), "test").otherwise("train").alias("split"),
    )
    return rows.join(chosen, [by, "_a"]).drop("_a")


def label_split(df: DataFrame, by: str, label: str, key: str, train_share: float = 0.8, seed: int = SEED) -> DataFrame:
    """Adds ``split``, cut within each class at the rounded share."""
    ranked = drawn_ranks(df, [by, label], key, seed, "label")
    cut = F.bround(F.col("_r_all") * F.lit(train_share))
    return ranked.withColumn("split", F.when(F.col("_r") <= cut, "train").otherwise("test")).drop("_r", "_r_all")


def first_n(df: DataFrame, order: str, n: int, by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by a stored ordinal, of each group if asked."""
    if by:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
        return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
    return df.orderBy(order).limit(n)
