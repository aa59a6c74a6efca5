"""Exact duplicates: spam bodies, redeliveries, latest version of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.text import strip

SPAM_COPIES = 5
SPAM_AUTHORS = 2


def spam_bodies(
    df: DataFrame, by: list[str], copies: int = SPAM_COPIES, authors: int = SPAM_AUTHORS
) -> DataFrame:
    """Stripped bodies that occur at least ``copies`` times by at least ``authors`` authors within a group.

    Rows are first counted by (group, digest, author), with map-side combine,
    so that a body of many copies does not move its copies; the digest keeps
    the text out of the exchange. A missing author is an author of its own.
    """
    digest = F.sha2(strip(F.col("body")), 256)
    per_author = (
        df.where(F.col("body").isNotNull())
        .groupBy(*by, digest.alias("digest"), F.coalesce("author", F.lit("")).alias("author"))
        .agg(F.count("*").alias("n"))
    )
    return (
        per_author.groupBy(*by, "digest")
        .agg(F.sum("n").alias("copies"), F.count("author").alias("authors"))
        .where((F.col("copies") >= copies) & (F.col("authors") >= authors))
    )


def remove_spam(df: DataFrame, by: list[str], copies: int = SPAM_COPIES, authors: int = SPAM_AUTHORS) -> DataFrame:
    """Rows whose body is not spam; all copies of a spam body go. A null group is a group like any other."""
    spam = spam_bodies(df, by, copies, authors)
    spam = spam.select(*[F.col(c).alias(f"_spam_{i}") for i, c in enumerate(by)], F.col("digest").alias("_spam"))
    keyed = df.withColumn("_digest", F.sha2(strip(F.col("body")), 256))
    same = keyed["_digest"] == spam["_spam"]
    for i, c in enumerate(by):
        same &= keyed[c].eqNullSafe(spam[f"_spam_{i}"])
    return keyed.join(spam, same, "left_anti").drop("_digest")


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: what a map filled in order holds in the end."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_value(df: DataFrame, key: list[str], value: str, *order: str) -> DataFrame:
    """One value for each key, by an aggregate with map-side combine."""
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))
