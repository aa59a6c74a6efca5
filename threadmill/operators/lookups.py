"""Left joins that attach context to comments, each against a side made unique first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.comment import account_age, bare_link, hours_since, parent_comment, readable
from threadmill.operators.dedup import latest_value

# Where the stamp of an account comes from, the best first.
AGE_SOURCES = (
    "post_author_created_utc", "author_created_utc", "oldest_post", "comment_author_created_utc", "oldest_comment",
)


def parent_index(comments: DataFrame) -> DataFrame:
    """``(id, parent_body)`` of readable comments; of several deliveries the last counts."""
    rows = comments.where(readable(F.col("id"), F.col("body")))
    return latest_value(rows, ["id"], "body", "ingested_at", "row_id").withColumnRenamed("body", "parent_body")


def attach_parent(comments: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``parent_body``: the text of the parent comment, one hop, ``''`` where there is none.

    A plain equi-join on the parent's id: neither side is forced to be
    broadcast, as both grow with the data.
    """
    keyed = comments.withColumn("_parent", parent_comment(F.col("parent_id")))
    index = index.withColumnRenamed("id", "_parent")
    return keyed.join(index, "_parent", "left").withColumn(
        "parent_body", F.coalesce("parent_body", F.lit(""))
    ).drop("_parent")


def parent_stats(resolved: DataFrame) -> DataFrame:
    """Resolved, unresolved and top-level comments and the rate of resolution."""
    reply = F.col("parent_id").startswith("t1_")
    got = F.col("parent_body") != ""
    return resolved.agg(
        F.count_if(reply & got).alias("resolved"),
        F.count_if(reply & ~got).alias("unresolved"),
        F.count_if(F.coalesce(~reply, F.lit(True))).alias("top_level"),
        F.coalesce(F.try_divide(F.count_if(reply & got).cast("double"), F.count_if(reply)), F.lit(0.0)).alias("rate"),
    )


def attach_title(comments: DataFrame, titles: DataFrame) -> DataFrame:
    """Adds ``post_title`` by bare link id, then by the id as it stands, else ``''``.

    Both sides meet on the bare id, so the comments move once; the spellings of
    an id in the titles are kept in a map, which has one entry for each.
    """
    one = titles.where("link_id is not null").groupBy("link_id").agg(F.max("title").alias("title"))
    bare = bare_link(F.col("link_id"))
    spelled = F.when(bare != F.col("link_id"), F.struct("link_id", "title"))
    both = one.groupBy(bare.alias("_bare")).agg(
        F.max(F.when(bare == F.col("link_id"), F.col("title"))).alias("_t1"),
        F.map_from_entries(F.collect_list(spelled)).alias("_t2"),
    )
    keyed = comments.withColumn("_bare", bare_link(F.col("link_id")))
    other = F.try_element_at("_t2", F.col("link_id"))
    return (
        keyed.join(both, "_bare", "left")
        .withColumn("post_title", F.coalesce("_t1", other, F.lit("")))
        .drop("_bare", "_t1", "_t2")
    )


def attach_post(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Adds hours since the post, thread size and the adult mark from post metadata.

    Of several rows of a post the one with the highest score counts.
    """
    one = posts.groupBy("link_id").agg(
        F.max_by(
            F.struct("created_utc", "num_comments", "over_18"),
            F.struct("score", "num_comments", "created_utc", "over_18"),
        ).alias("_post")
    )
    keyed = comments.withColumn("_bare", bare_link(F.col("link_id")))
    joined = keyed.join(one.withColumnRenamed("link_id", "_bare"), "_bare", "left")
    return joined.withColumns(
        {
            "time_since_post_hours": hours_since(F.col("created_utc"), F.col("_post.created_utc")),
            "thread_size_api": F.coalesce("_post.num_comments", F.lit(0)),
            "post_is_nsfw": F.coalesce("_post.over_18", F.lit(False)),
        }
    ).drop("_bare", "_post")


def oldest_activity(ages: DataFrame) -> DataFrame:
    """``(author, account_created_utc, source)``: the oldest positive stamp of the best source.

    Sources are tried in the order of ``AGE_SOURCES``; others, and null, come
    last, by name.
    """
    rows = ages.where("account_created_utc > 0 and author is not null and author <> '[deleted]'")
    rank = F.coalesce(
        *[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(AGE_SOURCES)],
        F.when(F.col("source").isNotNull(), F.lit(len(AGE_SOURCES))), F.lit(len(AGE_SOURCES) + 1),
    )
    best = F.min(F.struct(rank.alias("rank"), "source", "account_created_utc")).alias("m")
    return rows.groupBy("author").agg(best).select("author", "m.account_created_utc", "m.source")


def attach_account_age(comments: DataFrame, ages: DataFrame) -> DataFrame:
    """Adds ``account_age_days``, -1 where the account is unknown or not older."""
    one = ages.where("account_created_utc > 0").groupBy("author").agg(F.min("account_created_utc").alias("_since"))
    return (
        comments.join(one, "author", "left")
        .withColumn("account_age_days", account_age(F.col("created_utc"), F.col("_since")))
        .drop("_since")
    )


#: Features of an author before a comment, as (name in the history, name in the row, value where unknown).
AUTHOR_FEATURES = (
    ("n_prior", "author_n_prior", 0), ("vel_24h", "author_vel_24h", 0), ("avg_score", "author_avg_score", 0.0),
    ("unique_threads", "author_unique_threads", 0), ("days_active", "author_days_active", 0.0),
    ("is_first", "author_is_first", True), ("max_in_thread", "author_max_in_thread", 0),
)


def attach_author_features(df: DataFrame, features: DataFrame, key: str = "id") -> DataFrame:
    """Adds the author's history features by comment id, with defaults, and ``author_features_found``.

    ``features`` is a history with one row for each id; a null id finds nothing.
    """
    side = features.select(
        key, F.lit(True).alias("_found"), *[F.col(a).alias(b) for a, b, _ in AUTHOR_FEATURES]
    )
    joined = df.join(side, key, "left")
    filled = {b: F.coalesce(b, F.lit(v)) for _, b, v in AUTHOR_FEATURES}
    return joined.withColumns(filled | {"author_features_found": F.coalesce("_found", F.lit(False))}).drop("_found")


def attach_rules(df: DataFrame, rules: DataFrame, key: str = "subreddit") -> DataFrame:
    """Adds ``rules_text`` of the row's community, letter case aside, ``''`` where there is none."""
    side = rules.groupBy(F.lower(key).alias("_community")).agg(F.max("rules_text").alias("rules_text"))
    return attach_small(df.withColumn("_community", F.lower(key)), side, "_community").withColumn(
        "rules_text", F.coalesce("rules_text", F.lit(""))
    ).drop("_community")


def attach_small(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join of a side with one row for each key, as a rule a small one.

    There is no broadcast hint: the session's threshold in bytes and adaptive
    execution, which measures the side, choose the join.
    """
    return df.join(side, key, "left")


def attach_missing_fields(df: DataFrame, raw: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Raw fields by id, never overwriting a column that is there already."""
    wanted = [f for f in fields if f in raw.columns and f not in df.columns]
    return df.join(raw.select(key, *wanted), key, "left")


def unique_keys(key: str, *tables: DataFrame, exclude: tuple[str, ...] = ("", "[deleted]")) -> DataFrame:
    """Distinct non-empty keys over several tables."""
    parts = [t.select(F.col(key)) for t in tables]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    return union.where(F.col(key).isNotNull() & ~F.col(key).isin(*exclude)).distinct()


def missing_keys(needed: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Keys that a cache does not hold yet."""
    return needed.join(cached.select(key), key, "left_anti")
