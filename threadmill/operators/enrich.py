"""The two enrichment steps: context and text features of each comment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions import comment as C
from threadmill.functions import text as T

FEATURES = (
    "id", "subreddit", "body", "parent_body", "score", "author", "created_utc", "parent_id", "link_id",
    "is_submitter", "controversiality", "author_flair_text", "permalink", "label", "is_edited",
)


def extract_features(df: DataFrame) -> DataFrame:
    """The fifteen fields of a data set row; ``label`` is taken as it is."""
    edited = C.is_edited(F.col("_meta.is_edited"), F.col("edited"))
    return df.withColumn("is_edited", edited).select(*[F.col(c) for c in FEATURES])


def enrich_context(df: DataFrame) -> DataFrame:
    """Flags, flair and sizes of the comment and its parent.

    A comment is edited by its own ``is_edited`` or that of ``_meta``, where
    there are such columns, or by ``edited``.
    """
    marked = F.lit(False)
    if "is_edited" in df.columns:
        marked = F.col("is_edited")
    elif "_meta" in df.columns:
        marked = F.col("_meta.is_edited")
    body, parent = F.coalesce("body", F.lit("")), F.coalesce("parent_body", F.lit(""))
    return df.withColumns(
        {
            "is_top_level": C.is_top_level(F.col("parent_id")),
            "is_edited_bool": C.is_edited(marked, F.col("edited")),
            "author_flair_clean": C.clean_flair(F.col("author_flair_text")),
            "has_author_flair": T.strip(F.coalesce("author_flair_text", F.lit(""))) != "",
            "is_submitter_bool": F.coalesce("is_submitter", F.lit(False)),
            "word_count": T.word_count(body),
            "char_count": T.char_count(body),
            "has_url": T.has_url(body),
            "has_markdown": T.has_markdown(body),
            "parent_word_count": T.word_count(parent),
            "has_parent_body": parent != "",
        }
    )


def enrich_text(df: DataFrame) -> DataFrame:
    """Text features, ratios and clock fields; needs the context step and author history."""
    words = F.col("word_count")
    return df.withColumns(
        {
            **T.text_features(F.coalesce("body", F.lit(""))),
            "score_per_word": F.round(F.coalesce("score", F.lit(0)) / F.greatest(words, F.lit(1)).cast("double"), 4),
            "velocity_ratio": F.round(F.col("vel_24h") / F.greatest("n_prior", F.lit(1)).cast("double"), 4),
            "reply_length_ratio": F.when(
                F.col("parent_word_count") > 0, F.round(words / F.col("parent_word_count").cast("double"), 4)
            ).otherwise(0.0),
            "controversiality": F.coalesce("controversiality", F.lit(0)),
            **C.clock_fields(F.col("created_utc")),
        }
    )


def rules_text(rules: DataFrame) -> DataFrame:
    """``(subreddit, rules_text)`` of a table ``(subreddit, rules array)``: numbered from 1,
    name and description, blank rules left out but counted."""
    each = rules.select("subreddit", F.posexplode("rules").alias("pos", "rule"))
    name, text = (T.strip(F.coalesce(F.col(f"rule.{c}"), F.lit(""))) for c in ("short_name", "description"))
    line = F.when((name != "") & (text != ""), F.concat(name, F.lit(": "), text)).otherwise(F.concat(name, text))
    numbered = each.withColumn("line", line).where("line <> ''").select(
        "subreddit", "pos", F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), "line").alias("line")
    )
    # The rules of a community are few; their order is kept by the position.
    return numbered.groupBy("subreddit").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("rules_text")
    )


def bulleted(rules: DataFrame) -> DataFrame:
    """``(subreddit, rules_text)`` of ``(subreddit, rules array<string>)`` as dashed lines."""
    return rules.select(
        "subreddit", F.array_join(F.transform("rules", lambda r: F.concat(F.lit("- "), r)), "\n").alias("rules_text")
    )
