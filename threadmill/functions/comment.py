"""Predicates and derived fields of a comment row, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadmill.functions.text import strip, word_count

# Bodies that stand for a text that is gone.
STUBS = ("[removed]", "[deleted]")
# Bots whose names do not say so.
KNOWN_BOTS = (
    "VisualMod", "QualityVote", "SaveVideo", "TotesMessenger", "Flair_Helper", "ContentPolicyComplianceBot",
)
BOT_NAME = r"(?i)\bbot\b|Bot$|_bot_|^bot_|_bot$"

_GROUPS = {
    "stream": ("removed_no_text", "deleted_no_text", "captured_removed", "captured_deleted", "approved"),
    "index": ("removed_no_text", "deleted", "captured_removed", "other", "approved"),
}


def removal_class(
    body: Column, removal_type: Column, was_deleted: Column, variant: str = "stream"
) -> Column:
    """How a comment ended: five classes, tested in this order.

    A gone text by moderator, a gone text by user, a captured text of a removed
    comment, one of a deleted comment, and all else, the empty body included.
    ``index`` uses other names for the same tests; ``report`` tests the removal
    mark before the ``[deleted]`` stub and has no class for users' deletions.
    """
    removed = F.coalesce(removal_type == "removed", F.lit(False))
    deleted = F.coalesce(removal_type == "deleted", F.lit(False)) | F.coalesce(was_deleted, F.lit(False))
    stub_removed = F.coalesce(body == STUBS[0], F.lit(False))
    stub_deleted = F.coalesce(body == STUBS[1], F.lit(False))
    if variant == "report":
        return (
            F.when(stub_removed, "removed_no_text")
            .when(removed, "captured_removed")
            .when(stub_deleted, "deleted_no_text")
            .otherwise("approved")
        )
    a, b, c, d, e = _GROUPS[variant]
    return F.when(stub_removed, a).when(stub_deleted, b).when(removed, c).when(deleted, d).otherwise(e)


def filters(author: Column, body: Column, distinguished: Column) -> dict[str, Column]:
    """The independent reasons to drop a comment, by name; null counts as empty."""
    author, body = F.coalesce(author, F.lit("")), F.coalesce(body, F.lit(""))
    bare = strip(body)
    return {
        "automoderator": author == "AutoModerator",
        "distinguished": F.coalesce(distinguished.isin("moderator", "admin"), F.lit(False)),
        "mod_team": author.endswith("-ModTeam"),
        "empty_or_stub": bare.isin("", *STUBS),
        "too_short": word_count(body) < 3,
        "deleted_author": author == "[deleted]",
        "known_bot": author.isin(*KNOWN_BOTS),
        "bot_name": is_bot_name(author),
    }


def is_bot_name(author: Column) -> Column:
    return author.rlike(BOT_NAME)


def keep_comment(author: Column, body: Column, distinguished: Column) -> Column:
    drop = F.lit(False)
    for reason in filters(author, body, distinguished).values():
        drop = drop | reason
    return ~drop


def in_communities(community: Column, wanted: list[str]) -> Column:
    """Whether the row is of one of some communities, letter case aside."""
    return F.coalesce(F.lower(community).isin(*[w.lower() for w in wanted]), F.lit(False))


def readable(comment_id: Column, body: Column) -> Column:
    """An id, and a text that is neither empty nor a stub."""
    return F.coalesce((comment_id != "") & (body != "") & ~body.isin(*STUBS), F.lit(False))


def bare_link(link: Column) -> Column:
    """Post id without ``t3_``, wherever that stands."""
    return F.replace(link, F.lit("t3_"), F.lit(""))


def parent_comment(parent: Column) -> Column:
    """Id of the parent comment, null where the parent is a post."""
    return F.when(parent.startswith("t1_"), F.substring(parent, 4, 1 << 30))


def is_top_level(parent: Column) -> Column:
    return F.coalesce(parent.startswith("t3_"), F.lit(False))


def truthy(value: Column) -> Column:
    """Truth of an ``edited`` field that holds true, false or a number as text."""
    low = F.lower(strip(value))
    number = F.coalesce(low.try_cast("double") != 0, F.lit(False))
    return F.coalesce((low == "true") | number, F.lit(False))


def is_edited(meta_edited: Column, edited: Column) -> Column:
    return F.coalesce(meta_edited, F.lit(False)) | truthy(edited)


def clean_flair(flair: Column) -> Column:
    """Flair without outer white space; ``none`` where there is none. Blank flair becomes empty."""
    return F.when(F.coalesce(flair, F.lit("")) == "", "none").otherwise(strip(flair))


def answer_of(label: Column) -> Column:
    """``removed`` to ``True``, every other label to ``False``."""
    return F.when(label == "removed", "True").otherwise("False")


def label_of(answer: Column) -> Column:
    return F.when(answer == "True", "removed").when(answer == "False", "approved")


def stable_id(community: Column, index: Column, body: Column) -> Column:
    """``slm_<community>_<4-digit index>_<10 hex digits>`` of a row's content."""
    digest = F.md5(
        F.concat_ws("|", community, index.cast("string"), F.substring(F.coalesce(body, F.lit("")), 1, 64))
    )
    return F.concat(
        F.lit("slm_"), community, F.lit("_"), F.format_string("%04d", index), F.lit("_"), F.substring(digest, 1, 10)
    )


def hours_since(created: Column, post_created: Column) -> Column:
    """Hours from post to comment, two digits; -1 unknown; may be negative."""
    known = (F.nullif(created, F.lit(0)).isNotNull()) & (F.nullif(post_created, F.lit(0)).isNotNull())
    return F.when(known, F.round((created - post_created) / 3600.0, 2)).otherwise(F.lit(-1.0))


def account_age(created: Column, account_created: Column) -> Column:
    """Days from account to comment, one digit; -1 unless the account is known to be older."""
    ok = (account_created != 0) & (created != 0) & (account_created < created)
    return F.when(ok, F.round((created - account_created) / 86400.0, 1)).otherwise(F.lit(-1.0))


def clock_fields(created: Column) -> dict[str, Column]:
    """Hour, weekday (Monday 0) and weekend in UTC; -1, -1 and false when unknown."""
    at = F.timestamp_seconds(F.nullif(created, F.lit(0)))
    day = F.weekday(at)
    return {
        "hour_of_day": F.coalesce(F.hour(at), F.lit(-1)),
        "day_of_week": F.coalesce(day, F.lit(-1)),
        "is_weekend": F.coalesce(day >= 5, F.lit(False)),
    }


