"""The whole enrichment, compared with the SQL of its parts joined by row."""

from __future__ import annotations

from threadmill.operators import enrich, history, lookups
from threadmill.plans.join_queries import _PARENT
from threadmill.plans.registry import ORACLES, query
from threadmill.runtime import read_table


def _part(name: str, *columns: str) -> str:
    """The SQL of a query, over the resolved comments where it reads demo_sample."""
    sql = ORACLES[name].replace("demo_sample", "res").replace("sample_id", "row_id")
    return f"JOIN (SELECT row_id, {', '.join(columns)} FROM ({sql})) USING (row_id)"


_PARTS = "\n".join(
    [
        _part("window_author_history", "n_prior", "vel_24h", "avg_score", "unique_threads", "days_active", "is_first", "max_in_thread"),
        _part("join_title", "found_title AS post_title"),
        _part("join_post", "time_since_post_hours", "thread_size_api", "post_is_nsfw"),
        _part("join_account_age", "account_age_days"),
        _part("project_bare_ids", "is_top_level"),
        _part("project_flags", "has_author_flair", "is_submitter_bool", "is_edited_bool", "controversiality"),
        _part("text_sizes", "word_count", "char_count", "parent_word_count", "has_parent_body"),
        _part("text_markup", "has_url", "has_markdown"),
        _part("text_caps_ratio", "caps_ratio"),
        _part("text_sign_counts", "exclamation_count", "question_count"),
        _part("text_average_word_length", "avg_word_length"),
        _part("text_unique_word_ratio", "unique_word_ratio"),
        _part("text_sentence_count", "sentence_count"),
        _part("text_profanity", "profanity_count", "has_profanity_signal"),
        _part("text_paragraph_count", "paragraph_count"),
        _part("text_starts_with_quote", "starts_with_quote"),
        _part("text_link_count", "link_count"),
        _part("enrich_ratios", "score_per_word", "velocity_ratio"),
        _part("enrich_reply_ratio", "reply_length_ratio"),
        _part("project_clock", "hour_of_day", "day_of_week", "is_weekend"),
    ]
)


@query(f"""WITH {_PARENT} SELECT * EXCLUDE (created_utc, edited), created_utc, edited FROM (
SELECT * EXCLUDE (author, author_flair_text, _meta, controversiality, ingested_at) FROM res) r {_PARTS}""")
def enrich_full(spark, sf):
    """Both enrichment steps over the stream with all lookups, the pipeline as one lazy plan."""
    raw = read_table(spark, sf, "raw_comment")
    rows = lookups.attach_parent(history.author_history(raw), lookups.parent_index(raw))
    rows = lookups.attach_title(rows, read_table(spark, sf, "post_title"))
    rows = lookups.attach_post(rows, read_table(spark, sf, "post_metadata"))
    rows = lookups.attach_account_age(rows, read_table(spark, sf, "account_age"))
    done = enrich.enrich_text(enrich.enrich_context(rows))
    return done.drop("author", "author_flair_text", "author_flair_clean", "_meta", "ingested_at")
