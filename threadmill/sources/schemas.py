"""Schemas of the raw inputs; what is not named stays in a VARIANT column."""

# Names of the fields in the inputs.
RAW_COMMENT = (
    "id string, subreddit string, author string, body string, score bigint, created_utc bigint, "
    "parent_id string, link_id string, distinguished string, edited string, is_submitter boolean, "
    "controversiality bigint, author_flair_text string, permalink string, "
    "_meta struct<removal_type: string, was_deleted_later: boolean, is_edited: boolean, retrieved_2nd_on: bigint>"
)
PREDICTION = "id string, label string, prediction string, raw string, confidence_removed double"
EXTRA_FIELDS = (
    "author_fullname", "author_premium", "ups", "downs", "gilded", "total_awards_received", "no_follow",
    "stickied", "locked", "collapsed", "collapsed_reason_code", "score_hidden", "send_replies", "retrieved_on",
    "_meta",
)
