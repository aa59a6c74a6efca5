"""SQL fragments shared by the comparison queries."""

SPACE = r"\t\n\x{0b}\f\r\x{1c}-\x{1f}\x{85}\p{Z}"
PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def count(text: str, pattern: str) -> str:
    return f"coalesce(len(regexp_extract_all({text}, '{pattern}')), 0)"


def words(text: str) -> str:
    return count(text, f"[^{SPACE}]+")


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def blank(text: str) -> str:
    return f"coalesce(NOT regexp_matches({text}, '[^{SPACE}]'), true)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def bare_words(text: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex({text}, '[{SPACE}]+'), "
        f"lambda w: trim(w, '{PUNCTUATION}')), lambda w: w <> '')"
    )


def removal_class(variant: str = "stream") -> str:
    names = {
        "stream": ("removed_no_text", "deleted_no_text", "captured_removed", "captured_deleted", "approved"),
        "index": ("removed_no_text", "deleted", "captured_removed", "other", "approved"),
    }
    if variant == "report":
        return """CASE WHEN body = '[removed]' THEN 'removed_no_text'
            WHEN _meta.removal_type = 'removed' THEN 'captured_removed'
            WHEN body = '[deleted]' THEN 'deleted_no_text' ELSE 'approved' END"""
    a, b, c, d, e = names[variant]
    return f"""CASE WHEN body = '[removed]' THEN '{a}' WHEN body = '[deleted]' THEN '{b}'
        WHEN _meta.removal_type = 'removed' THEN '{c}'
        WHEN _meta.removal_type = 'deleted' OR coalesce(_meta.was_deleted_later, false) THEN '{d}'
        ELSE '{e}' END"""


#: Filter reasons over author, body and distinguished of raw_comment.
FILTERS = {
    "automoderator": "coalesce(author, '') = 'AutoModerator'",
    "distinguished": "coalesce(distinguished IN ('moderator', 'admin'), false)",
    "mod_team": "ends_with(coalesce(author, ''), '-ModTeam')",
    "empty_or_stub": f"{strip("coalesce(body, '')")} IN ('', '[removed]', '[deleted]')",
    "too_short": f"{words('body')} < 3",
    "deleted_author": "coalesce(author, '') = '[deleted]'",
    "known_bot": "coalesce(author, '') IN ('VisualMod', 'QualityVote', 'SaveVideo', 'TotesMessenger', "
    "'Flair_Helper', 'ContentPolicyComplianceBot')",
    "bot_name": r"regexp_matches(coalesce(author, ''), '(?i)\bbot\b|Bot$|_bot_|^bot_|_bot$')",
}
KEPT = "NOT (" + " OR ".join(FILTERS.values()) + ")"

def half_up(top: str, bottom: str, digits: int) -> str:
    """Quotient of integers rounded half away from zero, in integers, as Spark rounds."""
    top, scale = f"({top})", 10**digits
    return (
        f"(sign({top}) * ((abs({top}) * {2 * scale} + ({bottom})) // (2 * ({bottom}))) / {scale}.0::DOUBLE)"
    )


RATIO = "coalesce(CAST({0} AS DOUBLE) / nullif(CAST({1} AS DOUBLE), 0), 0.0)"


def ratio(a: str, b: str) -> str:
    return RATIO.format(f"({a})", f"({b})")


def f1(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    return ratio(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")


KAPPA = """CASE WHEN tp + fp + tn + fn = 0 THEN 0.0 WHEN {pe} = 1.0 THEN 1.0
  ELSE ({po} - {pe}) / (1.0 - {pe}) END""".format(
    po="(CAST(tp + tn AS DOUBLE) / CAST(tp + fp + tn + fn AS DOUBLE))",
    pe="((CAST(tp + fp AS DOUBLE) * CAST(tp + fn AS DOUBLE) + CAST(fn + tn AS DOUBLE) * CAST(fp + tn AS DOUBLE))"
    " / (CAST(tp + fp + tn + fn AS DOUBLE) * CAST(tp + fp + tn + fn AS DOUBLE)))",
)
STATS = {
    "accuracy": ratio("tp + tn", "tp + fp + tn + fn"),
    "precision": ratio("tp", "tp + fp"),
    "recall": ratio("tp", "tp + fn"),
    "f1": f1(),
    "kappa": KAPPA,
    "macro_f1": f"({f1()} + {f1('tn', 'fn', 'fp')}) / 2.0",
    "balanced_accuracy": f"({ratio('tp', 'tp + fn')} + {ratio('tn', 'tn + fp')}) / 2.0",
}


def stats(names=None) -> str:
    return ", ".join(f"CAST({STATS[n]} AS DOUBLE) AS {n}" for n in names or STATS)


#: Two rule-based models over demo_sample: by length, and by exclamation marks.
PRED = f"""pred AS (
  SELECT sample_id AS id, lower(subreddit) AS subreddit, label, body,
    CASE WHEN body IS NULL THEN 'unparseable' WHEN {words('body')} <= 45 THEN 'True' ELSE 'False' END AS prediction,
    CASE WHEN body IS NULL THEN 'unparseable' WHEN contains(body, '!') THEN 'True' ELSE 'False' END AS pred_b,
    CASE WHEN body IS NOT NULL THEN 1.0::DOUBLE / (1 + {words('body')}) END AS confidence
  FROM demo_sample)"""


def cells(by: str = "subreddit", pred: str = "prediction", source: str = "pred") -> str:
    ok = f"{pred} IN ('True', 'False')"
    pos = "coalesce(label = 'removed', false)"
    return f"""SELECT {by + ',' if by else ''}
  count(*) FILTER ({pred} = 'True' AND {pos}) AS tp, count(*) FILTER ({pred} = 'True' AND NOT {pos}) AS fp,
  count(*) FILTER ({pred} = 'False' AND NOT {pos}) AS tn, count(*) FILTER ({pred} = 'False' AND {pos}) AS fn,
  count(*) FILTER (NOT coalesce({ok}, false)) AS unparseable
FROM {source} {'GROUP BY ' + by if by else ''}"""
