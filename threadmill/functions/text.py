"""Text features of a comment as column expressions; all run in the JVM.

White space is what Unicode calls white space together with the four
information separators, written out, so that other SQL engines can agree.
A null or blank text gives zeros, one paragraph and false.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t\n\x{0b}\f\r\x{1c}-\x{1f}\x{85}\p{Z}"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# The words and word starts that count as profanity.
PROFANITY = (
    r"\bfuck\w*\b", r"\bshit\w*\b", r"\bass\b", r"\basshole\w*\b",
    r"\bbitch\w*\b", r"\bdamn\w*\b", r"\bcrap\b", r"\bhell\b",
    r"\bstfu\b", r"\bwtf\b", r"\blmao\b", r"\blmfao\b",
    r"\bidiot\w*\b", r"\bstupid\b", r"\bmoron\w*\b", r"\bdumb\w*\b",
    r"\btroll\w*\b", r"\bkill\s+your", r"\bdie\b", r"\bkys\b",
    r"\bretard\w*\b", r"\bcringe\b",
)


def strip(text: Column) -> Column:
    """Without leading and trailing white space (``trim`` knows the space only)."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(rf"[^{SPACE}]"), F.lit(True))


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    return _count(text, rf"[^{SPACE}]+")


def char_count(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def sign_count(text: Column, sign: str) -> Column:
    """Occurrences of a character in a text that is not blank."""
    n = F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    return F.when(is_blank(text), 0).otherwise(n).cast("long")


def caps_ratio(text: Column) -> Column:
    """Upper-case letters among all letters, four digits."""
    upper, letters = _count(text, r"\p{Lu}"), _count(text, r"\p{L}")
    return F.coalesce(F.round(F.try_divide(upper.cast("double"), letters), 4), F.lit(0.0))


def bare_words(text: Column) -> Column:
    """White-space tokens without ASCII punctuation at their ends, empty ones dropped."""
    return F.filter(
        F.transform(F.split(text, rf"[{SPACE}]+"), lambda w: F.btrim(w, F.lit(PUNCTUATION))),
        lambda w: w != "",
    )


def average_word_length(text: Column) -> Column:
    words = bare_words(text)
    total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return F.coalesce(F.round(F.try_divide(total.cast("double"), F.size(words)), 2), F.lit(0.0))


def unique_word_ratio(text: Column) -> Column:
    words = bare_words(F.lower(text))
    distinct = F.size(F.array_distinct(words)).cast("double")
    return F.coalesce(F.round(F.try_divide(distinct, F.size(words)), 4), F.lit(0.0))


def sentence_count(text: Column) -> Column:
    """Pieces between runs of ``.!?``, the one after the last included."""
    return F.when(is_blank(text), 0).otherwise(_count(text, r"[.!?]+") + 1).cast("long")


#: All start at the border of a word, which is tested once for all.
_PROFANE = r"(?iU)\b(?:" + "|".join(p.removeprefix(r"\b") for p in PROFANITY) + ")"


def profanity_count(text: Column) -> Column:
    return _count(text, _PROFANE)


def has_profanity(text: Column) -> Column:
    """Whether the count is above 0; beside the count, the text is searched once for both."""
    return profanity_count(text) > 0


def paragraph_count(text: Column) -> Column:
    parts = F.filter(F.split(text, "\n\n"), lambda p: p.rlike(rf"[^{SPACE}]"))
    return F.when(is_blank(text), 1).otherwise(F.size(parts)).cast("long")


def starts_with_quote(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"^[{SPACE}]*>"), F.lit(False))


def link_count(text: Column) -> Column:
    return _count(text, "https?://")


def has_url(text: Column) -> Column:
    return F.coalesce(text.contains("http://") | text.contains("https://"), F.lit(False))


def has_markdown(text: Column) -> Column:
    marks = [text.contains(m) for m in ("**", "~~", "^", "> ", "# ")]
    any_mark = marks[0]
    for m in marks[1:]:
        any_mark = any_mark | m
    return F.coalesce(any_mark, F.lit(False))


def left_chars(text: Column, n: int = 2048) -> Column:
    """The first ``n`` characters."""
    return F.substring(text, 1, n)


def left_words(text: Column, n: int) -> Column:
    """The first ``n`` white-space tokens with the white space between them: the
    default of token truncation where no other tokenizer is plugged in."""
    return F.regexp_extract(text, rf"(?s)^[{SPACE}]*(?:[^{SPACE}]+(?:[{SPACE}]+|\z)){{0,{n}}}", 0)


def word_and_punctuation_spans() -> Callable[[str], list[tuple[int, int]]]:
    """A tokenizer of the form :func:`left_tokens` takes: runs of word characters, runs of other signs."""
    form = re.compile(r"\w+|[^\w\s]+")
    return lambda text: [m.span() for m in form.finditer(text)]


def left_tokens(
    text: Column, n: int, make_tokenizer: Callable[[], Callable[[str], list[tuple[int, int]]]] = word_and_punctuation_spans
) -> Column:
    """The text up to the end of its ``n``-th token; null stays null.

    ``make_tokenizer`` is called once in each task and gives a function from a
    text to the character spans of its tokens, such as that of a subword
    vocabulary (``offsets`` of an encoding).
    """

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spans = make_tokenizer()
        for texts in batches:
            yield texts.map(lambda t: t[: got[n - 1][1]] if len(got := spans(t)) > n else t, na_action="ignore")

    return cut(text)


def text_features(text: Column) -> dict[str, Column]:
    """All features by name."""
    return {
        "caps_ratio": caps_ratio(text),
        "exclamation_count": sign_count(text, "!"),
        "question_count": sign_count(text, "?"),
        "avg_word_length": average_word_length(text),
        "unique_word_ratio": unique_word_ratio(text),
        "sentence_count": sentence_count(text),
        "profanity_count": profanity_count(text),
        "has_profanity_signal": has_profanity(text),
        "paragraph_count": paragraph_count(text),
        "starts_with_quote": starts_with_quote(text),
        "link_count": link_count(text),
    }
