"""Model answers to predictions ``True``, ``False``, ``unparseable``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadmill.functions.text import SPACE, strip

UNPARSEABLE = "unparseable"


def _first_word(text: Column) -> Column:
    return F.regexp_extract(text, rf"[^{SPACE}]+", 0)


def parse_first_word(text: Column) -> Column:
    """First word without ``.,!;:'"`` at its ends; else either word within 20 characters, True first."""
    text = strip(F.coalesce(text, F.lit("")))
    word, head = F.btrim(_first_word(text), F.lit(".,!;:'\"")), F.substring(text, 1, 20)
    return (
        F.when(word.isin("True", "False"), word)
        .when(head.contains("True"), "True")
        .when(head.contains("False"), "False")
        .otherwise(UNPARSEABLE)
    )


def parse_prefix(text: Column) -> Column:
    """Prefix in any letter case; error and safety-block sentinels are unparseable."""
    text = F.lower(strip(F.coalesce(text, F.lit(""))))
    return (
        F.when(text.startswith("error:") | text.startswith("blocked:"), UNPARSEABLE)
        .when(text.startswith("true"), "True")
        .when(text.startswith("false"), "False")
        .otherwise(UNPARSEABLE)
    )


def parse_final(text: Column) -> Column:
    """After the last ``FINAL:`` mark, else the first word, else the only one of the two contained; else null."""
    text = F.coalesce(text, F.lit(""))
    tail = F.lit(None).cast("string")
    for mark in ("final:", "Final:", "FINAL:"):
        tail = F.when(text.contains(mark), F.element_at(F.split(text, mark), -1)).otherwise(tail)
    after = _first_word(F.translate(F.lower(tail), "*`\"'.,!?:;\n", " " * 11))
    plain = F.translate(F.lower(strip(text)), "*`\"'.,!?:;", "")
    first = _first_word(plain)
    has_true, has_false = plain.contains("true"), plain.contains("false")
    return (
        F.when(after.isin("true", "false"), F.initcap(after))
        .when(first.isin("true", "false"), F.initcap(first))
        .when(has_true & ~has_false, "True")
        .when(has_false & ~has_true, "False")
    )


def parse_exact(text: Column) -> Column:
    text = strip(F.coalesce(text, F.lit("")))
    return F.when(text.isin("True", "False"), text).otherwise(UNPARSEABLE)


def confidence(lp_true: Column, lp_false: Column, digits: int = 4) -> Column:
    """P(removed) from the log probabilities of the two answers, one side sufficing."""
    p_true, p_false = F.exp(lp_true), F.exp(lp_false)
    return F.round(
        F.when(lp_true.isNotNull() & lp_false.isNotNull(), p_true / (p_true + p_false))
        .when(lp_true.isNotNull(), p_true)
        .when(lp_false.isNotNull(), 1.0 - p_false),
        digits,
    )
