"""Canonical forms of free-text records, as column expressions.

``letters`` keeps the letters and digits of a text in lower case and drops
everything else. ``field_list`` recognises a record that consists of labelled
fields only and returns its fields, each reduced to letters, in sorted order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LETTERS = 20

OTHER = r"[^\p{L}\p{N}]+"
FIELD_BREAK = r"[\r\n|;]+"
LABELLED = r"(?s)^[^:]*[\p{L}\p{N}][^:]*:.*[\p{L}\p{N}].*$"


def letters(text: Column) -> Column:
    """Letters and digits in order, letter case aside (ß counts as ss)."""
    return F.replace(F.regexp_replace(F.lower(text), OTHER, ""), F.lit("ß"), F.lit("ss"))


def field_list(text: Column) -> Column:
    """Sorted fields of a record made of two or more ``label: value`` fields, else null.

    Fields are set apart by line breaks, ``|`` or ``;``; pieces without a letter
    or digit are separators. The label ends at the first colon.
    """
    pieces = F.filter(F.split(text, FIELD_BREAK), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    fields_only = (F.size(pieces) >= 2) & F.forall(pieces, lambda p: p.rlike(LABELLED))
    # Three cheap tests keep the split away from ordinary prose.
    candidate = text.contains(":") & text.rlike(r"[\r\n|;]")
    return F.when(candidate & fields_only, F.array_sort(F.transform(pieces, letters)))


def field_key(text: Column) -> Column:
    return F.array_join(field_list(text), " ")
