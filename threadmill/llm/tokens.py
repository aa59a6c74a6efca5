"""Token spans and sizes of texts.

The default tokenizer is the public word-and-punctuation one: each longest run
of word characters is a token, and so is each longest run of characters that
are neither word characters nor white space. A path to a ``tokenizers`` JSON
file selects a public subword vocabulary instead; the file stays where it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PUNCT = "word_punct"
_TOKEN = re.compile(r"\w+|[^\w\s]+")

#: The same classes for the JVM: letters, numbers and underscore; white space
#: is Unicode white space and the four separators that Python counts with it.
_JVM_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{IsWhite_Space}\x{1c}-\x{1f}]+"


def size_column(text: Column) -> Column:
    """Tokens of the default tokenizer; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_JVM_TOKEN)), F.lit(0)).cast("long")


def span_reader(tokenizer: str = WORD_PUNCT) -> Callable[[str], np.ndarray]:
    """A function from a text to its ``(tokens, 2)`` array of character spans."""
    if tokenizer == WORD_PUNCT:

        def spans(text: str) -> np.ndarray:
            flat = [x for m in _TOKEN.finditer(text) for x in m.span()]
            return np.array(flat, np.int64).reshape(-1, 2)

        return spans
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.encode_special_tokens = True

    def spans(text: str) -> np.ndarray:
        got = model.encode(text, add_special_tokens=False).offsets
        return np.array(got, np.int64).reshape(-1, 2)

    return spans


def size_reader(tokenizer: str = WORD_PUNCT) -> Callable[[str], int]:
    if tokenizer == WORD_PUNCT:
        return lambda text: len(_TOKEN.findall(text))
    spans = span_reader(tokenizer)
    return lambda text: len(spans(text))
