"""Splitting oversized texts at natural boundaries.

A text's token offsets are its prefix sums; its boundaries (paragraph, line,
sentence and clause ends) form sorted arrays of token numbers. Each piece ends
at the last boundary under the limit, found by binary search, the next piece
starts the overlap before that, and where no boundary lies in reach the cut is
a hard one between two tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.tokens import WORD_PUNCT, span_reader

#: Boundaries from the strongest to the weakest; each pattern is matched
#: against the gap between two tokens together with the token before it.
LEVELS = ("paragraph", "line", "sentence", "clause", "word")

#: A stronger boundary is preferred to a later, weaker one as long as the piece
#: keeps at least this part of the limit.
LEAST_FILL = 0.5

_PARAGRAPH = re.compile("\n[^\\S\n]*\n|\u2029")
_LINE = re.compile("[\n\r\v\f\u2028\u2029]")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_CLAUSE_END = re.compile(r"[,;:–—][\"'”’»)\]]*$")


def boundary_arrays(text: str, spans: np.ndarray) -> list[np.ndarray]:
    """For each level the sorted token numbers before which a piece may start."""
    out: list[list[int]] = [[] for _ in LEVELS]
    if len(spans) < 2:
        return [np.array(x, np.int64) for x in out]
    gaps = np.nonzero(spans[1:, 0] > spans[:-1, 1])[0]
    ends, starts = spans[:, 1].tolist(), spans[:, 0].tolist()
    for i in gaps.tolist():
        gap = text[ends[i] : starts[i + 1]]
        if gap != " ":
            if _PARAGRAPH.search(gap):
                out[0].append(i + 1)
            if _LINE.search(gap):
                out[1].append(i + 1)
        tail = text[starts[i] : ends[i]][-3:]
        if _SENTENCE_END.search(tail):
            out[2].append(i + 1)
        elif _CLAUSE_END.search(tail):
            out[3].append(i + 1)
    out[4] = (gaps + 1).tolist()
    return [np.array(x, np.int64) for x in out]


def cut(n: int, bounds: list[np.ndarray], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces ``(first token, end token, how it was cut)`` of a text of ``n`` tokens."""
    pieces: list[tuple[int, int, str]] = []
    start = 0
    while n - start > limit:
        least = start + max(overlap + 1, int(limit * LEAST_FILL))
        end, how = start + limit, "hard"
        for level, array in zip(LEVELS, bounds, strict=True):
            at = int(np.searchsorted(array, start + limit, "right")) - 1
            if at >= 0 and array[at] >= least:
                end, how = int(array[at]), level
                break
        pieces.append((start, end, how))
        start = end - overlap
    pieces.append((start, n, "end"))
    return pieces


def _cutter(limit: int, overlap: int, tokenizer: str):
    # Imported names only: the function is pickled with what it refers to.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = span_reader(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for doc, value in zip(ids, texts, strict=True):
                text = value.as_py()
                if text is None:
                    continue
                spans = spans_of(text)
                n = len(spans)
                if n <= limit:
                    rows.append((doc, 0, 1, n, 0, "whole", 0, len(text), text))
                    continue
                pieces = cut(n, boundary_arrays(text, spans), limit, overlap)
                for k, (a, b, how) in enumerate(pieces):
                    # A piece runs to the start of the token after it, so that
                    # pieces without their overlaps join to the whole text.
                    first = 0 if k == 0 else int(spans[a, 0])
                    last = len(text) if b == n else int(spans[b, 0])
                    shared = 0 if k == 0 else pieces[k - 1][1] - a
                    rows.append(
                        (doc, k, len(pieces), b - a, shared, how, first, last, text[first:last])
                    )
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, _TYPES.values(), strict=True)], list(_TYPES)
            )

    return run


_TYPES = {
    "id": pa.int64(),
    "piece": pa.int32(),
    "pieces": pa.int32(),
    "tokens": pa.int32(),
    "shared": pa.int32(),
    "boundary": pa.string(),
    "start_char": pa.int64(),
    "end_char": pa.int64(),
    "text": pa.string(),
}
_SCHEMA = (
    "id long, piece int, pieces int, tokens int, shared int, boundary string, "
    "start_char long, end_char long, text string"
)


def split_texts(
    df: DataFrame,
    max_tokens: int,
    overlap_tokens: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = WORD_PUNCT,
) -> DataFrame:
    """Texts as pieces of at most ``max_tokens`` tokens.

    One row for each piece: its number from 0, the number of pieces of its
    text, its size, the tokens it shares with the piece before, the kind of
    boundary it ends at (``whole``: the text fits; ``hard``: no boundary was in
    reach; ``end``: the last piece), its character range and its text. The
    pieces without their shared tokens join to the whole text.

    A null text has no piece, an empty or blank one a single piece of size 0.
    Repeated ids are split each on their own; an empty table gives an empty
    result; other columns are not read. There is no shuffle: a text is split
    where it was read. ``overlap_tokens`` must be below half of ``max_tokens``.
    """
    if max_tokens < 1 or not 0 <= overlap_tokens <= max_tokens // 2:
        raise ValueError("need max_tokens >= 1 and 0 <= overlap_tokens <= max_tokens // 2")
    rows = df.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(_cutter(max_tokens, overlap_tokens, tokenizer), _SCHEMA)
