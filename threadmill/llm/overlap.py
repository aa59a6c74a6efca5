"""Same or near-same texts across splits.

Edit-distance segment join over words. With at most ``k`` word edits between
two texts, one of any ``k + 1`` disjoint segments of the evaluation text occurs
unchanged in the training text, shifted no further than the edits left and
right of it allow. Which segments are cut is free, so the ``k + 1`` disjoint
word triples that are rarest in the training texts are chosen, by dynamic
programming over a count sketch of all training triples. Training triples are
matched to them by key and allowed position; a bit signature of the words
refutes most other matches; a banded dynamic program decides the rest.

The keys are taken in rounds, a range of hashes each, so that the disk holds
the triples of one range at a time, even where every training triple meets a
segment. A key that many training texts hold is salted: its triples are dealt
out over several keys, its segments repeated for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threadmill.llm.canonical import FIELD_BREAK, MIN_LETTERS
from threadmill.llm.components import connected_components
from threadmill.runtime import drop_shared, shuffles_removed, write_shared

#: Edits allowed for each word of the longer text.
MAX_RATIO = 0.2
#: Cells of the count sketch of training segments, fixed: 4 MB.
SKETCH_BITS = 20
#: Bits of a round's filter of places of evaluation segments: about eight for each
#: place, within these (the larger is 32 MB). A fuller one lets more triples pass.
FILTER_BITS = (16, 28)
#: Key ranges that are joined one after the other, fewer below so many words of training texts each.
ROUNDS = 3
ROUND_WORDS = 1 << 22
#: Words of training texts whose triples one task of the join gets.
TASK_WORDS = 1 << 18
#: Training triples with one key, by the sketch, that one task of the join may get.
HOT_KEY = 1 << 17
#: Forms that a task remembers to leave out copies, before it starts anew; later steps drop the rest.
REMEMBERED = 1 << 18
#: Bits of the filter of forms that occur in candidate pairs: eight for each pair, within these.
FORM_BITS = (16, 28)
#: Words above which the signature has 256 bits instead of 128.
LONG_TEXT = 96
#: Segments have three words; texts shorter than this have segments of two.
SHORT_TEXT = 12


def edits_allowed(n, m):
    """Edits that two texts of ``n`` and ``m`` words may differ by."""
    return np.maximum(n, m) // 5


def encode_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts of single-spaced words to ``(offsets, word hashes)``."""
    lists = pc.split_pattern(texts, " ")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_numpy(zero_copy_only=False).astype(object)
    hashes = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], hashes[flat.indices.to_numpy()]


def gram_keys(hashes: np.ndarray, size: int, field: np.ndarray | int) -> np.ndarray:
    """Hash of the ``size`` words from each position; the last ``size - 1`` are not valid."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for i in range(size):
            x = hashes[i : i + n] * np.uint64(factors[i])
            key = (key ^ (x >> np.uint64(29)) ^ x) * np.uint64(0xFF51AFD7ED558CCD)
        key += np.asarray(field, np.uint64)[..., :n] if np.ndim(field) else np.uint64(field)
        key = (key + np.uint64(size)) * np.uint64(0xC4CEB9FE1A85EC53)
        # 40 bits: a collision makes a candidate more, and short keys move cheaply.
        return (key ^ (key >> np.uint64(32))) & np.uint64((1 << 40) - 1)


def signatures(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Four 64-bit words for each text: which hash buckets its words fall in."""
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    bucket = (hashes >> np.uint64(20)).astype(np.int64) & 255
    bucket = np.where(lengths[row] > LONG_TEXT, bucket, bucket & 127)
    bits = np.zeros((len(lengths), 256), bool)
    bits[row, bucket] = True
    return np.packbits(bits, axis=1).view(np.int64).reshape(-1, 4)


def wide_signatures(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Eight 64-bit words for each text, other buckets than :func:`signatures` has."""
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    bits = np.zeros((len(lengths), 512), bool)
    bits[row, (hashes >> np.uint64(31)).astype(np.int64) & 511] = True
    return np.packbits(bits, axis=1).view(np.int64).reshape(-1, 8)


class _Fresh:
    """Keeps the rows of a partition whose form is not among the last ones seen in it."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        keep = []
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        for i in ids:
            keep.append(i not in self.seen)
            self.seen.add(i)
        return batch.filter(pa.array(keep, pa.bool_()))


def _positions(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat starts of all ``size``-word segments and the text each lies in."""
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    start = np.arange(offsets[-1])
    ok = start + size <= offsets[row + 1]
    return start[ok], row[ok]


def _count_grams(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, cells = _Fresh(), np.zeros(1 << bits, np.int32)
        for batch in batches:
            batch = fresh(batch)
            if not batch.num_rows:
                continue
            offsets, hashes = encode_words(batch.column(2))
            field = np.repeat(batch.column(1).to_numpy(), np.diff(offsets))
            for size in (2, 3):
                start, _ = _positions(offsets, size)
                key = gram_keys(hashes, size, field)[start]
                cells += np.bincount(
                    (key & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits
                ).astype(np.int32)
        if cells.any():
            parts = cells.reshape(64, -1)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(range(64), pa.int32()),
                    "cells": pa.array([p.tobytes() for p in parts], pa.binary()),
                }
            )

    return run


def _add_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in pdf["cells"])
    cells = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).tobytes()
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "cells": [cells]})


def rarest_segments(cost: np.ndarray, size: int, need: int) -> np.ndarray:
    """Starts of the ``need`` disjoint segments with the smallest total cost.

    ``cost`` is ``(texts, starts)`` for texts of one length; the result is
    ``(texts, need)``.
    """
    rows, starts = cost.shape
    n = starts + size - 1
    best = np.zeros((rows, n + 1), np.float64)
    kept = []
    for _ in range(need):
        took = np.full((rows, n + 1), np.inf)
        took[:, size:] = best[:, : n + 1 - size] + cost
        best = np.minimum.accumulate(took, axis=1)
        kept.append(best)
    out = np.empty((rows, need), np.int64)
    end = np.full(rows, n)
    at = np.arange(rows)
    for m in range(need - 1, -1, -1):
        level = kept[m]
        goal = level[at, end]
        # The first end at which the best total is reached closes a segment.
        close = (level <= goal[:, None]).argmax(axis=1)
        out[:, m] = close - size
        end = close - size
    return out


def _cut_segments(sketch, bits: int, hot_key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, cells = _Fresh(), np.frombuffer(sketch.value, np.int32)
        for batch in batches:
            batch = fresh(batch)
            if not batch.num_rows:
                continue
            ids, fields = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offsets, hashes = encode_words(batch.column(2))
            lengths = np.diff(offsets)
            sig = signatures(offsets, hashes)
            salt = np.repeat(fields, lengths)
            keys = {s: gram_keys(hashes, s, salt) for s in (2, 3)}
            for n in np.unique(lengths).tolist():
                need = n * 5 // 4 // 5 + 1
                size = 3 if n >= SHORT_TEXT else 2
                if need < 2:
                    continue  # no edit is allowed; equal texts are found by their key
                same = np.nonzero(lengths == n)[0]
                step = max(1, 4_000_000 // (n * need))
                for lo in range(0, len(same), step):
                    rows = same[lo : lo + step]
                    at = offsets[rows][:, None] + np.arange(n - size + 1)
                    key = keys[size][at]
                    cost = cells[(key & np.uint64((1 << bits) - 1)).astype(np.int64)]
                    start = rarest_segments(cost.astype(np.float64), size, need)
                    paid = np.take_along_axis(cost, start, 1)
                    rank = paid.argsort(axis=1, kind="stable").argsort(axis=1)
                    who = np.repeat(rows, need)
                    # A hot key comes once for each of its salts.
                    copies = key_salts(paid.ravel(), hot_key)
                    one = np.repeat(np.arange(len(who)), copies)
                    salt_of = np.arange(len(one)) - np.repeat(np.cumsum(copies) - copies, copies)
                    chosen = np.take_along_axis(key, start, 1).ravel()[one]
                    cols = [
                        pa.array(salted(chosen, salt_of).view(np.int64)),
                        pa.array(ids[who[one]]),
                        pa.array(start.ravel()[one].astype(np.int32)),
                        pa.array(np.full(len(one), n, np.int32)),
                        pa.array(rank.ravel()[one].astype(np.int32)),
                        *[pa.array(sig[who[one], j]) for j in range(4)],
                    ]
                    yield pa.RecordBatch.from_arrays(cols, _SEGMENT_COLUMNS)

    return run


_SEGMENT = (
    "key long, eval_form long, eval_at int, n int, rank int, e0 long, e1 long, e2 long, e3 long"
)
_SEGMENT_COLUMNS = [c.split()[0] for c in _SEGMENT.split(", ")]


def key_salts(count: np.ndarray, hot_key: int) -> np.ndarray:
    """Into how many keys a key is cut that so many training texts hold, at most 2^20."""
    return np.minimum(count.astype(np.int64) // hot_key + 1, 1 << 20)


def salted(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The salt above the 40 bits of a key."""
    return key + (salt.astype(np.uint64) << np.uint64(40))


def key_round(key: np.ndarray, rounds: int) -> np.ndarray:
    """The round of a key, salted or not."""
    return ((key >> np.uint64(20)) & np.uint64((1 << 20) - 1)) % np.uint64(rounds)


def place_buckets(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coarse position and length: steps of eight words, and of a fifth of the length."""
    return at >> 3, np.floor(np.log(np.maximum(n, 1)) / np.log(1.2)).astype(np.int64)


def place_keys(key: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + (at.astype(np.uint64) * np.uint64(1_000_003)) + (
            length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        )
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def filter_slots(place: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three bits of the filter for each place."""
    mask = np.uint64((1 << bits) - 1)
    return [(place >> np.uint64(shift)) & mask for shift in (0, 19, 38)]


def _mark_places(bits: int):
    """Filter bits of the places where a training text may hold a segment.

    A task keeps the whole filter and gives it in 64 parts of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            key, at, n, rank = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            key &= (1 << 40) - 1
            shortest, longest = n - n // 5, n + n // 4
            low, high = place_buckets(at, shortest)[1], place_buckets(at, longest)[1]
            for d in range(int((high - low).max(initial=0)) + 1):
                # Lengths of this bucket, the edits they allow and the shifts those allow.
                least = np.maximum(shortest, np.floor(1.2 ** (low + d)).astype(np.int64) - 1)
                most = np.minimum(longest, np.ceil(1.2 ** (low + d + 1)).astype(np.int64) + 1)
                edits = np.maximum(n, most) // 5
                first = np.maximum(at + (least - n - edits) // 2, 0) >> 3
                last = (at + (most - n + edits + 1) // 2) >> 3
                fits = (low + d <= high) & (rank <= edits) & (least <= most)
                for e in range(int((last - first)[fits].max(initial=0)) + 1):
                    ok = fits & (first + e <= last)
                    place = place_keys(key[ok], first[ok] + e, low[ok] + d)
                    slot = np.unique(np.concatenate(filter_slots(place, bits)))
                    word = (slot >> np.uint64(6)).astype(np.int64)
                    if len(word):
                        starts = np.concatenate([[0], np.nonzero(np.diff(word))[0] + 1])
                        words[word[starts]] |= np.bitwise_or.reduceat(
                            np.uint64(1) << (slot & np.uint64(63)), starts
                        )
        if words.any():
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(range(64), pa.int32()),
                    "cells": pa.array([p.tobytes() for p in words.reshape(64, -1)], pa.binary()),
                }
            )

    return run


def _or_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.bitwise_or.reduce([np.frombuffer(c, np.uint64) for c in pdf["cells"]])
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "cells": [total.tobytes()]})


def _match_grams(filter_words, bits: int, sketch, sketch_bits: int, hot_key: int, turn: int, rounds: int):
    """Training triples of the keys of one round that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, words = _Fresh(), np.frombuffer(filter_words.value, np.uint64)
        cells = np.frombuffer(sketch.value, np.int32)
        for batch in batches:
            batch = fresh(batch)
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            offsets, hashes = encode_words(batch.column(2))
            lengths = np.diff(offsets)
            sig = signatures(offsets, hashes)
            salt = np.repeat(batch.column(1).to_numpy(), lengths)
            for size in (2, 3):
                start, row = _positions(offsets, size)
                # Texts whose partners can only have segments of the other size.
                low, high = (2, SHORT_TEXT * 5 // 4) if size == 2 else (SHORT_TEXT * 4 // 5, 1 << 62)
                ok = (lengths[row] >= low) & (lengths[row] <= high)
                start, row = start[ok], row[ok]
                key = gram_keys(hashes, size, salt)[start]
                own = key_round(key, rounds) == turn
                key, start, row = key[own], start[own], row[own]
                at = start - offsets[row]
                place = place_keys(key, *place_buckets(at, lengths[row]))
                hit = np.ones(len(place), bool)
                for slot in filter_slots(place, bits):
                    hit &= (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
                at, row, key = at[hit], row[hit], key[hit]
                salts = key_salts(cells[(key & np.uint64((1 << sketch_bits) - 1)).astype(np.int64)], hot_key)
                key = salted(key, ids[row].view(np.uint64) % salts.astype(np.uint64))
                cols = [
                    pa.array(key.view(np.int64)),
                    pa.array(ids[row]),
                    pa.array(at.astype(np.int32)),
                    pa.array(lengths[row].astype(np.int32)),
                    *[pa.array(sig[row, j]) for j in range(4)],
                ]
                yield pa.RecordBatch.from_arrays(cols, _GRAM_COLUMNS)

    return run


_GRAM = "key long, train_form long, train_at int, m int, t0 long, t1 long, t2 long, t3 long"
_GRAM_COLUMNS = [c.split()[0] for c in _GRAM.split(", ")]


def _mark_forms(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            slot = batch.column(0).to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(words, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        if words.any():
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(range(64), pa.int32()),
                    "cells": pa.array([p.tobytes() for p in words.reshape(64, -1)], pa.binary()),
                }
            )

    return run


def _only(marked, bits: int, columns: list[str]):
    """Distinct texts whose form may be marked, so that few others move.

    With three columns the class and the text come out, else its length and wide signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, words = _Fresh(), np.frombuffer(marked.value, np.uint64)
        for batch in batches:
            slot = batch.column(0).to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)
            hit = (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
            kept = fresh(batch.filter(pa.array(hit)))
            if len(columns) == 3:
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(3), kept.column(2)], columns)
            elif kept.num_rows:
                offsets, hashes = encode_words(kept.column(2))
                sig = wide_signatures(offsets, hashes)
                cols = [kept.column(0), pa.array(np.diff(offsets).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(sig[:, j]) for j in range(8)], columns)

    return run


def banded_distance(
    a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, band: int
) -> np.ndarray:
    """Edit distances of padded rows, exact up to ``band`` and larger beyond it.

    ``a`` is ``(pairs, max n)``, ``b`` is ``(pairs, max m)``; only cells within
    ``band`` of the diagonal are computed, all pairs at once.
    """
    pairs, width = len(a), 2 * band + 1
    big = np.int32(1 << 20)
    step = np.arange(width, dtype=np.int32)
    prev = np.where(step >= band, step - band, big).astype(np.int32)
    prev = np.broadcast_to(prev, (pairs, width)).copy()
    rows = a.shape[1]
    padded = np.zeros((pairs, rows + width + band), b.dtype)
    take = min(b.shape[1], rows + 2 * band)
    padded[:, band : band + take] = b[:, :take]
    out = np.full(pairs, big, np.int32)
    final = m - n + band
    inside = (final >= 0) & (final < width)
    at = np.nonzero((n == 0) & inside)[0]
    out[at] = prev[at, final[at]]
    for i in range(1, rows + 1):
        # Offset o of row i is column j = i + o - band, b[j - 1] = padded[i - 1 + o].
        cur = prev + (padded[:, i - 1 : i - 1 + width] != a[:, i - 1 : i])
        cur[:, :-1] = np.minimum(cur[:, :-1], prev[:, 1:] + 1)
        if i <= band:
            cur[:, : band - i] = big
            cur[:, band - i] = i
        cur = np.minimum.accumulate(cur - step, axis=1) + step
        prev = cur
        at = np.nonzero((n == i) & inside)[0]
        out[at] = cur[at, final[at]]
    return out


def _padded(offsets: np.ndarray, hashes: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.uint64)
    lengths = np.diff(offsets)[rows]
    fill = np.arange(width) < lengths[:, None]
    at = offsets[rows][:, None] + np.arange(width)
    out[fill] = hashes[at[fill]]
    return out


def bag_distance(left, right, buckets: int = 1024, block: int = 256) -> np.ndarray:
    """A lower bound of the edit distances: the larger surplus of words of either side."""
    pairs = len(left[0]) - 1
    out = np.zeros(pairs, np.int64)
    for lo in range(0, pairs, block):
        hi = min(lo + block, pairs)
        diff = np.zeros((hi - lo) * buckets, np.int64)
        for (offsets, hashes), sign in ((left, 1), (right, -1)):
            part = hashes[offsets[lo] : offsets[hi]]
            row = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
            slot = row * buckets + ((part >> np.uint64(17)).astype(np.int64) & (buckets - 1))
            diff += sign * np.bincount(slot, minlength=len(diff))
        diff = diff.reshape(hi - lo, buckets)
        out[lo:hi] = np.maximum(np.maximum(diff, 0).sum(axis=1), np.maximum(-diff, 0).sum(axis=1))
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (encode_words(batch.column(i)) for i in (2, 3))
        n, m = np.diff(left[0]), np.diff(right[0])
        allowed = edits_allowed(n, m)
        distance = np.full(len(n), 1 << 20, np.int32)
        # Words without a partner in the other text are edits; only pairs with
        # few enough of them are worth a table.
        hope = np.nonzero(bag_distance(left, right) <= allowed)[0]
        order = hope[np.argsort(n[hope], kind="stable")]
        for lo in range(0, len(order), 128):
            rows = order[lo : lo + 128]
            band = int(allowed[rows].max(initial=0))
            a = _padded(*left, rows, int(n[rows].max(initial=0)))
            b = _padded(*right, rows, int(m[rows].max(initial=0)))
            distance[rows] = banded_distance(a, n[rows], b, m[rows], band)
        near = distance <= allowed
        kept = batch.filter(pa.array(near))
        yield pa.RecordBatch.from_arrays(
            [kept.column(0), kept.column(1), pa.array(distance[near])],
            ["eval_class", "train_class", "edits"],
        )


def _only_in(ours: str, theirs: str) -> Column:
    """Buckets of the wide signature that only the first of two texts has."""
    other = lambda j: F.bitwise_not(F.col(f"{theirs}{j}"))
    return sum((F.bit_count(F.col(f"{ours}{j}").bitwiseAND(other(j))) for j in range(8)), F.lit(0))


def _unlike(ours: str, theirs: str) -> Column:
    """Words' buckets that only one of two texts has, in the coarser signature of both."""
    bit = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    fold = lambda s, j: F.col(f"{s}{j}").bitwiseOR(F.col(f"{s}{j + 2}"))
    full = sum((bit(f"{ours}{j}", f"{theirs}{j}") for j in range(4)), F.lit(0))
    half = sum(
        (F.bit_count(fold(ours, j).bitwiseAND(F.bitwise_not(fold(theirs, j)))) for j in range(2)),
        F.lit(0),
    )
    return F.when((F.col("n") > LONG_TEXT) & (F.col("m") > LONG_TEXT), full).otherwise(half)


_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(FIELD_BREAK)
_TEXT = "class binary, field int, words string, id long, is_train boolean, listed long, form long"
_TEXT_COLUMNS = [c.split()[0] for c in _TEXT.split(", ")]


def listed_fields(text: str) -> str | None:
    """What :func:`canonical.field_list` does, joined, for one text in a Python worker."""
    if ":" not in text:
        return None
    fields = []
    for piece in _BREAK.split(text):
        words = _WORD.findall(piece.lower().replace("ß", "ss"))
        if not words:
            continue
        label, colon, value = piece.partition(":")
        if not colon or not _WORD.search(label) or not _WORD.search(value):
            return None
        fields.append("".join(words))
    return " ".join(sorted(fields)) if len(fields) > 1 else None


def _read_texts(train: str, tests: list[str], count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bool]] = set()
        for batch in batches:
            ids, roles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for field in range(count):
                words, flat, spaced, listed, who, side = [], [], [], [], [], []
                for i, role, text in zip(ids, roles, batch.column(2 + field).to_pylist(), strict=True):
                    if not text or len(text) < MIN_LETTERS:
                        continue
                    found = _WORD.findall(text.lower().replace("ß", "ss"))
                    joined = "".join(found)
                    if len(joined) < MIN_LETTERS:
                        continue
                    words.append(" ".join(found))
                    flat.append(f"{field} {joined}")
                    spaced.append(f"{field} {words[-1]}")
                    fields = listed_fields(text)
                    listed.append(None if fields is None else f"{field} fields {fields}")
                    who.append(i)
                    side.append(role == train)
                hashed = [h is not None for h in listed]
                lists = np.zeros(len(listed), np.int64)
                if any(hashed):
                    lists[hashed] = _hash64([h for h in listed if h is not None])
                classes, forms = _hash128(flat), _hash64(spaced)
                # Of the copies of a word sequence in a task and side the first keeps its words,
                # as far as the task remembers.
                if len(seen) > REMEMBERED:
                    seen.clear()
                for k, key in enumerate(zip(forms.tolist(), side, strict=True)):
                    if key in seen:
                        words[k] = None
                    seen.add(key)
                yield pa.RecordBatch.from_arrays(
                    [
                        classes,
                        pa.array(np.full(len(words), field, np.int32)),
                        pa.array(words, pa.string()),
                        pa.array(who, pa.int64()),
                        pa.array(side, pa.bool_()),
                        pa.array(lists, mask=~np.array(hashed, bool)),
                        pa.array(forms, mask=np.array([w is None for w in words], bool)),
                    ],
                    _TEXT_COLUMNS,
                )

    return run


def _hash64(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)


def _hash128(texts: list[str]) -> pa.Array:
    """Sixteen bytes for each text, by which texts count as equal."""
    return pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())


def _texts(df: DataFrame, fields: list[str], id_col: str, split_col: str, train: str, tests: list[str]):
    role = F.lower(F.trim(F.col(split_col)))
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), role.alias("role"), *[F.col(f) for f in fields]
    ).where(F.col("id").isNotNull() & F.col("role").isin(train, *tests))
    return rows.mapInArrow(_read_texts(train, tests, len(fields)), _TEXT)


_PARTS = "part int, cells binary"


def _gather(parts: DataFrame, merge) -> bytes:
    """The merged parts of a sketch in order: 64 rows of fixed size, whatever the corpus."""
    with shuffles_removed(parts.sparkSession):
        rows = parts.groupBy("part").applyInPandas(merge, _PARTS).collect()
    return b"".join(bytes(r.cells) for r in sorted(rows, key=lambda r: r.part))


def near_classes(
    texts: DataFrame, eval_chars: int, train_chars: int, round_words: int = ROUND_WORDS, hot_key: int = HOT_KEY
) -> tuple[DataFrame, DataFrame]:
    """``(eval_class, train_class, edits)`` of near-same, not equal, word sequences, and a table to drop when it is read.

    ``texts`` is what :func:`cross_split_overlaps` writes: one row for each
    text, with the class of equal texts it belongs to and its form, the word
    sequence; copies of a form may lack words. Texts of a class may be spaced
    in several ways, so forms are compared, and a pair of classes comes once
    for each near pair of their forms. By the characters of the evaluation and
    training texts the filter, the rounds and the tasks of the join are sized.
    """
    spark = texts.sparkSession
    context = spark.sparkContext
    worded = texts.where("words is not null")
    train = worded.where("is_train").select("form", "field", "words", "class")
    evals = worded.where("not is_train").select("form", "field", "words", "class")
    sketch = context.broadcast(
        _gather(train.mapInArrow(_count_grams(SKETCH_BITS), _PARTS), _add_cells) or bytes(4 << SKETCH_BITS)
    )
    segments = write_shared(evals.mapInArrow(_cut_segments(sketch, SKETCH_BITS, hot_key), _SEGMENT), "segments")
    train_words = train_chars // 6
    rounds = min(ROUNDS, train_words // round_words + 1)
    # About one segment for each four words, five places for a segment, eight bits for a place.
    bits = min(max(FILTER_BITS[0], (eval_chars * 2 // rounds).bit_length()), FILTER_BITS[1])
    tasks = max(1, -(-train_words // (rounds * TASK_WORDS)))
    turn_of = F.pmod(F.shiftright("key", 20).bitwiseAND((1 << 20) - 1), F.lit(rounds))
    allowed = F.floor(F.greatest("n", "m") / 5)
    shift, grown = F.col("train_at") - F.col("eval_at"), F.col("m") - F.col("n")
    near = (
        (F.col("eval_form") != F.col("train_form"))
        & (F.abs(grown) <= allowed)
        & (F.col("rank") <= allowed)
        & (F.abs(shift) + F.abs(grown - shift) <= allowed)
        & (_unlike("e", "t") <= allowed)
        & (_unlike("t", "e") <= allowed)
    )
    found = []
    for turn in range(rounds):
        own = segments.where(turn_of == turn)
        # Each task gives a filter of the whole size, so an eighth of the join's tasks mark.
        marks = own.select("key", "eval_at", "n", "rank").coalesce(max(1, tasks // 8)).mapInArrow(_mark_places(bits), _PARTS)
        passed = context.broadcast(_gather(marks, _or_cells) or bytes(1 << (bits - 3)))
        grams = train.mapInArrow(_match_grams(passed, bits, sketch, SKETCH_BITS, hot_key, turn, rounds), _GRAM)
        # Segments of forms that occur in several input partitions are reduced to
        # one after the exchange that the join needs anyway; triples come at most
        # once from each partition, and pairs are made distinct.
        left = own.repartition(tasks, "key").dropDuplicates(["key", "eval_form", "eval_at"])
        right = grams.repartition(tasks, "key")
        pairs = left.join(right, "key").where(near).select("eval_form", "train_form").distinct()
        # Pairs of ids are small against the texts; they are written, mark the
        # texts that are wanted and then meet them.
        found.append(write_shared(pairs, "pairs"))
        passed.destroy()
    drop_shared(segments)
    sketch.destroy()
    pairs = reduce(DataFrame.unionAll, found).distinct() if rounds > 1 else found[0]

    def form_bits(pairs: int) -> int:
        return min(max(FORM_BITS[0], (pairs * 8).bit_length()), FORM_BITS[1])

    def wanted(pairs: DataFrame, bits: int, side: DataFrame, pair_column: str, kinds: dict[str, str]) -> DataFrame:
        marks = pairs.select(pair_column).mapInArrow(_mark_forms(bits), _PARTS)
        shared = context.broadcast(_gather(marks, _or_cells) or bytes(1 << (bits - 3)))
        columns = {pair_column: "long"} | kinds
        schema = ", ".join(f"{c} {kind}" for c, kind in columns.items())
        picked = side.mapInArrow(_only(shared, bits, list(columns)), schema)
        return picked.repartition(tasks, pair_column).dropDuplicates([pair_column])

    wide = lambda s, n: {n: "int"} | {f"{s}{j}": "long" for j in range(8)}
    bits = form_bits(sum(t.count() for t in found))
    close = (
        pairs.repartition(tasks, "train_form")
        .join(wanted(pairs, bits, train, "train_form", wide("t", "m")), "train_form")
        .repartition(tasks, "eval_form")
        .join(wanted(pairs, bits, evals, "eval_form", wide("e", "n")), "eval_form")
        .where((_only_in("e", "t") <= allowed) & (_only_in("t", "e") <= allowed))
        .select("eval_form", "train_form")
    )
    close = write_shared(close, "close")
    for table in found:
        drop_shared(table)
    bits = form_bits(close.count())
    alike = close.repartition(tasks, "train_form").join(
        wanted(close, bits, train, "train_form", {"train_class": "binary", "train_words": "string"}), "train_form"
    )
    whole = wanted(close, bits, evals, "eval_form", {"eval_class": "binary", "eval_words": "string"})
    both = alike.join(whole, "eval_form").where("eval_class <> train_class").select(
        "eval_class", "train_class", "eval_words", "train_words"
    )
    return both.mapInArrow(_verify, "eval_class binary, train_class binary, edits int"), close


def cross_split_overlaps(
    df: DataFrame,
    fields: tuple[str, ...] = ("body", "parent_body"),
    id_col: str = "sample_id",
    split_col: str = "split",
    train: str = "train",
    tests: tuple[str, ...] = ("validation", "test"),
    round_words: int = ROUND_WORDS,
    hot_key: int = HOT_KEY,
) -> tuple[DataFrame, DataFrame]:
    """Overlaps between evaluation and training texts, by class of equal texts.

    The first result is the membership ``(class, field, id, is_train)``, the
    second the links ``(eval_class, train_class, field, edits)``: equal texts
    and equal lists of labelled fields have ``edits`` 0, as have texts that these
    connect over other texts of either side, near-same ones the
    number of words inserted, dropped or replaced, at most one in five of the
    longer text, and the smallest number where copies are spaced differently. Letter case, punctuation and spacing do not count. Copies are
    in the membership, not in the links; :func:`overlap_pairs` expands them.

    Null, empty and short texts (fewer than 20 letters and digits) overlap
    nothing; rows with a null id or a split other than the named ones take no
    part. The result does not depend on ``round_words`` and ``hot_key``, which
    set the number of key ranges and of salts. Repeated rows are repeated members. A table without evaluation or
    training rows gives no links. ``field`` is the column's name.
    """
    size = Observation()
    read = _texts(df, list(fields), id_col, split_col, train, list(tests)).observe(
        size,
        F.sum(F.when(~F.col("is_train"), F.length("words"))).alias("evals"),
        F.sum(F.when(F.col("is_train"), F.length("words"))).alias("trains"),
    )
    texts = write_shared(read, "texts")
    near, close = near_classes(texts, size.get["evals"] or 0, size.get["trains"] or 0, round_words, hot_key)
    field_of = texts.select(F.col("class").alias("eval_class"), "field").distinct()
    near = near.join(field_of, "eval_class")
    sides = texts.groupBy("class", "field").agg(F.bool_or("is_train").alias("t"), F.bool_and("is_train").alias("a"))
    equal = sides.where("t and not a").select(
        F.col("class").alias("eval_class"), F.col("class").alias("train_class"), F.lit(0).alias("edits"), "field"
    )
    # A list of fields stands for its class on either side, and classes that hold
    # several lists connect these, so sameness carries over.
    lists = texts.where("listed is not null").select("class", "field", "listed").distinct()
    heads = lists.groupBy("class").agg(F.min("listed").alias("v"))
    bridges = lists.join(heads, "class").where("listed <> v").select(F.col("listed").alias("u"), "v")
    roots = connected_components(bridges).withColumnRenamed("node", "listed")
    groups = lists.join(roots, "listed", "left").select("class", "field", F.coalesce("root", "listed").alias("group"))
    groups = write_shared(groups.distinct().join(sides, ["class", "field"]), "lists")
    ordered = (
        groups.where("not a")
        .select(F.col("class").alias("eval_class"), "field", "group")
        .join(groups.where("t").select(F.col("class").alias("train_class"), "group"), "group")
        .where("eval_class <> train_class")
        .select("eval_class", "train_class", F.lit(0).alias("edits"), "field")
    )
    names = F.element_at(F.array(*[F.lit(c) for c in fields]), F.col("field") + 1)
    links = near.select("eval_class", "train_class", "edits", "field").unionAll(equal).unionAll(ordered)
    links = (
        links.groupBy("eval_class", "train_class", "field")
        .agg(F.min("edits").alias("edits"))
        .select("eval_class", "train_class", names.alias("field"), "edits")
    )
    members = texts.select("class", names.alias("field"), "id", "is_train")
    links = write_shared(links, "overlaps")
    drop_shared(close)
    drop_shared(groups)
    return members, links


def overlap_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(eval_id, train_id, field, edits)``: the links with their copies expanded."""
    evals = members.where("not is_train").select(F.col("class").alias("eval_class"), F.col("id").alias("eval_id"))
    trains = members.where("is_train").select(F.col("class").alias("train_class"), F.col("id").alias("train_id"))
    return (
        links.join(evals, "eval_class")
        .join(trains, "train_class")
        .select("eval_id", "train_id", "field", "edits")
    )
