"""Scoring texts for abusive, hateful or sexually explicit language.

A convolutional text classifier in numpy: hashed word embeddings, filters of
several widths, max pooling over the text and a logistic output. It is trained
on a bounded sample of reviewed rows; thresholds are calibrated by language on
rows held out from training. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reviewed rows that may train the classifier; beyond it the rows with the
#: smallest hash of their id are taken.
TRAIN_ROWS = 20_000
BUCKETS = 1 << 16
DIM = 16
WIDTHS = (1, 2, 3, 5)
FILTERS = 16
#: Steps of the optimiser, however many rows there are; each takes ``BATCH`` rows
#: and ``FRAGMENTS`` short pieces of clean rows, which say too little to be abuse.
STEPS = 1600
BATCH = 32
FRAGMENTS = 8
FRAGMENT_TOKENS = 4
RATE = 0.004
HELD_OUT = 5
#: Reviewed rows over-represent abuse; in the calibration a clean row counts so many times.
CLEAN_WEIGHT = 3.0
#: Held-out rows of all languages count in a language's threshold like so many of its own.
SHARED_ROWS = 60.0
#: Distinct tokens that a worker keeps before it starts anew; a matter of memory only.
VOCABULARY = 400_000

# Characters written in place of letters.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
        "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i",
        "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
        "\u200b": None, "\u200c": None, "\u200d": None, "\u2060": None, "\ufeff": None, "\u00ad": None,
        "’": "'", "‘": "'",
    }
)
IN_WORDS = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t"})
# Frequent words by which a language is told.
STOP_WORDS = {
    "en": "the and a of to in is was that it for on with my at which have this but or are".split(),
    "de": "der die das und ist nicht ein eine im am mit den dem auf zu wie aber du bei vor".split(),
    "fr": "le la les et est une dans sur pas avec au du des mais que pour ce un vers depuis".split(),
    "es": "el la los y es una en no con del por pero que para se un al las sin hacia".split(),
}

_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]{1,2}){3,}[^\W\d_](?![^\W_])")
# What every text with such letters holds: two of them, set apart on all sides.
_SPACED_HERE = re.compile(r"[ .\-_*][^\W\d_][ .\-_*]{1,2}[^\W\d_][ .\-_*]")
_GAPS = re.compile(r"[ .\-_*]+")
_TOKEN = re.compile(r"\w+(?:[@$+*!#]+\w+)*|[.!?;:]+|[\n\"“”„«»]")
_LONG_RUN = re.compile(r"(.)\1{2,}")
_STAR = re.compile(r"[*#]+")
_QUOTES = '"“”„«»'


def fold_token(token: str) -> str:
    """One spelling for disguised forms: look-alike digits and signs, stretched letters."""
    if token.isalpha():
        return _LONG_RUN.sub(r"\1", token)
    if not any(c.isalpha() for c in token):
        return "<n>" if token[0].isalnum() else "<s>"
    if "*" in token or "#" in token:
        return _STAR.sub("*", token)
    return _LONG_RUN.sub(r"\1", token.translate(IN_WORDS))


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) % (BUCKETS - 1) + 1


def token_buckets(token: str) -> tuple[int, int]:
    """Bucket of the word and of its letters regardless of their inner order."""
    word = fold_token(token)
    if word[0] == "<":
        return _hash(word), 0
    bag = f"{word[0]}{''.join(sorted(set(word)))}{len(word) // 3}"
    return _hash(word), _hash("~" + bag)


@dataclass
class Texts:
    """Encoded texts: token ids, laid out flat with their starts, and languages."""

    starts: np.ndarray
    ids: np.ndarray
    langs: np.ndarray

    def __len__(self) -> int:
        return len(self.langs)


class _Ids(dict):
    """Ids of tokens; a token that is looked up for the first time gets the next one."""

    def __init__(self, add):
        super().__init__({"": 0})
        self.add = add

    def __missing__(self, token: str) -> int:
        self[token] = i = len(self)
        self.add(token)
        return i


class Reader:
    """Texts to token ids; works out each distinct token once.

    Id 0 is padding. ``word``, ``bag``, ``stop`` and ``mark`` give for an id the
    buckets of the token, the language it speaks for and whether it is a
    quotation mark.
    """

    def __init__(self):
        self.stop_of = {w: k + 1 for k, ws in enumerate(STOP_WORDS.values()) for w in ws}
        self.clear()

    def clear(self) -> None:
        self.known = _Ids(self._add)
        self.fresh: list[tuple[int, int, int, bool]] = []
        self.word, self.bag, self.stop = (np.zeros(1, np.int64) for _ in range(3))
        self.mark = np.zeros(1, bool)

    def _add(self, token: str) -> None:
        word, bag = (_hash("<s>"), 0) if token == "\n" else token_buckets(token)
        self.fresh.append((word, bag, self.stop_of.get(token, 0), token in _QUOTES))

    def _settle(self) -> None:
        if self.fresh:
            word, bag, stop, mark = np.array(self.fresh, np.int64).T
            self.word, self.bag = np.concatenate([self.word, word]), np.concatenate([self.bag, bag])
            self.stop, self.mark = np.concatenate([self.stop, stop]), np.concatenate([self.mark, mark > 0])
            self.fresh = []

    def tokens(self, text: str) -> list[str]:
        text = text.lower()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text.translate(LOOKALIKES))
        text = text.strip()
        if len(text) > 1 and text[0] in _QUOTES and text[-1] in _QUOTES:
            text = text[1:-1]
        if _SPACED_HERE.search(text):
            text = _SPACED.sub(lambda m: _GAPS.sub("", m[0]), text)
        return _TOKEN.findall(text)

    def __call__(self, texts: list[str]) -> Texts:
        known, flat, lengths = self.known, [], []
        for text in texts:
            tokens = self.tokens(text)
            flat.append(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))
            lengths.append(len(tokens))
        self._settle()
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        ids = np.concatenate([*flat, np.zeros(0, np.int64)])
        kinds = len(STOP_WORDS) + 1
        slot = np.repeat(np.arange(len(texts)) * kinds, lengths) + self.stop[ids]
        votes = np.bincount(slot, minlength=len(texts) * kinds).reshape(-1, kinds)
        langs = np.array(list(STOP_WORDS))[votes[:, 1:].argmax(axis=1)]
        return Texts(starts, ids, langs)


@dataclass
class Model:
    """Parameters; ``slot`` maps a bucket to a row of ``table``, row 0 is all zero.

    ``filters[k]`` is ``(width, dim, filters)``.
    """

    slot: np.ndarray
    table: np.ndarray
    quote: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)


SPAN = max(WIDTHS)


def _picked(texts: Texts, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ids of some texts, one after the other."""
    lengths = (texts.starts[1:] - texts.starts[:-1])[pick]
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    inner = np.arange(starts[-1]) - np.repeat(starts[:-1], lengths)
    return starts, texts.ids[np.repeat(texts.starts[:-1][pick], lengths) + inner]


def layout(texts: Texts, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of some texts with padding after each, their starts, and where their windows begin and end.

    A window that starts in a text ends in its padding; those that start in the
    padding are left out, as they reach into the next text.
    """
    tight, flat = _picked(texts, pick)
    lengths = np.diff(tight)
    starts = tight + SPAN * np.arange(len(tight))
    ids = np.zeros(starts[-1], np.int64)
    ids[np.arange(len(flat)) + np.repeat(starts[:-1] - tight[:-1], lengths)] = flat
    windows = np.stack([starts[:-1], starts[:-1] + np.maximum(lengths, 1)], axis=1)
    return starts, ids, windows


def quoted(mark: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a position lies after an odd number of quotation marks of its text."""
    count = np.cumsum(mark)
    before = np.concatenate([[0], count])[starts[:-1]]
    return (count - np.repeat(before, np.diff(starts))) % 2 == 1


def _windows(x: np.ndarray) -> np.ndarray:
    """``(tokens, SPAN * dim)``: each token with those after it."""
    x = np.concatenate([x, np.zeros((SPAN - 1, DIM), np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(x.ravel(), SPAN * DIM)[::DIM]
    return np.ascontiguousarray(view)


def _bank(model: Model) -> np.ndarray:
    """The filters of all widths as one matrix over the longest window."""
    bank = np.zeros((SPAN, DIM, len(WIDTHS) * FILTERS), np.float32)
    for k, (w, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
        bank[:w, :, k * FILTERS : (k + 1) * FILTERS] = f
    return bank.reshape(SPAN * DIM, -1)


def token_vectors(model: Model, reader: Reader, known: np.ndarray | None = None) -> np.ndarray:
    """Vectors of all tokens of the reader; those of ``known``, its first ones, are taken over."""
    done = 0 if known is None else len(known)
    fresh = model.table[model.slot[reader.word[done:]]] + model.table[model.slot[reader.bag[done:]]]
    return fresh if known is None else np.concatenate([known, fresh]) if len(fresh) else known


def predict(
    model: Model, texts: Texts, reader: Reader, block: int = 128, vectors: np.ndarray | None = None
) -> np.ndarray:
    """Scores of the texts; blocks keep the windows in the cache."""
    if vectors is None:
        vectors = token_vectors(model, reader)
    mark, bank = reader.mark, _bank(model)
    out = np.zeros(len(texts), np.float32)
    for lo in range(0, len(texts), block):
        pick = np.arange(lo, min(lo + block, len(texts)))
        starts, ids, windows = layout(texts, pick)
        x = vectors[ids]
        marks = mark[ids]
        if marks.any():
            x[quoted(marks, starts)] += model.quote
        h = np.maximum.reduceat(_windows(x) @ bank, windows.ravel(), axis=0)[::2] + model.bias
        out[pick] = np.maximum(h, 0) @ model.out + model.out_bias
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fragments(texts: Texts, rows: np.ndarray, rng: np.random.Generator) -> Texts:
    """A short piece of each of some texts, at times an empty one."""
    lengths = (texts.starts[1:] - texts.starts[:-1])[rows]
    take = np.minimum(rng.integers(0, FRAGMENT_TOKENS + 1, len(rows)), lengths)
    first = texts.starts[:-1][rows] + (rng.random(len(rows)) * (lengths - take + 1)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(take)]).astype(np.int64)
    inner = np.arange(starts[-1]) - np.repeat(starts[:-1], take)
    return Texts(starts, texts.ids[np.repeat(first, take) + inner], texts.langs[rows])


def _join(a: Texts, b: Texts) -> Texts:
    starts = np.concatenate([a.starts, b.starts[1:] + a.starts[-1]])
    return Texts(starts, np.concatenate([a.ids, b.ids]), np.concatenate([a.langs, b.langs]))


def _add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``total[rows] += values`` where rows repeat."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.concatenate([[0], np.nonzero(np.diff(rows))[0] + 1])
    if len(rows):
        total[rows[first]] += np.add.reduceat(values[order], first, axis=0)


def train(
    texts: Texts, rows: np.ndarray, labels: np.ndarray, reader: Reader, seed: int, steps: int = STEPS
) -> Model:
    """Fit by Adam on the logistic loss; words seen in one text only stay neutral."""
    rng = np.random.default_rng(seed)
    word, bag, mark = reader.word, reader.bag, reader.mark
    seen = np.zeros(BUCKETS, np.int64)
    for i in rows:
        ids = texts.ids[texts.starts[i] : texts.starts[i + 1]]
        seen[np.unique(np.concatenate([word[ids], bag[ids]]))] += 1
    used = np.nonzero(seen[1:] >= 2)[0] + 1
    slot = np.zeros(BUCKETS, np.int32)
    slot[used] = np.arange(1, len(used) + 1)
    table = rng.normal(0, 0.1, (len(used) + 1, DIM)).astype(np.float32)
    table[0] = 0
    wide = FILTERS * len(WIDTHS)
    model = Model(
        slot,
        table,
        np.zeros(DIM, np.float32),
        [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(wide, np.float32),
        rng.normal(0, 0.1, wide).astype(np.float32),
        0.0,
    )
    params = [table, model.quote, *model.filters, model.bias, model.out, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    labels = labels.astype(np.float32)
    clean = rows[labels == 0]
    order = np.zeros(0, np.int64)
    each = np.arange(wide)
    for step in range(1, steps + 1):
        rate = RATE * (1 - step / steps) + RATE * 0.05
        while len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(rows))])
        pick, order = order[:BATCH], order[BATCH:]
        short = fragments(texts, rng.choice(clean, FRAGMENTS), rng)
        whole = Texts(*_picked(texts, rows[pick]), texts.langs[rows[pick]])
        batch = _join(whole, short)
        truth = np.concatenate([labels[pick], np.zeros(FRAGMENTS, np.float32)])
        starts, ids, windows = layout(batch, np.arange(len(batch)))
        keep = rng.random(len(ids)) > 0.15
        words, bags = slot[word[ids]] * keep, slot[bag[ids]] * keep
        inside = quoted(mark[ids], starts)
        x = table[words] + table[bags]
        x[inside] += model.quote
        view, bank = _windows(x), _bank(model)
        y = view @ bank
        top = np.stack([a + y[a:b].argmax(axis=0) for a, b in windows.tolist()])
        h = np.take_along_axis(y, top, 0) + model.bias
        drop = (rng.random(h.shape) > 0.3).astype(np.float32) / np.float32(0.7)
        z = np.maximum(h, 0) * drop
        p = 1 / (1 + np.exp(-np.clip(z @ model.out + params[-1][0], -30, 30)))
        d = ((p - truth) / len(truth)).astype(np.float32)
        dh = d[:, None] * model.out * drop * (h > 0)
        # Each filter of each text has one window, so no cell is written twice.
        at, inverse = np.unique(top, return_inverse=True)
        dy = np.zeros((len(at), wide), np.float32)
        dy[inverse.reshape(top.shape), each] = dh
        dbank = (view[at].T @ dy).reshape(SPAN, DIM, wide)
        dview = (dy @ bank.T).reshape(len(at), SPAN, DIM)
        dx = np.zeros((len(x) + SPAN, DIM), np.float32)
        for o in range(SPAN):
            dx[at + o] += dview[:, o]
        dx = dx[: len(x)]
        live = np.nonzero(np.abs(dx).sum(axis=1) > 0)[0]
        dtable = np.zeros_like(table)
        _add_rows(dtable, np.concatenate([words[live], bags[live]]), np.concatenate([dx[live], dx[live]]))
        dtable[0] = 0
        dfilters = [
            dbank[:w, :, k * FILTERS : (k + 1) * FILTERS] + np.float32(1e-5) * f
            for k, (w, f) in enumerate(zip(WIDTHS, model.filters, strict=True))
        ]
        dout = z.T @ d + np.float32(1e-4) * model.out
        grads = [dtable, dx[inside].sum(axis=0), *dfilters, dh.sum(axis=0), dout, d.sum(keepdims=True)]
        for q, g, m, v in zip(params, grads, first, second, strict=True):
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            q -= np.float32(rate / (1 - 0.9**step)) * m / (np.sqrt(v / np.float32(1 - 0.999**step)) + np.float32(1e-8))
        table[0] = 0
    model.out_bias = float(params[-1][0])
    return model


def best_threshold(score: np.ndarray, label: np.ndarray, weight: np.ndarray | float = 1.0) -> float:
    """The threshold with the largest F1 of weighted rows; midway between scores, 0.5 without abusive rows."""
    weight = np.broadcast_to(weight, score.shape)
    if not (label * weight).any():
        return 0.5
    order = np.argsort(-score)
    s, y, w = score[order], label[order], weight[order]
    tp, fp = np.cumsum(y * w), np.cumsum((1 - y) * w * CLEAN_WEIGHT)
    f1 = 2 * tp / (tp + fp + (y * w).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    after = s[k + 1] if k + 1 < len(s) else 0.0
    return float(np.clip((s[k] + after) / 2, 0.05, 0.95))


def fit(bodies: list[str], labels: list[int], seed: int = 42, steps: int = STEPS) -> Model:
    """Train on four of five rows, calibrate on the fifth.

    The threshold of a language has the best F1 over the held-out rows of that
    language and, with the weight of ``SHARED_ROWS`` rows together, those of all
    languages; ``""`` is the one of all.
    """
    reader = Reader()
    texts = reader(bodies)
    y = np.array(labels, np.int64)
    # Equal texts go to one side, so that copies do not flatter the calibration.
    held = np.array([zlib.crc32(t.encode()) % HELD_OUT == 0 for t in bodies], bool)
    rows = np.nonzero(~held)[0]
    if not len(rows) or y[rows].min() == y[rows].max():
        model = train(texts, rows, y[rows], reader, seed, steps=0)
        model.out[:] = 0
        model.out_bias = -30.0
        model.thresholds = {"": 0.5}
        return model
    model = train(texts, rows, y[rows], reader, seed, steps)
    score, label = predict(model, texts, reader)[held], y[held]
    model.thresholds = {"": best_threshold(score, label)}
    for lang in STOP_WORDS:
        weight = (texts.langs[held] == lang) + SHARED_ROWS / max(len(score), 1)
        model.thresholds[lang] = best_threshold(score, label, weight)
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader, vectors = shared.value, Reader(), None
        every = model.thresholds[""]
        for batch in batches:
            if len(reader.known) > VOCABULARY:
                reader.clear()
                vectors = None
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                # Each distinct text of the part is scored once.
                place: dict[str, int] = {}
                at = np.array([place.setdefault(t or "", len(place)) for t in part.column(1).to_pylist()])
                texts = reader(list(place))
                vectors = token_vectors(model, reader, vectors)
                score = predict(model, texts, reader, vectors=vectors).astype(np.float64)
                score[np.diff(texts.starts) == 0] = 0.0
                limit = np.array([model.thresholds.get(g, every) for g in texts.langs.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(texts.langs[at].tolist(), pa.string()),
                        pa.array(score[at]),
                        pa.array((score >= limit)[at]),
                    ],
                    ["id", "source", "lang", "score", "abusive"],
                )

    return run


def train_on_reviews(
    df: DataFrame,
    reviews: DataFrame,
    id_col: str = "sample_id",
    text_col: str = "body",
    verdict_col: str = "verdict",
    max_rows: int = TRAIN_ROWS,
    seed: int = 42,
    steps: int = STEPS,
) -> Model:
    """A classifier from at most ``max_rows`` reviewed rows.

    A row's verdicts ``abusive`` and ``clean`` are counted; ties, other verdicts
    and rows without a text train nothing. Without rows of both kinds the model
    gives every text the score of none.
    """
    votes = (
        reviews.where(F.col(verdict_col).isin("abusive", "clean"))
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.sum(F.when(F.col(verdict_col) == "abusive", 1).otherwise(-1)).alias("vote"))
        .where("id is not null and vote <> 0")
    )
    rows = (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .where("text is not null")
        .join(votes, "id")
        .select((F.col("vote") > 0).cast("int").alias("label"), "text", "id")
        .orderBy(F.xxhash64("id", F.lit(seed)), "id", "text")
        .limit(max_rows)
        .collect()
    )
    return fit([r.text for r in rows], [r.label for r in rows], seed, steps)


def score_abuse(
    df: DataFrame,
    model: Model,
    id_col: str = "sample_id",
    text_col: str = "body",
    source_col: str = "subreddit",
) -> DataFrame:
    """``(id, source, lang, score, abusive)`` for every row.

    Null, empty and wordless texts have score 0 and are not abusive. Repeated
    rows are scored each on their own; null ids and sources are kept; other
    columns are not read. Very long texts are scored whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")
    )
    return rows.mapInArrow(_score(shared), "id long, source string, lang string, score double, abusive boolean")


def abuse_rates(scored: DataFrame) -> DataFrame:
    """Rows, flagged rows, their rate and the mean score of each source, letter case aside."""
    return scored.groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.count("*").alias("n_rows"),
        F.count_if("abusive").alias("n_abusive"),
        F.avg(F.col("abusive").cast("double")).alias("rate"),
        F.avg("score").alias("mean_score"),
    )
