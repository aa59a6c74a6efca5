"""Filling fixed-capacity containers with items.

Sum-of-squares online packing. Documents are spread by a hash of their id over
shards; a shard keeps the number of open containers at each fill level in an
array and puts each item where the sum of the squared counts becomes smallest.
The containers that a shard leaves open are few; they go through a second
round as items of their own, over groups of shards, and are joined there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.tokens import WORD_PUNCT, size_column, size_reader
from threadmill.runtime import write_shared

#: Tokens that a shard packs, in containers. More make the open rest smaller
#: against the whole, fewer make more tasks.
SHARD_CONTAINERS = 4096
#: Shards whose open containers are joined by one task of the second round.
SHARDS_JOINED = 64


class LevelPacker:
    """Online packing by the sum-of-squares rule over integer fill levels."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        #: counts[h]: open containers filled to h; counts[0] and counts[capacity]
        #: stay 0, as neither an unused nor a full container counts.
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.used = 0

    def put(self, size: int) -> tuple[int, int]:
        """Place an item of 1..capacity tokens; the container and the item's offset in it."""
        room = self.capacity - size
        before, after = self.counts[: room + 1], self.counts[size:]
        # Moving a container from level h to h + size changes the sum of
        # squares by 2 * (N[h + size] - N[h] + 1); a new container starts at
        # h = 0 and takes nothing away, a full one adds nothing.
        change = 2 * (after - before) + 2
        change[0] = 2 * after[0] + 1 if room else 0
        if room:
            change[room] = 1 - 2 * before[room]
        change[1:][before[1:] == 0] = np.iinfo(np.int64).max
        # Of equal changes the fullest level, so that space is used up early.
        level = room - int(np.argmin(change[::-1]))
        if level == 0:
            box = self.used
            self.used += 1
        else:
            boxes = self.open[level]
            box = boxes.pop()
            self.counts[level] -= 1
        to = level + size
        if to < self.capacity:
            self.open.setdefault(to, []).append(box)
            self.counts[to] += 1
        return box, level

    def rest(self) -> Iterator[tuple[int, int]]:
        for level, boxes in self.open.items():
            for box in boxes:
                yield box, level


_ITEM = (
    "id long, piece int, pieces int, start_token long, tokens int, shard int, box long, "
    "offset int, fill int"
)


def _pack_shard(capacity: int, tokenizer: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        packer = LevelPacker(capacity)
        size_of = None if tokenizer == WORD_PUNCT else size_reader(tokenizer)
        for pdf in batches:
            rows = []
            sizes = pdf["size"] if size_of is None else pdf["text"].map(size_of, na_action="ignore")
            for doc, size in zip(pdf["id"].tolist(), sizes.tolist(), strict=True):
                size = int(size)
                if size <= 0:
                    rows.append((doc, 0, 0, 0, 0, part, -1, 0, -1))
                    continue
                pieces = -(-size // capacity)
                for k in range(pieces):
                    tokens = min(capacity, size - k * capacity)
                    box, offset = packer.put(tokens)
                    rows.append((doc, k, pieces, k * capacity, tokens, part, box, offset, -1))
            yield pd.DataFrame(rows, columns=_COLUMNS)
        rest = [(None, 0, 0, 0, 0, part, box, 0, fill) for box, fill in packer.rest()]
        if rest:
            yield pd.DataFrame(rest, columns=_COLUMNS)

    return run


_COLUMNS = [c.split()[0] for c in _ITEM.split(", ")]


def _join_rest(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = LevelPacker(capacity)
        part = TaskContext.get().partitionId()
        for batch in batches:
            shards, boxes, fills = (batch.column(i).to_pylist() for i in range(3))
            put = [packer.put(f) for f in fills]
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array(shards, pa.int32()),
                    "box": pa.array(boxes, pa.int64()),
                    "into": pa.array([f"r{part}-{b}" for b, _ in put]),
                    "shift": pa.array([o for _, o in put], pa.int32()),
                }
            )

    return run


def pack_documents(
    df: DataFrame,
    capacity: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = WORD_PUNCT,
    shard_containers: int = SHARD_CONTAINERS,
) -> DataFrame:
    """Documents placed in containers of ``capacity`` tokens.

    One row for each item: ``id, piece, pieces, start_token, tokens, container,
    offset``. A text that fits is one item and is never split; a larger one is
    cut into full containers and a rest. ``offset`` is the item's first token
    in its container.

    A null, empty or blank text has size 0: it needs no space and appears with
    ``pieces`` 0 and a null container. Repeated ids are placed each on their
    own; rows with a null id are placed too. An empty table gives an empty
    result; other columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    text = F.col(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    if tokenizer == WORD_PUNCT:
        rows = rows.select("id", size_column(F.col("text")).alias("size"))
        # Only ids and sizes move to the shards.
        rows = write_shared(rows, "sizes")
        total = rows.agg(F.sum("size")).first()[0] or 0
    else:
        total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, round(total / (capacity * shard_containers)))
    # Rows without an id are spread by their place in the table.
    spread = F.xxhash64("id", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    placed = rows.repartition(shards, spread).mapInPandas(
        _pack_shard(capacity, tokenizer), _ITEM
    )
    placed = write_shared(placed, "packed")
    rest = placed.where("fill >= 0").select("shard", "box", "fill")
    groups = max(1, -(-shards // SHARDS_JOINED))
    # Large fills first, so that small ones find their gaps.
    ordered = rest.repartition(groups, "shard").sortWithinPartitions(
        F.desc("fill"), "shard", "box"
    )
    joined = write_shared(
        ordered.mapInArrow(_join_rest(capacity), "shard int, box long, into string, shift int"),
        "joined",
    )
    name = F.when(F.col("box") >= 0, F.format_string("s%d-%d", "shard", "box"))
    return (
        placed.where("fill < 0")
        .join(joined, ["shard", "box"], "left")
        .select(
            "id",
            "piece",
            "pieces",
            "start_token",
            "tokens",
            F.coalesce("into", name).alias("container"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    )
