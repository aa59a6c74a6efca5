"""Duplicates hidden by formatting differences.

Canonical records are range-partitioned by ``(key, id)``, sorted externally by
the exchange's sort and scanned once: adjacent rows with the same full key form
a run. A key that holds a large share of all rows is cut over several
partitions, because the id is part of the range; the runs that touch a
partition border are joined again from one small row for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.canonical import MIN_LETTERS, field_key, letters
from threadmill.llm.components import connected_components
from threadmill.runtime import drop_shared, write_shared

_RUN_SCHEMA = "key_kind int, id long, head long, part int, run int, border_key string"


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal keys; ``head`` is the first id of the run so far.

    The key itself leaves the scan only where a border row needs it: on the
    first row of a partition and on one closing row with a null id.
    """
    part = TaskContext.get().partitionId()
    last_key, last_kind, head, run = None, 0, None, -1
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        keys, kinds = batch.column(0), batch.column(1).to_numpy()
        ids = batch.column(2).to_numpy()
        fresh = np.ones(n, bool)
        if n > 1:
            fresh[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(
                zero_copy_only=False
            )
        opening = run < 0
        fresh[0] = opening or keys[0].as_py() != last_key
        runs = run + np.cumsum(fresh)
        at = np.where(fresh, np.arange(n), -1)
        np.maximum.accumulate(at, out=at)
        heads = np.where(at >= 0, ids[np.maximum(at, 0)], -1 if head is None else head)
        border = [None] * n
        if opening:
            border[0] = keys[0].as_py()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kinds, pa.int32()),
                pa.array(ids, pa.int64()),
                pa.array(heads, pa.int64()),
                pa.array(np.full(n, part, np.int32)),
                pa.array(runs.astype(np.int32)),
                pa.array(border, pa.string()),
            ],
            ["key_kind", "id", "head", "part", "run", "border_key"],
        )
        last_key, last_kind, head, run = keys[n - 1].as_py(), kinds[-1], heads[-1], int(runs[-1])
    if run >= 0:
        yield pa.RecordBatch.from_pydict(
            {
                "key_kind": pa.array([last_kind], pa.int32()),
                "id": pa.array([None], pa.int64()),
                "head": pa.array([head], pa.int64()),
                "part": pa.array([part], pa.int32()),
                "run": pa.array([run], pa.int32()),
                "border_key": pa.array([last_key], pa.string()),
            }
        )


def sorted_runs(keyed: DataFrame) -> DataFrame:
    """``(key, key_kind, id)`` to ``(key_kind, id, first_id)``, the smallest id of each key.

    The keys are written once, since the exchange reads them twice: for a
    sample that sets the ranges, and to move them.
    """
    keyed = write_shared(keyed.select("key", "key_kind", "id"), "keys")
    ranged = keyed.repartitionByRange("key", "id")
    scanned = write_shared(
        ranged.sortWithinPartitions("key", "id").mapInArrow(_scan_runs, _RUN_SCHEMA), "runs"
    )
    drop_shared(keyed)
    # One row for each partition: its first key, last key and the id that opens
    # its last run. A chain of partitions that lie within one run takes the
    # opening id of the partition where the run began.
    ends = scanned.where(F.col("border_key").isNotNull()).groupBy("part").agg(
        F.max(F.when(F.col("id").isNotNull(), F.col("border_key"))).alias("first_key"),
        F.max(F.when(F.col("id").isNull(), F.col("border_key"))).alias("last_key"),
        F.max(F.when(F.col("id").isNull(), F.col("run"))).alias("last_run"),
        F.max(F.when(F.col("id").isNull(), F.col("head"))).alias("last_head"),
    )
    order = Window.orderBy("part")
    carried = F.lag("last_key").over(order) == F.col("first_key")
    linked = ends.withColumn("carried", F.coalesce(carried, F.lit(False)))
    opens = F.when(~F.col("carried") | (F.col("last_run") > 0), F.col("last_head"))
    linked = linked.withColumn("open_head", F.last(opens, ignorenulls=True).over(order))
    linked = linked.withColumn("before", F.lag("open_head").over(order))
    borders = linked.where("carried").select("part", F.lit(0).alias("run"), "before")
    return (
        scanned.where(F.col("id").isNotNull())
        .join(F.broadcast(borders), ["part", "run"], "left")
        .select("key_kind", "id", F.coalesce("before", "head").alias("first_id"))
    )


def same_records(
    df: DataFrame, id_col: str = "sample_id", text_col: str = "body", min_letters: int = MIN_LETTERS
) -> DataFrame:
    """One row ``(id, first_id)`` for each record that counts.

    Two records are the same when their letters and digits agree, letter case
    and everything else aside, or when both consist of labelled fields only and
    have the same fields in any order. Sameness carries over. ``first_id`` is
    the smallest id of the group, ``id`` itself for a record without copies.

    Null, empty and short texts (fewer than ``min_letters`` letters and digits)
    and rows with a null id have no row in the result. Repeated ids are kept as
    repeated rows. An empty table gives an empty result. Other columns of
    ``df`` are not read, whatever their names.
    """
    text = F.col(text_col)
    rows = (
        df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
        .where(F.col("id").isNotNull() & (F.length("text") >= min_letters))
        .select("id", letters(F.col("text")).alias("flat"), field_key(F.col("text")).alias("fields"))
        .where(F.length("flat") >= min_letters)
    )
    # A record of labelled fields enters twice, once under each of its keys.
    keys = F.array_compact(
        F.array(
            F.struct(F.lit(1).alias("key_kind"), F.concat(F.lit("1"), F.col("flat")).alias("key")),
            F.when(
                F.col("fields").isNotNull(),
                F.struct(
                    F.lit(2).alias("key_kind"), F.concat(F.lit("2"), F.col("fields")).alias("key")
                ),
            ),
        )
    )
    firsts = sorted_runs(rows.select("id", F.inline(keys)))
    flat = firsts.where("key_kind = 1").select("id", "first_id")
    by_fields = firsts.where("key_kind = 2").select("id", F.col("first_id").alias("field_first"))
    # Only the groups that field order connects need a component search.
    bridges = (
        by_fields.join(flat, "id")
        .where("first_id <> field_first")
        .select(F.col("first_id").alias("u"), F.col("field_first").alias("v"))
        .distinct()
    )
    roots = connected_components(bridges)
    return flat.join(
        roots.select(F.col("node").alias("first_id"), "root"), "first_id", "left"
    ).select("id", F.coalesce("root", "first_id").alias("first_id"))


def collapsed_records(
    df: DataFrame, id_col: str = "sample_id", text_col: str = "body", min_letters: int = MIN_LETTERS
) -> DataFrame:
    """The representative of each group of same records: ``(first_id, copies, text)``.

    ``text`` is that of the record with the smallest id; where rows repeat that
    id with several texts, the smallest of those that count.
    """
    groups = same_records(df, id_col, text_col, min_letters).groupBy("first_id").agg(F.count("*").alias("copies"))
    texts = (
        df.select(F.col(id_col).cast("long").alias("first_id"), F.col(text_col).alias("text"))
        .where(F.length(letters(F.col("text"))) >= min_letters)
        .join(groups, "first_id", "left_semi")
        .groupBy("first_id")
        .agg(F.min("text").alias("text"))
    )
    return groups.join(texts, "first_id")
