"""Mixing sources to target weights by iterative proportional fitting.

The tokens of each (source, language, topic) cell are counted; the cells are
raked to the target weights of the sources and to the natural shares of
languages and topics, under the cap that a document may be repeated. A cell's
weight over its tokens is the expected number of copies of its documents: the
whole part is taken of each, the fraction by a hash order within the cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from threadmill.llm.tokens import size_column
from threadmill.runtime import drop_shared, write_shared

#: Hash buckets of a cell, so that a cell with most documents is cut over tasks.
CELL_BUCKETS = 256
#: Cells that are raked on the driver; beyond it the same steps run on a table of cells.
DRIVER_CELLS = 200_000
ROUNDS = 200
#: Raking ends when no cell moves by more than this share of all tokens.
SETTLED = 1e-9
#: A source is short if its raked weight lacks more than this share of its target.
LACKING = 1e-12
_NONE = "(none)"


def rake(
    tokens: np.ndarray,
    source: np.ndarray,
    lang: np.ndarray,
    topic: np.ndarray,
    want: np.ndarray,
    cap: np.ndarray,
    rounds: int = ROUNDS,
    total: float | None = None,
) -> np.ndarray:
    """Token weights of the cells.

    ``want`` are the tokens asked of each source, ``cap`` the copies allowed.
    Each round rakes to topics, to languages and then to sources, and ends with
    the cap; what a capped cell lacks goes to the other cells of its source, so
    a source misses its target only if all its cells are at their cap.
    ``total`` are the tokens asked of all sources, those without a cell included.
    """
    weight, limit = tokens * np.minimum(1.0, cap), tokens * cap
    total = want.sum() if total is None else total
    goals = []
    for axis in (topic, lang):
        natural = np.bincount(axis, tokens)
        goals.append((axis, natural / max(natural.sum(), 1e-300) * total))
    for _ in range(rounds):
        old = weight
        for axis, goal in goals:
            have = np.bincount(axis, weight, len(goal))
            weight = weight * np.divide(goal, have, out=np.ones_like(goal), where=have > 0)[axis]
        weight = fill_sources(weight, source, want, limit)
        if np.abs(weight - old).max(initial=0.0) <= SETTLED * max(total, 1.0):
            break
    return weight


def fill_sources(weight: np.ndarray, source: np.ndarray, want: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Each source scaled by the factor at which its cells, cut to their limits, sum to its target.

    In the order of limit over weight the cells before some cell are at their
    limit and the others scaled; the first cell at which the factor that this
    gives does not exceed its own ratio is the right one. Without one all cells
    are at their limit.
    """
    ratio = np.divide(limit, weight, out=np.full_like(limit, np.inf), where=weight > 0)
    order = np.lexsort((ratio, source))
    s, w, room, r = source[order], weight[order], limit[order], ratio[order]
    start = np.searchsorted(s, s)
    before = lambda x: (c := np.concatenate([[0.0], np.cumsum(x)]))[:-1] - c[start]
    gap, rest = want[s] - before(room), np.bincount(source, weight, len(want))[s] - before(w)
    factor = np.divide(gap, rest, out=np.where(gap > 0, np.inf, 0.0), where=rest > 0)
    at = np.nonzero(factor <= r)[0]
    which, first = np.unique(s[at], return_index=True)
    best = np.full(len(want), np.inf)
    best[which] = np.maximum(factor[at[first]], 0.0)
    with np.errstate(invalid="ignore"):
        return np.where(np.isinf(best[source]), limit, np.minimum(limit, np.nan_to_num(best[source] * weight)))


def rake_table(cells: DataFrame, total: float, rounds: int = ROUNDS) -> DataFrame:
    """:func:`rake` on a table ``(source, lang, topic, tokens, want, cap)``; adds ``fitted``.

    Marginals are grouped sums, the factor of a source comes from windows over
    its cells; each round is written once and its largest change is observed.
    """
    pool = F.sum("tokens").over(Window.partitionBy())
    for axis in ("topic", "lang"):
        share = cells.groupBy(axis).agg(F.sum("tokens").alias("tokens"))
        goal = share.select(axis, (F.col("tokens") / pool * total).alias(f"{axis}_goal"))
        cells = cells.join(goal, axis)
    limit = F.col("tokens") * F.col("cap")
    cells = cells.withColumns({"limit": limit, "fitted": F.col("tokens") * F.least(F.lit(1.0), F.col("cap"))})
    table = write_shared(cells, "cells")
    for _ in range(rounds):
        step = table.withColumn("old", F.col("fitted"))
        for axis in ("topic", "lang"):
            have = step.groupBy(axis).agg(F.sum("fitted").alias("have"))
            factor = F.when(F.col("have") > 0, F.col(f"{axis}_goal") / F.col("have")).otherwise(1.0)
            step = step.join(have, axis).withColumn("fitted", F.col("fitted") * factor).drop("have")
        ratio = F.when(F.col("fitted") > 0, F.col("limit") / F.col("fitted")).otherwise(float("inf"))
        step = step.withColumn("ratio", ratio)
        own = Window.partitionBy("source")
        rising = own.orderBy("ratio", "lang", "topic")
        past = rising.rowsBetween(Window.unboundedPreceding, -1)
        gap = F.col("want") - F.coalesce(F.sum("limit").over(past), F.lit(0.0))
        rest = F.sum("fitted").over(own) - F.coalesce(F.sum("fitted").over(past), F.lit(0.0))
        factor = F.when(rest > 0, gap / rest).when(gap > 0, float("inf")).otherwise(0.0)
        step = step.withColumns({"factor": factor, "at": F.row_number().over(rising)})
        first = F.min(F.when(F.col("factor") <= F.col("ratio"), F.struct("at", "factor"))).over(own)
        best = F.greatest(first["factor"], F.lit(0.0))
        filled = F.when(first.isNull() | (best == float("inf")), F.col("limit")).otherwise(F.least("limit", best * F.col("fitted")))
        seen = Observation()
        step = step.withColumn("fitted", filled).observe(seen, F.max(F.abs(F.col("fitted") - F.col("old"))).alias("moved"))
        after = write_shared(step.select(*table.columns), "cells")
        drop_shared(table)
        table = after
        if (seen.get["moved"] or 0.0) <= SETTLED * max(total, 1.0):
            break
    return table.select("source", "lang", "topic", "tokens", "fitted")


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str):
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.col(lang_col), F.lit(_NONE)).alias("lang"),
        F.coalesce(F.col(topic_col), F.lit(_NONE)).alias("topic"),
        size_column(F.col(text_col)).alias("tokens"),
    )


def mix_sources(
    df: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_col: str = "kind",
    driver_cells: int = DRIVER_CELLS,
) -> tuple[DataFrame, DataFrame]:
    """Copies of each document in the mix, and the shares reached.

    ``targets`` has ``source, target_weight, max_repeat``. The first result is
    ``(id, source, tokens, copies)`` for documents with at least one copy; the
    second has, for each target source, the tokens there are, asked, raked and
    reached, the share asked and reached, the copies allowed and needed, and
    ``short``: whether the raking could not give the source its target, all its
    cells being at their cap.

    ``total_tokens`` defaults to the tokens of all documents of the target
    sources. Documents whose source is null or not a target take no part; a
    target source without documents has 0 tokens and is short unless its weight
    is 0. Null weights count 0, null or lower than one repeats count 1, a source
    named twice has its weights added and its largest repeat. Documents of size
    0 take no part. Null languages and topics are classes of their own. Up to
    ``driver_cells`` cells are raked in memory, more as a table. An empty table
    gives an empty mix and a report of zeros.
    """
    spark = df.sparkSession
    goal = (
        targets.where("source is not null")
        .groupBy("source")
        .agg(
            F.sum(F.coalesce("target_weight", F.lit(0.0))).alias("target_weight"),
            F.greatest(F.max("max_repeat"), F.lit(1)).cast("long").alias("max_repeat"),
        )
    )
    cell = ["source", "lang", "topic"]
    rows = _sized(df, id_col, text_col, source_col, lang_col, topic_col).where("tokens > 0")
    rows = write_shared(rows.join(goal.select("source"), "source", "left_semi"), "sized")
    cells = write_shared(rows.groupBy(*cell).agg(F.sum("tokens").alias("tokens")), "cells")
    size = cells.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    total = float(total_tokens if total_tokens is not None else size.tokens)
    weights = goal.agg(F.sum("target_weight")).first()[0] or 0.0
    asked = goal.withColumn("want", F.col("target_weight") / max(weights, 1e-300) * total)
    problem = cells.join(asked, "source").select(*cell, F.col("tokens").cast("double").alias("tokens"), "want", F.col("max_repeat").cast("double").alias("cap"))
    fitted = "source string, lang string, topic string, tokens double, fitted double"
    if size.n <= driver_cells:
        pdf = problem.toPandas()
        plan = spark.createDataFrame(list(_raked(pdf, total if weights else 0.0).itertuples(index=False, name=None)), fitted)
    else:
        plan = rake_table(problem, total)
    # Tokens before a document in hash order of its cell: bucket offsets plus
    # a running sum within the bucket. The cell's rate comes along with them.
    bucket = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(CELL_BUCKETS)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    held = rows.groupBy(*cell, "bucket").agg(F.sum("tokens").alias("held"))
    earlier = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rates = plan.select(*cell, (F.col("fitted") / F.col("tokens")).alias("rate"), F.col("tokens").alias("cell_tokens"))
    offset = held.select(
        *cell, "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset")
    ).join(rates, cell)
    inside = (
        Window.partitionBy(*cell, "bucket")
        .orderBy(F.xxhash64("id", F.lit(seed + 1)), "id", "tokens")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    lead = F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    drawn = rows.withColumn("lead", lead).join(offset, [*cell, "bucket"])
    whole = F.floor("rate")
    start = F.col("offset") + F.col("lead") + F.col("tokens") / 2
    extra = (start < (F.col("rate") - whole) * F.col("cell_tokens")).cast("long")
    picked = write_shared(
        drawn.select("id", "source", "tokens", (whole + extra).cast("long").alias("copies")).where(
            "copies > 0"
        ),
        "mix",
    )
    given = plan.groupBy("source").agg(F.sum("tokens").cast("long").alias("tokens"), F.sum("fitted").alias("tokens_raked"))
    got = picked.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_reached"),
        F.max("copies").alias("most_copies"),
        F.count("*").alias("documents"),
    )
    report = asked.withColumnRenamed("want", "tokens_asked").join(given, "source", "left").join(got, "source", "left")
    report = report.na.fill(0, ["tokens", "tokens_raked", "tokens_reached", "most_copies", "documents"])
    share = F.try_divide(F.col("tokens_reached"), F.sum("tokens_reached").over(Window.partitionBy()))
    return picked, report.withColumns(
        {
            "short": F.col("tokens_raked") < F.col("tokens_asked") * (1 - LACKING),
            "share_reached": F.coalesce(share.cast("double"), F.lit(0.0)),
        }
    )


def _raked(cells: pd.DataFrame, total: float) -> pd.DataFrame:
    """The cells with their weights."""
    if len(cells):
        codes = [np.unique(cells[a].to_numpy(str), return_inverse=True)[1] for a in ("source", "lang", "topic")]
        want = np.zeros(codes[0].max() + 1)
        want[codes[0]] = cells["want"]
        tokens = cells["tokens"].to_numpy(float)
        fitted = rake(tokens, *codes, want, cells["cap"].to_numpy(float), total=total)
    else:
        fitted = np.zeros(0)
    return cells.assign(fitted=fitted)[["source", "lang", "topic", "tokens", "fitted"]]
