"""Bootstrap and prevalence resampling on confusion cells.

The statistics depend on the five cells only, so a resample of n rows with
replacement is one multinomial draw over the cells, and a resample at a given
prevalence one hypergeometric draw: same distribution, cost independent of n.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions import metrics as M
from threadmill.functions.draws import md5_draws, spans
from threadmill.operators.ordered import even_buckets, running_totals
from threadmill.operators.sampling import drawn_ranks

CELLS = ("tp", "fp", "tn", "fn")

# Of bootstrap_counts: rows in a piece, resamples in a task, bytes of pieces held in it, positions drawn at once.
PIECE, RUNS_IN_TASK, HELD, STEP = 8192, 25, 64_000_000, 2048


def _seeded(*parts) -> np.random.Generator:
    import hashlib

    digest = hashlib.md5("|".join(map(str, parts)).encode()).digest()
    return np.random.default_rng(np.frombuffer(digest, np.uint32))


def bootstrap_cells(cells: DataFrame, by: list[str], runs: int = 2000, seed: int = 42) -> DataFrame:
    """``runs`` resampled confusion counts of each group."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in by)

    def replicate(pdfs):
        for pdf in pdfs:
            for row in pdf.to_dict("records"):
                counts = np.array([row[c] for c in (*CELLS, "unparseable")], np.int64)
                n = int(counts.sum())
                rng = _seeded(seed, *[row[k] for k in by])
                got = rng.multinomial(n, counts / n, runs) if n else np.zeros((runs, 5), np.int64)
                out = pd.DataFrame(got[:, :4], columns=list(CELLS)).assign(run=range(runs), **{k: row[k] for k in by})
                yield out[[*by, "run", *CELLS]]

    return cells.select(*by, *CELLS, "unparseable").mapInPandas(
        replicate, f"{schema}, run int, " + ", ".join(f"{c} long" for c in CELLS)
    )


def index_percentile(values: Column, share: float, upper: bool) -> Column:
    """Bound of a sorted list at ``floor(share * n)`` or ``ceil(share * n) - 1``, clamped."""
    ordered, n = F.array_sort(values), F.size(values)
    at = F.ceil(n * F.lit(share) - 1e-9) - 1 if upper else F.floor(n * F.lit(share) + 1e-9)
    return F.element_at(ordered, (F.greatest(F.lit(0), F.least(at, n - 1)) + 1).cast("int"))


def bootstrap_ci(
    cells: DataFrame, by: list[str], names: list[str], runs: int = 2000, level: float = 0.95, seed: int = 42
) -> DataFrame:
    """``(group, metric, ci_low, ci_high)``; statistics are rounded to four digits first.
    A group's list has ``runs`` values, a fixed number."""
    drawn = bootstrap_cells(cells, by, runs, seed).select(*by, *M.statistics(names, 4))
    long = drawn.unpivot(by, names, "metric", "value")
    tail = (1 - level) / 2
    return long.groupBy(*by, "metric").agg(F.collect_list("value").alias("v")).select(
        *by, "metric", index_percentile(F.col("v"), tail, False).alias("ci_low"),
        index_percentile(F.col("v"), 1 - tail, True).alias("ci_high"),
    )


def bootstrap_by_rows(
    df: DataFrame, by: list[str], order: str, runs: int, statistic: Callable[[DataFrame, list[str]], DataFrame], seed: int = 42
) -> DataFrame:
    """Resamples of rows for statistics that are no function of the cells, such as AUROC.

    Rows are numbered by ``order``, a number. Row i of a group is drawn as often as a replicate's hashes name it: each
    (replicate, position) hashes to an index, and indexes meet rows by an
    equi-join. ``statistic`` gets the resampled table and its keys.
    """
    ranked = running_totals(even_buckets(df, by, order), by, [order], {"_i": F.lit(1)})
    ranked = ranked.withColumnRenamed("_i_all", "_n")
    draws = ranked.select(*by, "_n", "_i", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "run", "_i")), 1, 13), 16, 10).cast("long")
    draws = draws.select(*by, "run", (F.pmod(pick, "_n") + 1).alias("_i"))
    # The draws are ``runs`` times the rows, which the planner's estimate does not see: no broadcast.
    return statistic(draws.hint("merge").join(ranked.drop("_n"), [*by, "_i"]), [*by, "run"])


def bootstrap_counts(df: DataFrame, by: list[str], order: str, runs: int, kinds: dict[str, Column], seed: int = 42) -> DataFrame:
    """``(group, run, <kind>...)``: how many rows of each kind the resamples of :func:`bootstrap_by_rows` draw.

    For statistics of such counts. The draws are the same, every one is made,
    but no resampled row is: a row is one letter, for the first of ``kinds``
    that holds, and a task draws from the letters of its resamples' groups. A
    draw depends on replicate and position, so groups share it. Letters beyond
    ``HELD`` are read in turns, each of which takes the draws that fall in it.
    """
    if len(kinds) > 64:
        raise ValueError("more than 64 kinds")
    kind = F.coalesce(*[F.when(holds, F.lit(k)) for k, holds in enumerate(kinds.values())], F.lit(len(kinds)))
    rows = df.select(*by, order, F.char(kind + 48).alias("_kind"))
    ranked = running_totals(even_buckets(rows, by, order), by, [order], {"_i": F.lit(1)})
    pieces = ranked.groupBy(*by, F.floor((F.col("_i") - 1) / PIECE).alias("_piece")).agg(
        F.max("_i_all").alias("_n"), F.expr("listagg(_kind, '') WITHIN GROUP (ORDER BY _i)").cast("binary").alias("_kinds")
    )
    blocks = -(-runs // RUNS_IN_TASK)
    # A block of resamples is a task; its pieces come in the order of their groups.
    sent = pieces.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartitionById(blocks, "_block")
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema]
    return sent.sortWithinPartitions("_block", *by, "_piece").select(*by, "_block", "_piece", "_n", "_kinds").mapInArrow(
        _counter(by, list(kinds), runs, seed), ", ".join([*schema, "run int", *[f"`{k}` long" for k in kinds]])
    )


def _counter(by: list[str], kinds: list[str], runs: int, seed: int) -> Callable:
    """Draws for the sorted pieces of a partition, see :func:`bootstrap_counts`."""
    # Counts of five kinds are summed in one number, in 12 bits each: STEP draws at most.
    weights = np.zeros((-(-len(kinds) // 5), 256), np.uint64)
    for k in range(len(kinds)):
        weights[k // 5, 48 + k] = 1 << 12 * (k % 5)

    def draw(groups: list[dict], first: int, last: int) -> None:
        for g in groups:
            g["letters"] = np.frombuffer(b"".join([*g.pop("held"), b"\0"]), np.uint8)  # the last stands for all others
        for positions in spans(1, max(g["n"] for g in groups), STEP):
            groups = [g for g in groups if g["n"] >= positions[0]]
            for block in spans(first, last, RUNS_IN_TASK):
                draws, at = md5_draws(seed, block, positions), slice(block[0] - first, block[-1] - first + 1)
                for g in groups:
                    own = draws[:, : g["n"] - int(positions[0]) + 1] % np.uint64(g["n"])
                    if len(g["letters"]) <= g["n"]:
                        own -= np.uint64(g["from"])  # what lies before becomes very large
                        np.minimum(own, np.uint64(len(g["letters"]) - 1), out=own)
                    letters = g["letters"].take(own.view(np.int64))
                    for w, weight in enumerate(weights):
                        sums = weight.take(letters).sum(axis=1)
                        for k in range(5 * w, min(5 * w + 5, len(kinds))):
                            g["counts"][k, at] += (sums >> np.uint64(12 * (k % 5)) & np.uint64(4095)).astype(np.int64)

    def result(groups: list[dict], first: int, last: int, fields: list[pa.Field]) -> pa.RecordBatch:
        own = np.repeat(np.arange(len(groups)), last - first + 1)
        keys = [pa.array([g["key"][k] for g in groups], f.type).take(pa.array(own)) for k, f in enumerate(fields)]
        run = pa.array(np.tile(np.arange(first, last + 1, dtype=np.int32), len(groups)))
        counts = [pa.array(np.concatenate([g["counts"][k] for g in groups])) for k in range(len(kinds))]
        return pa.RecordBatch.from_arrays([*keys, run, *counts], names=[*by, "run", *kinds])

    def count(batches):
        groups, size, now, first, last, fields = [], 0, None, 0, 0, []

        def turn(whole: bool):
            """Draws for the pieces held; a group of which more may follow keeps its counts."""
            nonlocal groups, size
            if groups:
                draw(groups, first, last)
                done, open_ = (groups, []) if whole else (groups[:-1], groups[-1:])
                for lo in range(0, len(done), 256):
                    yield result(done[lo : lo + 256], first, last, fields)
                groups = [g | {"from": g["from"] + len(g["letters"]) - 1, "held": []} for g in open_]
                size = 0

        for batch in batches:
            fields = [batch.schema.field(k) for k in by]
            keys = list(zip(*[batch.column(k).to_pylist() for k in by], strict=True))
            rest = (batch.column(k).to_pylist() for k in ("_block", "_piece", "_n", "_kinds"))
            for key, block, at, n, letters in zip(keys, *rest, strict=True):
                if block != now:
                    yield from turn(True)
                    now, first, last = block, block * RUNS_IN_TASK + 1, min(runs, (block + 1) * RUNS_IN_TASK)
                elif size > HELD:
                    yield from turn(at == 0)
                if at == 0:
                    counts = np.zeros((len(kinds), last - first + 1), np.int64)
                    groups.append({"key": key, "n": n, "from": 0, "held": [], "counts": counts})
                    size += 1000 + counts.nbytes
                groups[-1]["held"].append(letters)
                size += len(letters)
        yield from turn(True)

    return count


def auroc_ci(
    df: DataFrame, by: list[str], runs: int = 1000, level: float = 0.95, seed: int = 42, confidence: str = "confidence"
) -> DataFrame:
    """``(group, mean, low, high)`` of the AUROC of ``runs`` resamples, ties averaged.

    A resample of rows is one multinomial draw over the group's (confidence,
    label) cells. Values are rounded to four digits for the bounds; resamples
    of one class have no AUROC and are left out.
    """
    positive = F.coalesce(F.col("label") == "removed", F.lit(False))
    cells = (
        df.where(F.col(confidence).isNotNull())
        .groupBy(*by, F.col(confidence).cast("double").alias("c"))
        .agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in by)

    def replicate(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        counts = np.concatenate([pdf["p"].to_numpy(), pdf["n"].to_numpy()])
        n, rng, values = int(counts.sum()), _seeded(seed, *key), []
        step = max(1, 4_000_000 // len(counts))
        for lo in range(0, runs, step):
            got = rng.multinomial(n, counts / n, min(step, runs - lo))
            pos, neg = got[:, : len(pdf)], got[:, len(pdf) :]
            area = (pos * (2 * np.cumsum(neg, axis=1) - neg)).sum(axis=1)
            pairs = 2.0 * pos.sum(axis=1) * neg.sum(axis=1)
            values.append(np.divide(area, pairs, out=np.full(len(got), np.nan), where=pairs > 0))
        value = np.concatenate(values)
        out = pd.DataFrame({"run": range(runs), "auroc": pd.array(value, "Float64")})
        out.loc[np.isnan(value), "auroc"] = pd.NA
        return out.assign(**dict(zip(by, key, strict=True)))[[*by, "run", "auroc"]]

    # A group's cells are its distinct scores by label; its list has ``runs`` values at most.
    drawn = cells.groupBy(*by).applyInPandas(replicate, f"{schema}, run int, auroc double")
    tail = (1 - level) / 2
    got = drawn.groupBy(*by).agg(F.avg("auroc").alias("mean"), F.collect_list(F.round("auroc", 4)).alias("v"))
    bound = lambda share, upper: F.when(F.size("v") > 0, index_percentile(F.col("v"), share, upper))
    return got.select(*by, "mean", bound(tail, False).alias("low"), bound(1 - tail, True).alias("high"))


def removed_to_keep(approved: Column, removed: Column, rate: Column) -> Column:
    """Removed rows in a resample at a rate: half to even, at least one, at most all."""
    want = F.bround(rate * approved / (1.0 - rate)).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.least(want, removed))


def prevalence_sample(df: DataFrame, by: list[str], key: str, rate: Column | float, run: int = 0, seed: int = 42) -> DataFrame:
    """All approved rows and a sample of the removed ones; the group unchanged if a class is
    empty or the rate is not between 0 and 1."""
    rate = F.lit(rate) if isinstance(rate, float) else rate
    removed = F.coalesce(F.col("label") == "removed", F.lit(False))
    sizes = df.groupBy(*by).agg(F.count_if(removed).alias("_r"), F.count_if(~removed).alias("_a"))
    ranked = drawn_ranks(df.withColumn("_removed", removed), [*by, "_removed"], key, seed, f"rate{run}")
    ranked = ranked.withColumnRenamed("_r", "_k").drop("_r_all").join(sizes, by)
    whole = (F.col("_r") == 0) | (F.col("_a") == 0) | (rate <= 0) | (rate >= 1)
    most = F.when(whole, F.col("_r")).otherwise(removed_to_keep(F.col("_a"), F.col("_r"), rate))
    return ranked.where(~F.col("_removed") | (F.col("_k") <= most)).drop("_removed", "_k", "_r", "_a")


def prevalence_cells(cells: DataFrame, by: list[str], rate: str, runs: int, seed: int = 42) -> DataFrame:
    """Confusion counts of ``runs`` resamples of each row of ``cells`` at the rate in its column.

    ``cells`` has the confusion counts and ``removed_unparseable`` and
    ``approved_unparseable``; all groups and rates go in one job.
    """
    keys = [*by, rate]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in keys)

    def replicate(pdfs):
        for pdf in pdfs:
            for row in pdf.to_dict("records"):
                tp, fp, tn, fn = (int(row[c]) for c in CELLS)
                ru, au = int(row["removed_unparseable"]), int(row["approved_unparseable"])
                r, a, p = tp + fn + ru, fp + tn + au, float(row[rate])
                keep = r if not r or not a or not 0 < p < 1 else max(1, min(round(p * a / (1 - p)), r))
                rng = _seeded(seed, *[row[k] for k in keys])
                got = rng.multivariate_hypergeometric([tp, fn, ru], keep, runs) if r else np.zeros((runs, 3), np.int64)
                out = pd.DataFrame({"tp": got[:, 0], "fp": fp, "tn": tn, "fn": got[:, 1], "size": a + keep, "run": range(runs)})
                yield out.assign(**{k: row[k] for k in keys})[[*keys, "run", *CELLS, "size"]]

    return cells.mapInPandas(replicate, f"{schema}, run int, tp long, fp long, tn long, fn long, size long")


def prevalence_summary(replicates: DataFrame, keys: list[str], names: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean, population deviation, linear percentiles of each statistic, and the mean size."""
    long = replicates.select(*keys, "size", *M.statistics(names)).unpivot([*keys, "size"], names, "metric", "value")
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.percentile("value", low).alias("ci_low"), F.percentile("value", high).alias("ci_high"),
        F.avg("size").alias("mean_size"),
    )


def paired_delta(pairs: DataFrame, by: list[str], runs: int = 1000, seed: int = 42) -> DataFrame:
    """Difference of kappas of two models with its bootstrap interval.

    The joint cells (label, first, second) are drawn, so pairs stay paired; an
    interval that excludes 0 is ``robust``.
    """
    code = lambda c: F.when(F.col(c) == "True", 1).when(F.col(c) == "False", 0).otherwise(2)
    y = F.when(F.col("label") == "removed", 1).otherwise(0)
    joint = pairs.groupBy(*by, (y * 9 + code("pred_a") * 3 + code("pred_b")).alias("cell")).agg(F.count("*").alias("n"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name in by)

    def kappa(counts: np.ndarray, model: int) -> np.ndarray:
        cube = counts.reshape(-1, 2, 3, 3).sum(axis=3 if model == 0 else 2)[:, :, :2].astype(float)
        n = np.maximum(cube.sum(axis=(1, 2)), 1)
        po = (cube[:, 1, 1] + cube[:, 0, 0]) / n
        pe = (cube[:, 1].sum(1) * cube[:, :, 1].sum(1) + cube[:, 0].sum(1) * cube[:, :, 0].sum(1)) / n**2
        return np.where(pe == 1, 1.0, (po - pe) / np.where(pe == 1, 1, 1 - pe))

    def delta(key, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(18, np.int64)
        counts[pdf["cell"].to_numpy()] = pdf["n"].to_numpy()
        n = int(counts.sum())
        got = _seeded(seed, *key).multinomial(n, counts / n, runs)
        d = kappa(got, 0) - kappa(got, 1)
        lo, hi = np.percentile(d, [2.5, 97.5])
        point = float((kappa(counts[None], 0) - kappa(counts[None], 1))[0])
        out = pd.DataFrame({"delta": [point], "ci_low": [lo], "ci_high": [hi], "robust": [bool(lo > 0 or hi < 0)]})
        return out.assign(**dict(zip(by, key, strict=True)))[[*by, "delta", "ci_low", "ci_high", "robust"]]

    # A group has at most 18 rows.
    return joint.groupBy(*by).applyInPandas(delta, f"{schema}, delta double, ci_low double, ci_high double, robust boolean")
