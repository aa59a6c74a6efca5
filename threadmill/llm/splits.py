"""Splits that keep related records together.

Rows are tied by author within a community, by post within a community, and by
being the same record. Components of tied rows are bundled by identical size
and label profile. One min-cost flow sends all bundles to the splits, whose
quotas are rows: a bundle's proportional share is free, what lies beyond it
costs its deviation. The flow is found by its prices, one for each split, and
rounded to whole components; members of a bundle are then picked by hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.components import connected_components
from threadmill.llm.records import same_records
from threadmill.runtime import write_shared

#: Bundles that are solved on the driver at most. With more, label profiles are
#: told apart in coarser steps until they fit; sizes are never merged.
MAX_BUNDLES = 500_000
#: Hash buckets of a bundle. Ranks are exact within a bucket and buckets are
#: offset by their counts, so a bundle that holds most components is ranked by
#: many tasks.
RANK_BUCKETS = 512


def _known_author(author: Column) -> Column:
    name = F.lower(F.trim(author))
    return F.when(~name.isin("", "[deleted]"), name)


def _bare_post(link: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(link)), "^t3_", ""), F.lit(""))


def tied_groups(
    df: DataFrame,
    id_col: str = "sample_id",
    community_col: str = "subreddit",
    author_col: str = "author",
    link_col: str = "link_id",
    text_col: str = "body",
) -> DataFrame:
    """``(id, first_id)`` for each row: the smallest id of its component.

    Communities, authors and posts are compared regardless of letter case and
    posts regardless of a ``t3_`` prefix. A null community ties nothing by
    author or post; null, blank and ``[deleted]`` authors and null or blank
    posts tie nothing. Texts tie as in :func:`records.same_records`. A row with
    a null id is left out; repeated ids stay repeated and share a component.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.lower(F.trim(community_col)).alias("community"),
        _known_author(F.col(author_col)).alias("author"),
        _bare_post(F.col(link_col)).alias("post"),
    ).where("id is not null")
    keys = F.array_compact(
        F.array(
            F.when(
                F.col("author").isNotNull(), F.struct(F.lit("a").alias("tie"), F.col("author").alias("name"))
            ),
            F.when(F.col("post").isNotNull(), F.struct(F.lit("p").alias("tie"), F.col("post").alias("name"))),
        )
    )
    keyed = write_shared(
        rows.where("community is not null").select("id", "community", F.inline(keys)), "ties"
    )
    # Minimum by key with map-side combine, then back by an equi-join that AQE
    # may cut where one author or post holds a large share of the rows.
    firsts = (
        keyed.groupBy("community", "tie", "name")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first < last")
    )
    links = keyed.join(firsts, ["community", "tie", "name"]).select(
        F.col("id").alias("u"), F.col("first").alias("v")
    )
    records = same_records(df, id_col, text_col).select(
        F.col("id").alias("u"), F.col("first_id").alias("v")
    )
    roots = connected_components(links.unionAll(records))
    return rows.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("root", "id").alias("first_id")
    )


def _spread(*parts: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that look random and depend on the parts only."""
    x = np.zeros(np.broadcast_shapes(*[p.shape for p in parts]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            x = (x ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)) / float(1 << 53)


def flow_prices(cost: np.ndarray, size: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Prices of the splits at which each unit's cheapest split gives the rows asked for.

    ``cost[u, k]`` is what a row of unit ``u`` costs in split ``k``. These are
    the dual prices of the min-cost flow: with them a unit goes where cost and
    price are lowest. The smoothed dual, in which a unit is shared out by how
    little a split costs it, is solved for ever less smoothing; its steps
    raise the price of a split that gets too much.
    """
    price = np.where(demand > 0, 0.0, 1e6)
    goal = np.maximum(demand, 1e-9) / np.maximum(demand, 1e-9).sum() * size.sum()
    for level in range(13):
        heat = 0.5**level
        for _ in range(40):
            z = -(cost + price) / heat
            part = np.exp(z - z.max(axis=1, keepdims=True))
            part /= part.sum(axis=1, keepdims=True)
            load = size @ part
            price = price + heat * np.log(np.maximum(load, 1e-12) / goal)
            if np.abs(load - goal).max() <= 1e-6 * goal.sum():
                break
    return price


def allocate(bundles: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Bundles ``(size, removed, approved, count)`` to the components of each that every split gets.

    A bundle's whole proportional share is free, so it goes first. The few
    components left of each bundle, fewer than there are splits, are units of
    the flow: a row of one costs the part of a component by which its split
    exceeds the proportional share, and a little that depends on the bundle and
    the split only, so that equal costs are spread. At the flow's prices each
    unit takes its cheapest split; :func:`even_out` rounds.
    """
    size, count = bundles[:, 0].astype(np.int64), bundles[:, 3].astype(np.int64)
    kinds, quota = len(shares), shares * float((size * count).sum())
    want = count[:, None] * shares
    if not len(bundles):
        return np.zeros((0, kinds), np.int64)
    flow = np.floor(want + 1e-9).astype(np.int64)
    rest = want - flow
    left = count - flow.sum(axis=1)
    unit = np.repeat(np.arange(len(size)), left)
    if not len(unit):
        return even_out(flow, size, quota, want)
    turn = np.arange(len(unit)) - np.repeat(np.cumsum(left) - left, left)
    rows = size[unit].astype(float)
    noise = _spread(*[bundles[unit, j][:, None] for j in range(3)], turn[:, None], np.arange(kinds)[None, :])
    cost = 1 - rest[unit] + noise
    demand = quota - (flow * size[:, None]).sum(axis=0)
    price = flow_prices(cost, rows, np.maximum(demand, 0.0))
    to = (cost + price).argmin(axis=1)
    np.add.at(flow, (unit, to), 1)
    return even_out(flow, size, quota, want)


def even_out(flow: np.ndarray, size: np.ndarray, quota: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Whole components moved between splits until no single move brings the rows nearer to the quotas.

    What a split has too much, as when one component is larger than the rest
    allows for, is first taken from all bundles in proportion, then one
    component at a time, where it helps most and deviates least.
    """
    flow, kinds = flow.copy(), len(quota)
    for _ in range(2 * kinds):
        over = size @ flow - quota
        k, j = int(over.argmax()), int(over.argmin())
        rows = min(over[k], -over[j])
        held = np.where(size <= rows, flow[:, k], 0)
        if not held.any():
            break
        moved = np.floor(held * min(1.0, rows / (held @ size))).astype(np.int64)
        flow[:, k] -= moved
        flow[:, j] += moved
    over = size @ flow - quota
    for _ in range(64 * kinds):
        gain = np.full((kinds, kinds, len(size)), np.inf)
        for k in range(kinds):
            for j in range(kinds):
                if j != k:
                    change = np.abs(over[k] - size) + np.abs(over[j] + size) - abs(over[k]) - abs(over[j])
                    gain[k, j] = np.where(flow[:, k] > 0, change, np.inf)
        best = gain.min()
        if best > -1e-9:
            break
        k, j, u = np.nonzero(gain <= best + 1e-9)
        deviation = (want[u, k] - flow[u, k]) + (flow[u, j] - want[u, j])
        at = int(deviation.argmin())
        k, j, u = k[at], j[at], u[at]
        flow[u, k] -= 1
        flow[u, j] += 1
        over[k] -= size[u]
        over[j] += size[u]
    return flow


def assign_splits(
    df: DataFrame,
    targets: list[tuple[str, float]],
    label_col: str = "label",
    id_col: str = "sample_id",
    seed: int = 42,
    max_bundles: int = MAX_BUNDLES,
    **cols: str,
) -> DataFrame:
    """``(id, first_id, split)``: every row with its component and split.

    All rows of a component land in one split. ``targets`` are the splits and
    their shares, scaled to a sum of one; null or negative shares are an error.
    Labels other than ``removed`` and ``approved``, and nulls, count as a third
    kind. The bundle table that is solved on the driver has one row for each
    distinct (size, label profile), about N**(2/3) of N rows at most; if that
    is more than ``max_bundles``, label profiles are bundled in coarser steps.
    An empty table gives an empty result.
    """
    if not targets or any(s is None or s < 0 for _, s in targets) or sum(s for _, s in targets) <= 0:
        raise ValueError("targets need non-negative shares with a positive sum")
    total = sum(s for _, s in targets)
    names, shares = [t[0] for t in targets], [t[1] / total for t in targets]
    groups = tied_groups(df, id_col=id_col, **cols)
    labels = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).where(
        "id is not null"
    )
    labels = labels.groupBy("id").agg(
        F.count_if(F.col("label") == "removed").alias("r"),
        F.count_if(F.col("label") == "approved").alias("a"),
        F.count("*").alias("n"),
    )
    placed = write_shared(
        groups.distinct().join(labels, "id").select("id", "first_id", "n", "r", "a"), "groups"
    )
    comps = placed.groupBy("first_id").agg(
        F.sum("n").alias("size"), F.sum("r").alias("removed"), F.sum("a").alias("approved")
    )
    bucket = F.pmod(F.xxhash64("first_id", F.lit(seed)), F.lit(RANK_BUCKETS)).cast("int")
    profile = ["size", "removed", "approved"]
    comps = write_shared(comps.withColumn("bucket", bucket), "bundles")
    spark, step = df.sparkSession, 1
    while True:
        told = lambda c: F.floor(F.col(c) / step) * step
        comps = comps.withColumns({c: told(c) for c in ("removed", "approved")})
        counts = comps.groupBy(*profile).agg(F.count("*").alias("count"))
        bundles = counts.limit(max_bundles + 1).toPandas()
        if len(bundles) <= max_bundles:
            break
        step *= 4
        if step > 1 << 62:
            raise ValueError(f"more than {max_bundles} distinct sizes of components")
    bundles = bundles.sort_values(profile)
    upto = allocate(bundles.to_numpy(np.int64), np.array(shares)).cumsum(axis=1)
    bound_cols = [f"upto{k}" for k in range(len(names))]
    schema = ", ".join(f"{c} long" for c in profile + bound_cols)
    limits = spark.createDataFrame(np.hstack([bundles[profile].to_numpy(np.int64), upto]).tolist(), schema)
    held = comps.groupBy(*profile, "bucket").agg(F.count("*").alias("held"))
    before = F.sum("held").over(
        Window.partitionBy(*profile).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = held.select(*profile, "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(
        Window.partitionBy(*profile, "bucket").orderBy(F.xxhash64("first_id", F.lit(seed + 1)), "first_id")
    )
    ranked = comps.withColumn("within", within).join(offsets.join(limits, profile), [*profile, "bucket"])
    rank = F.col("offset") + F.col("within")
    split = F.coalesce(
        *[F.when(rank <= F.col(c), F.lit(n)) for c, n in zip(bound_cols, names, strict=True)]
    )
    chosen = ranked.select("first_id", split.alias("split"))
    return groups.join(chosen, "first_id").select("id", "first_id", "split")
