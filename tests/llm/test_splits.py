import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.llm.splits import allocate, assign_splits, flow_prices, tied_groups

SCHEMA = "sample_id long, subreddit string, author string, link_id string, body string, label string"
TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def table(spark, n=600, seed=0):
    rng = random.Random(seed)
    rows = [
        (
            i, rng.choice(["A", "a", "B", None]), rng.choice(["hot", None, "[deleted]", "Hot", *[f"u{j}" for j in range(400)]]),
            rng.choice(["t3_", ""]) + f"p{rng.randrange(900)}", rng.choice([None, "", f"some longer body text number {i} here"]),
            rng.choice(["removed", "approved", "approved", None]),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_ties(spark):
    rows = [
        (9, "Sub", "Ann", "t3_x1", "short", None), (4, "sub", "ANN", "x2", "short", None),
        (7, "SUB", None, "X2", "a body that is long enough to count", None),
        (2, "other", "zed", "q", "A Body: that is LONG enough to count!", None),
        (1, None, "Ann", "x1", None, None), (3, "sub", "[deleted]", None, "", None), (5, "sub", None, "", None, None),
    ]
    got = {r.id: r.first_id for r in tied_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {9: 2, 4: 2, 7: 2, 2: 2, 1: 1, 3: 3, 5: 5}


def test_groups_stay_together_near_targets(spark):
    df, rows = table(spark)
    got = assign_splits(df, TARGETS).collect()
    assert len(got) == len(rows)
    split_of = defaultdict(set)
    for r in got:
        split_of[r.first_id].add(r.split)
    assert all(len(s) == 1 and None not in s for s in split_of.values())
    share = lambda s: sum(r.split == s for r in got) / len(got)
    assert abs(share("validation") - 0.1) < 0.02 and abs(share("test") - 0.1) < 0.02
    again = {r.id: r.split for r in assign_splits(df.repartition(7), TARGETS).collect()}
    assert again == {r.id: r.split for r in got}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert assign_splits(empty, TARGETS).collect() == []
    df, _ = table(spark, 20)
    assert {r.split for r in assign_splits(df, [("only", 3.0)]).collect()} == {"only"}
    with pytest.raises(ValueError):
        assign_splits(df, [("a", -1.0), ("b", 1.0)])
    twice = df.unionAll(df).selectExpr("*", "1 AS first_id", "'x' AS split")
    got = assign_splits(twice, TARGETS).collect()
    assert len(got) == 40
    for i in {r.id for r in got}:
        assert len({r.split for r in got if r.id == i}) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 3), st.integers(0, 3), st.integers(1, 3)), min_size=1, max_size=4, unique_by=lambda b: b[:3]), st.sampled_from([(0.8, 0.1, 0.1), (0.5, 0.5), (1.0,), (0.6, 0.4)]))
def test_flow_is_whole_and_near_its_quotas(bundles, shares):
    b, shares = np.array(bundles), np.array(shares)
    flow = allocate(b, shares)
    assert (flow.sum(axis=1) == b[:, 3]).all() and (flow >= 0).all()
    rows = (flow * b[:, :1]).sum(axis=0)
    quota = shares * (b[:, 0] * b[:, 3]).sum()
    off = np.abs(rows - quota).sum()
    # No single unit can be moved to come nearer.
    for i, (size, *_) in enumerate(bundles):
        for k in range(len(shares)):
            for j in range(len(shares)):
                if j != k and flow[i, k] > 0:
                    moved = rows.copy()
                    moved[k] -= size
                    moved[j] += size
                    assert np.abs(moved - quota).sum() >= off - 1e-6


def test_prices_give_the_cheapest_flow():
    """With units of one row the rounded flow costs what the best of all assignments costs."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        cost, demand = rng.random((7, 3)), np.array([3.0, 2.0, 2.0])
        to = (cost + flow_prices(cost, np.ones(7), demand)).argmin(axis=1)
        best = min(
            cost[np.arange(7), p].sum() for p in set(itertools.permutations([0, 0, 0, 1, 1, 2, 2]))
        )
        assert (np.bincount(to, minlength=3) == demand).all() and cost[np.arange(7), to].sum() <= best + 1e-9


def test_coarser_profiles_when_there_are_many_bundles(spark):
    df, rows = table(spark)
    got = assign_splits(df, TARGETS, max_bundles=12).collect()
    assert len(got) == len(rows)
    share = lambda s: sum(r.split == s for r in got) / len(got)
    assert abs(share("validation") - 0.1) < 0.01 and abs(share("test") - 0.1) < 0.01


def test_large_groups_are_made_up_for_by_small_ones():
    bundles = [(500, 0, 500, 1), (40, 10, 30, 3), (1, 1, 0, 150), (1, 0, 1, 230)]
    flow = allocate(np.array(bundles), np.array([0.8, 0.1, 0.1]))
    rows = (flow * np.array(bundles)[:, :1]).sum(axis=0).tolist()
    assert sum(rows) == 1000 and abs(rows[0] - 800) <= 1 and abs(rows[1] - 100) <= 1
