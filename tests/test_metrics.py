import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadmill.functions import metrics as M
from threadmill.operators import evaluate, resample, threshold

# Published confusion counts and the accuracy, F1 and kappa that belong to them.
GOLDEN = [
    ((823, 228, 766, 183), (0.7945, 0.8002, 0.5889)),
    ((405, 122, 391, 142), (0.7509, 0.7542, 0.5020)),
    ((774, 221, 773, 232), (0.7735, 0.7736, 0.5470)),
    ((739, 256, 738, 267), (0.7385, 0.7386, 0.4770)),
    ((843, 215, 779, 163), (0.8110, 0.8169, 0.6219)),
    ((869, 162, 832, 137), (0.8505, 0.8532, 0.7009)),
    ((592, 144, 609, 174), (0.7907, 0.7883, 0.5814)),
]
CELLS = "tp long, fp long, tn long, fn long"


def stats(spark, rows):
    return spark.createDataFrame(rows, CELLS).select("tp", *M.statistics()).collect()


def test_published_statistics(spark):
    got = {r.tp: r for r in stats(spark, [c for c, _ in GOLDEN])}
    for cells, (acc, f1, kappa) in GOLDEN:
        r = got[cells[0]]
        assert (round(r.accuracy, 4), round(r.f1, 4), round(r.kappa, 4)) == pytest.approx((acc, f1, kappa), abs=1.01e-4)


def test_degenerate_cells(spark):
    empty, one, wrong = stats(spark, [(0, 0, 0, 0), (5, 0, 0, 0), (0, 3, 0, 4)])
    assert empty.kappa == 0 and empty.accuracy == 0 and one.kappa == 1.0 and wrong.f1 == 0 and wrong.macro_f1 == 0


def predictions(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "id": range(n), "g": rng.integers(0, 3, n).astype(str), "label": rng.choice(["removed", "approved"], n),
        "prediction": rng.choice(["True", "False", "unparseable"], n, p=[0.4, 0.5, 0.1]), "confidence": rng.integers(0, 20, n) / 20,
    })
    return spark.createDataFrame(pdf), pdf


def test_auroc_against_pairs(spark):
    df, pdf = predictions(spark)
    got = {r.g: r.auroc for r in evaluate.auroc(df, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        p = part.confidence[part.label == "removed"].to_numpy()[:, None]
        n = part.confidence[part.label == "approved"].to_numpy()[None]
        assert got[g] == pytest.approx(((p > n) + 0.5 * (p == n)).mean())
    single = df.where("label = 'removed'")
    assert all(r.auroc is None for r in evaluate.auroc(single, ["g"]).collect())


def test_kappa_is_symmetric(spark):
    a, b = stats(spark, [(7, 2, 11, 5), (8, 5, 11, 2)])
    flipped = stats(spark, [(7, 5, 11, 2)])[0]
    assert a.kappa == pytest.approx(flipped.kappa) and b.kappa != a.kappa


def test_mcnemar_and_tail(spark):
    rows = [("removed", "True", "False")] * 10 + [("approved", "True", "False")] * 4 + [("removed", "x", "x")]
    pairs = spark.createDataFrame([("g", *r) for r in rows], "g string, label string, pred_a string, pred_b string")
    r = evaluate.chi_square_tail(evaluate.mcnemar(pairs, ["g"])).first()
    assert (r.b, r.c) == (10, 4) and r.chi2 == pytest.approx(25 / 14)
    assert r.p_value == pytest.approx(math.erfc(math.sqrt(25 / 28))) and not r.significant_05
    none = evaluate.chi_square_tail(evaluate.mcnemar(pairs.where("pred_a = 'x'"), ["g"])).first()
    assert none.chi2 == 0 and none.p_value == 1 and not none.significant_01


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["removed", "approved"])), min_size=2, max_size=40))
def test_threshold_against_full_sweep(spark, rows):
    df = spark.createDataFrame([("g", n, label) for n, label in rows], "g string, n long, label string")
    got = threshold.fit_threshold(threshold.length_histogram(df, ["g"], F.col("n")), ["g"]).first()
    p, n = sum(x == "removed" for _, x in rows), sum(x == "approved" for _, x in rows)
    best = None
    for d in (0, 1):
        for t in range(1, max(x for x, _ in rows) + 2):
            says = [(x < t) if d == 0 else (x >= t) for x, _ in rows]
            tp = sum(s and label == "removed" for s, (_, label) in zip(says, rows, strict=True))
            tn = sum(not s and label == "approved" for s, (_, label) in zip(says, rows, strict=True))
            value = ((tp / p if p else 0.0) + (tn / n if n else 0.0)) / 2
            if best is None or value > best[0] + 1e-12:
                best = (value, t, threshold.DIRECTIONS[d])
    assert got.bal_acc == pytest.approx(best[0]) and (got.threshold, got.direction) == best[1:]


def test_resample_sizes_and_intervals(spark):
    df, _ = predictions(spark, 900)
    cells = evaluate.confusion(df, ["g"])
    ci = resample.bootstrap_ci(cells, ["g"], ["f1", "kappa"], runs=300)
    point = {r.g: r for r in evaluate.scores(df, ["g"]).collect()}
    for r in ci.collect():
        assert r.ci_low <= point[r.g][r.metric] <= r.ci_high
    golden = spark.createDataFrame([("c", 843, 215, 779, 163, 0, 0, 0.01)],
                                   "g string, tp long, fp long, tn long, fn long, removed_unparseable long, approved_unparseable long, rate double")
    drawn = resample.prevalence_cells(golden, ["g"], "rate", 50)
    assert {r.size for r in drawn.select("size").distinct().collect()} == {1004}
    again = resample.prevalence_cells(golden.repartition(3), ["g"], "rate", 50)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))


def test_index_percentile(spark):
    df = spark.createDataFrame([([float(x) for x in range(100, 0, -1)],)], "v array<double>")
    low = resample.index_percentile(F.col("v"), 0.025, False)
    high = resample.index_percentile(F.col("v"), 0.975, True)
    assert tuple(df.select(low, high).first()) == (3.0, 98.0)


def test_auroc_interval(spark):
    rng = np.random.default_rng(7)
    rows = [("a", "removed" if y else "approved", round(float(rng.normal(y)), 1)) for y in rng.integers(0, 2, 300).tolist()]
    rows += [("b", "removed", 0.5), ("b", "removed", 0.7), ("a", "removed", None), ("d", None, 0.1)]
    df = spark.createDataFrame(rows, "g string, label string, confidence double")
    got = {r.g: r for r in resample.auroc_ci(df, ["g"]).collect()}
    assert got["b"].mean is None and got["b"].low is None and got["b"].high is None and got["d"].high is None
    # Drawn by rows, with another generator: the bounds agree but for chance.
    y, x = (np.array([r[k] for r in rows[:300]]) for k in (1, 2))
    values = []
    for _ in range(1000):
        at = rng.integers(0, 300, 300)
        p, n = x[at][y[at] == "removed"], x[at][y[at] != "removed"]
        values.append(((p[:, None] > n).mean() + 0.5 * (p[:, None] == n).mean()))
    values.sort()
    assert abs(got["a"].low - values[25]) < 0.015 and abs(got["a"].high - values[974]) < 0.015
    assert abs(got["a"].mean - np.mean(values)) < 0.005
    again = {r.g: r for r in resample.auroc_ci(df.repartition(3), ["g"]).collect()}
    assert again == got


def test_registered_auroc_interval_is_no_range_of_few_resamples(spark, sf):
    from threadmill.plans import QUERIES
    from threadmill.plans.metric_queries import predictions

    pred = predictions(spark, sf).where("subreddit is not null").select("subreddit", "label", "confidence")
    key = lambda r: r.subreddit
    want = sorted(resample.auroc_ci(pred, ["subreddit"], runs=1000).collect(), key=key)
    assert sorted(QUERIES["bootstrap_auroc"](spark, sf).collect(), key=key) == want
