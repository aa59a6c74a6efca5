"""Agreement statistics of two rule-based models over demo_sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.functions.text import word_count
from threadmill.operators import evaluate, threshold
from threadmill.plans import sqltext as S
from threadmill.plans.registry import query
from threadmill.runtime import read_table


def predictions(spark, sf):
    """One model answers by length, the other by exclamation marks; no body, no answer."""
    demo = read_table(spark, sf, "demo_sample")
    body, words = F.col("body"), word_count(F.col("body"))
    return demo.select(
        F.col("sample_id").alias("id"), F.col("id").alias("comment"), F.lower("subreddit").alias("subreddit"), "label", "body", "post_title",
        "is_top_level", "parent_body", "account_age_days",
        F.when(body.isNull(), "unparseable").when(words <= 45, "True").otherwise("False").alias("prediction"),
        F.when(body.isNull(), "unparseable").when(body.contains("!"), "True").otherwise("False").alias("pred_b"),
        F.when(body.isNotNull(), F.lit(1.0) / (words + 1)).alias("confidence"),
    )


def flagship(spark, sf):
    """Length baseline by community: fitted on the training split, measured on the test split."""
    demo = read_table(spark, sf, "demo_sample").where("subreddit is not null and label is not null")
    rows = demo.withColumns({"subreddit": F.lower("subreddit"), "n_words": word_count(F.col("body"))})
    return threshold.length_baseline(
        rows.where("split = 'train'"), rows.where("split = 'test'"), ["subreddit"], F.col("n_words")
    )


_FIT = f"""d AS (SELECT lower(subreddit) AS subreddit, label, split, {S.words('body')} AS n_words FROM demo_sample
  WHERE subreddit IS NOT NULL AND label IS NOT NULL),
hist AS (SELECT subreddit, n_words AS len, count(*) FILTER (label = 'removed') AS p, count(*) FILTER (label <> 'removed') AS n
  FROM d WHERE split = 'train' GROUP BY subreddit, n_words),
steps AS (SELECT subreddit, len + 1 AS threshold, sum(p) OVER w AS pb, sum(n) OVER w AS nb,
  sum(p) OVER (PARTITION BY subreddit) AS pa, sum(n) OVER (PARTITION BY subreddit) AS na FROM hist
  WINDOW w AS (PARTITION BY subreddit ORDER BY len)
  UNION ALL SELECT subreddit, 1, 0, 0, sum(p), sum(n) FROM hist GROUP BY subreddit HAVING min(len) + 1 > 1),
cand AS (SELECT subreddit, threshold, 0 AS rank, 'short_is_removed' AS direction, pb AS tp, nb AS fp, na - nb AS tn, pa - pb AS fn FROM steps
  UNION ALL SELECT subreddit, threshold, 1, 'long_is_removed', pa - pb, na - nb, nb, pb FROM steps),
fit AS (SELECT * FROM (SELECT *, {S.STATS['balanced_accuracy']} AS bal_acc, row_number() OVER (PARTITION BY subreddit ORDER BY
  {S.STATS['balanced_accuracy']} DESC, rank, threshold) AS r FROM cand) WHERE r = 1)"""


@query(f"""WITH {_FIT} SELECT subreddit, CAST(threshold AS BIGINT) AS threshold, direction, bal_acc, CAST(tp AS BIGINT) AS tp,
  CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn FROM fit""")
def threshold_fit(spark, sf):
    demo = read_table(spark, sf, "demo_sample").where("subreddit is not null and label is not null and split = 'train'")
    rows = demo.withColumn("subreddit", F.lower("subreddit"))
    return threshold.fit_threshold(
        threshold.length_histogram(rows, ["subreddit"], word_count(F.col("body"))), ["subreddit"]
    )


@query(f"""WITH {_FIT}, t AS (SELECT d.*, CASE WHEN (f.direction = 'short_is_removed' AND n_words < f.threshold)
  OR (f.direction = 'long_is_removed' AND n_words >= f.threshold) THEN 'True' ELSE 'False' END AS prediction
  FROM d JOIN fit f ON d.subreddit = f.subreddit WHERE split = 'test'),
c AS ({S.cells(source='t')})
SELECT c.*, {S.stats()}, CAST(f.threshold AS BIGINT) AS threshold, f.direction FROM c JOIN (SELECT subreddit, threshold, direction FROM fit) f
  ON c.subreddit = f.subreddit""".replace("SELECT c.*", "SELECT c.subreddit, c.tp, c.fp, c.tn, c.fn, c.unparseable"))
def threshold_length_baseline(spark, sf):
    return flagship(spark, sf)


_AUC_CELLS = """k AS (SELECT subreddit, confidence AS c, count(*) FILTER (coalesce(label = 'removed', false)) AS p,
  count(*) FILTER (NOT coalesce(label = 'removed', false)) AS n FROM pred WHERE confidence IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {S.PRED} {S.cells()}")
def metric_confusion(spark, sf):
    return evaluate.confusion(predictions(spark, sf), ["subreddit"])


@query(f"""WITH {S.PRED}, q AS (SELECT subreddit, label, CASE prediction WHEN 'False' THEN 'maybe' ELSE prediction END AS p FROM pred)
SELECT subreddit, count(*) FILTER (p = 'True' AND coalesce(label = 'removed', false)) AS tp,
  count(*) FILTER (p = 'True' AND NOT coalesce(label = 'removed', false)) AS fp,
  count(*) FILTER (p = 'maybe' AND NOT coalesce(label = 'removed', false)) AS tn,
  count(*) FILTER (p = 'maybe' AND coalesce(label = 'removed', false)) AS fn,
  count(*) FILTER (p = 'unparseable') AS unparseable FROM q GROUP BY subreddit""")
def metric_confusion_loose(spark, sf):
    text = F.when(F.col("prediction") == "False", "maybe").otherwise(F.col("prediction"))
    return evaluate.confusion(predictions(spark, sf).withColumn("prediction", text), ["subreddit"], strict=False)


@query(f"WITH {S.PRED}, c AS ({S.cells()}) SELECT *, {S.stats()} FROM c")
def metric_scores(spark, sf):
    return evaluate.scores(predictions(spark, sf), ["subreddit"])


@query(f"""WITH {S.PRED}, c AS ({S.cells()}), {_AUC_CELLS}, r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY subreddit ORDER BY c
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM k),
a AS (SELECT subreddit, round(CAST(sum(p * (u * 2 + n)) AS DOUBLE) / nullif(CAST(sum(p) * sum(n) * 2 AS DOUBLE), 0), 4) AS auroc FROM r GROUP BY 1),
s AS (SELECT *, tp + fp + tn + fn AS total_evaluated, {S.stats(['f1', 'precision', 'recall', 'accuracy', 'kappa'])} FROM c)
SELECT s.subreddit, tp, fp, tn, fn, unparseable, total_evaluated, total_evaluated + unparseable AS total_attempted, round(f1, 4) AS f1,
  round("precision", 4) AS "precision", round(recall, 4) AS recall, round(accuracy, 4) AS accuracy, round(kappa, 4) AS kappa, auroc,
  true AS f1_inside, true AS precision_inside, true AS recall_inside, true AS accuracy_inside
FROM s JOIN a ON s.subreddit IS NOT DISTINCT FROM a.subreddit""")
def metric_bundle(spark, sf):
    """The whole bundle; of its drawn intervals, whether they hold the value itself and are no wider than six deviations."""
    got = evaluate.metric_bundle(predictions(spark, sf), ["subreddit"])
    n = F.greatest(F.col("total_evaluated"), F.lit(1))
    of = {"f1": F.greatest(F.least(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")), F.lit(1)), "accuracy": n,
          "precision": F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), "recall": F.greatest(F.col("tp") + F.col("fn"), F.lit(1))}
    for m, size in of.items():
        low, high = F.col(f"{m}_low"), F.col(f"{m}_high")
        inside = (low <= F.col(m)) & (F.col(m) <= high) & (high - low <= F.least(F.lit(1.0), 4 / F.sqrt(size)))
        got = got.withColumn(f"{m}_inside", inside).drop(f"{m}_low", f"{m}_high")
    return got


@query(f"""WITH {S.PRED}, c AS ({S.cells()}), m AS (SELECT {S.stats(['accuracy', 'f1', 'kappa'])} FROM c)
SELECT round(avg(accuracy), 9) AS accuracy, round(avg(f1), 9) AS f1, round(avg(kappa), 9) AS kappa FROM m""")
def metric_macro_means(spark, sf):
    names = ["accuracy", "f1", "kappa"]
    got = evaluate.macro_means(evaluate.scores(predictions(spark, sf), ["subreddit"], names), names)
    return got.select(*[F.round(n, 9).alias(n) for n in names])


@query(f"""WITH {S.PRED}, {_AUC_CELLS}, r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY subreddit ORDER BY c
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM k)
SELECT subreddit, CAST(sum(p * (u * 2 + n)) AS DOUBLE) / nullif(CAST(sum(p) * sum(n) * 2 AS DOUBLE), 0) AS auroc FROM r GROUP BY subreddit""")
def metric_auroc(spark, sf):
    return evaluate.auroc(predictions(spark, sf), ["subreddit"])


@query(f"""WITH {S.PRED}, {_AUC_CELLS} SELECT subreddit, c AS threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp
FROM k WINDOW w AS (PARTITION BY subreddit ORDER BY c DESC)""")
def metric_roc_curve(spark, sf):
    return evaluate.roc_curve(predictions(spark, sf), ["subreddit"])


@query(f"""WITH {S.PRED}, x AS (SELECT *, coalesce(label = 'removed', false) AS pos FROM pred WHERE confidence IS NOT NULL),
y AS (SELECT *, sum(CAST(pos AS BIGINT)) OVER (PARTITION BY subreddit ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING) AS t FROM x)
SELECT subreddit, CASE WHEN count(*) >= 10 THEN CAST(sum(CASE WHEN pos THEN 0 ELSE t END) AS DOUBLE)
  / nullif(CAST(count(*) FILTER (pos) * count(*) FILTER (NOT pos) AS DOUBLE), 0) END AS auroc FROM y GROUP BY subreddit""")
def metric_auroc_by_rows(spark, sf):
    return evaluate.auroc_by_rows(predictions(spark, sf), ["subreddit"], "id")


@query(f"""WITH {S.PRED} SELECT subreddit, round(avg(confidence), 9) AS mean, min(confidence) AS min, max(confidence) AS max,
  count(confidence) AS n FROM pred GROUP BY subreddit""")
def metric_confidence_stats(spark, sf):
    got = evaluate.confidence_stats(predictions(spark, sf), ["subreddit"])
    return got.withColumn("mean", F.round("mean", 9))


_MCN = f"""WITH {S.PRED}, l AS (SELECT p.* FROM pred p JOIN (SELECT id AS comment, max(sample_id) AS id FROM demo_sample WHERE id IS NOT NULL
  GROUP BY 1) d ON p.id = d.id), w AS (SELECT subreddit, prediction = CASE WHEN label = 'removed' THEN 'True' ELSE 'False' END AS a,
  pred_b = CASE WHEN label = 'removed' THEN 'True' ELSE 'False' END AS b FROM l),
m AS (SELECT subreddit, count(*) AS n, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c FROM w GROUP BY subreddit),
x AS (SELECT *, coalesce(pow(abs(b - c) - 1.0::DOUBLE, 2) / nullif(CAST(b + c AS DOUBLE), 0), 0.0) AS chi2 FROM m)"""


def _mcnemar(spark, sf):
    """Redelivered comments come twice; the last row of a comment counts."""
    pred = predictions(spark, sf)
    b = pred.select("comment", "id", F.col("pred_b").alias("prediction"))
    return evaluate.mcnemar(evaluate.paired(pred, b, "id", "comment", ("subreddit",)), ["subreddit"])


@query(f"{_MCN} SELECT *, chi2 > 3.841458820694124 AS significant_05, chi2 > 6.634896601021213 AS significant_01 FROM x")
def metric_mcnemar(spark, sf):
    return _mcnemar(spark, sf)


@query(f"""{_MCN} SELECT x.*, chi2 > 3.841458820694124 AS significant_05, chi2 > 6.634896601021213 AS significant_01,
  round(CASE WHEN chi2 > 0 THEN tail ELSE 1.0 END, 6) AS p_value FROM x,
  -- erf(z) for z = sqrt(chi2 / 2): 2 / sqrt(pi) * exp(-z^2) * sum of 2^k z^(2k+1) / (2k+1)!!, all terms positive
  LATERAL (SELECT 1 - 2 / sqrt(pi()) * sum(exp((2 * k + 1) * ln(greatest(sqrt(chi2 / 2), 1e-300)) + 2 * k * ln(2) + lgamma(k + 1)
    - lgamma(2 * k + 2) - chi2 / 2)) AS tail
    FROM range(0, 3000) r(k))""")
def metric_chi_square_tail(spark, sf):
    return evaluate.chi_square_tail(_mcnemar(spark, sf)).withColumn("p_value", F.round("p_value", 6))


@query(f"""WITH {S.PRED} SELECT subreddit, CAST(count(*) FILTER (prediction = 'True') AS DOUBLE) / count(*) AS share_true, count(*) AS n
FROM pred GROUP BY subreddit""")
def metric_predicted_shares(spark, sf):
    return evaluate.predicted_shares(predictions(spark, sf), ["subreddit"])


@query(f"""WITH {S.PRED}, h AS (SELECT subreddit, label, CAST(least(floor(confidence * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM pred
  WHERE confidence BETWEEN 0 AND 1 AND label IN ('removed', 'approved') GROUP BY 1, 2, 3),
d AS (SELECT *, n * 40.0::DOUBLE / sum(n) OVER (PARTITION BY subreddit, label) AS density FROM h)
SELECT *, density / max(density) OVER (PARTITION BY subreddit) * 0.7::DOUBLE AS height FROM d""")
def metric_histogram(spark, sf):
    return evaluate.density_histogram(predictions(spark, sf), "subreddit")


@query(f"""WITH {S.PRED}, c AS ({S.cells()}), m AS (SELECT {S.stats(['f1'])} FROM c)
SELECT percentile_cont(0.025) WITHIN GROUP (ORDER BY f1) AS low, percentile_cont(0.5) WITHIN GROUP (ORDER BY f1) AS mid,
  percentile_cont(0.975) WITHIN GROUP (ORDER BY f1) AS high, round(stddev_pop(f1), 9) AS std FROM m""")
def metric_percentiles(spark, sf):
    got = evaluate.scores(predictions(spark, sf), ["subreddit"], ["f1"])
    return got.agg(
        F.percentile("f1", 0.025).alias("low"), F.percentile("f1", 0.5).alias("mid"), F.percentile("f1", 0.975).alias("high"),
        F.round(F.stddev_pop("f1"), 9).alias("std"),
    )


@query(f"""WITH {S.PRED}, m AS (SELECT d.sample_id, p.label, p.prediction, lower(d.subreddit) AS subreddit, d.post_title, d.is_top_level, d.parent_body,
  d.account_age_days, c.condition FROM demo_sample d JOIN pred p ON d.sample_id = p.id,
  (VALUES ('baseline'), ('post_metadata'), ('structural'), ('author_history'), ('all_masked')) c(condition))
SELECT sample_id AS id, condition, CASE WHEN condition IN ('post_metadata', 'all_masked') THEN '' ELSE post_title END AS post_title,
  CASE WHEN condition IN ('structural', 'all_masked') THEN false ELSE is_top_level END AS is_top_level,
  CASE WHEN condition IN ('structural', 'all_masked') THEN '' ELSE parent_body END AS parent_body,
  CASE WHEN condition IN ('author_history', 'all_masked') THEN -1.0 ELSE account_age_days END AS account_age_days FROM m""")
def ablation_masks(spark, sf):
    got = evaluate.mask_features(predictions(spark, sf))
    return got.select("id", "condition", "post_title", "is_top_level", "parent_body", "account_age_days")


_ABL = f"""WITH {S.PRED}, a AS (SELECT d.sample_id AS id, p.label, c.condition,
  CASE WHEN coalesce(CASE WHEN c.condition IN ('structural', 'all_masked') THEN '' ELSE d.parent_body END, '') <> '' THEN 'True' ELSE 'False' END AS prediction
  FROM demo_sample d JOIN pred p ON d.sample_id = p.id,
  (VALUES ('baseline'), ('post_metadata'), ('structural'), ('author_history'), ('all_masked')) c(condition)),
s AS (SELECT condition, {S.stats(['accuracy', 'f1'])} FROM ({S.cells('condition', source='a')}))
SELECT s.condition, s.accuracy, s.f1, s.accuracy - b.accuracy AS accuracy_delta, s.f1 - b.f1 AS f1_delta
FROM s, s b WHERE b.condition = 'baseline'"""


@query(_ABL)
def ablation_table(spark, sf):
    masked = evaluate.mask_features(predictions(spark, sf))
    parent = F.coalesce("parent_body", F.lit("")) != ""
    scored = masked.withColumn("prediction", F.when(parent, "True").otherwise("False"))
    table = evaluate.scores(scored, ["condition"], ["accuracy", "f1"]).select("condition", "accuracy", "f1")
    return evaluate.ablation_table(table, "condition", ["accuracy", "f1"], [])


_GROUPED = f"""WITH {S.PRED}, g AS (SELECT coalesce(subreddit, '?') AS subreddit, label, prediction FROM pred WHERE label IS NOT NULL),
c AS (SELECT subreddit, label, count(*) FILTER (prediction = 'True') AS yes, count(*) AS n FROM g GROUP BY ROLLUP (subreddit, label))
SELECT subreddit, label, yes, n FROM c"""


@query(_GROUPED)
def report_rollup(spark, sf):
    rows = predictions(spark, sf).where("label is not null").withColumn("subreddit", F.coalesce("subreddit", F.lit("?")))
    return rows.rollup("subreddit", "label").agg(
        F.count_if(F.col("prediction") == "True").alias("yes"), F.count("*").alias("n")
    )
