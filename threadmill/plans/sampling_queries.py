"""Deterministic samples, splits and resamples."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.operators import evaluate, resample, sampling
from threadmill.plans import sqltext as S
from threadmill.plans.metric_queries import predictions
from threadmill.plans.registry import query
from threadmill.runtime import read_table


def _draw(key: str, tag: str) -> str:
    return f"md5('42{tag}|' || CAST({key} AS VARCHAR))"


@query(f"""SELECT sample_id, CASE WHEN r <= floor(n * 0.8::DOUBLE + 1e-9) THEN 'train' ELSE 'test' END AS part FROM (
  SELECT sample_id, row_number() OVER (PARTITION BY s ORDER BY {_draw('sample_id', 'split')}, sample_id) AS r,
  count(*) OVER (PARTITION BY s) AS n FROM (SELECT *, lower(subreddit) AS s FROM demo_sample WHERE subreddit IS NOT NULL))""")
def split_random(spark, sf):
    demo = read_table(spark, sf, "demo_sample").where("subreddit is not null")
    rows = demo.select("sample_id", F.lower("subreddit").alias("s"))
    return sampling.random_split(rows, "s", "sample_id").select("sample_id", F.col("split").alias("part"))


@query(f"""WITH d AS (SELECT sample_id, lower(subreddit) AS s, coalesce(nullif(author, ''), 'unknown') AS a FROM demo_sample WHERE subreddit IS NOT NULL),
t AS (SELECT s, a, count(*) AS c FROM d GROUP BY s, a),
f AS (SELECT s, a, coalesce(sum(c) OVER (PARTITION BY s ORDER BY {_draw('a', 'author')}, a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(c) OVER (PARTITION BY s) AS n FROM t)
SELECT d.sample_id, CASE WHEN f.filled < floor(f.n * 0.2::DOUBLE + 1e-9) THEN 'test' ELSE 'train' END AS part FROM d JOIN f ON d.s = f.s AND d.a = f.a""")
def split_by_author(spark, sf):
    demo = read_table(spark, sf, "demo_sample").where("subreddit is not null")
    rows = demo.select("sample_id", "author", F.lower("subreddit").alias("s"))
    return sampling.author_split(rows, "s").select("sample_id", F.col("split").alias("part"))


@query(f"""SELECT sample_id, CASE WHEN r <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' ELSE 'test' END AS part FROM (
  SELECT sample_id, row_number() OVER (PARTITION BY s, label ORDER BY {_draw('sample_id', 'label')}, sample_id) AS r,
  count(*) OVER (PARTITION BY s, label) AS n FROM (SELECT *, lower(subreddit) AS s FROM demo_sample WHERE subreddit IS NOT NULL AND label IS NOT NULL))""")
def split_by_label(spark, sf):
    demo = read_table(spark, sf, "demo_sample").where("subreddit is not null and label is not null")
    rows = demo.select("sample_id", "label", F.lower("subreddit").alias("s"))
    return sampling.label_split(rows, "s", "label", "sample_id").select("sample_id", F.col("split").alias("part"))


@query(f"""WITH d AS (SELECT sample_id, lower(subreddit) AS s, label FROM demo_sample WHERE subreddit IS NOT NULL),
m AS (SELECT s, least(count(*) FILTER (label = 'removed'), count(*) FILTER (label = 'approved'), 5000) AS most FROM d GROUP BY s),
r AS (SELECT *, row_number() OVER (PARTITION BY s, label ORDER BY {_draw('sample_id', 'balance')}, sample_id) AS r FROM d
  WHERE label IN ('removed', 'approved'))
SELECT sample_id, label FROM r JOIN m ON r.s = m.s WHERE r <= most""")
def sample_balanced(spark, sf):
    demo = read_table(spark, sf, "demo_sample").where("subreddit is not null")
    rows = demo.select("sample_id", "label", F.lower("subreddit").alias("s"))
    return sampling.cap_and_balance(rows, "s", "label", "sample_id").select("sample_id", "label")


@query(f"""WITH c AS (SELECT row_id, subreddit, {S.removal_class()} = 'captured_removed' AS keep FROM raw_comment)
SELECT row_id FROM c WHERE keep UNION ALL SELECT row_id FROM (
  SELECT row_id, row_number() OVER (PARTITION BY subreddit ORDER BY {_draw('row_id', 'reservoir')}, row_id) AS r FROM c WHERE NOT keep) WHERE r <= 50""")
def sample_reservoir(spark, sf):
    from threadmill.operators import audit

    rows = audit.classify(read_table(spark, sf, "raw_comment"))
    got = sampling.reservoir(rows, "subreddit", "row_id", 50, F.col("category") == "captured_removed")
    return got.select("row_id")


@query()
def sample_reservoir_full(spark, sf):
    """sample_reservoir with the reference's 200,000 rows a community."""
    from threadmill.operators import audit

    rows = audit.classify(read_table(spark, sf, "raw_comment"))
    got = sampling.reservoir(rows, "subreddit", "row_id", 200_000, F.col("category") == "captured_removed")
    return got.select("row_id")


@query(f"""SELECT sample_id, label FROM (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {_draw('sample_id', 'strata')}, sample_id) AS r
FROM demo_sample WHERE label IS NOT NULL) WHERE r <= 20""")
def sample_stratified(spark, sf):
    demo = read_table(spark, sf, "demo_sample").where("label is not null").select("sample_id", "label")
    return sampling.stratified_sample(demo, "label", "sample_id", 20).select("sample_id", "label")


@query("SELECT sample_id FROM (SELECT sample_id, row_number() OVER (PARTITION BY subreddit ORDER BY sample_id) AS r FROM demo_sample) WHERE r <= 25")
def limit_first_n(spark, sf):
    demo = read_table(spark, sf, "demo_sample").select("sample_id", "subreddit")
    return sampling.first_n(demo, "sample_id", 25, ["subreddit"]).select("sample_id")


_RATED = """d AS (SELECT p.*, c.natural_rate FROM pred p JOIN community c ON p.subreddit = lower(c.subreddit))"""


def _rated(spark, sf):
    rates = read_table(spark, sf, "community").select(F.lower("subreddit").alias("subreddit"), "natural_rate")
    return predictions(spark, sf).join(rates, "subreddit")


@query(f"""WITH {S.PRED}, {_RATED}, s AS (SELECT subreddit, count(*) FILTER (coalesce(label = 'removed', false)) AS r,
  count(*) FILTER (NOT coalesce(label = 'removed', false)) AS a FROM d GROUP BY subreddit),
k AS (SELECT d.*, coalesce(label = 'removed', false) AS rem, row_number() OVER (PARTITION BY d.subreddit, coalesce(label = 'removed', false)
  ORDER BY {_draw('id', 'rate0')}, id) AS k FROM d)
SELECT k.id FROM k JOIN s ON k.subreddit = s.subreddit WHERE NOT rem OR k <= CASE WHEN r = 0 OR a = 0 OR natural_rate <= 0 OR natural_rate >= 1 THEN r
  ELSE greatest(1, least(CAST(round_even(natural_rate * a / (1.0::DOUBLE - natural_rate), 0) AS BIGINT), r)) END""")
def resample_prevalence(spark, sf):
    return resample.prevalence_sample(_rated(spark, sf), ["subreddit"], "id", F.col("natural_rate")).select("id")


def _cells_with_rates(spark, sf):
    pred = _rated(spark, sf)
    cells = evaluate.confusion(pred, ["subreddit", "natural_rate"])
    lost = ~F.coalesce(F.col("prediction").isin("True", "False"), F.lit(False))
    removed = F.coalesce(F.col("label") == "removed", F.lit(False))
    unparsed = pred.groupBy("subreddit").agg(
        F.count_if(lost & removed).alias("removed_unparseable"), F.count_if(lost & ~removed).alias("approved_unparseable")
    )
    rates = F.array(F.lit(0.01), F.lit(0.05), F.lit(0.10), F.col("natural_rate"))
    return cells.join(unparsed, "subreddit").withColumn("rate", F.explode(rates))


@query()
def resample_natural_rates(spark, sf):
    """Six statistics at four prevalences of each community, 1,000 resamples each."""
    drawn = resample.prevalence_cells(_cells_with_rates(spark, sf), ["subreddit"], "rate", 1000)
    names = ["accuracy", "macro_f1", "f1", "kappa", "precision", "recall"]
    return resample.prevalence_summary(drawn, ["subreddit", "rate"], names)


@query(f"""WITH {S.PRED}, {_RATED}, s AS (SELECT subreddit, any_value(natural_rate) AS natural_rate, count(*) FILTER (coalesce(label = 'removed', false)) AS r,
  count(*) FILTER (NOT coalesce(label = 'removed', false)) AS a FROM d GROUP BY subreddit),
x AS (SELECT subreddit, a, r, unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE, natural_rate]) AS rate FROM s)
SELECT subreddit, rate, CASE WHEN r = 0 OR a = 0 THEN a + r ELSE a + greatest(1, least(CAST(round_even(rate * a / (1.0::DOUBLE - rate), 0) AS BIGINT), r)) END AS size
FROM x""")
def resample_sizes(spark, sf):
    drawn = resample.prevalence_cells(_cells_with_rates(spark, sf), ["subreddit"], "rate", 3)
    return drawn.groupBy("subreddit", "rate").agg(F.max("size").alias("size"))


@query()
def resample_thirty_runs(spark, sf):
    drawn = resample.prevalence_cells(_cells_with_rates(spark, sf), ["subreddit"], "rate", 30)
    return resample.prevalence_summary(drawn, ["subreddit", "rate"], ["f1", "precision", "recall", "accuracy"])


@query()
def bootstrap_intervals(spark, sf):
    cells = evaluate.confusion(predictions(spark, sf), ["subreddit"])
    return resample.bootstrap_ci(cells, ["subreddit"], ["f1", "precision", "recall", "accuracy", "kappa"])


@query()
def bootstrap_auroc(spark, sf):
    """AUROC of 1,000 resamples of rows of each community: the mean and the bounds of 95 %."""
    pred = predictions(spark, sf).where("confidence is not null and subreddit is not null")
    return resample.auroc_ci(pred.select("subreddit", "label", "confidence"), ["subreddit"])


_PICK = "CAST('0x' || substring(md5('42|' || CAST(run AS VARCHAR) || '|' || CAST(i AS VARCHAR)), 1, 13) AS BIGINT)"


@query(f"""WITH {S.PRED}, r AS (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY id) AS i, count(*) OVER (PARTITION BY subreddit) AS n
  FROM pred WHERE subreddit IS NOT NULL),
d AS (SELECT subreddit, n, i, unnest(range(1, 6)) AS run FROM r),
p AS (SELECT subreddit, run, {_PICK} % n + 1 AS i FROM d),
x AS (SELECT p.run, r.* FROM p JOIN r ON p.subreddit = r.subreddit AND p.i = r.i)
{S.cells('subreddit, run', source='x')}""")
def bootstrap_rows(spark, sf):
    pred = predictions(spark, sf).where("subreddit is not null")
    return resample.bootstrap_by_rows(pred, ["subreddit"], "id", 5, lambda d, by: evaluate.confusion(d, by))


@query()
def bootstrap_rows_full(spark, sf):
    """bootstrap_rows with the reference's 2,000 resamples."""
    pred = predictions(spark, sf).where("subreddit is not null").select("id", "subreddit", "label", "prediction")
    return resample.bootstrap_counts(pred, ["subreddit"], "id", 2000, evaluate.outcomes())


@query()
def bootstrap_paired_delta(spark, sf):
    pred = predictions(spark, sf)
    pairs = pred.select("id", "subreddit", "label", F.col("prediction").alias("pred_a"), "pred_b")
    return resample.paired_delta(pairs, ["subreddit"])
