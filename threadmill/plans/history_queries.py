"""Author history and other ordered computations."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.operators import enrich, history
from threadmill.plans import sqltext as S
from threadmill.plans.registry import ORACLES, query
from threadmill.runtime import read_table

_HIST = """k AS (SELECT *, row_number() OVER (PARTITION BY author, link_id ORDER BY created_utc, row_id) AS k FROM raw_comment),
h AS (SELECT row_id, author, id, created_utc, score,
  row_number() OVER o - 1 AS n_prior,
  count(*) OVER (PARTITION BY author ORDER BY created_utc RANGE BETWEEN 86399 PRECEDING AND 1 PRECEDING)
    + row_number() OVER (PARTITION BY author, created_utc ORDER BY row_id) - 1 AS vel_24h,
  coalesce(sum(coalesce(score, 1)) OVER p, 0) AS score_sum,
  coalesce(sum(CAST(k = 1 AS BIGINT)) OVER p, 0) AS unique_threads,
  created_utc - first_value(created_utc) OVER o AS active,
  row_number() OVER o = 1 AS is_first,
  coalesce(max(k) OVER p, 0) AS max_in_thread
  FROM k WINDOW o AS (PARTITION BY author ORDER BY created_utc, row_id),
  p AS (PARTITION BY author ORDER BY created_utc, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _history(spark, sf):
    return history.author_history(read_table(spark, sf, "raw_comment"))


@query(f"""WITH {_HIST} SELECT row_id, CAST(n_prior AS BIGINT) AS n_prior, CAST(vel_24h AS BIGINT) AS vel_24h,
  CAST(unique_threads AS BIGINT) AS unique_threads, {S.half_up('active', '86400', 1)} AS days_active, is_first, CAST(max_in_thread AS BIGINT) AS max_in_thread,
  coalesce({S.half_up('score_sum', 'nullif(n_prior, 0)', 1)}, 0.0) AS avg_score FROM h""")
def window_author_history(spark, sf):
    return _history(spark, sf).select(
        "row_id", "n_prior", "vel_24h", "unique_threads", "days_active", "is_first", "max_in_thread", "avg_score"
    )


query(ORACLES["window_author_history"], "window_hot_authors")(
    lambda spark, sf: history.author_history(read_table(spark, sf, "raw_comment"), hot=40).select(
        "row_id", "n_prior", "vel_24h", "unique_threads", "days_active", "is_first", "max_in_thread", "avg_score"
    )
)


@query(f"""WITH {_HIST} SELECT row_id, CAST(n_prior AS BIGINT) AS n_prior FROM h WHERE id IN (SELECT id FROM demo_sample)""")
def window_history_of_targets(spark, sf):
    got = history.history_of(read_table(spark, sf, "raw_comment"), read_table(spark, sf, "demo_sample"))
    return got.select("row_id", "n_prior")


@query(f"""WITH {_HIST} SELECT count(*) FILTER (is_first) AS first_timers, CAST(sum(n_prior) AS DOUBLE) / count(*) AS mean_prior,
  CAST(max(vel_24h) AS BIGINT) AS max_velocity FROM h""")
def window_history_summary(spark, sf):
    return history.history_summary(_history(spark, sf))


@query("SELECT row_id, count(*) OVER (PARTITION BY link_id) AS thread_comment_count_local FROM raw_comment WHERE link_id IS NOT NULL")
def window_thread_size(spark, sf):
    rows = read_table(spark, sf, "raw_comment").where("link_id is not null")
    return history.thread_size(rows).select("row_id", "thread_comment_count_local")


@query(f"""WITH {_HIST}, x AS (SELECT c.row_id, {S.words('c.body')} AS w, c.score, h.n_prior, h.vel_24h
  FROM raw_comment c JOIN h USING (row_id))
SELECT row_id, round(coalesce(score, 0) / greatest(w, 1)::DOUBLE, 4) AS score_per_word,
  round(vel_24h / greatest(n_prior, 1)::DOUBLE, 4) AS velocity_ratio FROM x""")
def enrich_ratios(spark, sf):
    rows = _history(spark, sf).withColumn("parent_body", F.lit(""))
    return enrich.enrich_text(enrich.enrich_context(rows)).select("row_id", "score_per_word", "velocity_ratio")


@query(f"""WITH x AS (SELECT sample_id, {S.words('body')} AS w, {S.words('parent_body')} AS p FROM demo_sample)
SELECT sample_id, CASE WHEN p > 0 THEN round(w / p::DOUBLE, 4) ELSE 0.0 END AS reply_length_ratio FROM x""")
def enrich_reply_ratio(spark, sf):
    rows = read_table(spark, sf, "demo_sample").withColumns(
        {
            "parent_id": F.lit("t3_"), "edited": F.lit("false"), "author_flair_text": F.lit(None).cast("string"),
            "is_submitter": F.lit(False), "vel_24h": F.lit(0), "n_prior": F.lit(0), "score": F.lit(0),
            "controversiality": F.lit(0), "created_utc": F.lit(1).cast("long"),
        }
    )
    return enrich.enrich_text(enrich.enrich_context(rows)).select("sample_id", "reply_length_ratio")


def _curve(spark, sf):
    """Whole values of events by type in time, as loss curves of five runs: sums are exact."""
    ev = read_table(spark, sf, "events").where("value is not null")
    return ev.select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.floor("value").cast("double").alias("loss"))


@query("""WITH n AS (SELECT event_type AS run, event_id AS step, floor(value) AS loss,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n
  FROM events WHERE value IS NOT NULL),
s AS (SELECT *, greatest(5, n // 20) AS w, sum(loss) OVER (PARTITION BY run ORDER BY i) AS c FROM n)
SELECT a.run, a.step, CASE WHEN a.n > 10 THEN (a.c - coalesce(b.c, 0)) / least(a.i, a.w + 1) ELSE a.loss END AS rolling
FROM s a LEFT JOIN s b ON a.run = b.run AND b.i = a.i - a.w - 1""")
def window_rolling_loss(spark, sf):
    got = history.rolling_loss(_curve(spark, sf))
    return got.select("run", "step", "rolling")


@query("""SELECT event_type AS run, arg_min(event_id, struct_pack(a := floor(value), b := event_id)) AS best_step, min(floor(value)) AS best_loss
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def agg_best_checkpoint(spark, sf):
    return history.best_checkpoint(_curve(spark, sf), loss="loss")
