"""Lookups: parents, titles, posts, ages, rules of thumb for keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.operators import audit, dedup, evaluate, history, lookups
from threadmill.plans import sqltext as S
from threadmill.plans.history_queries import _HIST
from threadmill.plans.registry import query
from threadmill.runtime import read_table

_INDEX = """idx AS (SELECT id, arg_max(body, struct_pack(a := ingested_at, b := row_id)) AS parent_body FROM raw_comment
  WHERE id <> '' AND body <> '' AND body NOT IN ('[removed]', '[deleted]') GROUP BY id)"""
_PARENT = f"""{_INDEX}, res AS (SELECT r.*, coalesce(i.parent_body, '') AS parent_body FROM raw_comment r
  LEFT JOIN idx i ON starts_with(r.parent_id, 't1_') AND substring(r.parent_id, 4) = i.id)"""


def _resolved(spark, sf):
    raw = read_table(spark, sf, "raw_comment")
    return lookups.attach_parent(raw, lookups.parent_index(raw))


@query(f"WITH {_PARENT} SELECT row_id, parent_body FROM res")
def join_parent(spark, sf):
    return _resolved(spark, sf).select("row_id", "parent_body")


@query(f"""WITH {_PARENT} SELECT resolved, unresolved, top_level, CAST(resolved AS DOUBLE) / nullif(resolved + unresolved, 0) AS rate FROM (
  SELECT count(*) FILTER (starts_with(parent_id, 't1_') AND parent_body <> '') AS resolved,
  count(*) FILTER (starts_with(parent_id, 't1_') AND parent_body = '') AS unresolved,
  count(*) FILTER (coalesce(NOT starts_with(parent_id, 't1_'), true)) AS top_level FROM res)""")
def join_parent_stats(spark, sf):
    return lookups.parent_stats(_resolved(spark, sf))


_TITLES = "t AS (SELECT link_id, max(title) AS title FROM post_title GROUP BY link_id)"


@query(f"""WITH {_TITLES} SELECT d.sample_id, coalesce(a.title, b.title, '') AS found_title FROM demo_sample d
LEFT JOIN t a ON replace(d.link_id, 't3_', '') = a.link_id LEFT JOIN t b ON d.link_id = b.link_id""")
def join_title(spark, sf):
    demo = read_table(spark, sf, "demo_sample").select("sample_id", "link_id")
    got = lookups.attach_title(demo, read_table(spark, sf, "post_title"))
    return got.select("sample_id", F.col("post_title").alias("found_title"))


@query(f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY score DESC NULLS LAST, num_comments DESC NULLS LAST,
  created_utc DESC NULLS LAST, over_18 DESC NULLS LAST) AS r FROM post_metadata),
p AS (SELECT * FROM ranked WHERE r = 1)
SELECT c.row_id, CASE WHEN c.created_utc <> 0 AND p.created_utc <> 0 THEN {S.half_up('c.created_utc - p.created_utc', '3600', 2)}
  ELSE -1.0 END AS time_since_post_hours, coalesce(p.num_comments, 0) AS thread_size_api, coalesce(p.over_18, false) AS post_is_nsfw
FROM raw_comment c LEFT JOIN p ON replace(c.link_id, 't3_', '') = p.link_id""")
def join_post(spark, sf):
    got = lookups.attach_post(read_table(spark, sf, "raw_comment"), read_table(spark, sf, "post_metadata"))
    return got.select("row_id", "time_since_post_hours", "thread_size_api", "post_is_nsfw")


@query(f"""WITH a AS (SELECT author, min(account_created_utc) AS since FROM account_age WHERE account_created_utc > 0 GROUP BY author)
SELECT c.row_id, CASE WHEN a.since <> 0 AND c.created_utc <> 0 AND a.since < c.created_utc
  THEN {S.half_up('c.created_utc - a.since', '86400', 1)} ELSE -1.0 END AS account_age_days
FROM raw_comment c LEFT JOIN a ON c.author = a.author""")
def join_account_age(spark, sf):
    got = lookups.attach_account_age(read_table(spark, sf, "raw_comment"), read_table(spark, sf, "account_age"))
    return got.select("row_id", "account_age_days")


@query("""SELECT author, account_created_utc, source FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY
  CASE source WHEN 'post_author_created_utc' THEN 0 WHEN 'author_created_utc' THEN 1 WHEN 'oldest_post' THEN 2 WHEN 'comment_author_created_utc' THEN 3
    WHEN 'oldest_comment' THEN 4 ELSE 5 END, source NULLS LAST, account_created_utc) AS r
  FROM account_age WHERE account_created_utc > 0 AND author IS NOT NULL AND author <> '[deleted]') WHERE r = 1""")
def join_oldest_activity(spark, sf):
    return lookups.oldest_activity(read_table(spark, sf, "account_age"))


@query("""SELECT sample_id, natural_rate FROM demo_sample d LEFT JOIN community c ON lower(d.subreddit) = lower(c.subreddit)""")
def join_natural_rate(spark, sf):
    demo = read_table(spark, sf, "demo_sample").select("sample_id", F.lower("subreddit").alias("s"))
    rates = read_table(spark, sf, "community").select(F.lower("subreddit").alias("s"), "natural_rate")
    return lookups.attach_small(demo, rates, "s").select("sample_id", "natural_rate")


_RULES = """g AS (SELECT lower(subreddit) AS s, '1. Be kind in ' || lower(subreddit) AS rules_text FROM community)"""


def _enriched_demo(spark, sf):
    """demo_sample with the history features of its comments, by their last delivery, and the rules of its community."""
    rows = read_table(spark, sf, "raw_comment").where("id is not null")
    features = dedup.latest(history.author_history(rows), ["id"], [F.desc("ingested_at"), F.desc("row_id")])
    sub = F.lower("subreddit")
    rules = read_table(spark, sf, "community").select(sub.alias("subreddit"), F.concat(F.lit("1. Be kind in "), sub).alias("rules_text"))
    return lookups.attach_rules(lookups.attach_author_features(read_table(spark, sf, "demo_sample"), features), rules)


_FOUND = f"""{_HIST.replace('FROM raw_comment)', 'FROM raw_comment WHERE id IS NOT NULL)')},
last AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY h.id ORDER BY r.ingested_at DESC, r.row_id DESC) AS rank
  FROM h JOIN raw_comment r ON h.row_id = r.row_id) WHERE rank = 1),
e AS (SELECT d.sample_id, d.subreddit, d.post_title, last.id IS NOT NULL AS author_features_found, CAST(coalesce(n_prior, 0) AS BIGINT) AS author_n_prior,
  CAST(coalesce(vel_24h, 0) AS BIGINT) AS author_vel_24h, coalesce({S.half_up('score_sum', 'nullif(n_prior, 0)', 1)}, 0.0) AS author_avg_score,
  CAST(coalesce(unique_threads, 0) AS BIGINT) AS author_unique_threads, coalesce({S.half_up('active', '86400', 1)}, 0.0) AS author_days_active,
  coalesce(is_first, true) AS author_is_first, CAST(coalesce(max_in_thread, 0) AS BIGINT) AS author_max_in_thread
  FROM demo_sample d LEFT JOIN last ON d.id = last.id)"""


@query(f"""WITH {_FOUND}, {_RULES} SELECT e.* EXCLUDE (subreddit, post_title), coalesce(g.rules_text, '') AS rules_text
FROM e LEFT JOIN g ON lower(e.subreddit) = g.s""")
def join_author_features(spark, sf):
    got = _enriched_demo(spark, sf)
    return got.select("sample_id", "author_features_found", *[b for _, b, _ in lookups.AUTHOR_FEATURES], "rules_text")


@query(f"""WITH {_FOUND} SELECT subreddit, count(*) AS total, count(*) FILTER (coalesce(post_title, '') = '') AS missing_titles,
  count(*) FILTER (author_n_prior = 0 AND NOT author_is_first) AS missing_author FROM e GROUP BY subreddit""")
def agg_missing_values(spark, sf):
    return audit.missing_values(_enriched_demo(spark, sf), "subreddit")


@query(f"""WITH {S.PRED} SELECT count(*) FILTER (prediction <> 'unparseable') AS n_kept, count(*) FILTER (prediction = 'unparseable') AS n_failed FROM pred""")
def filter_parsed_predictions(spark, sf):
    from threadmill.plans.metric_queries import predictions

    kept, counts = audit.parsed_predictions(predictions(spark, sf))
    return counts.join(kept.agg(F.count("*").alias("n_kept")), "n_kept")


@query("""WITH r AS (SELECT id, max(controversiality) AS controversiality, max(permalink) AS permalink FROM raw_comment GROUP BY id)
SELECT d.sample_id, r.controversiality, r.permalink FROM demo_sample d LEFT JOIN r ON d.id = r.id""")
def join_extra_fields(spark, sf):
    raw = read_table(spark, sf, "raw_comment").groupBy("id").agg(
        F.max("controversiality").alias("controversiality"), F.max("permalink").alias("permalink"), F.max("body").alias("body")
    )
    got = lookups.attach_missing_fields(read_table(spark, sf, "demo_sample"), raw, ["controversiality", "permalink", "body"])
    return got.select("sample_id", "controversiality", "permalink")


@query("""SELECT author FROM demo_sample WHERE author NOT IN ('', '[deleted]') UNION
SELECT author FROM raw_comment WHERE author NOT IN ('', '[deleted]')""")
def set_unique_authors(spark, sf):
    return lookups.unique_keys("author", read_table(spark, sf, "demo_sample"), read_table(spark, sf, "raw_comment"))


@query("""SELECT DISTINCT author FROM raw_comment WHERE author NOT IN ('', '[deleted]')
EXCEPT SELECT author FROM account_age""")
def set_missing_ages(spark, sf):
    needed = lookups.unique_keys("author", read_table(spark, sf, "raw_comment"))
    return lookups.missing_keys(needed, read_table(spark, sf, "account_age").where("author is not null"), "author")


@query("SELECT DISTINCT author FROM demo_sample WHERE split = 'train' INTERSECT SELECT author FROM demo_sample WHERE split = 'test'")
def set_shared_authors(spark, sf):
    demo = read_table(spark, sf, "demo_sample")
    return demo.where("split = 'train'").select("author").intersect(demo.where("split = 'test'").select("author"))


@query("""SELECT 'demo' AS origin, id, body FROM demo_sample UNION ALL SELECT 'raw', id, body FROM raw_comment""")
def set_union_all(spark, sf):
    a = read_table(spark, sf, "demo_sample").select(F.lit("demo").alias("origin"), "id", "body")
    return a.unionByName(read_table(spark, sf, "raw_comment").select(F.lit("raw").alias("origin"), "id", "body"))


@query("""SELECT r.row_id FROM raw_comment r WHERE EXISTS (SELECT 1 FROM demo_sample d WHERE d.id = r.id)""")
def join_semi_ids(spark, sf):
    ids = read_table(spark, sf, "demo_sample").select("id").distinct()
    return read_table(spark, sf, "raw_comment").join(ids, "id", "left_semi").select("row_id")


@query(f"""WITH {S.PRED}, a AS (SELECT subreddit, {S.stats(['accuracy', 'kappa'])} FROM ({S.cells()})),
b AS (SELECT subreddit, {S.stats(['accuracy', 'kappa'])} FROM ({S.cells(pred='pred_b')}))
SELECT a.subreddit, a.accuracy, a.kappa, nullif(b.accuracy, 0) AS accuracy_base, coalesce(nullif(b.kappa, 0), nullif(b.accuracy, 0)) AS kappa_base,
  round(a.accuracy - nullif(b.accuracy, 0), 4) AS accuracy_delta,
  round(a.kappa - coalesce(nullif(b.kappa, 0), nullif(b.accuracy, 0)), 4) AS kappa_delta
FROM a LEFT JOIN b ON a.subreddit = b.subreddit""")
def join_compare_baseline(spark, sf):
    from threadmill.plans.metric_queries import predictions

    pred = predictions(spark, sf)
    ours = evaluate.scores(pred, ["subreddit"], ["accuracy", "kappa"]).select("subreddit", "accuracy", "kappa")
    other = pred.withColumn("prediction", F.col("pred_b"))
    theirs = evaluate.scores(other, ["subreddit"], ["accuracy", "kappa"])
    return evaluate.compare_baseline(ours, theirs, "subreddit", {"accuracy": ["accuracy"], "kappa": ["kappa", "accuracy"]})
