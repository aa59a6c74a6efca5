"""Classes, filters, audits and duplicates over the comment stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.functions import comment as C
from threadmill.functions.text import strip
from threadmill.operators import audit, dedup, enrich
from threadmill.plans import sqltext as S
from threadmill.plans.registry import query
from threadmill.runtime import read_table


def _raw(spark, sf):
    return read_table(spark, sf, "raw_comment")


def _class_query(variant: str):
    sql = f"SELECT row_id, {S.removal_class(variant)} AS category FROM raw_comment"

    def run(spark, sf):
        return audit.classify(_raw(spark, sf), variant).select("row_id", "category")

    query(sql, f"classify_{variant}")(run)


for _v in ("stream", "index", "report"):
    _class_query(_v)


@query(f"SELECT row_id FROM raw_comment WHERE {S.KEPT}")
def filter_comments(spark, sf):
    return audit.kept_comments(_raw(spark, sf)).select("row_id")


@query(f"SELECT DISTINCT author, {S.FILTERS['bot_name']} AS is_bot FROM raw_comment")
def filter_bot_names(spark, sf):
    return _raw(spark, sf).select("author", C.is_bot_name(F.coalesce("author", F.lit(""))).alias("is_bot")).distinct()


@query("""SELECT row_id FROM raw_comment WHERE id <> '' AND body <> '' AND body NOT IN ('[removed]', '[deleted]')""")
def filter_readable(spark, sf):
    return _raw(spark, sf).where(C.readable(F.col("id"), F.col("body"))).select("row_id")


@query("""SELECT subreddit, count(*) AS n FROM raw_comment
WHERE lower(subreddit) IN ('askthearchive', 'kitchenscience', 'questboard') GROUP BY subreddit""")
def filter_communities(spark, sf):
    wanted = C.in_communities(F.col("subreddit"), ["AskTheArchive", "kitchenscience", "QuestBoard"])
    return _raw(spark, sf).where(wanted).groupBy("subreddit").agg(F.count("*").alias("n"))


@query(f"""SELECT id, subreddit, body, '' AS parent_body, score, created_utc, parent_id, link_id, is_submitter, controversiality, permalink,
  CAST(NULL AS VARCHAR) AS label, coalesce(_meta.is_edited, false) OR coalesce(lower({S.strip('edited')}) = 'true', false)
  OR coalesce(try_cast({S.strip('edited')} AS DOUBLE) <> 0, false) AS is_edited FROM raw_comment""")
def project_features(spark, sf):
    rows = _raw(spark, sf).withColumns({"parent_body": F.lit(""), "label": F.lit(None).cast("string")})
    return enrich.extract_features(rows).drop("author", "author_flair_text")


@query("""SELECT row_id, replace(link_id, 't3_', '') AS bare_link,
  CASE WHEN starts_with(parent_id, 't1_') THEN substring(parent_id, 4) END AS parent_comment,
  coalesce(starts_with(parent_id, 't3_'), false) AS is_top_level FROM raw_comment""")
def project_bare_ids(spark, sf):
    return _raw(spark, sf).select(
        "row_id", C.bare_link(F.col("link_id")).alias("bare_link"),
        C.parent_comment(F.col("parent_id")).alias("parent_comment"), C.is_top_level(F.col("parent_id")).alias("is_top_level"),
    )


@query(f"""SELECT row_id, CASE WHEN coalesce(author_flair_text, '') = '' THEN 'none' ELSE {S.strip('author_flair_text')} END
  AS author_flair_clean, {S.strip("coalesce(author_flair_text, '')")} <> '' AS has_author_flair,
  coalesce(is_submitter, false) AS is_submitter_bool,
  coalesce(_meta.is_edited, false) OR coalesce(lower({S.strip('edited')}) = 'true', false)
    OR coalesce(try_cast({S.strip('edited')} AS DOUBLE) <> 0, false) AS is_edited_bool,
  coalesce(controversiality, 0) AS controversiality FROM raw_comment""")
def project_flags(spark, sf):
    rows = enrich.enrich_context(_raw(spark, sf).withColumn("parent_body", F.lit("")))
    return rows.select(
        "row_id", "author_flair_clean", "has_author_flair", "is_submitter_bool", "is_edited_bool",
        F.coalesce("controversiality", F.lit(0)).alias("controversiality"),
    )


@query("""SELECT sample_id, CASE WHEN label = 'removed' THEN 'True' ELSE 'False' END AS answer,
  CASE WHEN label = 'removed' THEN 'removed' ELSE 'approved' END AS back FROM demo_sample""")
def project_answers(spark, sf):
    answer = C.answer_of(F.col("label"))
    return read_table(spark, sf, "demo_sample").select("sample_id", answer.alias("answer"), C.label_of(answer).alias("back"))


@query("""SELECT sample_id, 'slm_' || subreddit || '_' || lpad(CAST(sample_id AS VARCHAR), CAST(greatest(4, length(CAST(sample_id AS VARCHAR))) AS INTEGER), '0')
  || '_' || substring(md5(subreddit || '|' || CAST(sample_id AS VARCHAR) || '|' || substring(coalesce(body, ''), 1, 64)), 1, 10) AS stable_id
FROM demo_sample WHERE subreddit IS NOT NULL""")
def project_stable_id(spark, sf):
    demo = read_table(spark, sf, "demo_sample").where("subreddit is not null")
    return demo.select("sample_id", C.stable_id(F.col("subreddit"), F.col("sample_id"), F.col("body")).alias("stable_id"))


@query("""WITH t AS (SELECT row_id, to_timestamp(created_utc) AT TIME ZONE 'UTC' AS ts FROM raw_comment WHERE created_utc <> 0)
SELECT r.row_id, coalesce(CAST(hour(ts) AS INTEGER), -1) AS hour_of_day, coalesce(CAST(isodow(ts) - 1 AS INTEGER), -1) AS day_of_week,
  coalesce(isodow(ts) >= 6, false) AS is_weekend FROM raw_comment r LEFT JOIN t USING (row_id)""")
def project_clock(spark, sf):
    cols = C.clock_fields(F.col("created_utc"))
    return _raw(spark, sf).select("row_id", *[c.alias(n) for n, c in cols.items()])


_CLASSED = f"c AS (SELECT *, {S.removal_class()} AS category FROM raw_comment)"


@query(f"""WITH {_CLASSED} SELECT lower(subreddit) AS community,
  {', '.join(f"count(*) FILTER (category = '{k}') AS {k}" for k in audit.CLASSES)}, count(*) AS total,
  CAST(count(*) FILTER (category = 'captured_removed') AS DOUBLE) / count(*) AS usable FROM c GROUP BY 1""")
def agg_category_counts(spark, sf):
    rows = audit.classify(_raw(spark, sf)).withColumn("community", F.lower("subreddit"))
    return audit.category_counts(rows, "community")


@query(f"""WITH {_CLASSED} SELECT category, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share
FROM c GROUP BY category""")
def agg_category_shares(spark, sf):
    return audit.category_shares(audit.classify(_raw(spark, sf)))


@query(f"""WITH {_CLASSED} SELECT subreddit, category, count(*) AS n FROM c GROUP BY subreddit, category
ORDER BY n DESC, subreddit, category""")
def sort_category_counts(spark, sf):
    rows = audit.classify(_raw(spark, sf)).groupBy("subreddit", "category").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "subreddit", "category")


@query(f"""SELECT subreddit, count(*) AS total, {', '.join(f'count(*) FILTER ({t}) AS {n}' for n, t in S.FILTERS.items())},
  count(*) FILTER ({S.KEPT}) AS kept FROM raw_comment GROUP BY subreddit""")
def agg_filter_breakdown(spark, sf):
    return audit.filter_breakdown(_raw(spark, sf), "subreddit")


@query("""SELECT split, count(*) AS n_rows, count(DISTINCT author) AS n_authors, count(*) FILTER (label = 'removed') AS n_removed,
  count(*) FILTER (label = 'approved') AS n_approved FROM demo_sample GROUP BY split""")
def agg_dataset_stats(spark, sf):
    return audit.dataset_stats(read_table(spark, sf, "demo_sample"))


@query("""SELECT count(*) FILTER (l AND r) AS n_shared, count(*) AS n_authors FROM (
  SELECT author, bool_or(split = 'train') AS l, bool_or(split = 'test') AS r FROM demo_sample
  WHERE author IS NOT NULL AND split IN ('train', 'test') GROUP BY author)""")
def set_author_overlap(spark, sf):
    return audit.author_overlap(read_table(spark, sf, "demo_sample"), "train", "test")


_PRESENT = {
    "post_title": "coalesce(post_title, '') <> ''", "parent_body": "coalesce(parent_body, '') <> ''",
    "account_age": "coalesce(account_age_days, -1) >= 0", "author": "coalesce(author, '[deleted]') <> '[deleted]'",
    "top_level": "coalesce(is_top_level, false)", "missing_title": "coalesce(post_title, '') = ''",
}


@query(f"""SELECT subreddit, count(*) AS total, {', '.join(f'count(*) FILTER ({t}) AS {n}' for n, t in _PRESENT.items())},
  {', '.join(f'100.0::DOUBLE * count(*) FILTER ({t}) / count(*) AS {n}_pct' for n, t in _PRESENT.items())}
FROM demo_sample GROUP BY subreddit""")
def agg_presence(spark, sf):
    return audit.presence_counts(
        read_table(spark, sf, "demo_sample"), {n: F.expr(t) for n, t in _PRESENT.items()}, "subreddit"
    )


@query("""WITH req AS (SELECT DISTINCT subreddit, id FROM demo_sample), have AS (SELECT DISTINCT id FROM raw_comment WHERE body NOT IN ('[removed]', '[deleted]'))
SELECT subreddit, requested, recovered, CAST(recovered AS DOUBLE) / requested AS coverage FROM (
  SELECT req.subreddit, count(*) AS requested, count(have.id) AS recovered FROM req LEFT JOIN have ON req.id = have.id
  GROUP BY ROLLUP (req.subreddit))""")
def agg_coverage(spark, sf):
    archive = _raw(spark, sf).where(~F.col("body").isin("[removed]", "[deleted]"))
    return audit.coverage(read_table(spark, sf, "demo_sample"), archive)


@query("""SELECT CASE WHEN starts_with(source, 'lab') THEN 'lab' WHEN starts_with(source, 'b') THEN 'b' ELSE 'other' END AS model,
  CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1""")
def agg_token_costs(spark, sf):
    return audit.token_costs(read_table(spark, sf, "documents"), "source", ["n_chars"], ["lab", "b"])


_SPAM = f"""spam AS (SELECT {S.removal_class()} AS category, {S.strip('body')} AS b FROM raw_comment WHERE body IS NOT NULL
  GROUP BY 1, 2 HAVING count(*) >= 5 AND count(DISTINCT coalesce(author, '')) >= 2)"""


@query(f"""WITH {_SPAM} SELECT r.row_id FROM raw_comment r WHERE NOT EXISTS (
  SELECT 1 FROM spam WHERE spam.category = ({S.removal_class()}) AND spam.b = {S.strip('r.body')})""")
def dedup_remove_spam(spark, sf):
    return dedup.remove_spam(audit.classify(_raw(spark, sf)), ["category"]).select("row_id")


@query(f"""SELECT {S.removal_class()} AS category, md5({S.strip('body')}) AS digest, count(*) AS copies, count(DISTINCT coalesce(author, '')) AS authors
FROM raw_comment WHERE body IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5 AND count(DISTINCT coalesce(author, '')) >= 2""")
def dedup_spam_bodies(spark, sf):
    rows = audit.classify(_raw(spark, sf))
    spam = dedup.spam_bodies(rows, ["category"])
    # Named by MD5, as the engine compared with has no SHA-2.
    names = rows.where("body is not null").select(
        "category", F.sha2(strip(F.col("body")), 256).alias("digest"), F.md5(strip(F.col("body"))).alias("name")
    ).distinct()
    return spam.join(names, ["category", "digest"]).select("category", F.col("name").alias("digest"), "copies", "authors")


@query("""SELECT row_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, row_id DESC) AS r
  FROM raw_comment WHERE id IS NOT NULL) WHERE r = 1""")
def dedup_latest_delivery(spark, sf):
    rows = _raw(spark, sf).where("id is not null")
    return dedup.latest(rows, ["id"], [F.desc("ingested_at"), F.desc("row_id")]).select("row_id", "id", "score")
