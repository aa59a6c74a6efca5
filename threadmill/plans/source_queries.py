"""Readers and writers by round trips through the shared folder, and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadmill.operators import audit, dedup, enrich, evaluate, lookups
from threadmill.plans import sqltext as S
from threadmill.plans.metric_queries import predictions
from threadmill.plans.registry import query
from threadmill.runtime import read_table, shared_dir
from threadmill.sources import api, readers, writers
from threadmill.sources.zstd_dump import ZstdDump
from threadmill.streaming import live


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_COLS = "row_id, id, subreddit, score, created_utc, link_id, is_submitter"


@query(f"SELECT {_COLS}, length(body) AS n, _meta.removal_type AS removal_type FROM raw_comment")
def source_ndjson(spark, sf):
    path = _path(spark, "ndjson")
    writers.write_jsonl(read_table(spark, sf, "raw_comment"), path)
    schema = "row_id bigint, " + readers.RAW_COMMENT
    got = readers.read_ndjson(spark, path, schema)
    return got.select(*_COLS.split(", "), F.length("body").alias("n"), F.col("_meta.removal_type").alias("removal_type"))


@query("SELECT sample_id, label, body FROM demo_sample")
def source_jsonl(spark, sf):
    path = _path(spark, "jsonl")
    writers.write_jsonl(read_table(spark, sf, "demo_sample").select("sample_id", "label", "body"), path)
    return readers.read_jsonl(spark, path, "sample_id bigint, label string, body string")


@query("""SELECT category, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM (
  SELECT CASE WHEN _meta.removal_type = 'removed' THEN 'removed' ELSE 'approved' END AS category, row_id FROM raw_comment) GROUP BY category""")
def source_extracted(spark, sf):
    """One JSON object for each community with two arrays, exploded to rows."""
    path = _path(spark, "extracted")
    raw = read_table(spark, sf, "raw_comment")
    gone = F.coalesce(F.col("_meta.removal_type") == "removed", F.lit(False))
    row = F.struct("row_id", "id", "body")
    # Arrays of at most a few thousand rows each: the form of the old files, not of a large set.
    part = F.floor(F.col("row_id") / 1000)
    raw.groupBy("subreddit", part.alias("p")).agg(
        F.collect_list(F.when(gone, row)).alias("removed"), F.collect_list(F.when(~gone, row)).alias("approved")
    ).select("removed", "approved").write.json(path)
    got = readers.read_extracted(spark, path, "row_id bigint, id string, body string", False)
    return got.groupBy("category").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query("SELECT DISTINCT trim(id) AS id FROM demo_sample WHERE id IS NOT NULL")
def source_ids(spark, sf):
    path = _path(spark, "ids")
    read_table(spark, sf, "demo_sample").where("id is not null").select("id").write.text(path)
    return readers.read_ids(spark, path).select("id").distinct()


@query("""SELECT row_number() OVER (ORDER BY sample_id) - 1 AS idx, coalesce(body, '') AS body, subreddit, label, coalesce(parent_body, '') AS parent_body
FROM demo_sample WHERE label IS NOT NULL AND subreddit IS NOT NULL""")
def source_csv(spark, sf):
    """A CSV with line breaks and quotes in its cells; the index is the row's number in the file."""
    path = _path(spark, "csv")
    demo = read_table(spark, sf, "demo_sample").where("label is not null and subreddit is not null")
    rows = demo.orderBy("sample_id").select(
        "body", "subreddit", F.when(F.col("label") == "removed", "True").otherwise("False").alias("removed"),
        F.col("parent_body").alias("context"),
    ).coalesce(1)
    rows.write.options(
        escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path, header=True)
    got = readers.read_labelled_csv(spark, path)
    return got.select(F.col("idx").cast("long").alias("idx"), F.coalesce("body", F.lit("")).alias("body"), "subreddit", "label", "parent_body")


@query("""SELECT id, max(row_id) AS row_id, count(*) AS deliveries FROM raw_comment
  WHERE id IS NOT NULL AND created_utc IS NOT NULL GROUP BY id""")
def source_append_merge(spark, sf):
    """The stream appended in two parts, by community and month; the newest row of an id wins."""
    path = _path(spark, "append")
    raw = read_table(spark, sf, "raw_comment").where("id is not null and created_utc is not null").drop("_meta")
    for part in (F.col("row_id") % 2 == 0, F.col("row_id") % 2 == 1):
        writers.append_comments(raw.where(part), path)
    stored = spark.read.parquet(path)
    count = stored.groupBy("id").agg(F.count("*").alias("deliveries"))
    return dedup.latest_value(stored, ["id"], "row_id", "row_id").join(count, "id")


@query("SELECT author, account_created_utc FROM (SELECT author, max(account_created_utc) AS account_created_utc FROM account_age WHERE author IS NOT NULL GROUP BY author)")
def source_resumable_cache(spark, sf):
    """A cache that holds half of the keys, completed by those it lacks."""
    path = _path(spark, "cache")
    ages = read_table(spark, sf, "account_age").where("author is not null").groupBy("author").agg(F.max("account_created_utc").alias("account_created_utc"))
    ages.where(F.crc32("author") % 2 == 0).write.parquet(path)
    writers.append_missing(ages, spark.read.parquet(path), "author", path)
    return spark.read.parquet(path)


@query("""SELECT sample_id, 'kept' AS state FROM demo_sample WHERE sample_id % 3 = 0
UNION ALL SELECT sample_id, 'todo' FROM demo_sample WHERE sample_id % 3 <> 0""")
def source_resume_split(spark, sf):
    demo = read_table(spark, sf, "demo_sample").select("sample_id")
    previous = demo.where("sample_id % 3 <= 1").withColumn("ok", F.col("sample_id") % 3 == 0)
    kept, todo = writers.resumable(previous, demo, "sample_id", F.col("ok"))
    return kept.select("sample_id", F.lit("kept").alias("state")).unionAll(todo.select("sample_id", F.lit("todo").alias("state")))


@query("SELECT split AS name, target_share AS share FROM split_target")
def source_summary_csv(spark, sf):
    path = _path(spark, "summary")
    rows = read_table(spark, sf, "split_target").select(F.col("split").alias("name"), F.col("target_share").alias("share"))
    writers.write_summary_csv(rows, path, ["name", "share"], "name")
    return spark.read.schema("name string, share double").csv(path, header=True)


@query(f"""SELECT subreddit, {S.removal_class()} AS category, CAST(floor(created_utc / 86400) AS BIGINT) AS day, count(*) AS n
FROM raw_comment WHERE created_utc IS NOT NULL GROUP BY 1, 2, 3""")
def stream_category_counts(spark, sf):
    schema = read_table(spark, sf, "raw_comment").schema
    counts = live.live_category_counts(live.stream_comments(spark, f"{sf}/raw_comment.parquet*", schema))
    got = live.run_to_end(counts, _path(spark, "classes"), "complete")
    day = F.floor(F.unix_timestamp("window.start") / 86400).cast("long")
    return got.where("window is not null").select("subreddit", "category", day.alias("day"), "n")


@query("""SELECT author, CAST(t.h * 3600 AS BIGINT) AS hour_start, count(*) AS n FROM raw_comment,
  (SELECT unnest(range(0, 24)) AS k) o, LATERAL (SELECT floor(created_utc / 3600) - o.k AS h) t WHERE created_utc IS NOT NULL GROUP BY 1, 2""")
def stream_author_velocity(spark, sf):
    schema = read_table(spark, sf, "raw_comment").schema
    counts = live.live_author_velocity(live.stream_comments(spark, f"{sf}/raw_comment.parquet*", schema))
    got = live.run_to_end(counts, _path(spark, "velocity"), "complete")
    return got.select("author", F.unix_timestamp("window.start").alias("hour_start"), "n")


@query("SELECT row_id, id, score FROM raw_comment")
def source_zstd(spark, sf):
    """Compressed dumps of up to 2,000 lines each, read as a stream of lines."""
    path = _path(spark, "dumps")
    rows = read_table(spark, sf, "raw_comment").select("row_id", "id", "score")
    part = F.concat(F.lit("RC_"), F.floor(F.col("row_id") / 2000), F.lit(".zst"))
    text = F.array_join(F.collect_list(F.to_json(F.struct("row_id", "id", "score"))), "\n")
    files = rows.groupBy(part.alias("name")).agg(text.alias("text"))
    writers.write_files(files, path, compression="zstd").write.format("noop").mode("overwrite").save()
    spark.dataSource.register(ZstdDump)
    lines = spark.read.format("zstd_ndjson").load(f"{path}/RC_*.zst")
    return lines.select(F.from_json("value", "row_id bigint, id string, score bigint").alias("r")).select("r.*")


def _put(files, path: str) -> None:
    writers.write_files(files, path).write.format("noop").mode("overwrite").save()


@query("SELECT subreddit, natural_rate, CAST(epoch(opened_at) AS BIGINT) AS opened FROM community")
def source_side_table(spark, sf):
    """One JSON object keyed by community, which has one row for each."""
    path = _path(spark, "side")
    entry = F.struct("subreddit", F.struct("natural_rate", F.unix_timestamp("opened_at").alias("opened")))
    table = read_table(spark, sf, "community").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("text"))
    _put(table.withColumn("name", F.lit("rates.json")), path)
    return readers.read_side_table(spark, f"{path}/rates.json", "subreddit", "struct<natural_rate: double, opened: bigint>")


@query(f"SELECT sample_id % 50 AS k, {S.strip("string_agg(coalesce(body, ''), '|' ORDER BY sample_id)")} AS text FROM demo_sample GROUP BY 1")
def source_whole_text(spark, sf):
    path = _path(spark, "texts")
    rows = read_table(spark, sf, "demo_sample").groupBy((F.col("sample_id") % 50).alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("sample_id", F.coalesce("body", F.lit("")).alias("body")))).alias("v")
    )
    _put(rows.select(F.concat("k", F.lit(".txt")).alias("name"), F.array_join("v.body", "|").alias("text")), path)
    got = readers.read_whole_text(spark, f"{path}/*.txt")
    return got.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("k"), "text")


@query("SELECT lower(subreddit) || '_run' AS stem FROM community")
def source_discover(spark, sf):
    """Files of one kind in folders below a folder; those of other kinds are not found."""
    path = _path(spark, "found")
    sub = F.lower("subreddit")
    names = read_table(spark, sf, "community").select(
        F.explode(F.array(F.concat(sub, F.lit("/"), sub, F.lit("_run.jsonl")), F.concat(sub, F.lit("/notes.md")))).alias("name"), F.lit("{}").alias("text")
    )
    _put(names, path)
    return readers.discover(spark, path, "*.jsonl").select("stem")


@query(f"""WITH {S.PRED}, c AS ({S.cells()}) SELECT subreddit AS community, {S.stats(['f1', 'accuracy'])}, tp FROM c WHERE subreddit IS NOT NULL""")
def source_metrics(spark, sf):
    """Statistics of each community to a file each, and back; a broken file gives no row."""
    path = _path(spark, "metrics")
    scored = evaluate.scores(predictions(spark, sf), ["subreddit"], ["f1", "accuracy"]).where("subreddit is not null")
    files = scored.select(F.concat(F.lit("run_"), "subreddit", F.lit("_metrics.json")).alias("name"), F.to_json(F.struct("f1", "accuracy", "tp")).alias("text"))
    broken = spark.createDataFrame([("run_bad_metrics.json", "oops")], "name string, text string")
    _put(files.unionByName(broken), path)
    return readers.read_metrics(spark, f"{path}/*_metrics.json", "f1 double, accuracy double, tp bigint")


@query(f"""WITH {S.PRED}, c AS ({S.cells()}) SELECT subreddit, {S.stats(['f1', 'kappa'])}, tp, fp FROM c""")
def source_metrics_nested(spark, sf):
    """The metrics sink: one object a row, statistics nested."""
    path = _path(spark, "nested")
    scored = evaluate.scores(predictions(spark, sf), ["subreddit"], ["f1", "kappa"]).drop("tn", "fn", "unparseable")
    writers.write_metrics(scored, path, ["subreddit"])
    back = spark.read.schema("subreddit string, metrics struct<f1: double, kappa: double, tp: bigint, fp: bigint>").json(path)
    return back.select("subreddit", "metrics.*")


@query("""SELECT split, count(*) AS n_rows, count(DISTINCT author) AS n_authors, count(*) FILTER (label = 'removed') AS n_removed,
  count(*) FILTER (label = 'approved') AS n_approved FROM demo_sample GROUP BY split""")
def source_dataset_stats(spark, sf):
    """The statistics sink: dataset statistics as JSON, and back."""
    path = _path(spark, "stats")
    writers.write_metrics(audit.dataset_stats(read_table(spark, sf, "demo_sample")), path, ["split"])
    names = ["n_rows", "n_authors", "n_removed", "n_approved"]
    back = spark.read.schema(f"split string, metrics struct<{', '.join(f'{n}: bigint' for n in names)}>").json(path)
    return back.select("split", "metrics.*")


_LOSS = """e AS (SELECT event_type AS run, floor(value) AS loss, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL)"""


def _numbered_events(spark, sf):
    ev = read_table(spark, sf, "events").where("value is not null").select(
        "event_id", F.col("event_type").alias("run"), F.floor("value").cast("double").alias("loss")
    )
    return ev.withColumn("i", F.row_number().over(Window.partitionBy("run").orderBy("event_id")))


@query(f"""WITH {_LOSS} SELECT run || '.log' AS run, CASE WHEN i % 2 = 0 THEN i * 10 + 7 ELSE i * 10 END AS step, loss FROM e""")
def source_loss_log(spark, sf):
    """Logs with other lines between the points; odd points leave their step out."""
    path = _path(spark, "logs")
    step = F.when(F.col("i") % 2 == 0, F.concat(F.lit(", 'step': "), F.col("i") * 10 + 7)).otherwise("")
    line = F.concat(F.lit("saving\n{'loss': "), "loss", step, F.lit("}"))
    logs = _numbered_events(spark, sf).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("v"))
    _put(logs.select(F.concat("run", F.lit(".log")).alias("name"), F.array_join("v.line", "\n").alias("text")), path)
    return readers.read_loss_log(spark, f"{path}/*.log").select("run", "step", "loss")


@query(f"""WITH {_LOSS} SELECT run || '.json' AS run, i AS step, CASE WHEN i % 5 <> 0 THEN loss END AS loss, CASE WHEN i % 5 = 0 THEN loss END AS eval_loss FROM e""")
def source_train_meta(spark, sf):
    path = _path(spark, "trained")
    last = F.col("i") % 5 == 0
    point = F.struct(F.col("i").alias("step"), F.when(~last, F.col("loss")).alias("loss"), F.when(last, F.col("loss")).alias("eval_loss"))
    runs = _numbered_events(spark, sf).groupBy("run").agg(F.to_json(F.struct(F.collect_list(point).alias("log_history"))).alias("text"))
    _put(runs.select(F.concat("run", F.lit(".json")).alias("name"), "text"), path)
    return readers.read_train_meta(spark, f"{path}/*.json").select("run", "step", "loss", "eval_loss")


@query(f"""WITH {S.PRED} SELECT CAST(id AS VARCHAR) AS id, label, prediction, CASE WHEN id % 2 = 0 THEN 'm' || id % 4 END AS model,
  CASE WHEN id % 2 = 0 THEN 'named' ELSE 'runs' END AS subreddit FROM pred""")
def source_predictions(spark, sf):
    """Prediction files, half of them with a companion that names model and community."""
    path = _path(spark, "predictions")
    pred = predictions(spark, sf).withColumn("k", F.col("id") % 4)
    row = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "label", "prediction"))
    files = pred.groupBy("k").agg(F.array_join(F.collect_list(row), "\n").alias("text"))
    files = files.select(F.concat(F.lit("runs/r"), "k", F.lit(".jsonl")).alias("name"), "text")
    about = [(f"runs/r{k}.json", f'{{"model": "m{k}", "subreddit": "named"}}') for k in (0, 2)]
    _put(files.unionByName(spark.createDataFrame(about, "name string, text string")), path)
    return readers.read_predictions(spark, path).select("id", "label", "prediction", "model", "subreddit")


@query("SELECT subreddit, row_number() OVER (ORDER BY subreddit DESC) - 1 AS at FROM community")
def source_config(spark, sf):
    """The communities of a configuration file in its order."""
    path = _path(spark, "config")
    names = F.sort_array(F.collect_list("subreddit"), False)
    text = F.to_json(F.struct(names.alias("seen"), F.array().cast("array<string>").alias("unseen")))
    _put(read_table(spark, sf, "community").agg(text.alias("text")).withColumn("name", F.lit("c.json")), path)
    found = readers.read_config(spark, f"{path}/c.json")
    return spark.createDataFrame([(n, i) for i, n in enumerate(found)], "subreddit string, at bigint")


@query("""SELECT subreddit, row_number() OVER (ORDER BY natural_rate > 0.2 DESC, subreddit) - 1 AS at FROM community""")
def sort_priority_list(spark, sf):
    """Communities with a high rate first, the others after them in their order."""
    rows = read_table(spark, sf, "community").select("subreddit", "natural_rate").orderBy("subreddit").collect()
    names = [r.subreddit for r in rows]
    ordered = readers.order_list(names, [r.subreddit for r in rows if r.natural_rate > 0.2], [])
    return spark.createDataFrame([(n, i) for i, n in enumerate(ordered)], "subreddit string, at bigint")


@query("SELECT lower(subreddit) AS id FROM community WHERE lower(subreddit) > 'c'")
def source_sub_list(spark, sf):
    """A list with comment lines and blank ones."""
    path = _path(spark, "subs")
    name = F.lower("subreddit")
    line = F.when(name > "c", name).otherwise(F.concat(F.lit("# "), name))
    read_table(spark, sf, "community").select(F.explode(F.array(line, F.lit("  "))).alias("value")).write.text(path)
    return readers.read_ids(spark, path, comments=True).select("id")


@query("SELECT sample_id, label, split FROM demo_sample WHERE split = 'test'")
def source_copy_table(spark, sf):
    path = _path(spark, "copy")
    test = read_table(spark, sf, "demo_sample").where("split = 'test'").select("sample_id", "label", "split")
    writers.copy_table(test, path)
    return spark.read.parquet(path)


def _paged_service():
    """A service with a comment every seven seconds, ten a page."""

    def page(community: str, after: int, before: int) -> list[dict]:
        first = -(-after // 7) * 7
        return [{"id": f"{community}-{t}", "created_utc": t} for t in range(first, min(before, first + 70), 7)]

    return page


@query("SELECT subreddit || '-' || t AS id, t AS created_utc FROM community, (SELECT unnest(range(0, 2000, 7)) AS t)")
def source_paged_service(spark, sf):
    """Pages of each community in two time slices; records of a border come once."""
    slices = read_table(spark, sf, "community").select("subreddit", F.explode(F.array(F.lit(0), F.lit(1000))).alias("after"))
    slices = slices.withColumn("before", F.col("after") + 1000)
    return api.fetch_pages(slices, _paged_service, "id string, created_utc bigint", wait=0.0)


def _id_service():
    def lookup(ids: list[str]) -> list[dict]:
        return [{"id": i, "size": len(i)} for i in ids if i[-1] in "02468"]

    return lookup


def _id_query(kind: str, key: str, table: str):
    sql = f"SELECT {key} AS id, length({key}) AS size FROM (SELECT DISTINCT {key} FROM {table} WHERE {key} IS NOT NULL) WHERE right({key}, 1) IN ('0', '2', '4', '6', '8')"

    def run(spark, sf):
        ids = read_table(spark, sf, table).select(F.col(key).alias("id"))
        return api.fetch_by_ids(ids, _id_service, "id string, size bigint", wait=0.0)

    query(sql, f"source_by_id_{kind}")(run)


_id_query("comments", "id", "demo_sample")
_id_query("posts", "link_id", "post_metadata")


def _rules_service():
    """Rules of communities, as a service names them."""

    def rules(names: list[str]) -> list[dict]:
        return [{"id": n, "rules": [{"short_name": "Be kind", "description": n}, {"short_name": "No spam", "description": ""}]} for n in names]

    return rules


@query("SELECT sample_id, CASE WHEN c.subreddit IS NULL THEN '' ELSE '1. Be kind: ' || lower(c.subreddit) || chr(10) || '2. No spam' END AS rules_text FROM demo_sample d LEFT JOIN community c ON lower(d.subreddit) = lower(c.subreddit)")
def source_rules(spark, sf):
    """Rules fetched by community, as numbered text, joined to the rows."""
    names = read_table(spark, sf, "community").select(F.lower("subreddit").alias("id"))
    got = api.fetch_by_ids(names, _rules_service, "id string, rules array<struct<short_name: string, description: string>>", wait=0.0)
    text = enrich.rules_text(got.withColumnRenamed("id", "subreddit"))
    return lookups.attach_rules(read_table(spark, sf, "demo_sample").select("sample_id", "subreddit"), text).select("sample_id", "rules_text")
