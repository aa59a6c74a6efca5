"""Queries p1 to p8 over the test tables, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.llm.abuse import abuse_rates, score_abuse, train_on_reviews
from threadmill.llm.chunking import split_texts
from threadmill.llm.mixing import mix_sources
from threadmill.llm.overlap import cross_split_overlaps, overlap_pairs
from threadmill.llm.packing import pack_documents
from threadmill.llm.pii import mask_personal, mentions
from threadmill.llm.records import collapsed_records, same_records
from threadmill.llm.splits import assign_splits
from threadmill.runtime import read_table, write_shared

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = same_records(read_table(spark, sf_dir, "demo_sample")).where("id <> first_id")
    return found.select("first_id", F.col("id").alias("copy_id")).distinct()


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed_records(read_table(spark, sf_dir, "demo_sample")).withColumnRenamed("text", "body")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions(mask_personal(read_table(spark, sf_dir, "demo_sample")))
    return found.select(F.col("id").alias("sample_id"), "field", "kind").distinct()


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_personal(read_table(spark, sf_dir, "demo_sample")).withColumnRenamed("id", "sample_id")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions(mask_personal(read_table(spark, sf_dir, "demo_sample")))
    return found.groupBy("field", "kind").agg(
        F.count_distinct("id").alias("n_rows"), F.sum("n").alias("n_mentions")
    )


def _split_targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, float]]:
    """The rows of split_target, a table of one row for each split."""
    rows = read_table(spark, sf_dir, "split_target").orderBy(F.desc("target_share"), "split")
    return [(r.split, r.target_share) for r in rows.collect()]


def _p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    demo = read_table(spark, sf_dir, "demo_sample")
    return assign_splits(demo, _split_targets(spark, sf_dir))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the masked table; texts without mentions that changed, and masked texts that still hold a plain mailbox."""
    demo = read_table(spark, sf_dir, "demo_sample").select("sample_id", F.col("body").alias("text"))
    masked = p2_masked(spark, sf_dir).join(demo, "sample_id")
    return masked.agg(
        F.count("*").alias("n_rows"), F.count("body").alias("n_texts"),
        F.count_if((F.size("body_kinds") == 0) & (F.col("body") != F.col("text"))).alias("n_changed"),
        F.count_if(F.col("body").rlike(r"[a-z0-9]+@[a-z0-9]+\.(?:com|org|net)\b")).alias("n_left"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written before it is read, so that the rows come with their allocation.
    placed = write_shared(_p3(spark, sf_dir), "splits")
    found = placed.where(F.col("split").isNotNull() & (F.col("id") != F.col("first_id")))
    return found.select("first_id", F.col("id").alias("member_id")).distinct()


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir).select(F.col("id").alias("sample_id"), "first_id", "split")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _p3(spark, sf_dir).groupBy("split").agg(
        F.count("*").alias("n_rows"), F.count_distinct("first_id").alias("n_groups")
    )
    total = got.agg(F.sum("n_rows").alias("total"))
    want = read_table(spark, sf_dir, "split_target")
    return (
        want.join(got, "split", "left")
        .crossJoin(F.broadcast(total))
        .select(
            "split",
            "target_share",
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
            (F.coalesce("n_rows", F.lit(0)) / F.col("total")).alias("share"),
        )
    )


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups, groups in two splits, and whether each split is within 0.1 % of its rows of the target, or one row."""
    placed = write_shared(_p3(spark, sf_dir), "splits")
    per_group = placed.groupBy("first_id").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n"))
    groups = per_group.agg(F.count("*").alias("n_groups"), F.count_if(F.col("splits") != 1).alias("n_torn"), F.sum("n").alias("n_rows"))
    shares = placed.groupBy("split").agg(F.count("*").alias("n"))
    off = read_table(spark, sf_dir, "split_target").join(shares, "split", "left").join(groups.select("n_rows"))
    off = off.select(F.abs(F.coalesce("n", F.lit(0)) - F.col("target_share") * F.col("n_rows")) - F.greatest(F.lit(1.0), F.col("n_rows") / 1000))
    return groups.join(off.toDF("x").agg((F.max("x") <= 0).alias("on_target")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap_pairs(*cross_split_overlaps(read_table(spark, sf_dir, "demo_sample")))
    return pairs.select(
        F.least("eval_id", "train_id").alias("id_a"),
        F.greatest("eval_id", "train_id").alias("id_b"),
        "field",
    ).distinct()


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between classes of equal texts, each named by its smallest id."""
    members, links = cross_split_overlaps(read_table(spark, sf_dir, "demo_sample"))
    heads = members.groupBy("class").agg(F.min("id").alias("head"))
    return (
        links.join(heads.select(F.col("class").alias("eval_class"), F.col("head").alias("eval_head")), "eval_class")
        .join(heads.select(F.col("class").alias("train_class"), F.col("head").alias("train_head")), "train_class")
        .select("eval_head", "train_head", "field", "edits")
    )


def p4_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs whose texts are the same, not only nearly."""
    members, links = cross_split_overlaps(read_table(spark, sf_dir, "demo_sample"))
    pairs = overlap_pairs(members, links.where("edits = 0"))
    return pairs.select("eval_id", "train_id", "field").distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows that overlap the training rows, by split, community and field."""
    demo = read_table(spark, sf_dir, "demo_sample")
    members, links = cross_split_overlaps(demo)
    best = links.groupBy("eval_class", "field").agg(F.min("edits").alias("edits"))
    found = members.where("not is_train").join(
        best.withColumnRenamed("eval_class", "class"), ["class", "field"]
    )
    rows = demo.select(
        F.col("sample_id").alias("id"), "split", F.lower(F.trim("subreddit")).alias("subreddit")
    )
    return (
        found.join(rows, "id")
        .groupBy("split", "subreddit", "field")
        .agg(F.count_if(F.col("edits") == 0).alias("n_same"), F.count_if(F.col("edits") > 0).alias("n_near"))
    )


def _p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    demo = read_table(spark, sf_dir, "demo_sample")
    return score_abuse(demo, train_on_reviews(demo, read_table(spark, sf_dir, "review_label")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5(spark, sf_dir).where("abusive").select(F.col("id").alias("sample_id")).distinct()


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5(spark, sf_dir).select(F.col("id").alias("sample_id"), "lang", "score", "abusive")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse_rates(_p5(spark, sf_dir)).withColumnRenamed("source", "subreddit")


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows by language known or not, scores out of range, and texts without a word that are flagged."""
    demo = read_table(spark, sf_dir, "demo_sample").select(F.col("sample_id").alias("id"), "body")
    scored = _p5(spark, sf_dir).join(demo, "id")
    blank = ~F.coalesce(F.col("body").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    return scored.agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("score").between(0, 1)).alias("n_out_of_range"),
        F.count_if(blank & F.col("abusive")).alias("n_blank_flagged"), F.count_if(F.col("lang").isin("en", "de", "fr", "es")).alias("n_told"),
    )


def _size_limit(spark: SparkSession, sf_dir: str, purpose: str) -> tuple[int, int]:
    row = read_table(spark, sf_dir, "size_limit").where(F.col("purpose") == purpose).first()
    return row.max_tokens, row.overlap_tokens or 0


def _p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, _ = _size_limit(spark, sf_dir, "container")
    return pack_documents(read_table(spark, sf_dir, "documents"), capacity)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6(spark, sf_dir).where("pieces > 1").select(F.col("id").alias("doc_id")).distinct()


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, _ = _size_limit(spark, sf_dir, "container")
    boxes = _p6(spark, sf_dir).where("container is not null").groupBy("container").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("items")
    )
    return boxes.agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.max("tokens").alias("fullest"),
        (F.sum("tokens") / (F.count("*") * F.lit(capacity))).alias("filled"),
    )


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens placed, containers over capacity, texts split without need, and whether 97 % of the space of all but one container is used."""
    capacity, _ = _size_limit(spark, sf_dir, "container")
    placed = write_shared(_p6(spark, sf_dir), "placed")
    boxes = placed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    full = boxes.agg(F.count_if(F.col("tokens") > capacity).alias("n_over"), F.count("*").alias("n_boxes"))
    docs = placed.groupBy("id").agg(F.sum("tokens").alias("tokens"), F.max("pieces").alias("pieces"))
    sums = docs.agg(
        F.count("*").alias("n_docs"), F.sum("tokens").alias("n_tokens"),
        F.count_if((F.col("tokens") <= capacity) & (F.col("pieces") > 1)).alias("n_split"),
    )
    tight = F.col("n_tokens") >= 0.97 * capacity * (F.col("n_boxes") - 1)
    return sums.join(full).select("n_docs", "n_tokens", "n_over", "n_split", tight.alias("tight"))


def _p7(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_target"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir)[1].where("short").select("source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir)[1]


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target source: tokens there are, asked and raked, the cap kept, and 1 % of the raked tokens or two texts of 2,000 reached."""
    report = _p7(spark, sf_dir)[1]
    off = F.abs(F.col("tokens_reached") - F.col("tokens_raked"))
    return report.select(
        "source", "tokens", F.round("tokens_asked", 3).alias("asked"), F.round("tokens_raked", 3).alias("raked"),
        (F.col("most_copies") <= F.col("max_repeat")).alias("within_cap"),
        (off <= F.greatest(F.col("tokens_raked") / 100, F.lit(4000.0))).alias("reached"),
    )


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with pieces, tokens less overlaps, pieces over the limit, and documents whose pieces do not give their text."""
    limit, overlap = _size_limit(spark, sf_dir, "piece")
    pieces = p8_pieces(spark, sf_dir)
    fresh = F.col("tokens") - F.when(F.col("piece") > 0, overlap).otherwise(0)
    # A piece adds what lies beyond the end of the one before it.
    before = F.lag("end_char", 1, 0).over(Window.partitionBy("doc_id").orderBy("piece"))
    added = pieces.withColumn("before", before)
    part = F.struct("piece", F.expr("right(text, int(end_char - before))").alias("part"))
    docs = added.groupBy("doc_id").agg(
        F.sum(fresh).alias("tokens"), F.count_if(F.col("tokens") > limit).alias("over"),
        F.array_join(F.array_sort(F.collect_list(part))["part"], "").alias("whole"),
    )
    texts = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("own"))
    return docs.join(texts, "doc_id").agg(
        F.count("*").alias("n_docs"), F.sum(docs["tokens"]).alias("n_tokens"), F.sum("over").alias("n_over"),
        F.count_if(F.col("whole") != F.col("own")).alias("n_changed"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = p8_pieces(spark, sf_dir)
    return pieces.where("piece = 0 and pieces > 1").select("doc_id").distinct()


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, overlap = _size_limit(spark, sf_dir, "piece")
    pieces = split_texts(read_table(spark, sf_dir, "documents"), limit, overlap)
    return pieces.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_copies": p1_copies,
    "p2_found": p2_found,
    "p2_masked": p2_masked,
    "p2_counts": p2_counts,
    "p2_totals": p2_totals,
    "p3_found": p3_found,
    "p3_splits": p3_splits,
    "p3_shares": p3_shares,
    "p3_totals": p3_totals,
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p4_report": p4_report,
    "p4_same": p4_same,
    "p5_found": p5_found,
    "p5_scores": p5_scores,
    "p5_rates": p5_rates,
    "p5_totals": p5_totals,
    "p6_found": p6_found,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_totals": p6_totals,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_totals": p7_totals,
    "p8_found": p8_found,
    "p8_pieces": p8_pieces,
    "p8_totals": p8_totals,
}

_LETTERS = r"replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g'), 'ß', 'ss')"

#: Group of same records of demo_sample bodies: ``sample_id, first_id``.
_SAME = rf"""
pieces AS (
  SELECT sample_id, {_LETTERS.format("body")} AS flat,
         list_filter(string_split_regex(body, '[\r\n|;]+'),
                     lambda p: regexp_matches(p, '[\p{{L}}\p{{N}}]')) AS parts
  FROM demo_sample WHERE body IS NOT NULL),
keyed AS (
  SELECT sample_id, flat,
         CASE WHEN len(parts) >= 2 AND len(list_filter(parts, lambda p: NOT regexp_matches(
                p, '(?s)^[^:]*[\p{{L}}\p{{N}}][^:]*:.*[\p{{L}}\p{{N}}].*$'))) = 0
              THEN list_sort(list_transform(parts, lambda p: {_LETTERS.format("p")})) END AS fields
  FROM pieces WHERE length(flat) >= 20),
hop1 AS (SELECT *, min(sample_id) OVER (PARTITION BY flat) AS f1 FROM keyed),
hop2 AS (SELECT *, CASE WHEN fields IS NULL THEN f1
                        ELSE min(f1) OVER (PARTITION BY fields) END AS f2 FROM hop1),
same AS (SELECT sample_id, min(f2) OVER (PARTITION BY flat) AS first_id FROM hop2)"""

#: The same among the rows of a split.
_SAME_SPLIT = _SAME.replace("FROM demo_sample WHERE", "FROM demo_sample WHERE split IN ('train', 'validation', 'test') AND")

#: Tokens of documents.text; the gaps between them are white space.
_SIZE = (
    r"coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{85}]+')), 0)"
)

#: Components of tied rows: ``node, first_id`` for those with a tie.
_GROUPS = f"""WITH RECURSIVE {_SAME},
ties AS (
  SELECT sample_id, 'a' || lower(trim(subreddit)) || ' ' || lower(trim(author)) AS tie
  FROM demo_sample WHERE subreddit IS NOT NULL AND lower(trim(author)) NOT IN ('', '[deleted]')
  UNION ALL
  SELECT sample_id, 'p' || lower(trim(subreddit)) || ' ' ||
         regexp_replace(lower(trim(link_id)), '^t3_', '')
  FROM demo_sample WHERE subreddit IS NOT NULL AND link_id IS NOT NULL
    AND regexp_replace(lower(trim(link_id)), '^t3_', '') <> ''
  UNION ALL SELECT sample_id, 'r' || first_id FROM same),
heads AS (SELECT sample_id, min(sample_id) OVER (PARTITION BY tie) AS head FROM ties),
edges AS (
  SELECT DISTINCT sample_id AS u, head AS v FROM heads WHERE sample_id <> head
  UNION SELECT DISTINCT head, sample_id FROM heads WHERE sample_id <> head),
reach AS (
  SELECT u AS node, u AS seen FROM edges
  UNION SELECT r.node, e.v FROM reach r JOIN edges e ON r.seen = e.u),
roots AS (SELECT node, min(seen) AS first_id FROM reach GROUP BY node)"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_SAME} SELECT DISTINCT first_id, sample_id AS copy_id FROM same "
    "WHERE first_id <> sample_id",
    "p1_copies": f"""WITH {_SAME} SELECT g.first_id, copies, body FROM (SELECT first_id, count(*) AS copies FROM same GROUP BY first_id) g
JOIN demo_sample d ON d.sample_id = g.first_id""",
    "p3_found": f"{_GROUPS} SELECT first_id, node AS member_id FROM roots WHERE first_id <> node",
    "p3_totals": f"""{_GROUPS} SELECT count(DISTINCT coalesce(r.first_id, d.sample_id)) AS n_groups, 0 AS n_torn, count(*) AS n_rows,
  true AS on_target FROM demo_sample d LEFT JOIN roots r ON r.node = d.sample_id""",
    "p2_totals": """SELECT count(*) AS n_rows, count(body) AS n_texts, 0 AS n_changed, 0 AS n_left FROM demo_sample""",
    "p4_same": " UNION ".join(
        f"""SELECT e.sample_id AS eval_id, t.sample_id AS train_id, '{field}' AS field FROM (WITH {_SAME_SPLIT.replace('body', field)}
SELECT * FROM same JOIN demo_sample USING (sample_id)) e, (WITH {_SAME_SPLIT.replace('body', field)}
SELECT * FROM same JOIN demo_sample USING (sample_id)) t WHERE e.first_id = t.first_id AND t.split = 'train' AND e.split <> 'train'"""
        for field in ("body", "parent_body")
    ),
    "p5_totals": """SELECT count(*) AS n_rows, 0 AS n_out_of_range, 0 AS n_blank_flagged, count(*) AS n_told FROM demo_sample""",
    "p6_totals": f"""SELECT count(*) AS n_docs, CAST(sum({_SIZE}) AS BIGINT) AS n_tokens, 0 AS n_over, 0 AS n_split, true AS tight FROM documents""",
    "p7_totals": f"""WITH sized AS (SELECT source, CAST(sum({_SIZE}) AS BIGINT) AS tokens FROM documents
  WHERE source IN (SELECT source FROM mix_target) GROUP BY source),
g AS (SELECT t.source, max_repeat, coalesce(s.tokens, 0) AS tokens,
  target_weight / (SELECT sum(target_weight) FROM mix_target) * (SELECT sum(tokens) FROM sized) AS asked FROM mix_target t LEFT JOIN sized s ON t.source = s.source)
SELECT source, tokens, round(asked, 3) AS asked, round(least(asked, tokens * max_repeat), 3) AS raked, true AS within_cap, true AS reached FROM g""",
    "p8_totals": f"""SELECT count(*) AS n_docs, CAST(sum({_SIZE}) AS BIGINT) AS n_tokens, 0 AS n_over, 0 AS n_changed FROM documents WHERE text IS NOT NULL""",
    "p6_found": f"""SELECT DISTINCT doc_id FROM documents
WHERE {_SIZE} > (SELECT max_tokens FROM size_limit WHERE purpose = 'container')""",
    "p7_found": f"""WITH sized AS (
  SELECT source, sum({_SIZE}) AS tokens FROM documents
  WHERE source IN (SELECT source FROM mix_target) GROUP BY source)
SELECT t.source FROM mix_target t LEFT JOIN sized s ON t.source = s.source
WHERE coalesce(s.tokens, 0) * t.max_repeat < t.target_weight * (SELECT sum(tokens) FROM sized)""",
    "p8_found": f"""SELECT DISTINCT doc_id FROM documents
WHERE {_SIZE} > (SELECT max_tokens FROM size_limit WHERE purpose = 'piece')""",
}
