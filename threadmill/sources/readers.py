"""Readers. All are lazy but for the small configuration files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.functions.text import strip
from threadmill.sources.schemas import PREDICTION, RAW_COMMENT


def read_ndjson(spark: SparkSession, path: str, schema: str = RAW_COMMENT) -> DataFrame:
    """One JSON object a line; blank and malformed lines are skipped.

    A field of another type than its column becomes null, the row stays. The
    whole object is kept as VARIANT in ``extra``.
    """
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    parsed = lines.select(F.try_parse_json("value").alias("extra")).where("extra is not null")
    fields = spark.createDataFrame([], schema).schema
    cols = [
        F.try_variant_get("extra", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields
    ]
    return parsed.where(F.schema_of_variant("extra").startswith("OBJECT")).select(*cols, "extra")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: blank lines are skipped, a line that does not parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_extracted(
    spark: SparkSession, path: str, schema: str = RAW_COMMENT, one_object: bool = True
) -> DataFrame:
    """``{"removed": [...], "approved": [...]}`` as rows with ``category``; a missing array is empty.

    A file holds one object, or one object a line.
    """
    shape = f"removed array<struct<{_struct(schema)}>>, approved array<struct<{_struct(schema)}>>"
    whole = spark.read.schema(shape).option("multiLine", one_object).json(path)
    parts = [
        whole.select(F.inline(c), F.lit(c).alias("category")) for c in ("removed", "approved")
    ]
    return parts[0].unionByName(parts[1])


def _struct(schema: str) -> str:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            name, _, kind = schema[start:i].strip().partition(" ")
            out.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(out)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(target)
    return bool(found)


def read_side_table(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A JSON object keyed by id as ``(key, fields...)``; a missing file is an empty table.

    ``value`` is the type of an entry, a struct or ``string``.
    """
    shape = f"{key} string, value {value}"
    if not _exists(spark, path):
        empty = spark.createDataFrame([], shape)
    else:
        raw = spark.read.text(path, wholetext=True)
        entries = F.from_json("value", f"map<string, {value}>")
        empty = raw.select(F.explode(entries).alias(key, "value"))
    return empty.select(key, "value.*") if value.startswith("struct") else empty


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``, stripped; a missing file gives one row with an empty text."""
    if not _exists(spark, path):
        return spark.createDataFrame([(path, "")], "path string, text string")
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("text")
    )


def read_ids(spark: SparkSession, path: str, suffix: str = "_test_ids.txt", comments: bool = False) -> DataFrame:
    """One id a line, ``(subreddit, id)``; blank lines, and ``#`` lines if asked, are dropped."""
    rows = spark.read.text(path).select(
        F.replace(F.col("_metadata.file_name"), F.lit(suffix), F.lit("")).alias("subreddit"),
        strip(F.col("value")).alias("id"),
    )
    rows = rows.where("id <> ''")
    return rows.where(~F.col("id").startswith("#")) if comments else rows


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """``body, subreddit, removed, context`` as labelled rows; ``removed`` must be True or False.

    The index is the row's number in its file, which needs one task a file.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    label = (
        F.when(F.col("removed") == "True", "removed")
        .when(F.col("removed") == "False", "approved")
        .otherwise(F.raise_error(F.concat(F.lit("bad label: "), F.coalesce("removed", F.lit("null")))))
    )
    order = F.monotonically_increasing_id()
    rows = raw.select("body", "subreddit", label.alias("label"), F.coalesce("context", F.lit("")).alias("parent_body"),
                      F.col("_metadata.file_path").alias("_file"), order.alias("_o"))
    index = F.row_number().over(Window.partitionBy("_file").orderBy("_o")) - 1
    return rows.withColumn("idx", index).drop("_file", "_o")


def discover(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``(path, stem)`` of files below a folder, by name."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path")
    )
    return files.withColumn("stem", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).orderBy("path")


def read_predictions(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """Prediction files with the metadata of their ``<stem>.json`` companions, else the folder's name."""
    rows = (
        spark.read.schema(PREDICTION)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .json(folder)
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    rows = rows.withColumns(
        {"stem": F.regexp_extract("_path", r"([^/]+)\.[^./]*$", 1), "folder": F.regexp_extract("_path", r"([^/]+)/[^/]*$", 1)}
    )
    meta = (
        spark.read.schema("model string, subreddit string, method string, condition string")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("multiLine", True)
        .json(folder)
        .select(
            F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^./]*$", 1).alias("stem"),
            "model", "subreddit", F.coalesce("method", "condition").alias("method"),
        )
    )
    joined = rows.join(meta, "stem", "left")
    return joined.withColumn("subreddit", F.coalesce("subreddit", "folder")).drop("_path", "folder")


def read_metrics(spark: SparkSession, path: str, schema: str, suffix: str = "_metrics.json") -> DataFrame:
    """One JSON object a file, with the community from the file name, what follows its first
    underscore; unreadable files give no row."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(
        F.regexp_extract(F.replace(F.col("_metadata.file_name"), F.lit(suffix), F.lit("")), r"^(?:[^_]*_)?(.+)$", 1).alias("community"),
        F.from_json("value", schema).alias("m"),
    ).where(F.coalesce(*[F.col(f"m.{f.split()[0]}").cast("string") for f in schema.split(", ")]).isNotNull()).select("community", "m.*")


def read_loss_log(spark: SparkSession, path: str) -> DataFrame:
    """``(run, step, loss, eval_loss)`` of log lines that are single-quoted dicts with ``'loss'``;
    a missing step is ten for each point so far."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("run"), F.col("value"), F.monotonically_increasing_id().alias("_o")
    )
    shape = "loss double, eval_loss double, step long, epoch double"
    points = lines.where(F.trim("value").startswith("{") & F.col("value").contains("'loss'")).select(
        "run", "_o", F.from_json(F.replace("value", F.lit("'"), F.lit('"')), shape).alias("p")
    ).where("p.loss is not null or p.eval_loss is not null")
    count = F.row_number().over(Window.partitionBy("run").orderBy("_o"))
    return points.select("run", F.coalesce("p.step", count * 10).alias("step"), "p.loss", "p.eval_loss")


def read_train_meta(spark: SparkSession, path: str) -> DataFrame:
    """``log_history`` of a training summary: points with a loss, and with an evaluation loss."""
    point = "step long, loss double, eval_loss double, epoch double"
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", f"log_history array<struct<{_struct(point)}>>")
    return raw.select(F.col("_metadata.file_name").alias("run"), F.inline(entries.getField("log_history")))


def read_config(spark: SparkSession, path: str) -> list[str]:
    """Communities of a configuration file, in any storage: ``subreddits``, else ``seen`` and ``unseen``."""
    config = json.loads(spark.read.text(path, wholetext=True).first().value)
    return config.get("subreddits") or [*config.get("seen", []), *config.get("unseen", [])]


def order_list(items: list[str], first: list[str], skip: list[str]) -> list[str]:
    """Priority items to the head in their order, skipped ones out."""
    head = [x for x in first if x in items and x not in skip]
    return head + [x for x in items if x not in head and x not in skip]


