"""Sinks. User names never reach a published table: ``public`` drops them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIVATE = ("author", "author_fullname", "author_flair_text")


def public(df: DataFrame) -> DataFrame:
    return df.drop(*PRIVATE)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_files(df: DataFrame, path: str, name: str = "name", text: str = "text", compression: str | None = None) -> DataFrame:
    """One file below ``path`` for each row, named by it, optionally compressed; gives the files' names.

    It is written when the result is read. A repeated task writes its files anew.
    """
    from threadmill.sources.zstd_dump import filesystem

    def run(batches):
        store, folder = filesystem(path)
        for pdf in batches:
            for file, body in pdf.itertuples(index=False):
                target = f"{folder}/{file}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(target, compression=compression) as out:
                    out.write(body.encode())
            yield pdf[["name"]]

    return df.select(F.col(name).alias("name"), F.col(text).alias("text")).mapInPandas(run, "name string")


def append_comments(df: DataFrame, path: str) -> None:
    """Append by community and month; later readers take the newest delivery of an id."""
    month = F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM")
    df.withColumn("month", month).write.mode("append").partitionBy("subreddit", "month").parquet(path)


def append_missing(needed: DataFrame, cached: DataFrame, key: str, path: str) -> None:
    """Append rows whose key the cache does not hold."""
    needed.join(cached.select(key), key, "left_anti").write.mode("append").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Nothing happens where the result is there already."""
    df.write.mode("ignore").parquet(path)


def resumable(previous: DataFrame, inputs: DataFrame, key: str, good: Column) -> tuple[DataFrame, DataFrame]:
    """Results to keep and inputs still to do."""
    kept = previous.where(F.coalesce(good, F.lit(False)))
    return kept, inputs.join(kept.select(key), key, "left_anti")


def write_metrics(df: DataFrame, path: str, keys: list[str]) -> None:
    """One JSON object a row, the statistics nested under ``metrics``."""
    rest = [c for c in df.columns if c not in keys]
    df.select(*keys, F.struct(*rest).alias("metrics")).write.mode("overwrite").json(path)


def write_summary_csv(df: DataFrame, path: str, columns: list[str], order: str) -> None:
    """One CSV file with a header and fixed columns; a summary has few rows, none included."""
    df.select(*columns).orderBy(order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def copy_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
