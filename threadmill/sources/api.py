"""Paged and by-id services as tables. The client is plugged in; there is no network code here.

A client is made once for each partition. Work is spread by rows of a DataFrame
(community and time slice, or id), so the number of partitions is the number of
concurrent clients.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 100
EMPTY_PAGES = 2


def with_retries(call: Callable[[], list[dict]], tries: int = 3, wait: float = 10.0) -> list[dict] | None:
    """The call's result, or null after so many failures; waits double."""
    for n in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001 - a service fails in many ways
            if n + 1 < tries:
                time.sleep(wait * 2**n)
    return None


def fetch_pages(
    slices: DataFrame,
    make_client: Callable[[], Callable[[str, int, int], list[dict]]],
    schema: str,
    limit: int = 750_000,
    wait: float = 10.0,
) -> DataFrame:
    """Rows of each ``(subreddit, after, before)`` slice, ascending in time.

    ``client(subreddit, after, before)`` gives at most a page of records with
    ``id`` and ``created_utc``; the next page starts at the last stamp, two
    pages without a new record end the slice, and so does ``limit``. Records of
    a border second come twice and are dropped by id.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            for sub, after, before in pdf[["subreddit", "after", "before"]].itertuples(index=False):
                got, empty, border = 0, 0, set()
                while got < limit and empty < EMPTY_PAGES:
                    page = with_retries(lambda s=sub, a=after, b=before: client(s, int(a), int(b)), wait=wait) or []
                    fresh = [r for r in page if r["id"] not in border][: limit - got]
                    if not fresh:
                        empty += 1
                        continue
                    empty, got = 0, got + len(fresh)
                    after = fresh[-1]["created_utc"]
                    border = {r["id"] for r in page if r["created_utc"] == after}
                    yield pd.DataFrame(fresh, columns=names)

    names = [f.name for f in slices.sparkSession.createDataFrame([], schema).schema]
    return slices.mapInPandas(run, schema).dropDuplicates(["id"])


def fetch_by_ids(
    ids: DataFrame, make_client: Callable[[], Callable[[list[str]], list[dict]]], schema: str, key: str = "id", wait: float = 10.0
) -> DataFrame:
    """Records of ids in batches of a page; a batch that keeps failing is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            wanted = pdf[key].tolist()
            for lo in range(0, len(wanted), PAGE):
                got = with_retries(lambda part=wanted[lo : lo + PAGE]: client(part), wait=wait)
                if got:
                    yield pd.DataFrame(got, columns=names)

    names = [f.name for f in ids.sparkSession.createDataFrame([], schema).schema]
    return ids.select(key).where(F.col(key).isNotNull()).distinct().mapInPandas(run, schema)


def resume_points(slices: DataFrame, stored: DataFrame) -> DataFrame:
    """Slices that start where the stored rows of their community end."""
    last = stored.groupBy("subreddit").agg(F.max("created_utc").alias("_last"))
    joined = slices.join(last, "subreddit", "left")
    return joined.withColumn("after", F.greatest("after", F.coalesce("_last", F.lit(0)))).drop("_last")
