"""Scorers: a model behind ``mapInPandas``, loaded once for each partition.

A scorer is ``make() -> score``, where ``score`` takes a pandas frame of prompts
and returns one with ``raw`` and optionally log probabilities. The shipped
scorer is the length rule; a model server or an API client has the same form.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Score = Callable[[pd.DataFrame], pd.DataFrame]
OUTPUT = "raw string, lp_true double, lp_false double, error string"


def score_prompts(
    df: DataFrame, make: Callable[[], Score], key: str = "id", prompt: str = "prompt",
    per_minute: float | None = None, max_errors: int = 5,
) -> DataFrame:
    """``(key, raw, lp_true, lp_false, error)`` for each prompt.

    ``per_minute`` paces a partition's calls; repartition to the number of
    clients first. A failed batch gives rows with ``error`` instead of a lost
    task; after ``max_errors`` failed batches in a row the partition gives up.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, failed, due = make(), 0, time.monotonic()
        for pdf in batches:
            if per_minute:
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + 60.0 / per_minute * len(pdf)
            out = pd.DataFrame({key: pdf[key], "raw": None, "lp_true": None, "lp_false": None, "error": None})
            if failed >= max_errors:
                out["error"] = "ERROR: gave up"
            else:
                try:
                    got = score(pdf)
                    failed = 0
                    for c in got.columns:
                        out[c] = got[c].to_numpy()
                except Exception as e:  # noqa: BLE001 - any failure of a model becomes a row
                    failed += 1
                    out["error"] = f"ERROR: {e}"
            for c in ("lp_true", "lp_false"):
                out[c] = pd.to_numeric(out[c])
            yield out[[key, "raw", "lp_true", "lp_false", "error"]]

    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, {OUTPUT}")


def length_rule(threshold: int, short_is_removed: bool = True) -> Callable[[], Score]:
    """A scorer that answers by the number of words of the prompt."""

    def make() -> Score:
        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            words = pdf["prompt"].fillna("").map(lambda t: len(t.split()))
            yes = (words < threshold) if short_is_removed else (words >= threshold)
            return pd.DataFrame({"raw": yes.map({True: "True", False: "False"})})

        return score

    return make
