"""An author's history before each comment, by window functions.

Order within an author is ``(created_utc, row_id)``; the history of a row are
the rows strictly before it in that order. The thread counters use the number
of a row within its author and thread, so no window holds a set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.operators.ordered import null_safe

DAY = 86_400
#: Rows of an author that one window may hold.
HOT_ROWS = 500_000


def author_history(
    df: DataFrame, author: str = "author", time: str = "created_utc", thread: str = "link_id",
    score: str = "score", order: str = "row_id", hot: int = HOT_ROWS,
) -> DataFrame:
    """Adds ``n_prior, vel_24h, avg_score, unique_threads, days_active, is_first, max_in_thread``.

    A null score counts as 1. ``vel_24h`` counts earlier rows less than a day
    old, those of the same second that come before included. ``avg_score`` and
    ``days_active`` are rounded to one digit.

    Authors with more than ``hot`` rows, the missing and the deleted author
    among them, are cut into days, and what earlier days hold is carried over;
    all others have one window each. Rows without a time are the earliest.
    """
    busy = (
        df.groupBy(F.col(author).alias("_busy")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot).select("_busy")
    )
    same = df[author].eqNullSafe(busy["_busy"])
    names = (author, time, thread, score, order)
    quiet = _whole_history(df.join(busy, same, "left_anti"), *names)
    return quiet.unionByName(_daily_history(df.join(busy, same, "left_semi"), *names))


def _whole_history(df: DataFrame, author: str, time: str, thread: str, score: str, order: str) -> DataFrame:
    ordered = Window.partitionBy(author).orderBy(time, order)
    prior = ordered.rowsBetween(Window.unboundedPreceding, -1)
    in_thread = Window.partitionBy(author, thread).orderBy(time, order)
    last_day = Window.partitionBy(author).orderBy(time).rangeBetween(-DAY + 1, -1)
    same_second = Window.partitionBy(author, time).orderBy(order)
    # The two windows by (author, thread) and (author, time) are satisfied by
    # an exchange on author alone, so one shuffle serves all.
    numbered = df.repartition(author).withColumn("_k", F.row_number().over(in_thread))
    return numbered.withColumns(
        {
            "n_prior": (F.row_number().over(ordered) - 1).cast("long"),
            "vel_24h": F.count("*").over(last_day) + F.row_number().over(same_second) - 1,
            "avg_score": F.round(F.coalesce(F.avg(F.coalesce(score, F.lit(1))).over(prior), F.lit(0.0)), 1),
            "unique_threads": F.coalesce(F.sum((F.col("_k") == 1).cast("long")).over(prior), F.lit(0)),
            "days_active": F.round((F.col(time) - F.first(time).over(ordered)) / float(DAY), 1),
            "is_first": F.row_number().over(ordered) == 1,
            "max_in_thread": F.coalesce(F.max("_k").over(prior), F.lit(0)).cast("long"),
        }
    ).drop("_k")


def _daily_history(df: DataFrame, author: str, time: str, thread: str, score: str, order: str) -> DataFrame:
    """The same by (author, day): windows within a day, and offsets from the days before it.

    A day holds its rows and, for the count of the last 24 hours, those of the
    day before, which take no part otherwise.
    """
    rows = df.withColumns({"_day": F.floor(F.col(time) / DAY), "_points": F.coalesce(score, F.lit(1)).cast("long")})
    # The number of a row within its thread, from its number within the day.
    threads = rows.groupBy(F.col(author).alias("_a"), F.col(thread).alias("_th"), F.col("_day").alias("_d")).agg(
        F.count("*").alias("_c")
    )
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_a", "_th").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    threads = threads.select("_a", "_th", "_d", before.alias("_seen"))
    keys = [(author, "_a"), (thread, "_th"), ("_day", "_d")]
    in_thread = Window.partitionBy(author, "_day", thread).orderBy(time, order)
    numbered = rows.join(threads, null_safe(rows, threads, keys)).drop("_a", "_th", "_d")
    numbered = numbered.withColumn("_k", F.row_number().over(in_thread) + F.col("_seen")).drop("_seen")

    days = numbered.groupBy(F.col(author).alias("_a"), F.col("_day").alias("_d")).agg(
        F.count("*").alias("_n"), F.sum("_points").alias("_p"), F.count_if(F.col("_k") == 1).alias("_u"),
        F.max("_k").alias("_m"), F.min(time).alias("_f"),
    )
    past = Window.partitionBy("_a").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(
        "_a", "_d",
        *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}0") for c in ("_n", "_p", "_u")],
        F.coalesce(F.max("_m").over(past), F.lit(0)).alias("_m0"),
        F.first("_f").over(Window.partitionBy("_a").orderBy("_d")).alias("_f0"),
    )
    copies = numbered.withColumn("_copy", F.explode(F.when(F.col("_day").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))).withColumn("_day", F.col("_day") + F.col("_copy"))
    here = Window.partitionBy(author, "_day")
    first_own = Window.partitionBy(author, "_day", "_copy").orderBy(time, order)
    behind = first_own.rowsBetween(Window.unboundedPreceding, -1)
    joined = copies.join(carried, null_safe(copies, carried, [(author, "_a"), ("_day", "_d")]), "left").drop("_a", "_d")
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    n = F.row_number().over(first_own) - 1 + F.col("_n0")
    done = joined.withColumns(
        {
            "n_prior": n.cast("long"),
            "vel_24h": F.count("*").over(here.orderBy(time).rangeBetween(-DAY + 1, -1))
            + F.row_number().over(Window.partitionBy(author, "_day", "_copy", time).orderBy(order)) - 1,
            "avg_score": F.round(F.coalesce(F.try_divide((total("_points", behind) + F.col("_p0")).cast("double"), n), F.lit(0.0)), 1),
            "unique_threads": total((F.col("_k") == 1).cast("long"), behind) + F.col("_u0"),
            "days_active": F.round((F.col(time) - F.col("_f0")) / float(DAY), 1),
            "is_first": n == 0,
            "max_in_thread": F.greatest(F.coalesce(F.max("_k").over(behind), F.lit(0)), F.col("_m0")).cast("long"),
        }
    )
    return done.where("_copy = 0").drop("_day", "_points", "_k", "_copy", "_n0", "_p0", "_u0", "_m0", "_f0")


def history_of(df: DataFrame, targets: DataFrame, key: str = "id") -> DataFrame:
    """History features of some rows; the history itself still reads all rows."""
    return author_history(df).join(targets.select(key).distinct(), key, "left_semi")


def history_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count_if("is_first").alias("first_timers"),
        F.avg("n_prior").alias("mean_prior"),
        F.max("vel_24h").alias("max_velocity"),
    )


def thread_size(df: DataFrame, link: str = "link_id") -> DataFrame:
    """Adds the rows of the same post: aggregate and join back, which AQE can cut for a hot post."""
    sizes = df.groupBy(link).agg(F.count("*").alias("thread_comment_count_local"))
    return df.join(sizes, link)


def rolling_loss(df: DataFrame, step: str = "step", loss: str = "loss", by: str = "run") -> DataFrame:
    """Mean loss over a trailing frame; runs of at most ten points stay as they are.

    The frame is the row and the ``max(5, n // 20)`` rows before it, which
    depends on the run's length n; each run is summed by prefix, so that frames
    of different width need one window only.
    """
    ordered = Window.partitionBy(by).orderBy(step)
    n = F.count("*").over(Window.partitionBy(by))
    numbered = df.withColumns(
        {"_i": F.row_number().over(ordered), "_n": n, "_s": F.sum(loss).over(ordered)}
    ).withColumn("_w", F.greatest(F.lit(5), F.floor(F.col("_n") / 20)))
    back = numbered.select(by, F.col("_i").alias("_j"), F.col("_s").alias("_before"))
    joined = numbered.withColumn("_j", F.col("_i") - F.col("_w") - 1).join(back, [by, "_j"], "left")
    mean = (F.col("_s") - F.coalesce("_before", F.lit(0.0))) / F.least("_i", F.col("_w") + 1)
    return joined.withColumn(
        "rolling", F.when(F.col("_n") > 10, mean).otherwise(F.col(loss))
    ).drop("_i", "_j", "_n", "_s", "_w", "_before")


def best_checkpoint(df: DataFrame, by: str = "run", step: str = "step", loss: str = "eval_loss") -> DataFrame:
    """The first step with the smallest loss."""
    return df.where(F.col(loss).isNotNull()).groupBy(by).agg(
        F.min_by(step, F.struct(loss, step)).alias("best_step"), F.min(loss).alias("best_loss")
    )
