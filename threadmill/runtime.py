"""Session, table and checkpoint helpers used by every operator."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    session within one process, as in tests, makes a folder of this machine and
    sets it as the context's checkpoint directory; on a cluster it is an error.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="threadmill-")
    spark.sparkContext.setCheckpointDir(made)
    return shared_dir(spark)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions inside leave no shuffle files behind; a table that is read again is made again."""
    before = spark.conf.get(CLEAN_KEY, "false")
    spark.conf.set(CLEAN_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_KEY, before)


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back.

    The written table cuts the lineage and survives the loss of executors, so
    a plan that reads an intermediate result several times, or once for each
    iteration, does not compute it again. The shuffle files that made it are
    removed when it is there, so that a chain of steps holds one step's files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(df: DataFrame) -> None:
    """Delete a table made by :func:`write_shared` that is no longer read."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(os.path.dirname(file))
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def task_count(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the width of an explicit exchange."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
