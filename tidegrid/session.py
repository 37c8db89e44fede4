"""Session settings this package relies on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("tidegrid")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder.

    The cluster names the shared folder in ``spark.checkpoint.dir``; a temporary folder is
    used only on a local master that names none.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="tidegrid-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def held(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder by columns and read back: many rows take a fraction of
    the disk that a checkpoint of whole rows does. It stays until the folder is cleared."""
    folder = f"{shared_folder(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A join side that is written out once and broadcast only when counted to be small.

    Beyond the limit it stays a plain side: the shuffled join then relies on skew splitting.
    """
    held = cut(df)
    return F.broadcast(held) if held.count() <= limit else held


def calendar(df: DataFrame, day: str = "date") -> DataFrame:
    """Distinct days as a broadcast side: a table no longer than the calendar of the data."""
    return F.broadcast(df.select(day).where(F.col(day).isNotNull()).distinct())
