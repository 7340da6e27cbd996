"""Session helpers: table access, reliable lineage cuts and bounded collects."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "vulnlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is designed for (AQE, UTC, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in which lineage is cut: the session's ``spark.checkpoint.dir``.

    Where that is unset and all tasks run inside this process (master ``local`` or
    ``local[n]``, as in tests), a temporary folder is made and remembered; on a
    cluster there is no folder all executors share, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vulnlake-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that are over. Spark removes them only when
    the driver collects its garbage, which a driver with little to do does late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_partitions(df: DataFrame) -> int:
    """Shuffle partitions to use for a range shuffle of ``df``."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blank_to_null(column):
    """Trimmed text, or null where nothing but white space is left."""
    text = F.regexp_replace(column, r"^[\s 　﻿]+|[\s 　﻿]+$", "")
    return F.when(F.length(text) > 0, text)
