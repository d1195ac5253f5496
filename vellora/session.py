"""Session and table helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "vellora", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; an existing session is reused."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else $VELLORA_SHARED_DIR; a temporary one in local mode only."""
    d = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("VELLORA_SHARED_DIR")
    if d:
        return d
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="vellora-")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back, so that a lost executor costs no recomputation above it.

    This runs a job at once. The files go when the result is no longer referred to, if
    spark.cleaner.referenceTracking.cleanCheckpoints is set, as ``session`` does.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
