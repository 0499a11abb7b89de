"""Stage outputs: rows kept in the folder that the cluster names for checkpoints, read again by the next stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder for checkpoints. One is made only where the session names none and runs on this machine alone, as in tests."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def folder(spark: SparkSession) -> str:
    """The name of a new folder beside the checkpoints."""
    return f"{shared(spark)}/stage-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written once as Parquet, so that a reader takes only the columns it needs.

    Parquet lets later plans push projections and filters down to it. The folder stays until the shared one is cleared.
    """
    spark, to = df.sparkSession, folder(df.sparkSession)
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)
