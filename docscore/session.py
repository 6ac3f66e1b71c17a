"""A Spark session with the settings that the engine's plans expect."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "docscore", **conf: str) -> SparkSession:
    """UTC, ANSI mode, AQE with skew joins; further settings override these."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder that spark.checkpoint.dir names and go on from there. On a
    cluster it must be set; a folder of our own is used in local mode only."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "docscore-checkpoints"))
    return df.checkpoint(eager=True)
