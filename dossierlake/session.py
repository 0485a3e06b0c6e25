"""SparkSession factory with the settings that every query relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "dossierlake", master: str | None = None, partitions: int | None = None, **extra: str) -> SparkSession:
    """A session in UTC with AQE. `master` and `partitions` are for local runs; a cluster's own settings win when they are left out."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | extra)
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("DOSSIERLAKE_DRIVER_MEMORY", "8g"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
