"""Session settings that every plan in this package relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app_name: str = "barlake", master: str | None = None, **extra: str) -> SparkSession:
    """Return a session with the package's settings.

    ``master`` is only for local work; on a cluster it comes from spark-submit.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        cores = os.cpu_count() or 8
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(min(cores, 16)))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
