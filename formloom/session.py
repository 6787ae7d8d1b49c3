"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "formloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides, with _ for . in the names."""
    b = SparkSession.builder.appName(app).master(master or f"local[{os.cpu_count()}]")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (defaults | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
