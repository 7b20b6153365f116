"""Session construction shared by tests, bench and applications."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "fluvigrid", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; ANSI mode keeps its default (on).

    ``master`` is only set when given, so on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
