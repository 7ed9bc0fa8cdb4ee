"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "scenelake", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; cluster settings come from the environment unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (own | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
