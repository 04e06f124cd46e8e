"""A Spark session with the settings the engine expects."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "tidemark", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benches; a cluster brings its own and keeps its own sizes."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings of the session (``__`` for a point) for what runs within."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
