"""Session settings shared by tests, the bench and notebooks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find the package wherever the driver was started; clusters ship it themselves."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared one in ``spark.checkpoint.dir``, or below a temporary one where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    return f"{top}/{uuid.uuid4().hex}"


def local_session(cpus: int = 8, app: str = "sheetloom", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
