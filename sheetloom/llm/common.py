"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in every contract of this subpackage.
SPACE = r"\x20\x09-\x0D"
#: Characters that count as symbols in the quality rules.
SYMBOLS = "#*$%&|<>"


def ready(spark: SparkSession) -> SparkSession:
    """Make sure that checkpoints have a folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``; only where that is unset, as in
    local tests, a temporary folder is used.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)  # workers find the package wherever the driver was started
    # Intermediate tables are written out, so the shuffles of a finished job are never read again.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table in the checkpoint folder: compressed, and read by column."""
    spark = ready(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``store`` wrote and nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row and bound to a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text: maximal runs of anything but the six ASCII separators; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no training may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")
