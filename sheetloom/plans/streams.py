"""Streaming queries: the given tables as file streams, run to their end, results as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..streaming import streams as Z
from . import fixtures as fx
from . import pages


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parquet*")


def _finished(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The last state of a complete-mode aggregate, written by every micro-batch in place of the one before."""
    out = scratch(spark)
    query = df.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/table")).option("checkpointLocation", f"{out}/state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/table")


def z2_review_state(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("record_id"), F.col("event_type").alias("action"), "event_id")
    return _finished(spark, Z.review_state(e))


def z3_progress_windows(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("status"))
    done = _finished(spark, Z.progress_windows(e, "1 day", "1 hour"))
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def z1_intake_dedup(spark, sf_dir):
    """Arrivals of documents, one of each content: the given documents arrive at times of their own, the copies later."""
    d = _stream(spark, sf_dir, "documents")
    arrived = (F.lit("2024-01-01").cast("timestamp").cast("long") + F.col("doc_id") % 3000).cast("timestamp")
    kept = Z.intake_dedup(d.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"), arrived.alias("arrived")))
    out = scratch(spark)
    kept.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/table").groupBy("content_sha256").agg(F.count(F.lit(1)).alias("kept"))


def z4_rank_stream(spark, sf_dir):
    """Pages as two waves of files, the second with the later pages of every document: the query runs, stops, and goes on from its checkpoint."""
    page = fx.load(spark, sf_dir, fx.PAGE).select("doc_id", "page", "text")
    out = scratch(spark)
    schema = page.schema
    for late in (False, True):
        page.where((F.col("page") > 2) == late).write.mode("append").parquet(f"{out}/in")
        Z.run_ranking(spark.readStream.schema(schema).parquet(f"{out}/in"), out).awaitTermination()
    return Z.ranking(spark, out)


QUERIES = [z1_intake_dedup, z2_review_state, z3_progress_windows, z4_rank_stream]
ORACLES = {
    "z1_intake_dedup": "select sha256(coalesce(text, '')) as content_sha256, cast(1 as bigint) as kept from documents group by 1",
    "z4_rank_stream": pages.ORACLES["t9_rank_pages"],
    "z2_review_state": "select cast(user_id as varchar) as record_id, arg_max(event_type, (ts, event_id)) as action, max(ts) as timestamp, count(*) as events from events group by 1",
    "z3_progress_windows": "select date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as \"end\", event_type as status, count(*) as records from events group by 1, 2, 3",
}
