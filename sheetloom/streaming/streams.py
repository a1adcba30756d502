"""Streaming forms: intake dedup, review state, progress windows, page ranking per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pages import class_rank, score_pages


def intake_dedup(document: DataFrame, delay: str = "1 hour", time_col: str = "arrived") -> DataFrame:
    """The first document of each content digest within the watermark; state is bounded by ``delay``."""
    return document.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["content_sha256"])


def review_state(event: DataFrame) -> DataFrame:
    """The latest action of each record for the update or complete mode; an event older than the state changes nothing."""
    return event.groupBy("record_id").agg(F.max(F.struct("timestamp", "event_id", "action")).alias("m"), F.count(F.lit(1)).alias("events")).select("record_id", "m.action", "m.timestamp", "events")


STATE = "ts timestamp, event_id long, action string, events long"
CHANGE = "record_id string, action string, timestamp timestamp, events long"


def _latest(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    ts, event_id, action, events = state.get if state.exists else (None, -1, None, 0)
    for pdf in batches:
        events += len(pdf)
        top = pdf.sort_values(["timestamp", "event_id"]).iloc[-1]
        if ts is None or (top["timestamp"], top["event_id"]) > (pd.Timestamp(ts), event_id):
            ts, event_id, action = top["timestamp"].to_pydatetime(), int(top["event_id"]), top["action"]
    state.update((ts, event_id, action, events))
    yield pd.DataFrame({"record_id": [key[0]], "action": [action], "timestamp": [pd.Timestamp(ts)], "events": [events]})


def review_changes(event: DataFrame) -> DataFrame:
    """Z2 as a stateful operator: one row for each record that a micro-batch touches, with its state after it."""
    return event.groupBy("record_id").applyInPandasWithState(_latest, CHANGE, STATE, "update", "NoTimeout")


def progress_windows(record: DataFrame, width: str = "10 minutes", delay: str = "30 minutes", time_col: str = "timestamp") -> DataFrame:
    """Z3: completions per status and tumbling window, final once the watermark has passed."""
    w = record.withWatermark(time_col, delay).groupBy(F.window(time_col, width), "status").agg(F.count(F.lit(1)).alias("records"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "status", "records")


BEST = "docs array<long>, pages array<int>, scores array<long>, ranks array<int>"
RANKED = "doc_id long, pages array<int>, scores array<long>, page_classes array<string>"
#: Classes of pages by rank.
CLASSES = ("none", "dimension", "land")
#: Bits of a document's id that tell it apart within the block that holds its state.
BLOCK_BITS = 7


def ranked_pages(page: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best pages of each document so far, one row for each document that a micro-batch touches.

    The state of a document is its best pages only: a page that is not among the best of those seen
    can't be among the best of more, so pages may come late and in any batch. A page that comes again
    takes the better of its two decisions. Vetoed pages and pages without a score are no candidates.
    A call into Python costs more than a document's pages: a state holds a block of up to
    2^``BLOCK_BITS`` documents with neighbouring ids.
    """

    def best(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        for doc, p, score, rank in zip(*state.get) if state.exists else ():
            held.setdefault(doc, []).append((rank, score, -p))
        touched: set[int] = set()
        for pdf in batches:
            fresh: dict[int, list[tuple]] = {}
            for doc, p, score, rank in zip(*(pdf[c].tolist() for c in ("doc_id", "page", "score", "rank"))):
                fresh.setdefault(doc, []).append((rank, score, -p))
            for doc, rows in fresh.items():
                found: dict[int, tuple] = {}
                for t in held.get(doc, []) + rows:
                    found[t[2]] = max(found.get(t[2], t), t)
                held[doc] = sorted(found.values(), reverse=True)[:k]
            touched |= fresh.keys()
        flat = [(doc, -p, score, rank) for doc, rows in held.items() for rank, score, p in rows]
        state.update(tuple(list(c) for c in zip(*flat)))
        out = [(doc, [-p for _, _, p in held[doc]], [s for _, s, _ in held[doc]], [CLASSES[r] for r, _, _ in held[doc]]) for doc in sorted(touched)]
        yield pd.DataFrame(out, columns=["doc_id", "pages", "scores", "page_classes"])

    good = score_pages(page).where("score > 0 and not vetoed")
    slim = good.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "score", class_rank(F.col("page_class")).alias("rank"))
    return slim.withColumn("block", F.shiftright("doc_id", BLOCK_BITS)).groupBy("block").applyInPandasWithState(best, RANKED, BEST, "update", "NoTimeout")


def run_ranking(page: DataFrame, folder: str, k: int = 3) -> StreamingQuery:
    """Z4 as a running query over all that is there: changes of each micro-batch go to a folder of its number, written over when the batch is repeated."""

    def sink(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/ranked/batch={batch}")

    return ranked_pages(page, k).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def ranking(spark: SparkSession, folder: str) -> DataFrame:
    """What ``run_ranking`` has written, as ``rank_pages`` gives it: the last change of each document."""
    changes = spark.read.parquet(f"{folder}/ranked")
    last = changes.groupBy("doc_id").agg(F.max_by(F.arrays_zip("pages", "scores", "page_classes"), "batch").alias("best"))
    rows = last.select("doc_id", F.posexplode("best").alias("at", "b"))
    return rows.select("doc_id", F.col("b.pages").alias("page"), F.col("b.scores").alias("score"), F.col("b.page_classes").alias("page_class"), (F.col("at") + 1).alias("rank"))
