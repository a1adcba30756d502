"""Review, audit and rollups over records and append-only event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def summarize(record: DataFrame) -> DataFrame:
    """V1: counts by tier and status with subtotals, and shares of all; ``g`` tells the grouping level."""
    return (
        record.groupingSets([["tier", "status"], ["status"], []], "tier", "status")
        .agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("status") == "candidate_ready_for_review").alias("built"), F.grouping_id("tier", "status").alias("g"))
        .select("tier", "status", "g", "records", "built", F.round(F.col("built") / F.col("records"), 6).alias("build_rate"))
    )


def review_queue(record: DataFrame) -> DataFrame:
    """V2: the queue projection with defaults for what a record lacks."""
    return record.select("record_id", "document_index", F.coalesce("status", F.lit("pending_model")).alias("status"), F.coalesce("tier", F.lit("unranked")).alias("tier"), (F.col("status") != "candidate_ready_for_review").alias("needs_person"))


def queue_counts(queue: DataFrame) -> DataFrame:
    """V3: pending and ready counts by tier."""
    return queue.groupBy("tier").agg(F.count_if("needs_person").alias("pending"), F.count_if(~F.col("needs_person")).alias("ready"))


EDITABLE = ("pad_x", "pad_y", "center_x", "center_y", "pitch_x", "pitch_y", "tab_x", "tab_y", "body_x", "body_y")


def apply_edits(value: DataFrame, edit: DataFrame) -> DataFrame:
    """V4: ``value(record_id, field, value)`` overlaid with the last allowed, finite, positive edit of each field.

    ``edit(record_id, field, value, ts)``; ``source`` tells manual from automatic, and edited records go back to pending.
    """
    ok = edit.where(F.col("field").isin(*EDITABLE) & F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > 0) & (F.col("value") < float("inf")))
    last = ok.groupBy("record_id", "field").agg(F.max_by("value", F.struct("ts", "value")).alias("edited"))
    out = value.join(last, ["record_id", "field"], "full_outer")
    return out.select("record_id", "field", F.coalesce("edited", "value").alias("value"), F.when(F.col("edited").isNotNull(), "manual").otherwise("auto").alias("source"))


def review_state(event: DataFrame) -> DataFrame:
    """V5: the latest action of each record, by time, then event id; a partially aggregated maximum."""
    last = event.groupBy("record_id").agg(F.max(F.struct("timestamp", "event_id", "action")).alias("m"), F.count(F.lit(1)).alias("events"))
    return last.select("record_id", "m.action", "m.timestamp", "events")


def snapshot_rules() -> list[tuple[str, Column]]:
    """V6: reasons in order with the condition that raises them."""
    c = F.col
    return [
        ("record_id", F.coalesce(c("record_id"), F.lit("")) == ""), ("status", ~F.coalesce(c("status") == "pending_user_confirmation", F.lit(False))),
        ("confirmation_required", ~F.coalesce(c("confirmation_required"), F.lit(False))), ("document_sha256", ~F.coalesce(c("document_sha256").rlike("^[0-9A-Fa-f]{64}$"), F.lit(False))),
        ("selected_page", ~F.coalesce(c("selected_page") >= 1, F.lit(False))), ("candidate_path", F.coalesce(F.trim("candidate_path"), F.lit("")) == ""),
        ("candidate_sha256", ~F.coalesce(c("candidate_sha256").rlike("^[0-9A-Fa-f]{64}$"), F.lit(False))), ("families", F.coalesce(F.size("accepted_families"), F.lit(0)) < 1),
        ("values", ~F.coalesce(F.forall(F.map_values("values"), lambda v: v.isNotNull() & (v > 0)) & (F.size("values") > 0), F.lit(False))), ("provenance", F.coalesce(F.size("provenance"), F.lit(0)) < 1),
    ]


def snapshot_check(queue: DataFrame) -> DataFrame:
    """V6: ``(record_id, confirmable, reasons)``: every rule that a record breaks, in order."""
    reasons = F.filter(F.array(*[F.when(bad, F.lit(k)) for k, bad in snapshot_rules()]), lambda x: x.isNotNull())
    return queue.select("record_id", reasons.alias("reasons")).withColumn("confirmable", F.size("reasons") == 0)


def key_checks(queue: DataFrame, requested: DataFrame) -> DataFrame:
    """V7: ``(problem, key)``: empty ids, duplicate ids, duplicate targets, requested ids that are unknown."""
    dup = lambda c, name: queue.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(name).alias("problem"), F.col(c).alias("key"))
    empty = queue.where(F.coalesce("record_id", F.lit("")) == "").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("empty_record_id").alias("problem"), F.col("n").cast("string").alias("key"))
    unknown = requested.select("record_id").distinct().join(queue.select("record_id"), "record_id", "left_anti").select(F.lit("unknown_record_id").alias("problem"), F.col("record_id").alias("key"))
    return empty.unionByName(dup("record_id", "duplicate_record_id")).unionByName(dup("target", "duplicate_target")).unionByName(unknown)


def mapping_check(mapping: DataFrame, group: DataFrame, member: DataFrame) -> DataFrame:
    """V8: ``mapping(entry_id, group_id, canonical_entry_id)`` with the reasons that bar it.

    ``member(group_id, entry_id, sha_ok, pads_exact)``: the group's entries with their checks.
    """
    m = mapping.join(group.select("group_id", "approval_status", "proposed_canonical_entry_id"), "group_id", "left").join(member, ["group_id", "entry_id"], "left")
    c = F.col
    rules = {
        "group_not_approved": ~F.coalesce(c("approval_status") == "user_approved", F.lit(False)), "canonical_differs": ~F.coalesce(c("canonical_entry_id") == c("proposed_canonical_entry_id"), F.lit(False)),
        "not_a_member": c("sha_ok").isNull(), "maps_to_itself": F.coalesce(c("entry_id") == c("canonical_entry_id"), F.lit(False)), "hash_differs": ~F.coalesce(c("sha_ok"), F.lit(False)), "pads_differ": ~F.coalesce(c("pads_exact"), F.lit(False)),
    }
    reasons = F.filter(F.array(*[F.when(bad, F.lit(k)) for k, bad in rules.items()]), lambda x: x.isNotNull())
    return m.select("entry_id", "group_id", reasons.alias("reasons")).withColumn("eligible", F.size("reasons") == 0)


def proposals(record: DataFrame, group: DataFrame) -> DataFrame:
    """V9: the first record of each package code that the registry has under no code or alias."""
    known = group.select(F.explode(F.array("package_code", "alias")).alias("k")).select(F.regexp_replace(F.upper("k"), "[^A-Z0-9]", "").alias("key")).distinct()
    coded = record.select("record_id", "document_index", "package_code", F.regexp_replace(F.upper("package_code"), "[^A-Z0-9]", "").alias("key")).where("key <> ''")
    new = coded.join(known, "key", "left_anti")
    first = new.groupBy("key").agg(F.min(F.struct("document_index", "record_id", "package_code")).alias("m"))
    return first.select("m.record_id", "m.package_code")


def event_digest() -> Column:
    """Digest of an audit event over its fields in a fixed order."""
    return F.upper(F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), "event_type", F.col("at").cast("string"), "previous_event_sha256", "details"), 256))


def verify_chain(event: DataFrame) -> DataFrame:
    """Per transaction whether sequences are contiguous, links fit and digests recompute; the first bad sequence."""
    w = W.partitionBy("txn_id").orderBy("sequence")
    e = event.withColumns({"n": F.row_number().over(w), "before": F.lag("event_sha256").over(w)})
    good = (F.col("sequence") == F.col("n")) & F.coalesce("previous_event_sha256", F.lit("")).eqNullSafe(F.coalesce("before", F.lit(""))) & (F.upper("event_sha256") == event_digest())
    return e.groupBy("txn_id").agg(F.count(F.lit(1)).alias("events"), F.min(F.when(~F.coalesce(good, F.lit(False)), F.col("sequence"))).alias("first_bad")).withColumn("ok", F.col("first_bad").isNull())


def rollback_check(change: DataFrame, files: DataFrame) -> DataFrame:
    """``change(path, after_sha256, backup_path)`` against current digests; reports, changes nothing."""
    now = files.select(F.col("name").alias("path"), F.upper("sha256").alias("now"))
    backup = files.select(F.col("name").alias("backup_path"), F.lit(True).alias("has"))
    out = change.join(now, "path", "left").join(backup, "backup_path", "left")
    status = F.when(F.col("now").isNull(), "file_missing").when(F.col("now") != F.upper("after_sha256"), "changed_since").when(F.col("has").isNull(), "backup_missing").otherwise("ready")
    return out.select("path", status.alias("status"))


def record_id(document: DataFrame) -> DataFrame:
    """An index of four digits, the name as a slug of at most 48 characters, and eight digits of the digest."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(base), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return document.select("doc_id", F.concat_ws("-", F.lpad(F.col("doc_id").cast("string"), 4, "0"), F.when(slug == "", "document").otherwise(F.substring(slug, 1, 48)), F.lower(F.substring("content_sha256", 1, 8))).alias("record_id"))
