"""Corpus intake: listings, ledgers, dictionaries, registries, samples; validation with quarantine.

Loaders state their schemas and never infer them. A bad row goes to a quarantine table with a
reason, never to an exception.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import PARTITIONS, ROLES


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Every PDF below ``root``, suffix in any case, with the upper-case SHA-256 of its content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    return files.select("path", "length", F.upper(F.sha2("content", 256)).alias("content_sha256"), F.lower("path").alias("order_key"))


def digest_texts(docs: DataFrame) -> DataFrame:
    """A document table from a text table: the digest of the text stands for that of the file."""
    return docs.select("doc_id", "path", F.upper(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("content_sha256"))


def dedup_exact(document: DataFrame) -> DataFrame:
    """Each document with the first of its content in path order, and whether it is that one.

    The first is a partially aggregated minimum per digest, so thousands of copies of one content
    are summed before the shuffle. Null digests are never copies of one another.
    """
    order = F.struct(F.lower("path").alias("p"), "path", "doc_id")
    first = document.where(F.col("content_sha256").isNotNull()).groupBy("content_sha256").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("copies"))
    out = document.join(first, "content_sha256", "left")
    keep = F.coalesce(F.col("f.doc_id") == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", "path", "content_sha256", F.coalesce("f.doc_id", "doc_id").alias("first_doc_id"), keep.alias("kept"), F.coalesce("copies", F.lit(1)).alias("copies"))


def dedup_stats(marked: DataFrame) -> DataFrame:
    """Physical, unique and duplicate documents of ``dedup_exact``."""
    return marked.agg(F.count(F.lit(1)).alias("physical"), F.count_if("kept").alias("unique"), F.count_if(~F.col("kept")).alias("duplicate"))


LEDGER = "documents array<struct<canonical_path:string,pdf_path:string,sha256:string,tier:string,truth_pages:array<int>>>"


def load_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: (documents, rejected) of a JSON ledger; the first row of a digest stays, rows without path or digest are rejected."""
    rows = spark.read.schema(LEDGER).option("multiLine", True).json(path).select(F.posexplode("documents").alias("pos", "d"))
    return _ledger(rows)


def _ledger(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    flat = rows.select("pos", F.coalesce(filled(F.col("d.canonical_path")), filled(F.col("d.pdf_path"))).alias("path"), F.upper(filled(F.col("d.sha256"))).alias("content_sha256"), "d.tier", "d.truth_pages")
    bad = flat.where("path is null or content_sha256 is null").withColumn("reason", F.when(F.col("path").isNull(), "missing_path").otherwise("missing_digest"))
    ok = flat.where("path is not null and content_sha256 is not null")
    first = ok.withColumn("n", F.row_number().over(W.partitionBy("content_sha256").orderBy("pos"))).where("n = 1").drop("n")
    return first, bad


def load_tiered(document: DataFrame, tiers: list[str], expected: int | None = None) -> DataFrame:
    """Every ledger row with ``kept`` for live tiers; no dedup. ``expected`` rows are checked where stated."""
    out = document.withColumn("kept", F.coalesce(F.col("tier").isin(*tiers), F.lit(False)))
    if expected is not None and (n := out.where("kept").count()) != expected:
        raise ValueError(f"{n} live rows, {expected} expected")
    return out


def tier_stats(marked: DataFrame) -> DataFrame:
    return marked.groupBy("kept").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("content_sha256").alias("distinct_hashes"))


def verify_hash(document: DataFrame, dry_run: bool = False) -> DataFrame:
    """``status`` ok or input_hash_mismatch; an empty expectation passes in a dry run only. Case doesn't matter."""
    want = F.upper(F.trim(F.coalesce("expected_sha256", F.lit(""))))
    same = (want == F.upper("content_sha256")) | (want == "" if dry_run else F.lit(False))
    return document.withColumn("status", F.when(F.coalesce(same, F.lit(False)), "ok").otherwise("input_hash_mismatch"))


def verify_artefacts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``(name, status)``: ok, mismatch, missing (in the manifest only) or unlisted (a file only)."""
    both = manifest.select("name", F.upper("sha256").alias("want")).join(files.select("name", F.upper("sha256").alias("have")), "name", "full_outer")
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") == F.col("have"), "ok").otherwise("mismatch")
    return both.select("name", status.alias("status"))


DICTIONARY = (
    "schema string, status string, entry_count int, entries array<struct<term:string,normalized_key:string,alias_group_id:string,aliases:array<string>,"
    "evidence_class:string,source_pdf_sha256:string,source_page:int,source_line:string,source_line_sha256:string>>"
)


def load_terms(spark: SparkSession, path: str, schema_tag: str) -> DataFrame:
    """Dictionary entries; raises when the tag, the count or a term is wrong. ``status`` is shown, not judged."""
    raw = spark.read.schema(DICTIONARY).option("multiLine", True).json(path)
    entries = raw.select("schema", "status", "entry_count", F.inline("entries"))
    bad = raw.where((F.col("schema") != schema_tag) | F.col("schema").isNull() | (F.size("entries") != F.col("entry_count")) | (F.size("entries") == 0))
    empty = entries.where("coalesce(trim(term), '') = '' or coalesce(trim(normalized_key), '') = ''")
    if bad.limit(1).count() or empty.limit(1).count():
        raise ValueError("the dictionary fails its checks")
    return entries.drop("schema", "entry_count")


REGISTRY = (
    "schema string, tolerance_mm double, authority string, groups array<struct<group_id:string,package_code:string,package_aliases:array<string>,approval_status:string,"
    "proposed_canonical_entry_id:string,member_entry_ids:array<string>>>, entries array<struct<entry_id:string,formal_name:string,formal_path:string,formal_sha256:string,values:map<string,double>>>"
)


def load_registry(spark: SparkSession, path: str, schema_tag: str) -> tuple[DataFrame, DataFrame]:
    """(groups, entries); the tolerance lies in [0, 0.001]; of entries with one id the last counts."""
    raw = spark.read.schema(REGISTRY).option("multiLine", True).json(path)
    if raw.where((F.col("schema") == schema_tag) & F.col("tolerance_mm").between(0, 0.001)).limit(1).count() == 0:
        raise ValueError("the registry fails its checks")
    entries = raw.select("authority", F.posexplode("entries").alias("pos", "e")).select("authority", "pos", "e.*")
    last = entries.withColumn("n", F.row_number().over(W.partitionBy("entry_id").orderBy(F.desc("pos")))).where("n = 1").drop("n", "pos")
    return raw.select("authority", F.inline("groups")), last


TRANSCRIPTION = "struct<dimensions:array<struct<symbol:string,value:string,unit:string,raw:string,role:string,belongs_to:string,endpoints:string,is_derived:boolean>>,pin_count:int,recommended_land_pattern:boolean,paste_evidence_visible:boolean,unmarked_roles:array<string>,family_proposal:string,family_proposal_reason:string>"


def load_samples(raw: DataFrame) -> DataFrame:
    """``(doc_id, sample_idx, ord, ...)`` from JSON texts, bare or under "transcription"; ``raw(doc_id, sample_idx, json)``.

    Texts that are no JSON give no rows here; ``bad_samples`` lists them.
    """
    bare, under = F.from_json("json", TRANSCRIPTION), F.from_json("json", f"struct<transcription:{TRANSCRIPTION}>")
    t = F.when(bare["dimensions"].isNotNull(), bare).otherwise(under["transcription"])
    return raw.select("doc_id", "sample_idx", t.alias("t")).select("doc_id", "sample_idx", F.col("t.pin_count"), F.col("t.family_proposal"), F.posexplode("t.dimensions").alias("ord", "d")).select("doc_id", "sample_idx", "pin_count", "family_proposal", "ord", "d.*")


NUMBER = r"^[+-]?(?:\d+(?:[.,]\d+)?|[.,]\d+)$"


def dimension_faults() -> Column:
    """Names of the rules that a dimension row breaks."""
    rules = {
        "role": ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "belongs_to": ~F.coalesce(F.col("belongs_to").isin(*PARTITIONS), F.lit(False)),
        "value": ~F.coalesce(F.col("value").rlike(NUMBER), F.lit(False)), "unit": F.coalesce(F.trim("unit"), F.lit("")) == "",
        "raw": ~F.coalesce(F.contains(F.col("raw"), F.col("value")), F.lit(False)),
    }
    return F.filter(F.array(*[F.when(bad, F.lit(k)) for k, bad in rules.items()]), lambda x: x.isNotNull())


FATAL = ("role", "belongs_to")


def validate_samples(dimension: DataFrame) -> DataFrame:
    """Each row with its faults and an outcome: ok, discarded (unusable value or unit) or failed_sample (a contract break anywhere in the sample)."""
    marked = dimension.withColumn("faults", dimension_faults())
    fatal = F.exists("faults", lambda x: x.isin(*FATAL))
    broken = marked.groupBy("doc_id", "sample_idx").agg(F.bool_or(fatal).alias("_fatal"))
    out = marked.join(broken, ["doc_id", "sample_idx"])
    return out.withColumn("outcome", F.when(F.col("_fatal"), "failed_sample").when(F.size("faults") > 0, "discarded").otherwise("ok")).drop("_fatal")


BODY_ROLES = ("body_length", "body_width", "body_height", "lead_width", "overall_span", "pitch", "other")


def filter_body(dimension: DataFrame) -> DataFrame:
    """Direct package-outline rows with a body role; a sample without any is ``failed``."""
    derived = F.coalesce(F.col("is_derived"), F.lit(False)) if "is_derived" in dimension.columns else F.lit(False)
    keep = F.coalesce((F.col("belongs_to") == "package_outline") & F.col("role").isin(*BODY_ROLES) & ~derived, F.lit(False))
    per = dimension.groupBy("doc_id", "sample_idx").agg(F.count_if(keep).alias("rows"))
    return per.withColumn("status", F.when(F.col("rows") > 0, "ok").otherwise("failed"))


def pending(document: DataFrame, record: DataFrame) -> DataFrame:
    """Documents without a record."""
    return document.join(record.select("doc_id"), "doc_id", "left_anti")


def committed(spark: SparkSession, path: str, run_id: str | None = None) -> str | None:
    """The folder of a run's results below ``path``, or of the latest run; None before any is committed."""
    try:
        runs = spark.read.parquet(f"{path}/commits")
    except AnalysisException:  # nothing was ever committed here
        return None
    runs = runs if run_id is None else runs.where(F.col("run_id") == run_id)
    # Of two writers of one run the first attempt counts, whoever reads.
    first = runs.groupBy("run_id").agg(F.min(F.struct("at", "folder")).alias("m")).orderBy(F.desc("m.at")).select("m.folder").first()
    return first and first["folder"]


def write_results(record: DataFrame, path: str, run_id: str) -> str:
    """``record(document_index, status, ...)`` of a run, redacted, written once however often it is tried; gives its folder.

    ``results`` and ``queue`` (those that wait for the model) are JSON lines in the order of the
    index, file by file; ``by_status`` has the results partitioned; ``summary`` counts each status.
    All go to a folder of this attempt, and one commit row, written last, makes it the run's. A try
    that dies leaves a folder that nobody reads; a repeated run writes nothing. Records without an
    index come first; an empty table is committed too.
    """
    spark = record.sparkSession
    if (done := committed(spark, path, run_id)) is not None:
        return done
    folder = f"{path}/attempt-{uuid.uuid4().hex}"
    order = ["document_index"]
    redact(record).repartitionByRange(*order).sortWithinPartitions(*order).write.json(f"{folder}/results")
    kept = spark.read.schema(record.schema).json(f"{folder}/results")
    kept.where("status = 'pending_model'").repartitionByRange(*order).sortWithinPartitions(*order).write.json(f"{folder}/queue")
    kept.write.partitionBy("status").parquet(f"{folder}/by_status")
    kept.groupBy("status").agg(F.count(F.lit(1)).alias("records")).coalesce(1).sortWithinPartitions("status").write.json(f"{folder}/summary")
    _commit(spark, path, run_id, folder)
    return committed(spark, path, run_id)


def _commit(spark: SparkSession, path: str, run_id: str, folder: str) -> None:
    row = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(folder).alias("folder"), F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")


# What is taken out of string leaves.
SECRETS = ((r"sk-[A-Za-z0-9._-]{12,}", "[REDACTED_KEY]"), (r"(?i)Bearer\s+\S+", "Bearer [REDACTED]"))


def redact(df: DataFrame, literals: tuple[str, ...] = (), patterns=SECRETS) -> DataFrame:
    """Every string leaf (in structs, arrays and map values too) without the literals and patterns."""

    def text(c: Column) -> Column:
        for x in literals:
            c = F.replace(c, F.lit(x), F.lit("[REDACTED]"))
        for p, to in patterns:
            c = F.regexp_replace(c, p, to)
        return c

    def walk(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return text(c)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in kind]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: walk(v, kind.valueType))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def reconcile(document: DataFrame, record: DataFrame) -> DataFrame:
    """Documents without an outcome, outcomes without a document, documents with several outcomes; all zero when accounts are right."""
    r = record.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    both = document.select("doc_id").distinct().withColumn("d", F.lit(1)).join(r, "doc_id", "full_outer")
    return both.agg(F.count_if(F.col("n").isNull()).alias("without_outcome"), F.count_if(F.col("d").isNull()).alias("without_document"), F.count_if(F.col("n") > 1).alias("several_outcomes"), F.count(F.lit(1)).alias("keys"))
