"""Queries of intake and review operators over the derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review as V
from ..session import scratch
from ..sources import intake as S
from . import fixtures as fx


def _docs(spark, sf_dir):
    return S.digest_texts(fx.load(spark, sf_dir, fx.DOCUMENT))


def _record(spark, sf_dir):
    return fx.load(spark, sf_dir, fx.RECORD)


def s2_dedup_exact(spark, sf_dir):
    return S.dedup_exact(_docs(spark, sf_dir)).select("doc_id", "first_doc_id", "kept", "copies")


def s2_dedup_stats(spark, sf_dir):
    return S.dedup_stats(S.dedup_exact(_docs(spark, sf_dir)))


def s3_ledger(spark, sf_dir):
    rows = fx.load(spark, sf_dir, fx.DOCUMENT).select(
        F.col("doc_id").alias("pos"),
        F.struct(F.when(F.col("doc_id") % 3 == 0, F.col("path")).otherwise(" ").alias("canonical_path"), F.when(F.col("doc_id") % 7 != 0, F.col("path")).alias("pdf_path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("lang").alias("tier"), F.array().cast("array<int>").alias("truth_pages")).alias("d"),
    )
    return S._ledger(rows)[0].select("pos", "path", "content_sha256", "tier")


def s4_tiers(spark, sf_dir):
    docs = fx.load(spark, sf_dir, fx.DOCUMENT).select("doc_id", F.col("lang").alias("tier"), F.md5("text").alias("content_sha256"))
    return S.tier_stats(S.load_tiered(docs, ["en", "de"]))


def s5_verify_hash(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("expected_sha256", F.when(F.col("doc_id") % 4 == 0, F.lit("")).when(F.col("doc_id") % 4 == 1, F.lit("00")).otherwise(F.lower("content_sha256")))
    return S.verify_hash(docs, dry_run=True).groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


def s6_artefacts(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    manifest = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").cast("string").alias("name"), F.when(F.col("doc_id") % 7 == 0, "00").otherwise(F.lower("content_sha256")).alias("sha256"))
    files = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("name"), F.col("content_sha256").alias("sha256"))
    return S.verify_artefacts(manifest, files)


def _validated(spark, sf_dir):
    dim = fx.load(spark, sf_dir, fx.DIMENSION).withColumn("raw", F.when(F.col("doc_id") % 9 == 0, "n/a").otherwise(F.concat("value", F.lit(" mm"))))
    return S.validate_samples(dim.withColumn("belongs_to", F.when((F.col("doc_id") % 23 == 0) & (F.col("ord") == 1), "elsewhere").otherwise(F.col("belongs_to"))))


def s10_validate(spark, sf_dir):
    return _validated(spark, sf_dir).select("doc_id", "sample_idx", "ord", F.array_join("faults", ",").alias("faults"), "outcome")


def s11_body_samples(spark, sf_dir):
    return S.filter_body(fx.load(spark, sf_dir, fx.DIMENSION))


def s12_pending(spark, sf_dir):
    return S.pending(_docs(spark, sf_dir).select("doc_id"), _record(spark, sf_dir))


def s14_redact(spark, sf_dir):
    docs = fx.load(spark, sf_dir, fx.DOCUMENT).select("doc_id", "text")
    return S.redact(docs, patterns=(*S.SECRETS, (r"AKIA[0-9A-Z]{16}", "[REDACTED_KEY]"))).select("doc_id", F.md5("text").alias("digest"))


def s15_reconcile(spark, sf_dir):
    return S.reconcile(_docs(spark, sf_dir), _record(spark, sf_dir))


def v1_summary(spark, sf_dir):
    return V.summarize(_record(spark, sf_dir)).drop("g")


def v2_review_queue(spark, sf_dir):
    return V.review_queue(_record(spark, sf_dir))


def v3_queue_counts(spark, sf_dir):
    return V.queue_counts(V.review_queue(_record(spark, sf_dir)))


def v4_apply_edits(spark, sf_dir):
    geo = fx.load(spark, sf_dir, fx.GEOMETRY).select(F.col("doc_id").alias("record_id"), "pad_x", "body_y")
    value = geo.unpivot(["record_id"], ["pad_x", "body_y"], "field", "value")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edit = line.groupBy(F.col("l_partkey").alias("record_id"), F.col("l_linenumber").alias("ts")).agg(F.max("l_quantity").cast("double").alias("value"))
    edit = edit.withColumn("field", F.when(F.col("ts") % 3 == 0, "pad_x").when(F.col("ts") % 3 == 1, "body_y").otherwise("colour"))
    return V.apply_edits(value, edit)


def v5_review_state(spark, sf_dir):
    return V.review_state(fx.load(spark, sf_dir, fx.REVIEW_EVENT))


def v7_key_checks(spark, sf_dir):
    rec = _record(spark, sf_dir)
    queue = rec.select(F.when(F.col("document_index") % 97 == 0, "").otherwise(F.col("record_id")).alias("record_id"), F.concat(F.lit("t"), (F.col("document_index") % 700).cast("string")).alias("target"))
    asked = rec.select(F.when(F.col("document_index") % 50 == 0, F.concat("record_id", F.lit("-x"))).otherwise(F.col("record_id")).alias("record_id"))
    return V.key_checks(queue, asked)


def v8_mapping_check(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("entry_id"), F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("k"))
    group = fx.load(spark, sf_dir, fx.REGISTRY_GROUP)
    member = part.where("k % 11 <> 0").select("group_id", "entry_id", (F.col("k") % 5 != 0).alias("sha_ok"), (F.col("k") % 3 != 0).alias("pads_exact"))
    mapping = part.join(group.select("group_id", F.col("proposed_canonical_entry_id").alias("canonical_entry_id")), "group_id").select("entry_id", "group_id", "canonical_entry_id")
    return V.mapping_check(mapping, group, member).withColumn("reasons", F.array_join("reasons", ","))


def v9_proposals(spark, sf_dir):
    rec = _record(spark, sf_dir).select("record_id", "document_index", F.concat(F.lit("Brand#"), (F.col("doc_id") % 90).cast("string")).alias("package_code"))
    return V.proposals(rec, fx.load(spark, sf_dir, fx.REGISTRY_GROUP))


def v12_record_id(spark, sf_dir):
    return V.record_id(_docs(spark, sf_dir))


def s13_write_results(spark, sf_dir):
    """A run's records written twice under one name: what its folder holds, by status."""
    status = F.when(F.col("document_index") % 4 == 0, "pending_model").otherwise(F.col("status"))
    r, out = _record(spark, sf_dir).withColumn("status", status), scratch(spark)
    S.write_results(r, out, "run")
    folder = S.write_results(r, out, "run")
    read = lambda part: spark.read.schema(r.schema).json(f"{folder}/{part}")
    queued = read("queue").groupBy("status").agg(F.count(F.lit(1)).alias("queued"))
    g = read("results").groupBy("status").agg(F.count(F.lit(1)).alias("records"), F.sum("document_index").alias("indexes"))
    summary = spark.read.schema("status string, records long").json(f"{folder}/summary").withColumnRenamed("records", "summed")
    commits = spark.read.parquet(f"{out}/commits").agg(F.count(F.lit(1)).alias("commits"))
    return g.join(queued, "status", "left").join(summary, "status").join(commits).na.fill(0, ["queued"])


QUERIES = [
    s2_dedup_exact, s2_dedup_stats, s3_ledger, s4_tiers, s5_verify_hash, s6_artefacts, s10_validate, s11_body_samples, s12_pending, s13_write_results, s14_redact, s15_reconcile,
    v1_summary, v2_review_queue, v3_queue_counts, v4_apply_edits, v5_review_state, v7_key_checks, v8_mapping_check, v9_proposals, v12_record_id,
]

_DOC = f"document as (select *, upper(sha256(coalesce(text, ''))) as content_sha256 from ({fx.duck(fx.DOCUMENT)}))"
_DIM = f"dimension as ({fx.duck(fx.DIMENSION)})"
_REC = f"record as ({fx.duck(fx.RECORD)})"
_GROUP = f"grp as ({fx.duck(fx.REGISTRY_GROUP)})"
_FIRST = "m as (select *, first_value(doc_id) over w as first_doc_id, count(*) over (partition by content_sha256) as copies from document window w as (partition by content_sha256 order by lower(path), path, doc_id))"
_QUEUE = "q as (select record_id, document_index, status, tier, status <> 'candidate_ready_for_review' as needs_person from record)"
_ROLES = ", ".join(f"'{r}'" for r in S.ROLES)
_PARTS = ", ".join(f"'{r}'" for r in S.PARTITIONS)
ORACLES = {
    "s13_write_results": f"with {_REC}, r as (select *, case when document_index % 4 = 0 then 'pending_model' else status end as s from record) select s as status, count(*) as records, cast(sum(document_index) as bigint) as indexes, count(*) filter (s = 'pending_model') as queued, count(*) as summed, cast(1 as bigint) as commits from r group by 1",
    "s2_dedup_exact": f"with {_DOC}, {_FIRST} select doc_id, first_doc_id, doc_id = first_doc_id as kept, copies from m",
    "s2_dedup_stats": f"with {_DOC}, {_FIRST} select count(*) as physical, count(*) filter (doc_id = first_doc_id) as \"unique\", count(*) filter (doc_id <> first_doc_id) as duplicate from m",
    "s3_ledger": f"""with {_DOC}, p as (select doc_id as pos, coalesce(case when doc_id % 3 = 0 then nullif(trim(path), '') end, case when doc_id % 7 <> 0 then nullif(trim(path), '') end) as path, content_sha256, lang as tier from document),
r as (select *, row_number() over (partition by content_sha256 order by pos) as n from p where path is not null) select pos, path, content_sha256, tier from r where n = 1""",
    "s4_tiers": "select lang in ('en', 'de') as kept, count(*) as \"rows\", count(distinct md5(text)) as distinct_hashes from documents group by 1",
    "s5_verify_hash": "select case when doc_id % 4 = 1 then 'input_hash_mismatch' else 'ok' end as status, count(*) as documents from documents group by 1",
    "s6_artefacts": """with m as (select cast(doc_id as varchar) as name, doc_id from documents where doc_id % 5 <> 0), f as (select cast(doc_id as varchar) as name, doc_id from documents where doc_id % 3 <> 0)
select coalesce(m.name, f.name) as name, case when f.name is null then 'missing' when m.name is null then 'unlisted' when m.doc_id % 7 = 0 then 'mismatch' else 'ok' end as status from m full outer join f on m.name = f.name""",
    "s10_validate": rf"""with {_DIM}, x as (select doc_id, sample_idx, ord, value, case when doc_id % 9 = 0 then 'n/a' else value || ' mm' end as raw, role, case when doc_id % 23 = 0 and ord = 1 then 'elsewhere' else belongs_to end as belongs_to, unit from dimension),
y as (select *, list_filter([case when role not in ({_ROLES}) then 'role' end, case when belongs_to not in ({_PARTS}) then 'belongs_to' end, case when not regexp_matches(value, '^[+-]?(?:\d+(?:[.,]\d+)?|[.,]\d+)$') then 'value' end, case when trim(unit) = '' then 'unit' end, case when not contains(raw, value) then 'raw' end], lambda z: z is not null) as f from x),
z as (select *, bool_or(list_contains(f, 'role') or list_contains(f, 'belongs_to')) over (partition by doc_id, sample_idx) as fatal from y)
select doc_id, sample_idx, ord, coalesce(array_to_string(f, ','), '') as faults, case when fatal then 'failed_sample' when len(f) > 0 then 'discarded' else 'ok' end as outcome from z""",
    "s11_body_samples": f"with {_DIM}, n as (select doc_id, sample_idx, count(*) filter (belongs_to = 'package_outline' and role in ({', '.join(repr(r) for r in S.BODY_ROLES)})) as \"rows\" from dimension group by all) select *, case when \"rows\" > 0 then 'ok' else 'failed' end as status from n",
    "s12_pending": f"with {_REC} select doc_id from documents where doc_id not in (select doc_id from record)",
    "s14_redact": r"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9._-]{12,}', '[REDACTED_KEY]', 'g'), '(?i)Bearer\s+\S+', 'Bearer [REDACTED]', 'g'), 'AKIA[0-9A-Z]{16}', '[REDACTED_KEY]', 'g')) as digest from documents",
    "s15_reconcile": f"with {_REC}, r as (select doc_id, count(*) as n from record group by 1), d as (select distinct doc_id as k from documents) select count(*) filter (n is null) as without_outcome, count(*) filter (k is null) as without_document, count(*) filter (n > 1) as several_outcomes, count(*) as keys from d full outer join r on k = doc_id",
    "v1_summary": f"with {_REC} select tier, status, count(*) as records, count(*) filter (status = 'candidate_ready_for_review') as built, round(count(*) filter (status = 'candidate_ready_for_review') / count(*), 6) as build_rate from record group by grouping sets ((tier, status), (status), ())",
    "v2_review_queue": f"with {_REC}, {_QUEUE} select * from q",
    "v3_queue_counts": f"with {_REC}, {_QUEUE} select tier, count(*) filter (needs_person) as pending, count(*) filter (not needs_person) as ready from q group by 1",
    "v4_apply_edits": f"""with geo as ({fx.duck(fx.GEOMETRY)}), v as (select doc_id as record_id, 'pad_x' as field, pad_x as value from geo union all select doc_id, 'body_y', body_y from geo),
e as (select l_partkey as record_id, l_linenumber as ts, cast(max(l_quantity) as double) as value, case l_linenumber % 3 when 0 then 'pad_x' when 1 then 'body_y' else 'colour' end as field from lineitem group by 1, 2),
k as (select record_id, field, arg_max(value, (ts, value)) as edited from e where field <> 'colour' and value > 0 group by 1, 2)
select coalesce(v.record_id, k.record_id) as record_id, coalesce(v.field, k.field) as field, coalesce(edited, value) as value, case when edited is not null then 'manual' else 'auto' end as source from v full outer join k on v.record_id = k.record_id and v.field = k.field""",
    "v5_review_state": f"with e as ({fx.duck(fx.REVIEW_EVENT)}) select record_id, arg_max(action, (timestamp, event_id, action)) as action, max(timestamp) as timestamp, count(*) as events from e group by 1",
    "v7_key_checks": f"""with {_REC}, q as (select case when document_index % 97 = 0 then '' else record_id end as record_id, 't' || cast(document_index % 700 as varchar) as target from record), u as (select * from q), a as (select case when document_index % 50 = 0 then record_id || '-x' else record_id end as record_id from record)
select 'empty_record_id' as problem, cast(count(*) as varchar) as key from u where record_id = '' having count(*) > 0
union all select 'duplicate_record_id', record_id from u where record_id <> '' group by 2 having count(*) > 1
union all select 'duplicate_target', target from u group by 2 having count(*) > 1
union all select distinct 'unknown_record_id', record_id from a where record_id not in (select record_id from u)""",
    "v8_mapping_check": f"""with {_GROUP}, m as (select cast(p_partkey as varchar) as entry_id, p_brand as group_id, p_partkey as k, approval_status, proposed_canonical_entry_id as c from part join grp on p_brand = group_id),
r as (select entry_id, group_id, list_filter([case when approval_status <> 'user_approved' then 'group_not_approved' end, case when k % 11 = 0 then 'not_a_member' end, case when entry_id = c then 'maps_to_itself' end,
  case when k % 11 = 0 or k % 5 = 0 then 'hash_differs' end, case when k % 11 = 0 or k % 3 = 0 then 'pads_differ' end], lambda z: z is not null) as f from m)
select entry_id, group_id, coalesce(array_to_string(f, ','), '') as reasons, len(f) = 0 as eligible from r""",
    "v9_proposals": f"""with {_REC}, {_GROUP}, known as (select regexp_replace(upper(unnest([package_code, alias])), '[^A-Z0-9]', '', 'g') as key from grp), c as (select record_id, document_index, 'Brand#' || cast(doc_id % 90 as varchar) as package_code from record),
n as (select *, row_number() over (partition by package_code order by document_index, record_id) as r from c where regexp_replace(upper(package_code), '[^A-Z0-9]', '', 'g') not in (select key from known)) select record_id, package_code from n where r = 1""",
    "v12_record_id": f"""with {_DOC}, s as (select doc_id, content_sha256, regexp_replace(regexp_replace(lower(regexp_replace(list_extract(string_split(path, '/'), -1), '\\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from document)
select doc_id, substr(lpad(cast(doc_id as varchar), 4, '0'), 1, 4) || '-' || case when slug = '' then 'document' else substr(slug, 1, 48) end || '-' || lower(substr(content_sha256, 1, 8)) as record_id from s""",
}
