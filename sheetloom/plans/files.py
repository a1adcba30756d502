"""Queries of file loaders and audit operators: what they read is written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review as V
from ..session import scratch
from ..sources import intake as S
from . import fixtures as fx

TAG = "sheet-v1"


def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def s7_load_terms(spark, sf_dir):
    """A dictionary of all brands as a JSON file, read back."""
    brands = _part(spark, sf_dir).groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    entry = F.struct(
        F.col("p_brand").alias("term"), F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")).alias("normalized_key"), F.lit("").alias("alias_group_id"), F.array(F.lower("p_brand")).alias("aliases"),
        F.lit("declarative_package_label").alias("evidence_class"), F.col("first").cast("int").alias("source_page"),
    )
    one = brands.agg(F.array_sort(F.collect_list(entry)).alias("entries")).select(F.lit(TAG).alias("schema"), F.lit("draft").alias("status"), F.size("entries").alias("entry_count"), "entries")
    out = scratch(spark)
    one.write.json(out)
    return S.load_terms(spark, out, TAG).select("status", "term", "normalized_key", F.array_join("aliases", ",").alias("aliases"), "source_page")


def s8_load_registry(spark, sf_dir):
    """A registry with a group for each brand and an entry for each brand and size; every tenth entry stands in it twice, and the last counts."""
    p = _part(spark, sf_dir)
    group = p.groupBy("p_brand").agg(F.countDistinct("p_size").alias("n"))
    groups = group.agg(F.array_sort(F.collect_list(F.struct(F.col("p_brand").alias("group_id"), F.col("p_brand").alias("package_code"), F.array(F.lower("p_brand")).alias("package_aliases"), F.lit("user_approved").alias("approval_status")))).alias("groups"))
    entry = p.select("p_brand", "p_size").distinct().withColumn("id", F.concat_ws("-", "p_brand", "p_size"))
    copies = entry.select("id", "p_size", F.explode(F.when(F.col("p_size") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    entries = copies.agg(F.array_sort(F.collect_list(F.struct("copy", "id", "p_size"))).alias("e")).select(F.transform("e", lambda x: F.struct(x["id"].alias("entry_id"), F.concat(x["id"], F.lit("/"), x["copy"].cast("string")).alias("formal_name"), F.create_map(F.lit("size"), x["p_size"].cast("double")).alias("values"))).alias("entries"))
    out = scratch(spark)
    groups.join(entries).select(F.lit(TAG).alias("schema"), F.lit(0.001).alias("tolerance_mm"), F.lit("maintainer").alias("authority"), "groups", "entries").write.json(out)
    g, e = S.load_registry(spark, out, TAG)
    sizes = e.groupBy(F.split("entry_id", "-")[0].alias("group_id")).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.endswith("formal_name", F.lit("/1"))).alias("last_ones"), F.sum(F.col("values")["size"]).cast("long").alias("sizes"))
    return g.select("group_id", "authority", "approval_status").join(sizes, "group_id")


def s9_load_samples(spark, sf_dir):
    """The dimensions of each part and sample as a JSON text, every other one under a name of its own, read back as rows."""
    d = fx.load(spark, sf_dir, fx.DIMENSION)
    row = F.struct("ord", *[F.col(c) for c in ("value", "unit", "role", "belongs_to", "endpoints")], F.concat("value", F.lit(" mm")).alias("raw"))
    g = d.groupBy("doc_id", "sample_idx").agg(F.array_sort(F.collect_list(row)).alias("dimensions"))
    inner = F.to_json(F.struct(F.transform("dimensions", lambda x: x.dropFields("ord")).alias("dimensions")))
    js = F.when(F.col("doc_id") % 2 == 0, inner).when(F.col("doc_id") % 9 == 0, F.lit("no json")).otherwise(F.concat(F.lit('{"transcription":'), inner, F.lit("}")))
    return S.load_samples(g.select("doc_id", "sample_idx", js.alias("json"))).select("doc_id", "sample_idx", "ord", "value", "role", "raw")


def v10_verify_chain(spark, sf_dir):
    """Orders of each customer as a chain of events; events of every fiftieth order are changed after they were signed."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("event_type"), F.col("o_orderdate").cast("string").alias("at"))
    g = o.groupBy(F.col("o_custkey").alias("txn_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "event_type", "at"))).alias("events"))
    start = F.struct(F.lit("").alias("last"), F.slice(F.transform("events", lambda x, i: F.struct((i + 1).alias("sequence"), x["event_type"].alias("event_type"), x["at"].alias("at"), F.lit("").alias("previous_event_sha256"), x["o_orderkey"].alias("key"), F.lit("").alias("event_sha256"))), 1, 0).alias("out"))

    def sign(acc, x):
        seq = F.size(acc["out"]) + 1
        text = F.concat_ws("|", seq.cast("string"), x["event_type"], x["at"], acc["last"], x["o_orderkey"].cast("string"))
        sha = F.upper(F.sha2(text, 256))
        row = F.struct(seq.alias("sequence"), x["event_type"].alias("event_type"), x["at"].alias("at"), acc["last"].alias("previous_event_sha256"), x["o_orderkey"].alias("key"), sha.alias("event_sha256"))
        return F.struct(sha.alias("last"), F.concat(acc["out"], F.array(row)).alias("out"))

    e = g.select("txn_id", F.inline(F.aggregate("events", start, sign)["out"]))
    e = e.withColumn("details", F.when(F.col("key") % 50 == 0, "changed").otherwise(F.col("key").cast("string")))
    return V.verify_chain(e).select("txn_id", "events", "first_bad", "ok")


def v11_rollback_check(spark, sf_dir):
    """Changes of one file a part: every seventh has gone, every fifth was changed since, every third has no backup."""
    p = _part(spark, sf_dir)
    name, sha = F.concat(F.lit("f"), F.col("p_partkey").cast("string")), F.sha2(F.col("p_name"), 256)
    change = p.select(name.alias("path"), sha.alias("after_sha256"), F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("backup_path"))
    now = p.where("p_partkey % 7 <> 0").select(name.alias("name"), F.when(F.col("p_partkey") % 5 == 0, F.sha2(F.col("p_type"), 256)).otherwise(F.upper(sha)).alias("sha256"))
    kept = p.where("p_partkey % 3 <> 0").select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("name"), sha.alias("sha256"))
    return V.rollback_check(change, now.unionByName(kept))


QUERIES = [s7_load_terms, s8_load_registry, s9_load_samples, v10_verify_chain, v11_rollback_check]
ORACLES = {
    "s7_load_terms": "select 'draft' as status, p_brand as term, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) as normalized_key, lower(p_brand) as aliases, cast(min(p_partkey) as int) as source_page from part group by p_brand",
    "s8_load_registry": "with e as (select distinct p_brand, p_size from part) select p_brand as group_id, 'maintainer' as authority, 'user_approved' as approval_status, count(*) as entries, count(*) filter (p_size % 10 = 0) as last_ones, cast(sum(p_size) as bigint) as sizes from e group by p_brand",
    "s9_load_samples": f"with d as ({fx.duck(fx.DIMENSION)}) select doc_id, sample_idx, cast(row_number() over (partition by doc_id, sample_idx order by ord) - 1 as int) as ord, value, role, value || ' mm' as raw from d where doc_id % 2 = 0 or doc_id % 9 <> 0",
    "v10_verify_chain": "with e as (select o_custkey as txn_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) select txn_id, count(*) as events, cast(min(n) filter (o_orderkey % 50 = 0) as int) as first_bad, count(*) filter (o_orderkey % 50 = 0) = 0 as ok from e group by 1",
    "v11_rollback_check": "select 'f' || p_partkey as path, case when p_partkey % 7 = 0 then 'file_missing' when p_partkey % 5 = 0 then 'changed_since' when p_partkey % 3 = 0 then 'backup_missing' else 'ready' end as status from part",
}
