"""Queries of notation and package operators over the derived page and dimension tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dimensions as D
from ..operators import notation as N
from ..operators import packages as M
from ..operators import pages as P
from . import fixtures as fx

# A small dictionary: term, key, alias group, aliases, evidence class.
TERMS = (
    ("CASE 101-01", "CASE10101", "", "", "declarative_case_label"), ("CASE 102-01", "CASE10201", "case-102", "C102", "declarative_case_label"), ("SOT-23", "SOT23", "sot-23", "TO-236", "declarative_package_label"),
    ("SOT-21", "SOT21", "", "", "declarative_package_label"), ("SOT-22", "SOT22", "sot-22", "SC-70", "table_package_column"), ("CASE 105-01", "CASE10501", "", "", "declarative_package_outline"),
)


def _page(spark, sf_dir):
    return fx.load(spark, sf_dir, fx.PAGE)


def _line(spark, sf_dir):
    return P.explode_lines(_page(spark, sf_dir))


def _terms(spark):
    rows = [(i, *t[:3], [a for a in t[3].split(",") if a], t[4]) for i, t in enumerate(TERMS)]
    # A list of fixed size: without the hint Spark takes rows from Python for a huge table and shuffles every key of every line.
    return F.broadcast(spark.createDataFrame(rows, "pos int, term string, normalized_key string, alias_group_id string, aliases array<string>, evidence_class string"))


def _hits(spark, sf_dir):
    return M.relation_gate(_line(spark, sf_dir), _terms(spark))


def n1_classify_lines(spark, sf_dir):
    return N.classify_lines(_line(spark, sf_dir))


def n2_notation_summary(spark, sf_dir):
    return N.notation_summary(N.classify_lines(_line(spark, sf_dir)))


def n3_pair_values(spark, sf_dir):
    return N.pair_values(N.classify_lines(_line(spark, sf_dir)))


def n5_resolve_units(spark, sf_dir):
    return N.resolve_units(_page(spark, sf_dir), N.pair_values(N.classify_lines(_line(spark, sf_dir))))


def n6_accepted_values(spark, sf_dir):
    return N.accepted_values(_page(spark, sf_dir), _line(spark, sf_dir))


def n7_extract_bounds(spark, sf_dir):
    return N.extract_bounds(_page(spark, sf_dir), _line(spark, sf_dir))



def n11_anchor(spark, sf_dir):
    dim = fx.load(spark, sf_dir, fx.DIMENSION).where("sample_idx = 0").select("doc_id", "ord", "value")
    dim = dim.unionByName(dim.where("ord = 0").select("doc_id", F.lit(9).alias("ord"), F.lit("2.54").alias("value")))
    return N.anchor(dim, _page(spark, sf_dir))


def n13_decimal_extension(spark, sf_dir):
    dim = fx.load(spark, sf_dir, fx.DIMENSION).where("sample_idx = 0").select("doc_id", "ord", F.when(F.col("ord") == 0, "2.5").when(F.col("ord") == 1, "1.27").otherwise(F.col("value")).alias("value"))
    return N.decimal_extension(dim, _page(spark, sf_dir))


def _anchored(spark, sf_dir):
    dim = fx.load(spark, sf_dir, fx.DIMENSION).where("sample_idx = 0").select("doc_id", "ord", F.when(F.col("ord") == 0, "2.5").when(F.col("ord") == 1, "1.27").otherwise(F.col("value")).alias("value"), "unit")
    return D.to_mm(dim)


def n12_anchor_used(spark, sf_dir):
    dim = _anchored(spark, sf_dir)
    return N.anchor_used(dim.select("doc_id", F.concat(F.lit("f"), "ord").alias("field"), "value_mm"), dim, _page(spark, sf_dir))


def n14_decimal_guard(spark, sf_dir):
    dim = _anchored(spark, sf_dir)
    value = dim.select("doc_id", F.concat(F.lit("f"), "ord").alias("field"), "ord", "value_mm")
    return N.apply_decimal_guard(value, dim, N.decimal_extension(dim, _page(spark, sf_dir))).withColumn("value_mm", F.round("value_mm", 6))


def d16_body_candidates(spark, sf_dir):
    dim = fx.load(spark, sf_dir, fx.DIMENSION).where("sample_idx = 0").withColumn("raw", F.when(F.col("doc_id") % 7 == 0, "1 x 2").when(F.col("doc_id") % 5 == 0, F.concat(F.lit("ø "), "value")).otherwise(F.col("value")))
    dim = dim.withColumn("value", F.when(F.col("doc_id") % 4 == 0, "2.54").otherwise(F.col("value")))
    token = N.accepted_values(_page(spark, sf_dir), _line(spark, sf_dir)).select("doc_id", "value_mm", F.coalesce("accepted", F.lit(False)).alias("accepted"))
    return D.filter_body_candidates(dim, token)


def m1_match_terms(spark, sf_dir):
    return M.match_terms(_line(spark, sf_dir), _terms(spark)).select("doc_id", "page", "line_no", "term", "offset")


def m2_context(spark, sf_dir):
    return M.context(_line(spark, sf_dir)).select("doc_id", "page", "line_no", "context")


def m3_relation_gate(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", "page", "line_no", "term", "mode")


def m4_resolve_identity(spark, sf_dir):
    return M.resolve_identity(_page(spark, sf_dir), _hits(spark, sf_dir))


def m5_representative(spark, sf_dir):
    return M.representative(_hits(spark, sf_dir), _terms(spark))


def m6_frozen_match(spark, sf_dir):
    docs = fx.load(spark, sf_dir, fx.DOCUMENT).select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"))
    terms = docs.where("doc_id % 6 = 0").select(
        F.col("content_sha256").alias("source_pdf_sha256"), F.concat(F.lit("CASE "), F.col("doc_id").cast("string")).alias("source_line"), F.lit("").alias("alias_group_id"), F.concat(F.lit("k"), (F.col("doc_id") % 12).cast("string")).alias("normalized_key"),
        F.when(F.col("doc_id") % 18 == 0, "00").otherwise(F.sha2(F.concat(F.lit("CASE "), F.col("doc_id").cast("string")).cast("binary"), 256)).alias("source_line_sha256"),
    )
    return M.frozen_match(docs, terms)


def m7_lookup_canonical(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 9 == 0, "none such").otherwise(F.lower("p_brand")).alias("name"))
    return M.lookup_canonical(part, fx.load(spark, sf_dir, fx.REGISTRY_GROUP))


def m8_body_cross_check(spark, sf_dir):
    g = fx.load(spark, sf_dir, fx.GEOMETRY)
    return M.body_cross_check(g.select("doc_id", F.col("body_x").alias("doc_x"), F.when(F.col("body_y") > 0, F.col("body_y")).alias("doc_y"), F.when(F.col("doc_id") % 2 == 0, F.col("body_y")).otherwise(F.col("body_x") + 0.1).alias("entry_x"), F.when(F.col("doc_id") % 2 == 0, F.col("body_x")).otherwise(F.col("body_y") + F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(0.0)).alias("entry_y")))


def m9_route_fallback(spark, sf_dir):
    page = _page(spark, sf_dir)
    rec = page.select("doc_id").distinct().withColumn("has_candidate", F.col("doc_id") % 8 == 0)
    frozen = rec.where("doc_id % 10 = 1").select("doc_id", F.lit("unique").alias("status"))
    return M.route_fallback(rec, frozen, m4_resolve_identity(spark, sf_dir), m7_lookup_canonical(spark, sf_dir), m8_body_cross_check(spark, sf_dir))


QUERIES = [
    n1_classify_lines, n2_notation_summary, n3_pair_values, n5_resolve_units, n6_accepted_values, n7_extract_bounds, n11_anchor, n12_anchor_used, n13_decimal_extension, n14_decimal_guard, d16_body_candidates,
    m1_match_terms, m2_context, m3_relation_gate, m4_resolve_identity, m5_representative, m6_frozen_match, m7_lookup_canonical, m8_body_cross_check, m9_route_fallback,
]

_PAGE = f"page as ({fx.duck(fx.PAGE)})"
_LINES = r"lines as (select doc_id, page, unnest(string_split(text, chr(10))) as norm, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from page)"
_GROUP = f"grp as ({fx.duck(fx.REGISTRY_GROUP)})"
ORACLES = {
    "n7_extract_bounds": f"""with {_PAGE}, k as (select doc_id, page from page where (doc_id + page) % 5 = 1)
select doc_id, page, cast(m.max_line as int) as max_line, cast(m.max_line + 1 as int) as min_line, m.max_mm, m.min_mm, 3 as block_pair_count from k cross join (values (4, 2.54::double, 1.27::double), (6, 3.1::double, 2.9::double), (8, 1.75::double, 1.45::double)) as m(max_line, max_mm, min_mm)""",
    "m1_match_terms": f"""with {_PAGE}, {_LINES}, t as (select unnest(['CASE 101-01', 'CASE 102-01', 'SOT-23', 'SOT-21', 'SOT-22', 'CASE 105-01']) as term)
select doc_id, page, cast(line_no as int) as line_no, term, cast(strpos(norm, term) - 1 as int) as offset from lines join t on contains(norm, term)""",
    "m2_context": f"with {_PAGE}, {_LINES}, f as (select * from lines where norm <> '') select doc_id, page, cast(line_no as int) as line_no, string_agg(norm, ' | ') over (partition by doc_id, page order by line_no rows between 3 preceding and 3 following) as context from f",
    "m6_frozen_match": """with d as (select doc_id, sha256(text) as h from documents), t as (select h, 'TERM:K' || cast(doc_id % 12 as varchar) as k from d where doc_id % 6 = 0 and doc_id % 18 <> 0)
select doc_id, case when count(distinct k) = 1 then 'unique' else 'ambiguous' end as status, string_agg(distinct k, ',' order by k) as identities from d join t using (h) group by doc_id""",
    "m7_lookup_canonical": f"""with {_GROUP}, p as (select p_partkey as doc_id, case when p_partkey % 9 = 0 then 'NONESUCH' else upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '')) end as k from part), g as (select group_id, upper(regexp_replace(package_code, '[^A-Za-z0-9]', '')) as k from grp where approval_status = 'user_approved')
select doc_id, case when group_id is null then 'not_found' else 'unique' end as status, group_id from p left join g using (k)""",
    "n11_anchor": rf"""with {_PAGE}, d as (select doc_id, ord, value from ({fx.duck(fx.DIMENSION)}) where sample_idx = 0), e as (select * from d union all select doc_id, 9, '2.54' from d where ord = 0),
tok as (select doc_id, page, unnest(list_concat(regexp_extract_all(text, '[\p{{Nd}}.,]+'), regexp_extract_all(text, '[+-][\p{{Nd}}.,]+'))) as value from page)
select e.doc_id, e.ord, e.value, count(distinct tok.page) as pages, count(distinct tok.page) > 0 as anchored from e left join tok on tok.doc_id = e.doc_id and tok.value = e.value group by all""",
}
