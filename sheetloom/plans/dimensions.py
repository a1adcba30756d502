"""Queries of dimension and consensus operators over the derived dimension table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms as K
from ..operators import consensus as C
from ..operators import dimensions as D
from . import fixtures as fx


def _dim(spark, sf_dir):
    return fx.load(spark, sf_dir, fx.DIMENSION).withColumn("raw", F.concat_ws(" ", "value", "unit"))


def _dual(spark, sf_dir):
    """The dimensions with an inch twin of every fifth row, now and then off by 5 %."""
    d = _dim(spark, sf_dir)
    inch = d.where("(doc_id + ord) % 5 = 0").withColumn("value", F.round(F.col("value").cast("double") / 25.4 * F.when(F.col("doc_id") % 3 == 0, 1.05).otherwise(1.0), 4).cast("string")).withColumns({"unit": F.lit("in"), "ord": F.col("ord") + 10})
    return d.unionByName(inch)


def _slots(spark, sf_dir):
    return C.align_slots(_dim(spark, sf_dir))


def d1_to_mm(spark, sf_dir):
    units = F.element_at(F.array(*map(F.lit, ("mm", "mil", "in"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return D.to_mm(_dim(spark, sf_dir).withColumn("unit", units)).select("doc_id", "sample_idx", "ord", F.round("value_mm", 6).alias("value_mm"))


def d2_dedup_units(spark, sf_dir):
    return D.dedup_units(_dual(spark, sf_dir)).select("doc_id", "sample_idx", "ord", "dropped")


def d3_dedup_candidates(spark, sf_dir):
    return D.dedup_candidates(_dual(spark, sf_dir), ["doc_id", "role"]).select("doc_id", "role", "ord", F.round("value_mm", 6).alias("value_mm"))


def d4_by_symbol(spark, sf_dir):
    d = _dim(spark, sf_dir).where("sample_idx = 0").withColumn("symbol", F.element_at(F.array(*map(F.lit, "ABCDEF")), (F.col("ord") + 1).cast("int")))
    return D.by_symbol(d, ["E", "C", "A"])


def d5_pattern_role(spark, sf_dir):
    dim = _dim(spark, sf_dir)
    return dim.select("doc_id", "sample_idx", "ord", D.pattern_role(dim).alias("pattern"))


def d6_axis_and_relation(spark, sf_dir):
    return D.labelled(_dim(spark, sf_dir)).select("doc_id", "sample_idx", "ord", "axis", "relation", "effective_role")


def d9_land_rows(spark, sf_dir):
    return D.land_rows(_dim(spark, sf_dir)).select("doc_id", "sample_idx", "ord", "tier")


def d10_half_filter(spark, sf_dir):
    d = _dim(spark, sf_dir)
    extra = d.where("ord = 0 and doc_id % 4 = 0").withColumns({"ord": F.lit(9), "role": F.lit("pitch"), "value": (F.col("value").cast("decimal(10,2)") * 2).cast("string")})
    return D.half_filter(d.unionByName(extra)).select("doc_id", "sample_idx", "ord", "half", "excluded")



def d12_normalize_roles(spark, sf_dir):
    return D.normalize_roles(_dim(spark, sf_dir)).select("doc_id", "sample_idx", "ord", "role_original", "role")


def d13_unique_axis(spark, sf_dir):
    return D.unique_axis(_dim(spark, sf_dir), ["doc_id", "role"])


def pitched(dimension):
    """The rows of packages as pitches, of every other document as half pitches."""
    pitch = F.when(F.col("doc_id") % 2 == 0, "pitch").otherwise("half_pitch")
    return dimension.withColumn("role", F.when(F.col("role") == "body_length", pitch).otherwise(F.col("role")))


def d14_pitch_refs(spark, sf_dir):
    return D.pitch_refs(pitched(_dim(spark, sf_dir))).select("doc_id", F.array_join(F.transform("pitches", lambda x: F.round(x, 4).cast("string")), ",").alias("pitches"))


def d15_paste_check(spark, sf_dir):
    d = _dim(spark, sf_dir)
    paste = d.where("ord < 2 and doc_id % 2 = 0").withColumns({"ord": F.col("ord") + 20, "belongs_to": F.lit("solder_paste"), "value": (F.col("value").cast("decimal(10,2)") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(-0.1)).cast("string")})
    return D.paste_check(d.unionByName(paste))




def d20_guards(spark, sf_dir):
    return D.guards(_dim(spark, sf_dir))


def d21_half_double(spark, sf_dir):
    v = D.to_mm(_dim(spark, sf_dir).where("sample_idx = 0")).select("doc_id", F.col("ord").cast("string").alias("field"), "value_mm")
    twice = v.where("doc_id % 3 = 0 and field = '1'").select("doc_id", F.lit("t").alias("field"), (F.col("value_mm") * 2).alias("value_mm"))
    return D.half_double(v.unionByName(twice))


def d22_provenance(spark, sf_dir):
    v = D.to_mm(_dim(spark, sf_dir).where("sample_idx = 0")).select("doc_id", F.col("ord").cast("string").alias("field"), "value_mm")
    return D.provenance(v, _dim(spark, sf_dir))


def c1_sample_gate(spark, sf_dir):
    s = _dim(spark, sf_dir).select("doc_id", "sample_idx").distinct()
    s = s.withColumn("status", F.when((F.col("doc_id") + F.col("sample_idx")) % 4 == 0, "failed").otherwise("ok")).withColumn("error_type", F.when(F.col("status") == "failed", F.concat(F.lit("E"), (F.col("doc_id") % 2).cast("string"))))
    return C.sample_gate(s)


def c2_consensus_keys(spark, sf_dir):
    return C.with_keys(_dim(spark, sf_dir)).select("doc_id", "sample_idx", "ord", "value_key", "unit_key", "partition")


def c3_canonical_endpoints(spark, sf_dir):
    return _dim(spark, sf_dir).select("doc_id", "sample_idx", "ord", C.canonical_endpoints(F.col("endpoints")).alias("canon"))


def c4_align_slots(spark, sf_dir):
    return _slots(spark, sf_dir).groupBy("doc_id", "slot").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sample_idx").alias("samples"))


def c5_vote(spark, sf_dir):
    return C.vote(_slots(spark, sf_dir))


def c6_representative_row(spark, sf_dir):
    return C.representative_row(_slots(spark, sf_dir))


def c7_needs_third(spark, sf_dir):
    return C.needs_third(_slots(spark, sf_dir))


def c8_vote_document(spark, sf_dir):
    s = _dim(spark, sf_dir).select("doc_id", "sample_idx").distinct()
    s = s.withColumns(
        {
            "family_proposal": F.when((F.col("doc_id") * (F.col("sample_idx") + 1)) % 3 == 0, "CHIP").otherwise(F.when(F.col("doc_id") % 2 == 0, "SOT3").otherwise("DUAL")),
            "pin_count": (2 + (F.col("doc_id") + F.col("sample_idx")) % 2).cast("int"), "recommended_land_pattern": F.col("doc_id") % 3 != F.col("sample_idx"),
            "paste_evidence": (F.col("doc_id") + F.col("sample_idx")) % 5 == 0, "unmarked_roles": F.array(F.lit("pitch"), F.concat(F.lit("r"), (F.col("sample_idx") % 2).cast("string"))),
        }
    )
    return C.vote_document(s).withColumn("unmarked_roles", F.array_join("unmarked_roles", ","))


def c9_consensus_stats(spark, sf_dir):
    """Agreement over the repeated readings, of which now and then a row is missing, named differently or derived."""
    d = _dim(spark, sf_dir).where("ord < 4").withColumn("value", F.concat((F.col("ord") + 1).cast("string"), F.lit(".00"))).withColumn("is_derived", F.expr("ord = 3 and sample_idx = 1"))
    stats = C.consensus_stats(C.align_slots(d), C.align_slots(d.where("sample_idx < 2")))
    return stats.withColumns({"sample_dimension_counts": F.array_join(F.transform("sample_dimension_counts", lambda x: x.cast("string")), ","), "consensus_throughput_vs_max_sample": F.round("consensus_throughput_vs_max_sample", 6)})


def c10_token_votes(spark, sf_dir):
    t = _dim(spark, sf_dir).select("doc_id", "sample_idx", F.concat(F.lit("CASE"), "value").alias("token"))
    return C.token_votes(t)


QUERIES = [
    d1_to_mm, d2_dedup_units, d3_dedup_candidates, d4_by_symbol, d5_pattern_role, d6_axis_and_relation, d9_land_rows, d10_half_filter, d12_normalize_roles, d13_unique_axis,
    d14_pitch_refs, d15_paste_check, d20_guards, d21_half_double, d22_provenance, c1_sample_gate, c2_consensus_keys, c3_canonical_endpoints, c4_align_slots,
    c5_vote, c6_representative_row, c7_needs_third, c8_vote_document, c9_consensus_stats, c10_token_votes,
]

_DIM = f"dimension as (select *, value || ' ' || unit as raw, cast(value as double) as mm from ({fx.duck(fx.DIMENSION)}))"
_DUAL = f"{_DIM}, inch as (select doc_id, sample_idx, ord + 10 as ord, role, belongs_to, endpoints, 'in' as unit, round(mm / 25.4 * case when doc_id % 3 = 0 then 1.05 else 1.0 end, 4) as v, raw from dimension where (doc_id + ord) % 5 = 0)"
_LAB = f"""{_DIM}, lab as (select *, case when ord in (0, 2, 3, 4) then 'x' when ord = 1 then 'y' else 'x' end as axis, case ord when 0 then 'pad' when 1 then 'pad' when 2 then 'gap' when 3 then 'overall' when 4 then 'center' else 'outline' end as relation from dimension)"""
ORACLES = {
    "d15_paste_check": f"""with {_LAB}, l as (select doc_id, axis, arg_min(mm, (ord, mm)) as land from lab where relation = 'pad' and belongs_to = 'solder_land' group by all),
q as (select distinct doc_id, axis, cast(value as decimal(10,2)) + case when doc_id % 6 = 0 then 1 else -0.1 end as paste, sample_idx, ord from lab where ord < 2 and doc_id % 2 = 0), f as (select doc_id, axis, arg_min(paste, (ord, paste)) as paste from q group by all), a as (select doc_id from l union select doc_id from f)
select a.doc_id, bool_and(paste <= land + 1e-9) as paste_within_land from a left join (select doc_id, land, paste from l join f using (doc_id, axis)) p on p.doc_id = a.doc_id group by 1""",
    "d20_guards": f"""with {_LAB}, g as (select doc_id, sample_idx, max(mm) filter (er = 'pad') as p, max(mm) filter (er = 'gap') as g, max(mm) filter (er = 'center') as c, max(mm) filter (er = 'overall') as o, max(mm) filter (belongs_to = 'package_outline') as b
 from (select *, case when role = 'other' then case ord when 0 then 'x' else 'x' end else relation end as er0, case when role <> 'other' then relation else 'other' end as er from lab where axis = 'x') group by all),
r as (select doc_id, sample_idx, list_filter([case when abs(g + p - c) > {K.GAP_TOL} * greatest(c, g + p) then 'gap_plus_pad' end, case when abs(g + 2 * p - o) > {K.CLOSURE} + 1e-9 then 'overall_closure' end, case when abs(c + p - o) > {K.CLOSURE} + 1e-9 then 'center_closure' end, case when b < p then 'body_below_pad' end, case when b > o then 'body_above_overall' end], lambda x: x is not null) as f from g)
select doc_id, sample_idx, coalesce(array_to_string(f, ','), '') as reasons, len(f) = 0 as passes from r""",
    "d21_half_double": f"""with {_DIM}, v as (select doc_id, cast(ord as varchar) as field, cast(value as decimal(20,6)) as v from dimension where sample_idx = 0), w as (select * from v union all select doc_id, 't', v * 2 from v where doc_id % 3 = 0 and field = '1')
select a.doc_id, a.field as half_field, b.field as double_field from w a join w b on a.doc_id = b.doc_id and b.v = 2 * a.v and a.field <> b.field""",
    "d1_to_mm": f"with {_DIM} select doc_id, sample_idx, ord, cast(round(cast(cast(value as decimal(18,4)) * cast([1, 0.0254, 25.4][doc_id % 3 + 1] as decimal(10,4)) as double), 6) as double) as value_mm from dimension",
    "d2_dedup_units": f"""with {_DUAL}, hit as (select distinct i.doc_id, i.sample_idx, i.ord from inch i join dimension m on m.doc_id = i.doc_id and m.sample_idx = i.sample_idx and m.belongs_to = i.belongs_to and (m.endpoints = i.endpoints or m.raw = i.raw) where abs(v * 25.4 - m.mm) <= {K.DUAL_UNIT_TOL} * greatest(v * 25.4, m.mm))
select doc_id, sample_idx, ord, false as dropped from dimension union all select i.doc_id, i.sample_idx, i.ord, h.ord is not null from inch i left join hit h using (doc_id, sample_idx, ord)""",
    "d3_dedup_candidates": f"with {_DIM} select doc_id, role, min(ord) as ord, round(mm, 6) as value_mm from dimension group by doc_id, role, mm",
    "d4_by_symbol": f"with {_DIM}, s as (select *, ['A','B','C','D','E','F'][ord + 1] as symbol from dimension where sample_idx = 0), r as (select *, row_number() over (partition by doc_id order by case symbol when 'E' then 0 when 'C' then 1 else 2 end, ord) as n from s where symbol in ('E', 'C', 'A')) select doc_id, symbol, value from r where n = 1",
    "d14_pitch_refs": f"""with {_DIM}, v as (select distinct doc_id, cast(value as decimal(10,2)) * (case when doc_id % 2 = 0 then 1 else 2 end) as v from dimension where belongs_to = 'package_outline' and role = 'body_length')
select doc_id, string_agg(cast(cast(v as double) as varchar), ',' order by v) as pitches from v group by doc_id""",
    "d5_pattern_role": f"with {_DIM} select doc_id, sample_idx, ord, case when belongs_to = 'solder_paste' or role in ('paste_width', 'paste_height') then 'paste' when belongs_to = 'solder_land' then 'lands' when belongs_to in ('package_outline', 'occupied_area') then 'other' else 'unknown' end as pattern from dimension",
    "d6_axis_and_relation": f"""with {_LAB} select doc_id, sample_idx, ord, axis, relation, case when relation in ('center', 'pad', 'gap', 'overall') and role <> 'other' then relation
  when role in ('pad_width', 'pad_height') then 'pad' when role = 'pad_gap' then 'gap' when role = 'pad_center_distance' then 'center' when role = 'overall_span' then 'overall' else role end as effective_role from lab""",
    "d9_land_rows": f"with {_DIM} select doc_id, sample_idx, ord, 3 as tier from dimension where belongs_to = 'solder_land' union all select doc_id, sample_idx, ord, 1 from dimension d where belongs_to = 'other' and not exists (select 1 from dimension e where e.doc_id = d.doc_id and e.sample_idx = d.sample_idx and e.belongs_to = 'solder_land')",
    "d10_half_filter": f"""with {_DIM}, w as (select doc_id, sample_idx, belongs_to, cast(value as decimal(10,2)) as v from dimension where role in ('pad_center_distance', 'pitch') union all select doc_id, sample_idx, belongs_to, cast(value as decimal(10,2)) * 2 from dimension where ord = 0 and doc_id % 4 = 0),
p as (select doc_id, sample_idx, ord, exists (select 1 from w where w.doc_id = d.doc_id and w.sample_idx = d.sample_idx and w.belongs_to = d.belongs_to and w.v = 2 * cast(d.value as decimal(10,2))) as half from dimension d where role in ('pad_width', 'pad_height'))
select *, half and count(*) filter (not half) over (partition by doc_id, sample_idx) >= 2 as excluded from p""",
    "d12_normalize_roles": f"""with {_LAB}, x as (select *, bool_or(role = 'pad_width') over w as hw, bool_or(role = 'pad_height') over w as hh from lab window w as (partition by doc_id, sample_idx))
select doc_id, sample_idx, ord, role as role_original, case when role = 'other' and relation = 'pad' and axis = 'x' and not hw then 'pad_width' when role = 'other' and relation = 'pad' and axis = 'y' and not hh then 'pad_height' else role end as role from x""",
    "d13_unique_axis": f"with {_DIM} select doc_id, role, case when max(mm) - min(mm) <= {K.CONSISTENT} + 1e-12 then round(avg(mm), 6) end as value_mm, count(*) as n from dimension group by all",


    "d22_provenance": f"""with {_DIM}, v as (select doc_id, cast(ord as varchar) as field, mm from dimension where sample_idx = 0),
j as (select v.doc_id, field, count(*) as n, string_agg(sample_idx || ':' || ord, ',' order by sample_idx, ord) as r from v join dimension d on d.doc_id = v.doc_id and abs(d.mm - v.mm) <= {K.PROVENANCE_TOL} + 1e-12 group by all)
select doc_id, field, coalesce(n, 0) as sources, coalesce(r, '') as "rows" from v left join j using (doc_id, field)""",
    "c1_sample_gate": f"""with {_DIM}, s as (select distinct doc_id, sample_idx from dimension), t as (select *, (doc_id + sample_idx) % 4 = 0 as bad from s)
select doc_id, count(*) filter (not bad) as ok, count(*) filter (bad) as failed, case when bool_or(bad) then 'E' || (doc_id % 2) else '' end as errors, count(*) filter (not bad) >= 2 as enough from t group by doc_id""",
    "c2_consensus_keys": f"with {_DIM} select doc_id, sample_idx, ord, value as value_key, 'mm' as unit_key, belongs_to as partition from dimension",
    "c3_canonical_endpoints": rf"with {_DIM} select doc_id, sample_idx, ord, regexp_replace(replace(endpoints, '->', '→'), '\s+', '', 'g') as canon from dimension",
    "c8_vote_document": f"""with {_DIM}, s as (select distinct doc_id, sample_idx from dimension), t as (select *, case when (doc_id * (sample_idx + 1)) % 3 = 0 then 'CHIP' when doc_id % 2 = 0 then 'SOT3' else 'DUAL' end as f, 2 + (doc_id + sample_idx) % 2 as p, doc_id % 3 <> sample_idx as l, (doc_id + sample_idx) % 5 = 0 as paste from s),
n as (select doc_id, count(*) as n, bool_or(paste) as paste_evidence, bool_or(sample_idx % 2 = 0) as r0, bool_or(sample_idx % 2 = 1) as r1 from t group by 1),
f as (select doc_id, f as v, count(*) as c from t group by all), p as (select doc_id, p as v, count(*) as c from t group by all), l as (select doc_id, l as v, count(*) as c from t group by all)
select n.doc_id, n.n, paste_evidence, case when r0 and r1 then 'pitch,r0,r1' when r0 then 'pitch,r0' else 'pitch,r1' end as unmarked_roles,
  coalesce((select v from f where f.doc_id = n.doc_id and c * 2 > n.n), 'other') as family_proposal, cast((select v from p where p.doc_id = n.doc_id and c * 2 > n.n) as int) as pin_count, coalesce((select v from l where l.doc_id = n.doc_id and c * 2 > n.n), false) as recommended_land_pattern from n""",
    "c9_consensus_stats": f"""with {_DIM}, r as (select doc_id, sample_idx, ord, role, belongs_to, ord = 3 and sample_idx = 1 as v from dimension where ord < 4),
i as (select doc_id, ord, count(*) filter (sample_idx = 0) as a, count(*) filter (sample_idx = 1) as b, count(distinct role) as kr, count(distinct belongs_to) as kb, count(distinct v) as kv from r where sample_idx < 2 group by all),
f as (select doc_id, count(*) as u, count(*) filter (a = 1 and b = 1 and kr = 1) as same, count(*) filter (a = 1 and b = 1 and kr > 1) as dr, count(*) filter (a = 1 and b = 1 and kb > 1) as db, count(*) filter (a = 1 and b = 1 and kv > 1) as dv, count(*) filter (a <> b) as dp, count(*) filter (a <> b or kr > 1 or kb > 1 or kv > 1) as d from i group by 1),
t as (select r.* from r left join f using (doc_id) where sample_idx < 2 or coalesce(d > 0, true)), n as (select doc_id, count(distinct sample_idx) as n from t group by 1), cnt as (select doc_id, sample_idx, count(*) as c from t group by all), sizes as (select doc_id, string_agg(cast(c as varchar), ',' order by sample_idx) as l, max(c) as m from cnt group by 1),
s as (select doc_id, ord, count(*) as p, count(distinct role) as kr, count(distinct belongs_to) as kb, count(distinct v) as kv, max(role) filter (role <> 'other') as named, count(*) filter (role <> 'other') as c, count(*) filter (sample_idx = 0) as a, count(*) filter (sample_idx = 1) as b, count(distinct case when sample_idx < 2 then role end) as kr2, count(distinct case when sample_idx < 2 then v end) as kv2 from t group by all),
w as (select s.*, n, p * 2 > n as kept, case when c * 2 > n then named else 'other' end as role, a <> 1 or b <> 1 or kr2 > 1 or kv2 > 1 as open from s join n using (doc_id))
select w.doc_id, cast(max(n) as int) as sample_success_count, count(*) as aligned_slot_count, count(*) filter (kept) as consensus_dimension_count, count(*) filter (not kept) as dropped_no_presence_majority_count, count(*) filter (kept and kr > 1) as role_vote_disagreement_count, count(*) filter (kept and kb > 1) as belongs_to_disagreement_count,
 count(*) filter (kept and kv > 1) as is_derived_disagreement_count, count(*) filter (kept and role = 'other' and c > 0) as downgraded_other_count, count(*) filter (kept and open and role <> 'other') as third_sample_majority_resolved_count, any_value(u) as initial_key_union_count, any_value(same) as initial_role_agreement_count, any_value(dr) as initial_role_disagreement_count,
 any_value(db) as initial_belongs_to_disagreement_count, any_value(dv) as initial_is_derived_disagreement_count, any_value(dp) as initial_presence_disagreement_count, any_value(d) as initial_disagreement_count, any_value(l) as sample_dimension_counts, any_value(m) as input_max_sample_dimension_count, 2 as requested_base_samples,
 coalesce(any_value(d) > 0, true) as third_sample_triggered, cast(case when coalesce(any_value(d) > 0, true) then 3 else 2 end as int) as sample_attempt_count, round(count(*) filter (kept) / any_value(m), 6) as consensus_throughput_vs_max_sample from w left join f using (doc_id) join sizes using (doc_id) group by 1""",
    "c10_token_votes": f"with {_DIM} select doc_id, 'CASE' || value as token, count(distinct sample_idx) as samples, count(distinct sample_idx) >= 2 as accepted from dimension group by all",
}
