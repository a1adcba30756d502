"""Queries of relation and pad operators over the derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pads as P
from ..operators import relations as R
from . import fixtures as fx


def _dim(spark, sf_dir):
    return fx.load(spark, sf_dir, fx.DIMENSION).where("sample_idx = 0")


def _geo(spark, sf_dir):
    return fx.load(spark, sf_dir, fx.GEOMETRY)


def r1_two_pad(spark, sf_dir):
    return R.rel_two_pad(_dim(spark, sf_dir)).select("doc_id", "formula", "pad_x", "pad_y", "center_x", "relation_score", "role_score")



def _pins(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), (2 + F.col("p_partkey") % 3).cast("int").alias("pin_count"))


def _inline(spark, sf_dir):
    """The dimensions with their center taken as two edges of a line of three, of which a seventh lacks one."""
    d = _dim(spark, sf_dir)
    edge = lambda a, b, o: d.where("ord = 4").withColumns({"ord": F.lit(o), "endpoints": F.lit(f"{a} pad centerline -> {b} pad centerline"), "role": F.lit("pad_center_distance")})
    return d.where("ord <> 4").unionByName(edge("left", "middle", 4)).unionByName(edge("middle", "right", 10).where("doc_id % 7 <> 0"))


def _grid(spark, sf_dir):
    d = _dim(spark, sf_dir).withColumn("role", F.when(F.col("ord") == 4, "pad_center_distance").otherwise(F.col("role")))
    up = d.where("ord = 4").withColumns({"ord": F.lit(11), "endpoints": F.when(F.col("doc_id") % 5 == 0, "top pad centerline -> left pad centerline").otherwise("top pad centerline -> bottom pad centerline")})
    return d.unionByName(up)



def r4_inline(spark, sf_dir):
    return R.rel_inline(_inline(spark, sf_dir), _pins(spark, sf_dir)).select("doc_id", "pad_x", "pad_y", "center_x")


def r5_grid(spark, sf_dir):
    return R.rel_grid(_grid(spark, sf_dir), _pins(spark, sf_dir)).select("doc_id", "pad_x", "pad_y", "center_x", "pitch_y")



def r15_pin_mapping(spark, sf_dir):
    pins = _pins(spark, sf_dir)
    d = pins.select("doc_id", F.lit(0).alias("ord"), F.concat(F.lit("left pad "), (1 + F.col("doc_id") % 2).cast("string"), F.lit(" -> right pad 2")).alias("endpoints"))
    want = pins.select("doc_id", F.inline(F.array(F.struct(F.lit("left").alias("side"), F.lit(1).alias("number")), F.struct(F.lit("right").alias("side"), F.lit(2).alias("number")))))
    return R.pin_mapping(d, want)


def r17_family_gate(spark, sf_dir):
    geo = _geo(spark, sf_dir)
    decision = geo.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "insufficient").otherwise("auto").alias("status"), "family")
    solved = geo.where("doc_id % 7 <> 0").select("doc_id", "family")
    count = geo.select("doc_id", F.lit(3).alias("pads"), (2 + F.col("doc_id") % 2).cast("int").alias("pin_count"))
    return R.family_gate(decision, solved, count)



def r12_symbol_combos(spark, sf_dir):
    d = _dim(spark, sf_dir).withColumn("symbol", F.when((F.col("doc_id") % 3 != 0) & (F.col("ord") < 2), F.element_at(F.array(F.lit("A"), F.lit("b")), (F.col("ord") + 1).cast("int"))).when((F.col("doc_id") % 3 != 0) & (F.col("ord") == 4), "C").otherwise(""))
    return R.symbol_combos(d)



def r9_admit(spark, sf_dir):
    return R.admit(R.rel_two_pad(_dim(spark, sf_dir))).select("doc_id", "formula", "pad_x", "faults", "admitted")


def r10_pick(spark, sf_dir):
    return R.pick(R.rel_two_pad(_dim(spark, sf_dir)))


def r11_role_direct(spark, sf_dir):
    return R.role_direct(_dim(spark, sf_dir))



def r16_resolve_families(spark, sf_dir):
    geo = _geo(spark, sf_dir)
    both = geo.unionByName(geo.where("family = 'CHIP'").withColumn("family", F.lit("SMX"))).unionByName(geo.where("family = 'SOT3'").withColumn("family", F.lit("GRID4")))
    return R.resolve_families(geo, P.geometry_signature(P.expand_pads(both)))


def r18_missing_fields(spark, sf_dir):
    return R.missing_fields(_geo(spark, sf_dir))


def p1_expand_pads(spark, sf_dir):
    return P.expand_pads(_geo(spark, sf_dir)).withColumns({c: F.round(c, 6) + 0.0 for c in ("at_x", "at_y")})


def p2_validate_geometry(spark, sf_dir):
    return P.validate_geometry(_geo(spark, sf_dir))


def p3_bounds(spark, sf_dir):
    geo = _geo(spark, sf_dir)
    return P.bounds(P.expand_pads(geo), geo)


def p4_visible_ranges(spark, sf_dir):
    geo = _geo(spark, sf_dir)
    side = geo.select("doc_id", (F.col("pad_y") / 2).alias("y"), (-F.col("body_x")).alias("x0"), F.col("body_x").alias("x1"))
    return P.visible_ranges(side, P.expand_pads(geo).drop("family"))


def p5_paste_size(spark, sf_dir):
    return P.paste_size(_geo(spark, sf_dir))


def p6_geometry_signature(spark, sf_dir):
    return P.geometry_signature(P.expand_pads(_geo(spark, sf_dir)))


def _whole_pads(spark, sf_dir):
    """Pads with every compared field: round corners on the first pad, four layer sets, a paste margin on large pads."""
    pad = P.expand_pads(_geo(spark, sf_dir)).drop("family")
    first = F.col("number") == "1"
    layers = F.when(F.col("size_x") > 1, "F.Cu,F.Mask").otherwise("F.Cu,F.Paste,F.Mask")
    return pad.withColumns({"type": F.lit("smd"), "shape": F.when(first, "roundrect").otherwise("rect"), "layers": layers, "rotation": F.lit(0.0), "roundrect_rratio": F.when(first, 0.25), "solder_paste_margin": F.when(F.col("size_x") > 1, -0.05)})


def p8_diff_pads(spark, sf_dir):
    pad = _whole_pads(spark, sf_dir).withColumnRenamed("doc_id", "pair_id")
    k = F.col("pair_id")
    other = pad.where("pair_id % 9 <> 0 or number <> '2'").withColumns({
        "at_x": F.col("at_x") + F.when(k % 4 == 0, 0.0005).when(k % 4 == 1, 0.01).otherwise(0.0), "shape": F.when(k % 5 == 0, "oval").otherwise(F.col("shape")),
        "rotation": F.when(k % 7 == 0, 90.0).otherwise(F.col("rotation")), "solder_paste_margin": F.when(k % 6 == 0, 0.0).otherwise(F.col("solder_paste_margin")),
    })
    return P.diff_pads(pad, other)


def p9_match_registry(spark, sf_dir):
    """Every part against a registry with one entry for each code and size; some entries stand in it twice, under a second name."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("package_code"), "p_size")
    pad = _whole_pads(spark, sf_dir)
    first = part.groupBy("package_code", "p_size").agg(F.min("doc_id").alias("doc_id"))
    name = F.col("doc_id").cast("string")
    entry = first.select("doc_id", "package_code", F.explode(F.when(F.col("doc_id") % 7 == 0, F.array(name, F.concat(name, F.lit("-copy")))).otherwise(F.array(name))).alias("entry_id"))
    entry_pad = entry.select("doc_id", "entry_id").join(pad, "doc_id").drop("doc_id")
    code = part.select("doc_id", F.when(F.col("doc_id") % 13 == 0, "").when(F.col("doc_id") % 17 == 0, F.concat("package_code", F.lit("-X"))).otherwise(F.lower("package_code")).alias("package_code"))
    return P.match_registry(code, pad, entry.select("entry_id", "package_code"), entry_pad)


def p10_package_codes(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    more = F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).when(F.col("p_partkey") % 7 == 0, "").otherwise(F.lower("p_brand"))
    js = F.to_json(F.struct(F.struct(F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_brand")).alias("package_code")).alias("a"), F.array(F.struct(more.alias("package_code"))).alias("b")))
    return P.package_codes(part.select(F.col("p_partkey").alias("doc_id"), js.alias("json")))


def p11_compare_values(spark, sf_dir):
    geo = _geo(spark, sf_dir)
    v = geo.unpivot(["doc_id"], ["pad_x", "pad_y", "center_x"], "field", "value")
    other = v.where("not (doc_id % 8 = 0 and field = 'pad_y')").withColumn("value", F.col("value") + F.when(F.col("doc_id") % 5 == 0, 0.02).otherwise(0.005))
    return P.compare_values(v.where("not (doc_id % 11 = 0 and field = 'pad_x')"), other)


def p12_unchanged(spark, sf_dir):
    geo = _geo(spark, sf_dir)
    after = geo.withColumns({"body_x": F.col("body_x") + 1, "pad_x": F.when(F.col("doc_id") % 50 == 0, F.col("pad_x") + 1).otherwise(F.col("pad_x"))})
    return P.unchanged(geo, after).select("doc_id", "family", F.round("pad_x", 6).alias("pad_x"))


QUERIES = [
    r1_two_pad, r4_inline, r5_grid, r12_symbol_combos, r15_pin_mapping, r17_family_gate, r9_admit, r10_pick, r11_role_direct, r16_resolve_families, r18_missing_fields,
    p1_expand_pads, p2_validate_geometry, p3_bounds, p4_visible_ranges, p5_paste_size, p6_geometry_signature, p8_diff_pads, p9_match_registry, p10_package_codes, p11_compare_values, p12_unchanged,
]

_GEO = f"geo as ({fx.duck(fx.GEOMETRY)})"
_LAND = f"""dimension as (select *, cast(value as double) as mm from ({fx.duck(fx.DIMENSION)}) where sample_idx = 0),
land as (select doc_id, mm, case when role = 'other' then 0 else 1 end as named, case when ord = 1 then 'y' else 'x' end as axis,
  case when ord in (0, 1) and role <> 'other' then 'pad' when ord = 2 and role <> 'other' then 'gap' when ord = 3 and role <> 'other' then 'overall' when ord = 4 and role <> 'other' then 'center' else role end as er from dimension where belongs_to = 'solder_land'),
pad as (select doc_id, mm as v, named as nm from land where er = 'pad' and axis = 'x'), crs as (select doc_id, mm as v, named as nm from land where er = 'pad' and axis = 'y'),
gap as (select doc_id, mm as v, named as nm from land where er = 'gap'), ovr as (select doc_id, mm as v, named as nm from land where er = 'overall'), ctr as (select doc_id, mm as v, named as nm from land where er = 'center'),
cand as (select pad.doc_id, 'REL_DIRECT_CENTER_x' as formula, round(pad.v, 6) as pad_x, round(crs.v, 6) as pad_y, round(ctr.v, 6) as center_x, 1 as relation_score, pad.nm + crs.nm + ctr.nm as role_score from pad join crs using (doc_id) join ctr using (doc_id) where ctr.v > pad.v
 union all select pad.doc_id, 'REL_GAP_PLUS_PAD_x', round(pad.v, 6), round(crs.v, 6), round(gap.v + pad.v, 6), case when exists (select 1 from ovr where ovr.doc_id = pad.doc_id and abs(ovr.v - gap.v - 2 * pad.v) <= 0.02 + 1e-9) then 4 else 2 end, pad.nm + crs.nm + gap.nm from pad join crs using (doc_id) join gap using (doc_id)
 union all select ovr.doc_id, 'REL_OVERALL_GAP_x', round((ovr.v - gap.v) / 2, 6), round(crs.v, 6), round(gap.v + (ovr.v - gap.v) / 2, 6), case when exists (select 1 from pad where pad.doc_id = ovr.doc_id and abs(pad.v - (ovr.v - gap.v) / 2) <= 0.02 + 1e-9) then 4 else 3 end, ovr.nm + gap.nm + crs.nm from ovr join gap using (doc_id) join crs using (doc_id) where ovr.v > gap.v)"""
_ONE = "case when max({v}) - min({v}) <= 0.02 + 1e-12 then round(avg({v}), 6) end"
_SIDE = lambda er, axis: _ONE.replace("{v}", f"case when er = '{er}' and axis = '{axis}' then mm end")
ORACLES = {
    "r4_inline": f"""with {_LAND}, every as (select doc_id, mm, axis, er from land where er <> 'center' union all select doc_id, mm, 'x', 'center' from dimension where ord = 4),
g as (select doc_id, {_SIDE('pad', 'x')} as pad_x, {_SIDE('pad', 'y')} as pad_y, {_SIDE('center', 'x')} as center_x from every group by 1)
select doc_id, pad_x, pad_y, center_x from g where 2 + doc_id % 3 = 3 and doc_id % 7 <> 0 and center_x > pad_x and pad_y is not null""",
    "r5_grid": f"""with {_LAND}, up as (select doc_id, mm from dimension where ord = 4), every as (select doc_id, mm, axis, er from land where er <> 'center' union all select doc_id, mm, 'x', 'center' from up union all select doc_id, mm, 'y', 'center' from up where doc_id % 5 <> 0),
g as (select doc_id, {_SIDE('pad', 'x')} as pad_x, {_SIDE('pad', 'y')} as pad_y, {_SIDE('center', 'x')} as center_x, {_SIDE('center', 'y')} as pitch_y from every group by 1)
select * from g where 2 + doc_id % 3 = 4 and center_x > pad_x and pitch_y > pad_y""",
    "r9_admit": f"with {_LAND} select doc_id, formula, pad_x, '' as faults, true as admitted from cand",
    "r11_role_direct": f"""with {_LAND}, n as (select doc_id, count(distinct round(mm, 6)) filter (er = 'pad' and axis = 'x') as nx, count(distinct round(mm, 6)) filter (er = 'pad' and axis = 'y') as ny, count(distinct round(mm, 6)) filter (er = 'gap') as ng, count(distinct round(mm, 6)) filter (er = 'center') as nc,
 min(mm) filter (er = 'pad' and axis = 'x') as x, min(mm) filter (er = 'pad' and axis = 'y') as y, min(mm) filter (er = 'gap') as g, min(mm) filter (er = 'center') as c from land group by 1), r as (select *, coalesce(c, g + x) as cx from n)
select doc_id, case when x is not null and y is not null and cx is not null then 'solved' else 'insufficient' end as status, round(x, 6) as pad_x, round(y, 6) as pad_y, round(cx, 6) as center_x, '' as conflicts from r""",
    "r12_symbol_combos": f"""with {_LAND}, s as (select doc_id, ord, mm, case when doc_id % 3 <> 0 then case ord when 0 then 'A' when 1 then 'B' when 4 then 'C' end end as symbol from dimension where belongs_to = 'solder_land'),
g as (select doc_id, min(mm) filter (symbol = 'A') as a, min(mm) filter (symbol = 'B') as b, min(mm) filter (symbol = 'C') as c, list(mm order by ord) filter (symbol is null) as f from s group by 1),
p as (select doc_id, case when a is not null and b is not null and c is not null then 'named' when len(f) >= 3 then 'by_order' else 'none' end as source, * exclude (doc_id) from g)
select doc_id, source, case source when 'named' then a when 'by_order' then f[1] end as pad_x, case source when 'named' then b when 'by_order' then f[2] end as pad_y, case source when 'named' then c when 'by_order' then f[3] end as center_x,
 coalesce(case source when 'named' then c > a when 'by_order' then f[3] > f[1] end, false) as consistent from p""",
    "r1_two_pad": f"with {_LAND} select doc_id, formula, pad_x, pad_y, center_x, cast(relation_score as int) as relation_score, cast(role_score as int) as role_score from cand",
    "r10_pick": f"""with {_LAND}, b as (select doc_id, format('{{:.6f}}|{{:.6f}}|{{:.6f}}|0.000000', pad_x, pad_y, center_x) as solution, max((relation_score, role_score, formula)) as m from cand group by all),
t as (select *, rank() over (partition by doc_id order by m[1] desc, m[2] desc) as r from b), w as (select doc_id, count(*) as n, min(solution) as s, min(m[3]) as f, min(m[1]) as rs, min(m[2]) as os from t where r = 1 group by 1)
select doc_id, 'CHIP' as family, case when n = 1 then 'unique' else 'ambiguous' end as status, case when n = 1 then s end as solution, case when n = 1 then f end as formula, cast(rs as int) as relation_score, cast(os as int) as role_score, n as tied from w""",
    "r15_pin_mapping": "select p_partkey as doc_id, p_partkey % 2 = 0 as matches, 2 as sides_seen from part",
    "r17_family_gate": f"""with {_GEO}, r as (select doc_id, family, list_filter([case when doc_id % 5 = 0 then 'decision_not_auto' end, case when doc_id % 7 = 0 then 'family_not_solved' end, case when doc_id % 2 = 0 and family <> 'QUAD_EP' then 'counts_differ' end], lambda x: x is not null) as f from geo)
select doc_id, family, coalesce(array_to_string(f, ','), '') as reasons, len(f) = 0 as passes from r""",
    "p2_validate_geometry": f"""with {_GEO}, r as (select doc_id, list_filter([case when center_x <= pad_x then 'overlap_x' end, case when family in ('SOT3', 'GRID4', 'DUAL', 'QUAD_EP') and pitch_y <= pad_y then 'overlap_y' end], lambda x: x is not null) as f from geo) select doc_id, coalesce(array_to_string(f, ','), '') as reasons, len(f) = 0 as valid from r""",
    "p5_paste_size": f"with {_GEO} select doc_id, round(tab_x * sqrt(0.7), 6) as paste_x, round(tab_y * sqrt(0.7), 6) as paste_y from geo where family = 'QUAD_EP'",
    "p10_package_codes": """with c as (select p_partkey as doc_id, case when p_partkey % 7 = 0 then '' else upper(p_brand) end as a, upper(case when p_partkey % 5 = 0 then p_type when p_partkey % 7 = 0 then '' else p_brand end) as b from part), l as (select *, list_distinct(list_filter([a, b], lambda x: x <> '')) as l from c)
select doc_id, case len(l) when 0 then 'none' when 1 then 'unique' else 'ambiguous' end as status, case when len(l) = 1 then l[1] end as package_code, case when len(l) = 1 then case when a <> '' then 'a.package_code' else 'b[0].package_code' end end as path from l""",
    "p11_compare_values": f"""with {_GEO}, v as (select doc_id, 'pad_x' as field, pad_x as v from geo union all select doc_id, 'pad_y', pad_y from geo union all select doc_id, 'center_x', center_x from geo)
select doc_id, field, case when doc_id % 11 = 0 and field = 'pad_x' then 'right_only' when doc_id % 8 = 0 and field = 'pad_y' then 'left_only' else 'differs' end as kind from v where (doc_id % 11 = 0 and field = 'pad_x') or (doc_id % 8 = 0 and field = 'pad_y') or doc_id % 5 = 0""",
    "p12_unchanged": f"with {_GEO} select doc_id, family, round(pad_x, 6) as pad_x from geo where doc_id % 50 = 0 union all select doc_id, family, round(pad_x + 1, 6) from geo where doc_id % 50 = 0",
    "r18_missing_fields": f"with {_GEO} select doc_id, family, case when body_y > 0 then '' else 'body_y' end as missing, cast(case when body_y > 0 then 0 else 1 end as int) as n_missing from geo",
    "r16_resolve_families": f"with {_GEO} select doc_id, case when family = 'SOT3' then 'multi_family_conflict' else 'unique' end as status, case when family <> 'SOT3' then family end as family, case family when 'CHIP' then 'CHIP,SMX' when 'SOT3' then 'SOT3,GRID4' else family end as families from geo",
}
