"""Relation solving as self-joins of labelled dimension rows, candidates in one table, one window that picks or refuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms as K
from .dimensions import labelled, pattern_role, relation_pitch_matches, to_mm
from .marks import marked, tolerance_only

CANDIDATE = ("doc_id", "family", "formula", "pad_x", "pad_y", "center_x", "pitch_y", "relation_score", "role_score")


def _land(dimension: DataFrame) -> DataFrame:
    """Land rows that may enter geometry: not derived, not paste, with a value."""
    d = labelled(dimension).where((F.col("belongs_to") == "solder_land") & F.col("value_mm").isNotNull() & (F.col("pattern") != "paste"))
    if "is_derived" in dimension.columns:
        d = d.where(~F.coalesce("is_derived", F.lit(True)))
    named = F.when(F.col("role") == "other", 0).otherwise(1)
    return d.select("doc_id", "ord", "axis", "effective_role", "value_mm", named.alias("named")).distinct()


def _of(d: DataFrame, role: str, name: str, axis: str = "x") -> DataFrame:
    return d.where((F.col("effective_role") == role) & (F.col("axis") == axis)).select("doc_id", F.col("value_mm").alias(name), F.col("named").alias(f"{name}_named"))


def rel_two_pad(dimension: DataFrame) -> DataFrame:
    """Direct center, gap + pad, (overall - gap) / 2; a closing row raises the relation score to 4.

    Self-joins within a document only; the closing row is an aggregated maximum, so it never multiplies candidates.
    """
    d = _land(dimension)
    pad, cross, gap, overall, center = (_of(d, r, n, a) for r, n, a in (("pad", "pad", "x"), ("pad", "cross", "y"), ("gap", "gap", "x"), ("overall", "overall", "x"), ("center", "center", "x")))
    out = lambda df, formula, pad_x, cx, score, roles: df.select("doc_id", F.lit("CHIP").alias("family"), F.lit(formula).alias("formula"), F.round(pad_x, 6).alias("pad_x"), F.round("cross", 6).alias("pad_y"), F.round(cx, 6).alias("center_x"), F.lit(None).cast("double").alias("pitch_y"), score.cast("int").alias("relation_score"), roles.cast("int").alias("role_score"))
    c = F.col
    direct = pad.join(cross, "doc_id").join(center, "doc_id").where(c("center") > c("pad"))
    spans = overall.groupBy("doc_id").agg(F.collect_set("overall").alias("spans"))
    sums = pad.join(cross, "doc_id").join(gap, "doc_id").join(spans, "doc_id", "left")
    closes = F.coalesce(F.exists("spans", lambda o: F.abs(o - c("gap") - 2 * c("pad")) <= K.CLOSURE + 1e-9), F.lit(False))
    sizes = pad.groupBy("doc_id").agg(F.collect_set("pad").alias("pads"))
    split = overall.join(gap, "doc_id").join(cross, "doc_id").join(sizes, "doc_id", "left").withColumn("half", (c("overall") - c("gap")) / 2).where("half > 0")
    known = F.coalesce(F.exists("pads", lambda p: F.abs(p - c("half")) <= K.CLOSURE + 1e-9), F.lit(False))
    return (
        out(direct, "REL_DIRECT_CENTER_x", c("pad"), c("center"), F.lit(1), c("pad_named") + c("cross_named") + c("center_named"))
        .unionByName(out(sums, "REL_GAP_PLUS_PAD_x", c("pad"), c("gap") + c("pad"), F.when(closes, 4).otherwise(2), c("pad_named") + c("cross_named") + c("gap_named")))
        .unionByName(out(split, "REL_OVERALL_GAP_x", c("half"), c("gap") + c("half"), F.when(known, 4).otherwise(3), c("overall_named") + c("gap_named") + c("cross_named")))
    )


def relation_rows(dimension: DataFrame) -> DataFrame:
    """Land rows that relations are made of, reduced to distinct values: ``(doc_id, axis, center, overall, value_mm, role)``.

    Not derived, not paste, no mere tolerance; the axis is read from the ends (D7). Equal values of
    one axis and role are one row, so repeated rows never multiply candidates.
    """
    texts = {c: F.lit("") for c in ("symbol", "raw") if c not in dimension.columns}
    d = to_mm(dimension.withColumns(texts)).where(F.col("value_mm").isNotNull())
    d = d.withColumn("pattern", pattern_role(d)).where(F.col("belongs_to").isin("solder_land", "occupied_area") & (F.col("pattern") != "paste"))
    if "is_derived" in dimension.columns:
        d = d.where(~F.coalesce("is_derived", F.lit(False)))
    m = marked(d)
    m = m.where(~tolerance_only() & F.col("relation_axis").isNotNull())
    g = m.groupBy("doc_id", "belongs_to", "relation_axis", "center_marked", "overall_marked", F.round("value_mm", 6).alias("value_mm"), "role").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    return g.withColumnsRenamed({"relation_axis": "axis", "center_marked": "center", "overall_marked": "overall"})


def _scored(role: Column, *wanted: str) -> Column:
    return F.when(role.isin(*wanted), 2).otherwise(0)


def rel_three(dimension: DataFrame) -> DataFrame:
    """R2: parts in two rows of three pads: on the width axis a size below a center-marked pitch, on the height axis a size below a center-marked distance; score 2.

    Whatever the rows' roles say; a role that fits adds 2 to the role score. The size across becomes
    pad_y, the one upright pad_x. Of equal solutions the best role score stays.
    """
    d = relation_rows(dimension).where("belongs_to = 'solder_land'")

    def pair(axis: str, size: str, far: str, role: str) -> DataFrame:
        a = d.where(F.col("axis") == axis)
        one = a.select("doc_id", F.col("value_mm").alias(size), F.col("ord").alias("_o"), _scored(F.col("role"), role).alias("_s"))
        two = a.where("center").select("doc_id", F.col("value_mm").alias(far), F.col("ord").alias("_p"), _scored(F.col("role"), "pad_center_distance", "pitch").alias("_t"))
        j = one.join(two, "doc_id").where((F.col("_o") != F.col("_p")) & (F.col(far) > F.col(size)))
        return j.groupBy("doc_id", size, far).agg(F.max(F.col("_s") + F.col("_t")).alias(f"{size}_score"))

    j = pair("width", "pad_y", "pitch_y", "pad_width").join(pair("height", "pad_x", "center_x", "pad_height"), "doc_id")
    return j.select("doc_id", F.lit("SOT3").alias("family"), F.lit("REL_SOT3_TWO_AXES").alias("formula"), "pad_x", "pad_y", "center_x", "pitch_y", F.lit(2).alias("relation_score"), (F.col("pad_x_score") + F.col("pad_y_score")).cast("int").alias("role_score"))


def admit(candidate: DataFrame) -> DataFrame:
    """Every candidate with its missing or invalid fields; nothing is dropped."""
    bad = lambda c: ~F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    need = ["pad_x", "pad_y", "center_x"]
    faults = F.array(*[F.when(bad(c), F.lit(c)) for c in need], F.when((F.col("family") != "CHIP") & bad("pitch_y"), F.lit("pitch_y")))
    return candidate.withColumn("faults", F.array_join(F.filter(faults, lambda x: x.isNotNull()), ",")).withColumn("admitted", F.col("faults") == "")


def solution() -> Column:
    return F.concat_ws("|", *[F.format_string("%.6f", F.coalesce(c, F.lit(0.0))) for c in ("pad_x", "pad_y", "center_x", "pitch_y")])


def pick(candidate: DataFrame) -> DataFrame:
    """Per document and family the winning solution: each solution's best scores, then the best relation, then role; ties are ambiguous."""
    ok = admit(candidate).where("admitted").withColumn("solution", solution())
    best = ok.groupBy("doc_id", "family", "solution").agg(F.max(F.struct("relation_score", "role_score", "formula")).alias("b"))
    score = F.struct("b.relation_score", "b.role_score")
    top = best.withColumn("s", score).groupBy("doc_id", "family").agg(F.max("s").alias("t"))
    win = best.withColumn("s", score).join(top, ["doc_id", "family"]).where("s = t")
    g = win.groupBy("doc_id", "family").agg(F.count(F.lit(1)).alias("n"), F.min("solution").alias("_s"), F.min("b.formula").alias("_f"), F.min("b.relation_score").alias("relation_score"), F.min("b.role_score").alias("role_score"))
    one = F.col("n") == 1
    return g.select("doc_id", "family", F.when(one, "unique").otherwise("ambiguous").alias("status"), F.when(one, F.col("_s")).alias("solution"), F.when(one, F.col("_f")).alias("formula"), "relation_score", "role_score", F.col("n").alias("tied"))


def role_direct(dimension: DataFrame) -> DataFrame:
    """A solution from exactly one distinct value per role, with the conflicting roles listed."""
    d = _land(dimension)
    roles = {"pad_x": ("pad", "x"), "pad_y": ("pad", "y"), "gap": ("gap", "x"), "center": ("center", "x")}
    of = {k: F.when((F.col("effective_role") == r) & (F.col("axis") == a), F.col("value_mm")) for k, (r, a) in roles.items()}
    g = d.groupBy("doc_id").agg(*[x.alias(n) for k, v in of.items() for n, x in ((k, F.min(v)), (f"low_{k}", F.min(F.round(v, 6))), (f"high_{k}", F.max(F.round(v, 6))))])
    one = {k: F.when(F.col(f"low_{k}") == F.col(f"high_{k}"), F.col(k)) for k in roles}
    center = F.coalesce(one["center"], one["gap"] + one["pad_x"])
    conflicts = F.filter(F.array(*[F.when(F.col(f"low_{k}") < F.col(f"high_{k}"), F.lit(k)) for k in roles]), lambda x: x.isNotNull())
    done = one["pad_x"].isNotNull() & one["pad_y"].isNotNull() & center.isNotNull()
    return g.select("doc_id", F.when(done, "solved").when(F.size(conflicts) > 0, "conflict").otherwise("insufficient").alias("status"), F.round(one["pad_x"], 6).alias("pad_x"), F.round(one["pad_y"], 6).alias("pad_y"), F.round(center, 6).alias("center_x"), F.array_join(conflicts, ",").alias("conflicts"))


def resolve_families(geometry: DataFrame, signature: DataFrame) -> DataFrame:
    """``signature(doc_id, family, signature)``: one signature is unique (with all its families), several conflict, none is no solution."""
    order = F.create_map(*[F.lit(x) for i, f in enumerate(K.FAMILIES) for x in (f, i)])
    g = signature.groupBy("doc_id").agg(F.count_distinct("signature").alias("groups"), F.array_sort(F.collect_set(F.struct(F.element_at(order, F.col("family")).alias("o"), "family"))).alias("f"))
    out = geometry.select("doc_id").distinct().join(g, "doc_id", "left")
    status = F.when(F.col("groups").isNull(), "no_pad_solution").when(F.col("groups") == 1, "unique").otherwise("multi_family_conflict")
    return out.select("doc_id", status.alias("status"), F.when(F.col("groups") == 1, F.get("f", F.lit(0))["family"]).alias("family"), F.array_join(F.transform("f", lambda s: s["family"]), ",").alias("families"))


REQUIRED = {"CHIP": (), "SMX": (), "SOT3": ("pitch_y",), "GRID4": ("pitch_y",), "INLINE3": (), "DUAL": ("pitch_y",), "ASYM3": ("pitch_y", "tab_x", "tab_y"), "QUAD_EP": ("pitch_y", "tab_x", "tab_y")}


def missing_fields(geometry: DataFrame, with_body: bool = True) -> DataFrame:
    """The required fields of a family that are null or not positive."""
    base = ["pad_x", "pad_y", "center_x", *(["body_x", "body_y"] if with_body else [])]
    need = F.element_at(F.create_map(*[x for f, more in REQUIRED.items() for x in (F.lit(f), F.array(*map(F.lit, (*base, *more))))]), F.col("family"))
    fields = sorted({*base, *(x for m in REQUIRED.values() for x in m)})
    lacking = F.filter(F.array(*[F.when(~F.coalesce(F.col(c) > 0, F.lit(False)), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    miss = F.array_sort(F.array_intersect(lacking, need))
    return geometry.select("doc_id", "family", F.array_join(miss, ",").alias("missing"), F.size(miss).alias("n_missing"))


def _unique(d: DataFrame, role: str, axis: str, tol: float = K.CONSISTENT) -> Column:
    """The mean of a role's values on an axis when they agree, as an aggregate."""
    v = F.when((F.col("effective_role") == role) & (F.col("axis") == axis), F.col("value_mm"))
    return F.when(F.max(v) - F.min(v) <= tol + 1e-12, F.round(F.avg(v), 6))


def _nodes() -> Column:
    """The two nodes that a center dimension joins, in a fixed order: left, middle or right."""
    ends = F.transform(F.split(F.lower(F.coalesce("endpoints", F.lit(""))), "->|→"), lambda e: F.regexp_extract(F.trim(e), "^(left|middle|right)", 1))
    return F.array_join(F.array_sort(ends), "-")


def rel_inline(dimension: DataFrame, pins: DataFrame) -> DataFrame:
    """Three pads in a line: pin count 3, exactly the edges left-middle and middle-right, one pitch above the pad; score 8.

    ``pins(doc_id, pin_count)``.
    """
    d = labelled(dimension).where((F.col("belongs_to") == "solder_land") & F.col("value_mm").isNotNull())
    edge = F.when((F.col("effective_role") == "center") & (F.col("axis") == "x"), _nodes())
    g = d.groupBy("doc_id").agg(_unique(d, "pad", "x").alias("pad_x"), _unique(d, "pad", "y").alias("pad_y"), _unique(d, "center", "x").alias("center_x"), F.array_sort(F.collect_set(edge)).alias("edges"))
    ok = (F.array_join("edges", ",") == "left-middle,middle-right") & (F.col("center_x") > F.col("pad_x")) & F.col("pad_y").isNotNull()
    return g.join(pins.where("pin_count = 3"), "doc_id").where(F.coalesce(ok, F.lit(False))).select("doc_id", F.lit("INLINE3").alias("family"), F.lit("REL_INLINE3_x").alias("formula"), "pad_x", "pad_y", "center_x", F.lit(None).cast("double").alias("pitch_y"), F.lit(8).alias("relation_score"), F.lit(3).alias("role_score"))


def rel_grid(dimension: DataFrame, pins: DataFrame) -> DataFrame:
    """Four pads in a grid: pin count 4, a unique center above the pad on both axes whose ends name opposing sides; score 8."""
    d = labelled(dimension).where((F.col("belongs_to") == "solder_land") & F.col("value_mm").isNotNull())
    ends = F.transform(F.split(F.lower(F.coalesce("endpoints", F.lit(""))), "->|→"), lambda e: F.regexp_extract(F.trim(e), "^(left|right|top|bottom)", 1))
    pair = F.array_join(F.array_sort(ends), "-")
    opposing = lambda axis, names: F.bool_and(F.when((F.col("effective_role") == "center") & (F.col("axis") == axis), pair == names))
    g = d.groupBy("doc_id").agg(
        _unique(d, "pad", "x").alias("pad_x"), _unique(d, "pad", "y").alias("pad_y"), _unique(d, "center", "x").alias("center_x"), _unique(d, "center", "y").alias("pitch_y"),
        opposing("x", "left-right").alias("ox"), opposing("y", "bottom-top").alias("oy"),
    )
    ok = F.col("ox") & F.col("oy") & (F.col("center_x") > F.col("pad_x")) & (F.col("pitch_y") > F.col("pad_y"))
    return g.join(pins.where("pin_count = 4"), "doc_id").where(F.coalesce(ok, F.lit(False))).select("doc_id", F.lit("GRID4").alias("family"), F.lit("REL_GRID4_TWO_AXES").alias("formula"), "pad_x", "pad_y", "center_x", "pitch_y", F.lit(8).alias("relation_score"), F.lit(4).alias("role_score"))


def rel_asym(dimension: DataFrame, pitch: DataFrame) -> DataFrame:
    """One large and two small pads: an outer span, a smaller and a larger size on its axis and on the other, and a pitch that meets the outline's; score 6.

    Both orientations. The pitch is twice a further value across or that value and the small pad, and
    must match ``pitch(doc_id, pitches)`` from ``pitch_refs`` (D14); candidates that don't are kept
    out. Sizes are distinct values, so each pair of them comes once.
    """
    d = relation_rows(dimension)
    land = d.where("belongs_to = 'solder_land'").select("doc_id", "axis", "value_mm", "ord", "role")
    over = d.where("overall and (belongs_to = 'solder_land' or role = 'overall_span')").select("doc_id", F.col("axis").alias("sep"), F.col("value_mm").alias("overall"), F.col("ord").alias("_oo"), _scored(F.col("role"), "overall_span").alias("_so"))

    def pair(small: str, large: str, axis: str) -> DataFrame:
        one = land.select("doc_id", F.col("axis").alias(axis), F.col("value_mm").alias(small), F.col("ord").alias(f"_o{small}"), F.when(F.col("role") == F.concat(F.lit("pad_"), "axis"), 2).otherwise(0).alias(f"_s{small}"))
        two = land.select("doc_id", F.col("axis").alias(axis), F.col("value_mm").alias(large), F.col("ord").alias(f"_o{large}"), F.when(F.col("role") == F.concat(F.lit("tab_"), "axis"), 2).otherwise(0).alias(f"_s{large}"))
        return one.join(two, ["doc_id", axis]).where(F.col(large) > F.col(small))

    c = F.col
    j = over.join(pair("pad_x", "tab_x", "sep"), ["doc_id", "sep"]).where((c("overall") > c("tab_x")) & (c("_oo") != c("_opad_x")) & (c("_oo") != c("_otab_x")))
    j = j.withColumn("cross", F.when(c("sep") == "width", "height").otherwise("width")).join(pair("pad_y", "tab_y", "cross"), ["doc_id", "cross"])
    third = land.select("doc_id", F.col("axis").alias("cross"), F.col("value_mm").alias("_p"), F.col("ord").alias("_op"), "role")
    j = j.join(third, ["doc_id", "cross"]).where(~c("_op").isin(c("_opad_y"), c("_otab_y"), c("_oo"))).join(pitch, "doc_id")
    how = F.inline(F.array(
        F.struct(F.lit("half_pitch_x2").alias("how"), (2 * c("_p")).alias("pitch_y"), _scored(c("role"), "half_pitch", "half_pitch_from_centerline").alias("_sh")),
        F.struct(F.lit("gap_plus_pad").alias("how"), (c("_p") + c("pad_y")).alias("pitch_y"), _scored(c("role"), "pad_gap", "gap_between_pads").alias("_sh")),
    ))
    j = j.select("*", how).withColumn("center_x", c("overall") - (c("pad_x") + c("tab_x")) / 2)
    ok = j.where((c("center_x") > 0) & relation_pitch_matches(c("pitch_y"), c("pitches")))
    score = c("_so") + c("_spad_x") + c("_stab_x") + c("_spad_y") + c("_stab_y") + c("_sh")
    r = lambda n: F.round(n, 6).alias(n)
    cols = [r(n) for n in ("pad_x", "pad_y", "tab_x", "tab_y", "center_x", "pitch_y")]
    out = ok.select("doc_id", F.lit("ASYM3").alias("family"), F.concat_ws("_", F.lit("REL_ASYM3"), "sep", "how").alias("formula"), *cols, F.lit(6).alias("relation_score"), score.cast("int").alias("role_score"))
    return out.groupBy(*[n for n in out.columns if n != "role_score"]).agg(F.max("role_score").alias("role_score"))


def pin_mapping(dimension: DataFrame, expected: DataFrame) -> DataFrame:
    """Pad numbers that the ends name per side against ``expected(doc_id, side, number)``; the last number of a side counts."""
    pads = F.regexp_extract_all(F.lower(F.coalesce("endpoints", F.lit(""))), F.lit(r"((?:left|right|top|bottom) pad \d+)"), F.lit(1))
    named = dimension.select("doc_id", "ord", F.explode(pads).alias("p")).select("doc_id", F.regexp_extract("p", r"^(\w+)", 1).alias("side"), "ord", F.regexp_extract("p", r"(\d+)$", 1).cast("int").alias("number"))
    last = named.groupBy("doc_id", "side").agg(F.max_by("number", F.struct("ord", "number")).alias("seen"))
    j = expected.join(last, ["doc_id", "side"], "full_outer")
    return j.groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("seen") == F.col("number"), F.lit(False))).alias("matches"), F.count("seen").alias("sides_seen"))


def family_gate(decision: DataFrame, solved: DataFrame, count: DataFrame) -> DataFrame:
    """Reasons that bar a decided family: not automatic, not among the solved, or another pad count (one more is allowed for a numbered exposed pad)."""
    j = decision.join(solved.groupBy("doc_id").agg(F.collect_set("family").alias("families")), "doc_id", "left").join(count.select("doc_id", "pads", "pin_count"), "doc_id", "left")
    extra = F.when(F.col("family") == "QUAD_EP", 1).otherwise(0)
    rules = {
        "decision_not_auto": ~F.coalesce(F.col("status") == "auto", F.lit(False)), "family_not_solved": ~F.coalesce(F.array_contains("families", F.col("family")), F.lit(False)),
        "counts_differ": F.coalesce(~(F.col("pads") - F.col("pin_count")).between(F.lit(0), extra), F.lit(False)),
    }
    reasons = F.filter(F.array(*[F.when(bad, F.lit(k)) for k, bad in rules.items()]), lambda x: x.isNotNull())
    return j.select("doc_id", "family", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passes"))


def symbol_combos(dimension: DataFrame) -> DataFrame:
    """A solution from rows named A, B and C (pad, cross pad, center), else from the first three land rows without a name; first values win."""
    d = labelled(dimension).where((F.col("belongs_to") == "solder_land") & F.col("value_mm").isNotNull())
    named = [F.min(F.when(F.upper("symbol") == s, F.struct("ord", "value_mm"))).alias(s) for s in "ABC"]
    free = F.array_sort(F.collect_list(F.when(F.coalesce(F.trim("symbol"), F.lit("")) == "", F.struct("ord", "value_mm")))).alias("free")
    g = d.groupBy("doc_id").agg(*named, free)
    by_name = F.col("A").isNotNull() & F.col("B").isNotNull() & F.col("C").isNotNull()
    pick = lambda s, i: F.when(by_name, F.col(f"{s}.value_mm")).when(F.size("free") >= 3, F.get("free", F.lit(i))["value_mm"])
    out = g.select("doc_id", F.when(by_name, "named").when(F.size("free") >= 3, "by_order").otherwise("none").alias("source"), pick("A", 0).alias("pad_x"), pick("B", 1).alias("pad_y"), pick("C", 2).alias("center_x"))
    ok = F.coalesce(F.col("center_x") > F.col("pad_x"), F.lit(False))
    return out.withColumn("consistent", ok)
