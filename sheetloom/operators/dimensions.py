"""Dimension rows: units, duplicates, labels, tolerance joins and guards.

Windows and joins are keyed by document (and sample); tolerance joins go through value buckets, so
they are hash joins and not nested loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms as K
from ..functions.text import any_of
from .pages import LAND_MARKS, PASTE_MARKS, compact

MM = "decimal(38,12)"


def to_mm(dimension: DataFrame) -> DataFrame:
    """``value_mm`` by exact decimals; null for what isn't a positive number of a known unit.

    A generator of one value makes the number once a row, however often it is looked at, and leaves the rows dealt as they are.
    """
    number = F.replace("value", F.lit(","), F.lit(".")).try_cast("decimal(20,6)")
    unit = F.lower(F.trim(F.coalesce("unit", F.lit(""))))
    factor = F.create_map(*[F.lit(x) for kv in K.UNIT_MM.items() for x in kv])
    out = (number * F.try_element_at(factor, unit).cast("decimal(8,4)")).cast("double")
    made = dimension.select("*", F.explode(F.array(out)).alias("_mm"))
    return made.withColumn("value_mm", F.when(F.col("_mm") > 0, F.col("_mm"))).drop("_mm")


def dedup_units(dimension: DataFrame) -> DataFrame:
    """``dropped`` marks a row in another unit that repeats a metric row: the same ends, or the same raw text, within 2 %."""
    d = to_mm(dimension)
    key = ["doc_id", "sample_idx", "belongs_to"]
    metric = d.where(F.lower("unit") == "mm").select(*key, F.col("endpoints").alias("_e"), F.col("raw").alias("_r"), F.col("value_mm").alias("_v"))
    other = d.where(F.lower("unit") != "mm").select(*key, "ord", "endpoints", "raw", "value_mm")
    close = F.abs(F.col("value_mm") - F.col("_v")) <= K.DUAL_UNIT_TOL * F.greatest("value_mm", "_v")
    hits = [other.join(metric.withColumnRenamed("_" + c[0], c), [*key, c]).where(close).select("doc_id", "sample_idx", "ord") for c in ("endpoints", "raw")]
    gone = hits[0].unionByName(hits[1]).distinct().withColumn("dropped", F.lit(True))
    return d.join(gone, ["doc_id", "sample_idx", "ord"], "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


def first_candidates(dimension: DataFrame, key: list[str]) -> DataFrame:
    """D3 on rows with ``value_mm``: ``first`` marks those that stand for their key: without tolerance wording and metric where any are, the first of equal values (1e-9)."""
    w = W.partitionBy(*key)
    plain = (~F.lower(F.coalesce("raw", "value")).rlike("±|tol|max|min|ref|typ")).cast("int")
    d = dimension.withColumn("_p", plain).withColumn("_in", F.col("_p") == F.max("_p").over(w))
    metric = (F.col("_in") & (F.lower("unit") == "mm")).cast("int")
    d = d.withColumn("_m", metric).withColumn("_in", F.col("_in") & (F.col("_m") == F.max("_m").over(w)))
    rank = W.partitionBy(*key, "_in").orderBy("value_mm", "ord")
    d = d.withColumn("_s", F.coalesce(F.col("value_mm") - F.lag("value_mm").over(rank) > 1e-9, F.lit(True)).cast("int")).withColumn("_s", F.sum("_s").over(rank))
    at = F.row_number().over(W.partitionBy(*key, "_in", "_s").orderBy("ord"))
    return d.withColumn("first", F.col("_in") & (at == 1)).drop("_p", "_m", "_in", "_s")


def dedup_candidates(dimension: DataFrame, key: list[str]) -> DataFrame:
    """D3: per key prefer rows without tolerance wording, then metric rows; equal values (1e-9) keep the first."""
    return first_candidates(to_mm(dimension).where("value_mm is not null"), key).where("first").select(*key, "ord", "value_mm")


def by_symbol(dimension: DataFrame, aliases: list[str]) -> DataFrame:
    """Per document the first value of the first alias that it has."""
    rank = F.create_map(*[F.lit(x) for i, a in enumerate(aliases) for x in (a, i)])
    d = dimension.withColumn("_k", F.try_element_at(rank, F.col("symbol"))).where("_k is not null")
    return d.groupBy("doc_id").agg(F.min(F.struct("_k", "ord", "symbol", "value")).alias("m")).select("doc_id", "m.symbol", "m.value")


def pattern_role(dimension: DataFrame) -> Column:
    """Lands, paste, other or unknown. What the row belongs to decides, then marks in its symbol and raw text, where it has them."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("symbol", "raw") if c in dimension.columns]
    text = compact(F.concat_ws(" ", *parts)) if parts else F.lit("")
    owner = F.coalesce("belongs_to", F.lit(""))
    paste = (owner == "solder_paste") | F.coalesce(F.col("role").isin("paste_width", "paste_height"), F.lit(False))
    marked = F.when(paste, "paste").when(owner == "solder_land", "lands").when(any_of(text, PASTE_MARKS), "paste").when(any_of(text, LAND_MARKS), "lands")
    return marked.when(owner.isin("package_outline", "occupied_area"), "other").otherwise("unknown")


# Words of the two axes.
ACROSS, UPRIGHT = ("left", "right", "width", "horizontal", "左", "右"), ("top", "bottom", "height", "vertical", "上", "下")


def axis() -> Column:
    """``x`` or ``y`` when both ends name edges (or else sides) of one axis, ``both`` when they differ, or null."""
    t = F.lower(F.coalesce("endpoints", F.lit("")))
    ends = F.transform(F.split(t, "->|→"), lambda e: F.trim(e))
    edges = F.transform(ends, lambda e: F.regexp_extract(e, "(left|right|top|bottom|左|右|上|下)(?: edge|缘)$", 1))
    sides = F.transform(ends, lambda e: F.regexp_extract(e, "^(left|right|top|bottom|左|右|上|下)", 1))
    of = lambda xs: F.when(F.forall(xs, lambda e: e.isin(*ACROSS)), "x").when(F.forall(xs, lambda e: e.isin(*UPRIGHT)), "y").when(F.forall(xs, lambda e: e != ""), "both")
    has = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda m: F.contains(t, m))
    words = F.when(has(ACROSS) & ~has(UPRIGHT), "x").when(has(UPRIGHT) & ~has(ACROSS), "y")
    return F.coalesce(of(edges), of(sides), words)


def relation() -> Column:
    """What a dimension spans: center, pad, gap, overall or other, from both halves of its ends."""
    ends = F.transform(F.split(F.lower(F.coalesce("endpoints", F.lit(""))), "->|→"), lambda x: F.trim(x))
    a, b = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    side = lambda e: F.regexp_extract(e, "^(left|right|top|bottom)", 1)
    edge = lambda e: F.regexp_extract(e, "(left|right|top|bottom) edge$", 1)
    pads = F.contains(a, F.lit("pad")) & F.contains(b, F.lit("pad"))
    center = F.contains(a, F.lit("center")) & F.contains(b, F.lit("center"))
    return F.coalesce(
        F.when(pads & center, "center").when(pads & (side(a) == side(b)), "pad").when(pads & (edge(a) == side(a)) & (edge(b) == side(b)), "overall").when(pads, "gap").when(F.size(ends) == 2, "outline"),
        F.lit("other"),
    )


ROLE_OF = {"pad_gap": "gap", "gap_between_pads": "gap", "pad_center_distance": "center", "overall_span": "overall", "pad_width": "pad", "pad_height": "pad"}


def labelled(dimension: DataFrame) -> DataFrame:
    """Millimetres, pattern role, axis, relation, and the effective role: the role's alias unless the ends say otherwise."""
    d = to_mm(dimension).withColumns({"pattern": pattern_role(dimension), "axis": axis(), "relation": relation()})
    alias = F.create_map(*[F.lit(x) for kv in ROLE_OF.items() for x in kv])
    said = F.col("relation").isin("center", "pad", "gap", "overall") & (F.col("role") != "other")
    return d.withColumn("effective_role", F.when(said, F.col("relation")).otherwise(F.coalesce(F.try_element_at(alias, F.col("role")), F.col("role"))))


def land_rows(dimension: DataFrame) -> DataFrame:
    """The land rows of a document's sample by the first tier that has any: explicit metric, explicit, or unlabelled rows before a tolerance row."""
    w = W.partitionBy("doc_id", "sample_idx")
    explicit = F.col("belongs_to") == "solder_land"
    stop = F.max(F.lower(F.coalesce("value", F.lit(""))).rlike("±|max|min").cast("int")).over(w.orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    tier = F.when(explicit & (F.lower("unit") == "mm"), 3).when(explicit, 2).when((F.coalesce("belongs_to", F.lit("other")) == "other") & (stop == 0), 1).otherwise(0)
    return dimension.withColumn("tier", tier).withColumn("_b", F.max("tier").over(w)).where("tier = _b and tier > 0").drop("_b")


def half_filter(dimension: DataFrame, least: int = 2, eps: float = 1e-9) -> DataFrame:
    """Pad sizes that are half of a center distance or pitch of their partition are marked, unless too few would stay."""
    d = to_mm(dimension)
    key = ["doc_id", "sample_idx", "belongs_to"]
    whole = d.where(F.col("role").isin("pad_center_distance", "pitch")).select(*key, F.round(F.col("value_mm") * 500_000, 0).cast("long").alias("_h"), F.col("value_mm").alias("_w"))
    pads = d.where(F.col("role").isin("pad_width", "pad_height")).withColumn("_h", F.round(F.col("value_mm") * 1_000_000, 0).cast("long"))
    halves = pads.join(whole, [*key, "_h"]).where(F.abs(F.col("_w") - 2 * F.col("value_mm")) <= eps).select(*key, "ord").distinct().withColumn("half", F.lit(True))
    marked = pads.drop("_h").join(halves, [*key, "ord"], "left").withColumn("half", F.coalesce("half", F.lit(False)))
    left = F.count_if(~F.col("half")).over(W.partitionBy("doc_id", "sample_idx"))
    return marked.withColumn("excluded", F.col("half") & (left >= least))


def normalize_roles(dimension: DataFrame) -> DataFrame:
    """Where a document's sample lacks a pad width or height, ``other`` rows between two edges of one pad get it by their axis; the old role is kept."""
    d = labelled(dimension)
    w = W.partitionBy("doc_id", "sample_idx")
    lacks = {r: ~F.bool_or(F.col("role") == r).over(w) for r in ("pad_width", "pad_height")}
    fits = (F.col("role") == "other") & (F.col("relation") == "pad")
    new = F.when(fits & lacks["pad_width"] & (F.col("axis") == "x"), "pad_width").when(fits & lacks["pad_height"] & (F.col("axis") == "y"), "pad_height")
    return d.withColumn("role_original", F.col("role")).withColumn("role", F.coalesce(new, "role"))


def unique_axis(dimension: DataFrame, key: list[str], tol: float = K.CONSISTENT) -> DataFrame:
    """The mean of a key's values when they lie within ``tol``, else null."""
    g = to_mm(dimension).groupBy(*key).agg(F.min("value_mm").alias("lo"), F.max("value_mm").alias("hi"), F.avg("value_mm").alias("m"), F.count("value_mm").alias("n"))
    return g.select(*key, F.when(F.col("hi") - F.col("lo") <= tol + 1e-12, F.round("m", 6)).alias("value_mm"), "n")


# Ends that make a package pitch a half one.
MIDDLE_TERMINALS = ("中间端子", "中央端子", "中心端子", "middleterminal", "centerterminal", "centreterminal")


def pitch_refs(dimension: DataFrame) -> DataFrame:
    """Per document the distinct outline pitches: package rows that are not derived, half pitches doubled."""
    own = ~F.coalesce("is_derived", F.lit(False)) if "is_derived" in dimension.columns else F.lit(True)
    d = to_mm(dimension).where((F.col("belongs_to") == "package_outline") & own)
    d = d.where(F.col("role").isin("pitch", "half_pitch", "half_pitch_from_centerline", "pad_center_distance"))
    half = F.col("role").startswith("half_pitch") | any_of(compact(F.coalesce("endpoints", F.lit(""))), MIDDLE_TERMINALS)
    v = F.round(F.when(half, 2 * F.col("value_mm")).otherwise(F.col("value_mm")), 9)
    return d.withColumn("_v", v).where("_v is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("_v")).alias("pitches"))


def pitch_matches(value: Column, pitches: Column, tol: float = 0.15) -> Column:
    """Whether a value lies between the smallest and largest of several pitches, or within ``tol`` of a single one."""
    one = F.get(pitches, F.lit(0))
    return F.when(F.size(pitches) >= 2, value.between(F.array_min(pitches), F.array_max(pitches))).otherwise(F.coalesce(F.abs(value - one) / one <= tol, F.lit(False)))


def relation_pitch_matches(value: Column, pitches: Column, tol: float = 0.15) -> Column:
    """D14 for relations: a single pitch, or the larger of two that are one and its half (3 %), is met within ``tol``; else the range, 0.02 wider."""
    one = F.array_sort(F.array_distinct(F.transform(F.filter(pitches, lambda p: p > 0), lambda p: F.round(p, 6))))
    low, high = F.array_min(one), F.array_max(one)
    near = F.abs(value - high) / high <= tol
    return F.coalesce(F.when((F.size(one) == 1) | (F.abs(high - 2 * low) / high <= 0.03), near).otherwise(value.between(low - 0.02, high + 0.02)), F.lit(False))


def paste_check(dimension: DataFrame) -> DataFrame:
    """Whether the first paste size per axis is smaller than the first land size; null where an axis lacks one."""
    d = labelled(dimension).where(F.col("pattern").isin("lands", "paste") & (F.col("relation") == "pad"))
    first = d.groupBy("doc_id", "axis", "pattern").agg(F.min(F.struct("ord", "value_mm")).alias("m"))
    two = first.groupBy("doc_id", "axis").agg(F.max(F.when(F.col("pattern") == "lands", F.col("m.value_mm"))).alias("land"), F.max(F.when(F.col("pattern") == "paste", F.col("m.value_mm"))).alias("paste"))
    return two.groupBy("doc_id").agg(F.bool_and(F.when(F.col("land").isNotNull() & F.col("paste").isNotNull(), F.col("paste") <= F.col("land") + 1e-9)).alias("paste_within_land"))


def guards(dimension: DataFrame) -> DataFrame:
    """Per document and sample the closures that its values break, as reasons; missing values break nothing."""
    d = labelled(dimension).where(F.col("axis") == "x")
    value = lambda r, p="solder_land": F.max(F.when((F.col("effective_role") == r) & (F.col("belongs_to") == p), F.col("value_mm")))
    g = d.groupBy("doc_id", "sample_idx").agg(value("pad").alias("pad"), value("gap").alias("gap"), value("center").alias("center"), value("overall").alias("overall"), F.max(F.when(F.col("belongs_to") == "package_outline", F.col("value_mm"))).alias("body"))
    c = F.col
    rules = {
        "gap_plus_pad": F.abs(c("gap") + c("pad") - c("center")) > K.GAP_TOL * F.greatest(c("center"), c("gap") + c("pad")), "overall_closure": F.abs(c("gap") + 2 * c("pad") - c("overall")) > K.CLOSURE + 1e-9,
        "center_closure": F.abs(c("center") + c("pad") - c("overall")) > K.CLOSURE + 1e-9, "body_below_pad": c("body") < c("pad"), "body_above_overall": c("body") > c("overall"),
    }
    reasons = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(k)) for k, bad in rules.items()]), lambda x: x.isNotNull())
    return g.select("doc_id", "sample_idx", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passes"))


def half_double(value: DataFrame) -> DataFrame:
    """``value(doc_id, field, value_mm)`` to pairs of fields of which one is exactly twice the other."""
    v = value.withColumn("_d", F.col("value_mm").cast("decimal(20,6)"))
    a = v.select("doc_id", F.col("field").alias("half_field"), (F.col("_d") * 2).cast("decimal(20,6)").alias("_d"))
    b = v.select("doc_id", F.col("field").alias("double_field"), "_d")
    return a.join(b, ["doc_id", "_d"]).where("half_field <> double_field").select("doc_id", "half_field", "double_field")


def provenance(value: DataFrame, dimension: DataFrame, tol: float = K.PROVENANCE_TOL) -> DataFrame:
    """``value(doc_id, field, value_mm)`` to the dimensions within ``tol``, through value buckets: a hash join."""
    width = 2 * tol
    bucket = F.floor(F.col("value_mm") / width)
    v = value.select("doc_id", "field", "value_mm", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    d = to_mm(dimension).where("value_mm is not null").select("doc_id", F.floor(F.col("value_mm") / width).alias("_b"), F.col("value_mm").alias("_v"), "sample_idx", "ord")
    hit = v.join(d, ["doc_id", "_b"]).where(F.abs(F.col("value_mm") - F.col("_v")) <= tol + 1e-12)
    per = hit.groupBy("doc_id", "field").agg(F.count(F.lit(1)).alias("sources"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "ord"))), lambda s: F.concat_ws(":", s["sample_idx"].cast("string"), s["ord"].cast("string"))), ",").alias("rows"))
    return value.select("doc_id", "field").join(per, ["doc_id", "field"], "left").select("doc_id", "field", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("rows", F.lit("")).alias("rows"))


def filter_body_candidates(dimension: DataFrame, token: DataFrame, tol: float = K.PROVENANCE_TOL) -> DataFrame:
    """Package rows with the reason that bars them as body sizes, or ``ok``.

    Diameters and heights are out; a row whose value stands on a page only in lines that may not be
    nominal (qualified or parenthetical) is out; a raw text with several numbers is out.
    ``token(doc_id, value_mm, accepted)`` are classified lines; tolerance by value buckets.
    """
    d = to_mm(dimension).where(F.col("belongs_to") == "package_outline")
    width = 2 * tol
    bucket = F.floor(F.col("value_mm") / width)
    rows = d.select("doc_id", "sample_idx", "ord", F.col("value_mm").alias("_v"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    seen = token.where("value_mm is not null").select("doc_id", F.floor(F.col("value_mm") / width).alias("_b"), F.col("value_mm").alias("_t"), "accepted")
    near = rows.join(seen, ["doc_id", "_b"]).where(F.abs(F.col("_v") - F.col("_t")) <= tol + 1e-12)
    votes = near.groupBy("doc_id", "sample_idx", "ord").agg(F.bool_or("accepted").alias("_yes"), F.bool_or(~F.col("accepted")).alias("_no"))
    j = d.join(votes, ["doc_id", "sample_idx", "ord"], "left")
    t = F.lower(F.concat_ws(" ", F.coalesce("endpoints", F.lit("")), F.coalesce("raw", F.lit(""))))
    reason = (
        F.when(F.col("value_mm").isNull(), "no_value").when(t.rlike("ø|⌀|diameter|dia\\."), "diameter").when((F.col("role") == "body_height") | t.rlike("height|seating"), "height")
        .when(F.coalesce(F.col("_no") & ~F.col("_yes"), F.lit(False)), "not_nominal_on_page").when(F.regexp_count(F.coalesce("raw", F.lit("")), F.lit(r"\d+(?:[.,]\d+)?")) > 1, "several_numbers").otherwise("ok")
    )
    return j.select("doc_id", "sample_idx", "ord", reason.alias("reason"))
