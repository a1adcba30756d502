"""The family of a document from its lands, the gate over all its solutions, and the ladder of states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as K
from ..functions.text import any_of
from .body import assign_body
from .dimensions import labelled, to_mm
from .marks import lowered, pad_count

FIELDS = ("pad_x", "pad_y", "center_x", "center_y", "pitch_y", "pitch_x", "tab_x", "tab_y")
#: What a family needs beyond pad_x, pad_y and center_x.
NEEDS = {"SOT3": ("pitch_y",), "GRID4": ("pitch_y",), "DUAL": ("pitch_y",), "ASYM3": ("pitch_y", "tab_x", "tab_y"), "QUAD_EP": ("pitch_y", "tab_x", "tab_y")}


# Marks of large pads, and metric units.
LARGE = ("大焊盘", "大端子", "散热焊盘", "散热片", "thermal", "heat sink", "tab")
METRIC = ("mm", "millimeter", "millimeters", "毫米")
AREA = 1.15


def pad_sizes(dimension: DataFrame) -> DataFrame:
    """Per document the sizes of its large and small pads: the largest of each, and whether all of one kind agree within 0.02. Metric rows count where there are any."""
    d = to_mm(dimension.withColumns({c: F.lit("") for c in ("raw",) if c not in dimension.columns})).where((F.col("belongs_to") == "solder_land") & F.col("value_mm").isNotNull())
    if "is_derived" in d.columns:
        d = d.where(~F.coalesce("is_derived", F.lit(False)))
    r = F.coalesce("role", F.lit(""))
    large = r.isin("tab_width", "tab_height") | any_of(F.concat_ws(" ", r, lowered("endpoints"), lowered("raw")), LARGE)
    d = d.withColumns({"large": large, "metric": F.regexp_replace(lowered("unit"), " ", "").isin(*METRIC)})
    kinds = {"large_w": (True, ("pad_width", "tab_width")), "large_h": (True, ("pad_height", "tab_height")), "small_w": (False, ("pad_width",)), "small_h": (False, ("pad_height",))}
    aggs = []
    for name, (is_large, roles) in kinds.items():
        for m in (True, False):
            v = F.when((F.col("large") == is_large) & r.isin(*roles) & (F.col("metric") if m else F.lit(True)), F.col("value_mm"))
            aggs += [F.max(v).alias(f"{name}_{int(m)}"), (F.max(v) - F.min(v) <= K.CONSISTENT + 1e-9).alias(f"{name}_same_{int(m)}")]
    g = d.groupBy("doc_id").agg(F.bool_or("metric").alias("_m"), F.bool_or(F.col("large") & F.col("metric")).alias("_l1"), F.bool_or("large").alias("_l0"), *aggs)
    pick = lambda n: F.when(F.col("_m"), F.col(f"{n}_1")).otherwise(F.col(f"{n}_0")).alias(n)
    return g.select("doc_id", F.when(F.col("_m"), F.col("_l1")).otherwise(F.col("_l0")).alias("has_large"), *[pick(n) for k in kinds for n in (k, f"{k}_same")])


def decide_family(document: DataFrame, dimension: DataFrame, quad: DataFrame, dual: DataFrame, inline: DataFrame, grid: DataFrame) -> DataFrame:
    """The family of each ``document(doc_id, pin_count)`` from land evidence, by rungs; a sample's own proposal is never used.

    ``quad`` and ``dual`` are topologies (R8, R6), ``inline`` and ``grid`` candidates (R4, R5). An exposed
    pad is QUAD_EP where its topology stands, else ``reject_ep``. Two rows are DUAL, or what the
    topology says of them. Then a line or grid; then two or three visible pads, as many as pins where
    those are known: a large pad of more than 1.15 times the small ones' area is ASYM3, three equal
    ones SOT3, two SMX. Anything else is ``insufficient``.
    """
    c = F.col
    flag = lambda df, name: df.select("doc_id").distinct().withColumn(name, F.lit(True))
    j = document.select("doc_id", "pin_count").join(quad.select("doc_id", F.col("status").alias("_quad")), "doc_id", "left").join(dual.select("doc_id", F.col("status").alias("_dual")), "doc_id", "left")
    j = j.join(flag(inline, "_i"), "doc_id", "left").join(flag(grid, "_g"), "doc_id", "left").join(pad_count(dimension), "doc_id", "left").join(pad_sizes(dimension), "doc_id", "left")
    no = lambda x: F.coalesce(x, F.lit(False))
    agree = no(c("pads").isin(2, 3)) & no(c("pin_count").isNull() | (c("pin_count") == c("pads")))
    same = lambda *ks: no(c(f"{ks[0]}_same")) & (no(c(f"{ks[1]}_same")) if len(ks) > 1 else F.lit(True))
    bigger = same("large_w", "large_h") & same("small_w", "small_h") & no(c("large_w") * c("large_h") > AREA * c("small_w") * c("small_h"))
    exposed, rows = no(c("_quad") != "not_applicable"), no(c("_dual") != "not_applicable")
    by_size = (
        F.when(no(c("has_large")), F.when(bigger, "ASYM3")).when((c("pads") == 3) & same("small_w", "small_h"), "SOT3").when((c("pads") == 2) & (c("small_w").isNotNull() | c("small_h").isNotNull()), "SMX")
    )
    family = (
        F.when(exposed, F.when(c("_quad").isin("auto", "partial"), "QUAD_EP")).when(rows, F.when(c("_dual") == "auto", "DUAL")).when(no(c("_i")), "INLINE3").when(no(c("_g")), "GRID4").when(agree, by_size)
    )
    j = j.withColumn("family", family)
    status = F.when(c("family").isNotNull(), "auto").when(exposed, "reject_ep").when(rows, c("_dual")).otherwise("insufficient")
    return j.select("doc_id", status.alias("status"), "family", F.coalesce("pads", F.lit(0)).cast("long").alias("pads"))


def spans(dimension: DataFrame) -> DataFrame:
    """``(doc_id, centers, totals)``: the center distances and outer spans that land rows state directly."""
    d = labelled(dimension).where((F.col("belongs_to") == "solder_land") & F.col("value_mm").isNotNull())
    center = F.col("role").isin("pad_center_distance") | (F.col("relation") == "center")
    return d.groupBy("doc_id").agg(F.collect_set(F.when(center, F.round("value_mm", 6))).alias("centers"), F.collect_set(F.when(F.col("role") == "overall_span", F.round("value_mm", 6))).alias("totals"))


def solution_set(solution: DataFrame, dimension: DataFrame, places: int = 6) -> DataFrame:
    """Solutions of all sources by document: those that contradict the drawing go, equal ones become one with all its sources.

    ``solution(doc_id, family, source, formula, rank, ...)`` with any of ``FIELDS``. A stated center
    distance must be met within 0.02; where none is, a stated outer span must be (0.05 for two rows).
    Equal means equal fields at ``places`` decimals; the source of the smallest rank gives the formula.
    """
    s = solution.withColumns({f: F.lit(None).cast("double") for f in FIELDS if f not in solution.columns})
    j = s.join(spans(dimension), "doc_id", "left")
    c = F.col
    outer = c("center_x") + F.when(c("family") == "ASYM3", (c("pad_x") + c("tab_x")) / 2).otherwise(c("pad_x"))
    tol = F.when(c("family") == "DUAL", K.DUAL_CLOSURE).otherwise(K.CLOSURE)
    stated = F.coalesce(F.size("centers") > 0, F.lit(False))
    center_off = stated & ~F.exists("centers", lambda x: F.abs(x - c("center_x")) <= K.CLOSURE + 1e-9)
    span_off = ~stated & F.coalesce(F.size("totals") > 0, F.lit(False)) & c("center_x").isNotNull() & ~F.coalesce(F.exists("totals", lambda x: F.abs(x - outer) <= tol + 1e-9), F.lit(False))
    partial = c("center_x").isNull()
    ok = j.where((~center_off | partial) & ~span_off)
    key = [F.round(f, places).alias(f) for f in FIELDS]
    return ok.groupBy("doc_id", "family", *key).agg(F.min_by("formula", "rank").alias("formula"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def prefill(document: DataFrame, dimension: DataFrame, solution: DataFrame, token: DataFrame | None = None) -> DataFrame:
    """``document(doc_id, family, has_exposed_pad, quad_status, paste_ambiguous)`` with its state and, where one solution stands, its values.

    reject_ep: an exposed pad that nothing solves. manual_select: lands and paste can't be told apart,
    no solution or several, a needed field missing, or a large pad too short for the small ones.
    auto_unique: pads and a proven body on both axes; auto_pads: pads alone; partial_auto: two rows
    around an exposed pad whose center distance is open. Body values go when they are smaller than a
    pad or the gap on their axis, beyond an outer span of the package on it, or (chips) than the
    center distance; both then, since a body has two axes or none.
    """
    c = F.col
    sets = solution_set(solution, dimension)
    many = sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("solutions"), *[F.first(n).alias(n) for n in (*FIELDS, "formula", "sources")])
    d = document.join(many, "doc_id", "left").withColumn("solutions", F.coalesce("solutions", F.lit(0)).cast("long"))
    quad = (c("family") == "QUAD_EP") & F.coalesce(c("quad_status").isin("auto", "partial"), F.lit(False))
    rejected = F.coalesce("has_exposed_pad", F.lit(False)) & ~quad
    one = (c("solutions") == 1) & ~rejected & ~F.coalesce("paste_ambiguous", F.lit(False))
    body = assign_body(dimension, d.where(one).select("doc_id", "family", "formula"), token)
    limit = labelled(dimension).where("belongs_to = 'package_outline' and role = 'overall_span' and axis in ('x', 'y')").groupBy("doc_id").agg(*[F.max(F.when(c("axis") == a, c("value_mm"))).alias(f"over_{w}") for a, w in (("x", "width"), ("y", "height"))])
    at = lambda f, col: F.max(F.when(c("field") == f, c(col)))
    two = body.groupBy("doc_id").agg(*[at(f, "value_mm").alias(f) for f in ("body_x", "body_y")], *[at(f, "source_axis").alias(f"{f}_from") for f in ("body_x", "body_y")])
    d = d.join(two, "doc_id", "left").join(limit, "doc_id", "left").withColumns({"_rejected": rejected, "_one": one})
    gap = c("center_x") - F.when(c("family") == "ASYM3", (c("pad_x") + c("tab_x")) / 2).otherwise(c("pad_x"))
    below = lambda body, *floors: [F.coalesce(c(body) + 1e-9 < f, F.lit(False)) for f in floors]
    over = lambda f: F.coalesce(c(f) > F.when(c(f"{f}_from") == "width", c("over_width")).otherwise(c("over_height")) + 1e-9, F.lit(False))
    rows = c("family").isin("SOT3", "ASYM3", "GRID4")
    bad = [*below("body_x", c("pad_x"), gap, F.when(c("family") == "CHIP", c("center_x"))), *below("body_y", F.when(rows, c("pad_y")), F.when(rows, c("pitch_y") - c("pad_y"))), over("body_x"), over("body_y")]
    sound = ~F.exists(F.array(*bad), lambda x: x)
    d = d.withColumns({f: F.when(c("_one") & sound, c(f)) for f in ("body_x", "body_y")})
    short_tab = (c("family") == "ASYM3") & F.coalesce(c("tab_y") + 1e-9 < c("pitch_y") + c("pad_y"), F.lit(False))
    need = F.array(*[F.when(F.lit(True), c(f)) for f in ("pad_x", "pad_y", "center_x")], *[F.when(c("family").isin(*[k for k, v in NEEDS.items() if f in v]), F.coalesce(f, F.lit(-1.0))).otherwise(F.lit(1.0)) for f in ("pitch_y", "tab_x", "tab_y")])
    pads = F.forall(need, lambda x: F.coalesce(x > 0, F.lit(False)))
    whole = c("body_x").isNotNull() & c("body_y").isNotNull()
    status = (
        F.when(c("_rejected"), "reject_ep").when(~c("_one") | short_tab, "manual_select").when(pads & whole, "auto_unique").when(pads, "auto_pads")
        .when((c("family") == "QUAD_EP") & (c("quad_status") == "partial"), "partial_auto").otherwise("manual_select")
    )
    show = lambda f: F.when(c("_one"), c(f)).alias(f)
    return d.select("doc_id", "family", status.alias("status"), "solutions", *[show(f) for f in ("formula", "sources", *FIELDS)], "body_x", "body_y")
