"""Body sizes: the outer value of a boundary, the unique planar pair, and the axes of the body with their proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of
from .dimensions import filter_body_candidates, first_candidates, to_mm
from .marks import marked, tolerance_only

BODY = ("body_length", "body_width")
# Names of views, inner boundaries, and edges that end the context of an end.
VIEWS = ("正视图", "俯视图", "顶视图", "底视图", "侧视图", "frontview", "topview", "bottomview", "sideview")
INNER = ("内侧", "内部", "inner", "inside")
EDGES = "左|右|上|下|前|后|left|right|top|bottom|front|back"
# Words of round bodies and of heights.
DIAMETER = ("diameter", "cylinder", "cylindrical", "直径", "圆柱", "外周", "穿过圆心")
HEIGHT = ("height", "thickness", "高度", "厚度", "顶面", "底面")
# Limits, tolerances, and one number with a second in brackets.
LIMIT = r"(?:max(?:imum)?|min(?:imum)?|ref(?:erence)?|typ(?:ical)?)"
TOLERANCE = r"±|\+/-|\+\s*(?:\d|[.,])[\s\S]*[-−]\s*(?:\d|[.,])"
NUMBER = r"(?:\d+(?:[.,]\d+)?|[.,]\d+)"
BRACKETED = rf"^\s*{NUMBER}\s*\(\s*{NUMBER}\s*\)"
FOLDED = "文本层 min/max "


def _with(dimension: DataFrame, *columns: str) -> DataFrame:
    """``dimension`` with text columns that it may lack, as empty ones."""
    return dimension.withColumns({c: F.lit("") for c in columns if c not in dimension.columns})


def symbol_key() -> Column:
    return F.regexp_replace(F.replace("_name", F.lit("×"), F.lit("x")), "[^a-z0-9]+", "")


def without_views(key: Column) -> Column:
    return F.regexp_replace(key, "|".join(VIEWS), "")


def outer_value(rows: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Of ``rows(keys, ord, value_mm, raw, _key)`` the one outer value per key, by one aggregate, with the row's ``carry`` columns.

    A single row stands as it is. Of several, rows of inner boundaries go where others stay; what
    stays must describe one boundary (the ends but for the names of views), and its largest value
    wins, the first of equals. Several boundaries are ``ambiguous`` and give no value. ``reason``
    says why values differ: min_max (two within 20 %, or marked min and max), repeated or range.
    """
    inner, canon, v = any_of(F.col("_key"), INNER), without_views(F.col("_key")), F.col("value_mm")
    best = lambda where: F.max_by(F.struct("ord", *carry), F.when(where, F.struct(v, -F.col("ord"))))
    count = lambda c: F.count(F.when(c, 1))
    text = F.regexp_replace(F.lower("raw"), "[^a-z0-9]+", "")
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), count(~inner).alias("_outer"), F.count_distinct(F.when(~inner, canon)).alias("_b_outer"), F.count_distinct(canon).alias("_b_all"),
        F.min(F.when(~inner, v)).alias("_lo_outer"), F.max(F.when(~inner, v)).alias("_hi_outer"), F.min(v).alias("_lo_all"), F.max(v).alias("_hi_all"),
        best(~inner).alias("_o_outer"), best(F.lit(True)).alias("_o_all"), F.bool_or(F.contains(text, F.lit("min"))).alias("_min"), F.bool_or(F.contains(text, F.lit("max"))).alias("_max"),
    )
    some = F.col("_outer") > 0
    either = lambda name: F.when(some, F.col(f"_{name}_outer")).otherwise(F.col(f"_{name}_all"))
    lo, hi, n = either("lo"), either("hi"), F.when(some, F.col("_outer")).otherwise(F.col("n"))
    unique = (F.col("n") == 1) | (either("b") == 1)
    reason = F.when(F.col("n") == 1, "direct").when(((n == 2) & (hi - lo < 0.2 * lo)) | (F.col("_min") & F.col("_max")), "min_max").when(hi - lo <= 1e-9, "repeated").otherwise("range")
    return g.select(
        *keys, F.col("n").cast("long").alias("n"), F.when(unique, "unique").otherwise("ambiguous").alias("status"), F.when(unique, hi).alias("value_mm"),
        F.when(unique, reason).alias("reason"), *[F.when(unique, either("o")[c]).alias(c) for c in ("ord", *carry)],
    )


def body_rows(dimension: DataFrame, token: DataFrame | None = None) -> DataFrame:
    """Direct length and width rows of package outlines with their marks and three gates.

    ``plain``: neither a diameter nor a height. ``single``: one planar value, not a list. ``drawn``:
    also nominal by its own notation (no MAX, MIN, REF or TYP, the first number of a tolerance), and
    where ``token(doc_id, value_mm, accepted)`` is given, by the notation of the page's lines.
    """
    d = to_mm(_with(dimension, "symbol", "raw")).where((F.col("belongs_to") == "package_outline") & F.col("role").isin(*BODY) & F.col("value_mm").isNotNull())
    if "is_derived" in d.columns:
        d = d.where(~F.coalesce("is_derived", F.lit(False)))
    m = marked(d).withColumns({"_symbol": symbol_key(), "_raw": F.trim("_raw")})
    context = F.concat_ws(" ", "_name", "_raw", "_text")
    diameter = any_of(F.col("_name"), ("φ", "ϕ", "phi")) | F.col("_symbol").isin("phid", "diameter") | (F.col("_symbol").rlike(r"^d\d*$") & any_of(context, DIAMETER))
    height = F.col("_symbol").isin("l", "h", "a") & (any_of(context, HEIGHT) | F.coalesce(F.col("planar_axis") == "height", F.lit(False)))
    spread, bracket = F.col("_raw").rlike(TOLERANCE), F.col("_raw").rlike(BRACKETED)
    folded = F.startswith(F.col("_raw"), F.lit(FOLDED))
    numbers = F.regexp_count("_raw", F.lit(rf"(?<![a-z0-9.,]){NUMBER}(?![a-z])"))
    first = F.replace(F.regexp_extract("_raw", f"({NUMBER})", 1), F.lit(","), F.lit(".")).try_cast("double")
    value = F.replace("value", F.lit(","), F.lit(".")).try_cast("double")
    nominal = folded | (~F.col("_raw").rlike(rf"(?U)\b{LIMIT}\b") & ~bracket & (~spread | F.coalesce(first == value, F.lit(False))))
    m = m.withColumns({"plain": ~(diameter | height), "single": folded | spread | bracket | (numbers <= 1), "_nominal": nominal, "_limit": F.col("_raw").rlike(LIMIT)})
    m = m.withColumns({"drawn": F.col("plain") & F.col("single") & F.col("_nominal"), "strict": F.col("planar_axis").isNotNull() & F.col("single") & ~tolerance_only() & ~F.col("_limit")})
    if token is not None:
        ok = filter_body_candidates(dimension if "sample_idx" in dimension.columns else dimension.withColumn("sample_idx", F.lit(0)), token)
        m = m.join(ok.where("reason not in ('ok', 'several_numbers')").select("doc_id", "ord").distinct().withColumn("_page", F.lit(True)), ["doc_id", "ord"], "left")
        m = m.withColumn("drawn", F.col("drawn") & F.col("_page").isNull())
    return m


def planar_pair(rows: DataFrame) -> DataFrame:
    """Per document the one width and height, from ``body_rows``, that belong together; exactly one group or none.

    A row across and a row upright of complementary roles belong together when they name the same
    view, carry the same symbol or share the context before their edges. The pair's names are its
    group; D17 picks in each group, and one group must have both. Rows are reduced to the distinct
    combinations of what they name before they meet, so many rows of equal names never multiply.
    """
    name = ["planar_axis", "role", "view", "_symbol", "context"]
    view = F.coalesce(F.nullif(F.regexp_extract("_key", f"({'|'.join(VIEWS)})", 1), F.lit("")), F.lit(""))
    d = rows.where("drawn and planar_axis is not null").withColumns({"view": view, "context": F.regexp_replace(without_views(F.col("_key")), rf"(?:{EDGES})[\s\S]*$", "")})
    profile = d.select("doc_id", *name).distinct()
    w = profile.where("planar_axis = 'width'").select("doc_id", *[F.col(c).alias(f"w{c}") for c in name])
    h = profile.where("planar_axis = 'height'").select("doc_id", *[F.col(c).alias(f"h{c}") for c in name])
    same = lambda c: F.col(f"w{c}") == F.col(f"h{c}")
    j = w.join(h, "doc_id").where((F.col("wrole") != F.col("hrole")) & ((same("view") & (F.col("wview") != "")) | same("_symbol") | (same("context") & (F.col("wcontext") != ""))))
    both = lambda c: F.concat_ws("&", F.least(f"w{c}", f"h{c}"), F.greatest(f"w{c}", f"h{c}"))
    j = j.withColumn("pair", F.concat_ws("|", both("context"), both("_symbol"), both("view")))
    sides = F.array(*[F.struct(*[F.col(f"{s}{c}").alias(c) for c in name]) for s in "wh"])
    members = j.select("doc_id", "pair", F.inline(sides)).distinct().join(d, ["doc_id", *name])
    carry = ("role", "raw", "span_axis")
    picked = outer_value(members, ["doc_id", "pair", "planar_axis"], carry).where("status = 'unique'")
    side = lambda a, c: F.max(F.when(F.col("planar_axis") == a, F.col(c)))
    whole = picked.groupBy("doc_id", "pair").agg(*[side(a, c).alias(f"{a}_{c}") for a in ("width", "height") for c in ("value_mm", "ord", *carry)]).where("width_ord is not null and height_ord is not null")
    g = whole.groupBy("doc_id").agg(F.count(F.lit(1)).alias("groups"), *[F.min(f"{a}_{c}").alias(f"{a}_{c}") for a in ("width", "height") for c in ("value_mm", "ord", *carry)])
    out = rows.select("doc_id").distinct().join(g, "doc_id", "left")
    one = F.coalesce(F.col("groups") == 1, F.lit(False))
    status = F.when(F.col("groups").isNull(), "none").when(one, "unique").otherwise("ambiguous")
    return out.select("doc_id", status.alias("status"), F.coalesce("groups", F.lit(0)).cast("long").alias("groups"), *[F.when(one, F.col(f"{a}_value_mm")).alias(f"{a}_mm") for a in ("width", "height")], *[F.when(one, F.col(f"{a}_{c}")).alias(f"{a}_{c}") for a in ("width", "height") for c in ("ord", *carry)])


#: Formula tags that carry the axis between the rows of pads.
AXIS = "(width|height|x|y)"
BY_AXIS = {"INLINE3": rf"^REL_INLINE3_{AXIS}$", "DUAL": rf"^REL_DUAL_{AXIS}_.+$", "ASYM3": rf"^REL_ASYM3_{AXIS}_.+$", "QUAD_EP": rf"^REL_QUAD_EP_{AXIS}_TWO_ROW$"}
TWO_AXES = {"GRID4": "REL_GRID4_TWO_AXES", "QUAD_EP": "REL_QUAD_EP_TWO_AXES"}
CHIP_FORMULA = rf"^REL_(?:DIRECT_CENTER|GAP_PLUS_PAD|OVERALL_GAP)_{AXIS}$"


def axis_map(solution: DataFrame) -> DataFrame:
    """``solution(doc_id, family, formula)`` as two rows a document: which axis or role of the drawing becomes X and Y.

    ``selector_axis`` or ``selector_role`` picks the candidates; ``expected_axis`` is what a relation
    has proven and a candidate's ends must not contradict. A formula that names no axis maps nothing.
    """
    f, fam = F.col("formula"), F.col("family")
    named = F.coalesce(*[F.when(fam == k, F.nullif(F.regexp_extract(f, p, 1), F.lit(""))) for k, p in BY_AXIS.items()])
    chip = F.when(fam.isin("CHIP", "SMX"), F.nullif(F.regexp_extract(f, CHIP_FORMULA, 1), F.lit("")))
    word = lambda a: F.when(a.isin("x", "width"), "width").when(a.isin("y", "height"), "height")
    other = lambda a: F.when(a == "width", "height").when(a == "height", "width")
    two = F.coalesce(*[F.when((fam == k) & (f == t), F.lit("width")) for k, t in TWO_AXES.items()])
    s = solution.select("doc_id", "family", "formula", F.coalesce(two, word(named)).alias("_sep"), F.when((fam == "SOT3") & (f == "REL_SOT3_TWO_AXES"), "width").otherwise(word(chip)).alias("_rel"))
    by_role = ~fam.isin(*BY_AXIS, *TWO_AXES) & (F.col("_rel").isNotNull() | ~F.startswith(f, F.lit("REL_")))
    rows = [
        F.struct(
            F.lit(field).alias("field"), F.lit(target).alias("target_axis"), (F.col("_sep") if x else other(F.col("_sep"))).alias("selector_axis"),
            F.when(by_role, role).alias("selector_role"), F.when(by_role, F.col("_rel") if x else other(F.col("_rel"))).alias("expected_axis"),
        )
        for x, (field, target, role) in ((True, ("body_x", "footprint_x", "body_length")), (False, ("body_y", "footprint_y", "body_width")))
    ]
    return s.select("doc_id", "family", "formula", F.inline(F.array(*rows)))


def assign_body(dimension: DataFrame, solution: DataFrame, token: DataFrame | None = None) -> DataFrame:
    """body_x and body_y of each document of ``solution(doc_id, family, formula)``, with the chain that proves them.

    With a formula, its tag says which drawing axis (or, for chips, which role) becomes X and Y; D17
    picks among the candidates, whose ends must prove the axis or at least not contradict it. Without
    one (null), the drawing's own orientation counts through D18. Both values are given or neither:
    a proven one beside an unproven one is withheld. ``reason`` says what an open one lacks. A
    document without body rows has two open rows; null formulas are those without a unique solution.
    """
    carry = ("role", "raw", "span_axis")
    rows = body_rows(dimension, token)
    fields = axis_map(solution)
    cand = first_candidates(rows, ["doc_id", "role", "plain"]).select("doc_id", "ord", "value_mm", "_key", "plain", "strict", "first", *carry)
    j = fields.where("formula is not null").select("doc_id", "family", "field", "selector_axis", "selector_role").join(cand, "doc_id")
    able = F.when(F.col("family").isin("INLINE3", "GRID4"), F.col("strict")).otherwise(F.col("plain"))
    fits = F.coalesce(F.col("span_axis") == F.col("selector_axis"), F.lit(False)) | F.coalesce((F.col("role") == F.col("selector_role")) & F.col("first"), F.lit(False))
    picked = outer_value(j.where(able & fits), ["doc_id", "field"], carry).select("doc_id", "field", "status", "value_mm", *carry, F.lit(None).cast("string").alias("_drawn"))
    # Without a formula: the planar pair, as picks of the same form.
    pair = planar_pair(rows.join(solution.where("formula is null").select("doc_id").distinct(), "doc_id", "left_semi"))
    sides = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("_drawn"), F.col(f"{a}_mm").alias("value_mm"), *[F.col(f"{a}_{c}").alias(c) for c in carry]) for f, a in (("body_x", "width"), ("body_y", "height"))]))
    drawn = pair.select("doc_id", "status", sides).select(*picked.columns)
    r = fields.join(picked.unionByName(drawn), ["doc_id", "field"], "left").withColumnsRenamed({"role": "source_role", "raw": "source_raw", "span_axis": "_span"})
    none = F.col("formula").isNull()
    mapped = none | F.col("selector_axis").isNotNull() | F.col("selector_role").isNotNull()
    axis = F.coalesce("_drawn", "_span", "expected_axis")
    reason = (
        F.when(~mapped, "formula_names_no_axis").when(none & F.coalesce(F.col("status") != "unique", F.lit(True)), F.concat(F.lit("planar_pair_"), F.coalesce("status", F.lit("none")))).when(F.col("status").isNull(), "no_candidate")
        .when(F.col("status") != "unique", "several_boundaries").when(F.col("_span") != F.col("expected_axis"), "relation_axis_conflict").when(axis.isNull(), "axis_not_proven")
    )
    r = r.withColumns({"reason": reason, "source_axis": axis})
    proven = r.groupBy("doc_id").agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("_proven"))
    r = r.join(proven, "doc_id")
    ok = (F.col("_proven") == 2) & F.col("reason").isNull()
    status = F.when(ok, "proven").when(F.col("reason").isNull(), "withheld_pair_incomplete").when(F.col("reason") == "relation_axis_conflict", "unresolved_relation_axis_conflict").otherwise("unresolved")
    step = F.when(F.col("selector_role").isNotNull() | none, F.col("source_role")).otherwise(F.concat(F.lit("endpoint:"), "source_axis"))
    via = F.when(none, F.concat(F.lit("drawing_orientation:"), "source_axis", F.lit("->"), "target_axis")).otherwise(F.concat(F.lit("land_solution:"), "formula"))
    chain = F.when(F.col("reason").isNull(), F.concat_ws(" > ", F.concat(F.lit("original_image:"), "source_axis"), step, via, "target_axis"))
    return r.select("doc_id", "field", status.alias("status"), F.when(ok, F.col("value_mm")).alias("value_mm"), F.when(F.col("reason").isNull(), F.col("source_axis")).alias("source_axis"), F.when(F.col("reason").isNull(), F.col("source_raw")).alias("source_raw"), chain.alias("mapping_chain"), F.coalesce("reason", F.lit("")).alias("reason"))
