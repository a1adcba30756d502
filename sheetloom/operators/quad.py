"""Parts with an exposed pad, from closed chains of land dimensions, as one aggregate and column arithmetic.

Each row is labelled by what it measures and on which axis; a document then has one value, or none,
for each label, by the smallest and largest of its rows. Chains over those values must agree with
their first member; values are never ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as K
from ..functions.text import any_of
from .body import _with, symbol_key
from .dimensions import to_mm
from .marks import marked, tolerance_only
from .pages import EP_ROLES

AXES = ("width", "height")
# Marks of thermal vias, peripheral pads, exposed pads and square shapes.
VIAS = ("thermal via", "散热过孔", "热过孔")
VIA_WORDS = ("via", "过孔", "thermal")
PERIPHERAL = ("small", "contact pad", "terminal", "小焊盘", "端子焊盘")
PERIPHERAL_ENDS = ("small", "contactpad", "terminalpad", "小焊盘", "端子焊盘")
EXPOSED = ("center pad", "centre pad", "exposed pad", "thermal pad", "e-pad", "中央焊盘", "中心焊盘", "大焊盘")
EXPOSED_MIXED = ("center pad", "exposed", "thermal pad", "大焊盘", "中央焊盘")
SQUARE = ("□", "square", "方形")
# Values that are ranges or limits, and pads that are numbered.
RANGE = r"(?:\d+(?:\.\d+)?|\.\d+)\s*(?:-|–|—|~|～|\bto\b|至|到)\s*(?:\d+(?:\.\d+)?|\.\d+)"
LIMITS = r"\b(?:min(?:imum)?|max(?:imum)?|ref(?:erence)?)\b|最大|最小|参考"
SHORT_LIMITS = r"\b(?:max|min|ref)\b|最大|最小|参考"
NUMBERED = r"(?:pad|land|pin|焊盘|引脚)\s*#?\s*(\d+)\b"
DIRECT = ("pad_width", "pad_height", "pitch", "tab_width", "tab_height", "pad_center_distance")
FEWEST, MOST = 4, 48


def land_labels(dimension: DataFrame) -> DataFrame:
    """Land rows that may prove an exposed-pad part: nominal and direct, vias marked, with their marks and the part they play.

    ``is_ep`` rows size the exposed pad; the others are peripheral. ``operand`` rows may enter
    arithmetic; limits and ranges prove an axis and nothing else.
    """
    d = to_mm(_with(dimension, "symbol", "raw", "role_original")).where((F.col("belongs_to") == "solder_land") & F.col("value_mm").isNotNull())
    if "is_derived" in d.columns:
        d = d.where(~F.coalesce("is_derived", F.lit(False)))
    m = marked(d).withColumn("_symbol", symbol_key())
    said = F.concat_ws(" ", "_name", "_raw")
    m = m.withColumn("_all", F.concat_ws(" ", "_name", F.lower(F.coalesce("role", F.lit(""))), "_raw", "_text"))
    role = F.coalesce("role", F.lit(""))
    spread = F.col("_raw").rlike(r"±|\+/-|\+\s*(?:\d|[.,])[\s\S]*[-−]\s*(?:\d|[.,])")
    number = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    off = spread & ~F.coalesce(number(F.regexp_extract("_raw", r"([+-]?(?:\d+(?:[.,]\d+)?|[.,]\d+))", 1)) == number(F.col("value")), F.lit(False))
    nominal = ~tolerance_only() & ~off & (role.isin(*DIRECT) | ~said.rlike(f"(?U){SHORT_LIMITS}"))
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    via = (F.col("_symbol").isin("v", "ev") & any_of(F.col("_all"), VIA_WORDS)) | any_of(F.col("_all"), VIAS)
    is_ep = role.isin("tab_width", "tab_height") | F.col("_symbol").isin("x2", "y2") | plain("role").isin(*EP_ROLES) | plain("role_original").isin(*EP_ROLES)
    is_ep = is_ep | (role.isin("pad_width", "pad_height") & ~any_of(F.col("_all"), PERIPHERAL) & any_of(F.col("_all"), EXPOSED))
    inner = F.coalesce(any_of(F.col("_a"), PERIPHERAL_ENDS) & any_of(F.col("_b"), PERIPHERAL_ENDS), F.lit(False))
    return m.where(nominal).withColumns({
        "is_via": via, "is_ep": ~via & is_ep, "mixed": any_of(F.col("_all"), PERIPHERAL) & any_of(F.col("_all"), EXPOSED_MIXED), "inner_ends": inner,
        "axis": F.coalesce("relation_axis", "grid_axis"), "square": any_of(said, SQUARE), "operand": ~said.rlike(f"(?U){RANGE}|{LIMITS}"),
        "ids": F.regexp_extract_all(F.concat_ws(" ", said, F.col("_text")), F.lit(f"(?iU){NUMBERED}"), F.lit(1)),
    })


def _labels() -> dict[str, Column]:
    """Which rows carry each label; ``topology`` labels prove an axis, the others are values."""
    r, c = F.coalesce("role", F.lit("")), F.col
    out = {}
    for axis in AXES:
        on = lambda a: F.coalesce(a == axis, F.lit(False))  # noqa: B023, E731
        rim, here, facing = ~c("is_ep"), on(c("axis")), on(c("opposing_axis"))
        center = rim & (r == "pad_center_distance") & facing & ~c("same_line") & c("center_marked")
        gap = rim & r.isin("other", "pad_gap", "gap_between_pads") & ~c("mixed") & c("inner_ends") & facing & ~c("center_marked")
        outer = (r == "overall_span") & on(F.coalesce("opposing_axis", "axis"))
        out |= {
            f"pad_{axis}": rim & r.isin("pad_width", "pad_height") & ~c("mixed") & here, f"ep_{axis}": c("is_ep") & (here | c("square")),
            f"center_{axis}": center & c("operand"), f"inner_{axis}": gap & c("operand"), f"outer_{axis}": outer & c("operand"),
            f"ep_gap_{axis}": rim & r.isin("pad_gap", "gap_between_pads") & c("mixed") & (here | c("axis").isNull()) & c("operand"),
            f"topology_{axis}": center | gap | outer, f"pitch_{axis}": rim & (r == "pitch") & here, f"row_pitch_{axis}": rim & (r == "pitch") & (here | c("axis").isNull()),
        }
    return out | {"pitch_common": ~c("is_ep") & (r == "pitch") & c("axis").isNull(), "shape": ~c("is_ep") & r.isin("pad_width", "pad_height") & ~c("mixed")}


def _closed(members: list[Column], tol: float = K.CONSISTENT) -> Column:
    """The first of the members that are there, if all others lie within ``tol`` of it."""
    some = F.filter(F.array(*members), lambda x: x.isNotNull())
    first = F.get(some, F.lit(0))
    return F.when(F.forall(some, lambda x: F.abs(x - first) <= tol + 1e-9), first)


def _above(value: Column, floor: Column | float = 0.0) -> Column:
    return F.when(value > floor, value)


def quad_topology(dimension: DataFrame, document: DataFrame) -> DataFrame:
    """``document(doc_id, pin_count, has_exposed_pad)`` with the solved exposed-pad geometry, or why there is none.

    ``status``: auto, partial (two rows whose center distance no chain gives), insufficient with a
    ``reason``, or not_applicable without evidence of an exposed pad. Two rows: pad, center and
    exposed pad along the one axis with evidence, by chains that agree within 0.02. Four sides: two
    distinct pad sizes, tried both ways, of which one way alone may close. Documents without land
    rows lack an exposed pad's size; null pin counts count only where the drawing numbers its pads.
    """
    rows = land_labels(dimension).where("not is_via")
    rim = ~F.col("is_ep")
    v, label = F.round("value_mm", 6), _labels()
    ids = F.size(F.array_distinct(F.flatten(F.collect_set(F.when(rim, F.col("ids"))))))
    spare = rim & F.col("role").isin("other", "pad_center_distance", "overall_span") & F.col("operand")
    lo = {k: F.min(F.when(c, v)).alias(f"lo_{k}") for k, c in label.items()}
    hi = {k: F.max(F.when(c, v)).alias(f"hi_{k}") for k, c in label.items()}
    times = F.max(F.when(rim, F.col("multiplicity"))).alias("_times")
    per_pitch = F.array_sort(F.collect_set(F.when(rim & (F.col("role") == "pitch") & F.col("multiplicity").isNotNull(), F.struct("multiplicity", v.alias("v"))))).alias("_counted")
    g = rows.groupBy("doc_id").agg(*lo.values(), *hi.values(), times, per_pitch, F.count_if("is_ep").alias("_ep_rows"), F.count_distinct(F.when(label["shape"], v)).alias("_shapes"), F.nullif(ids, F.lit(0)).cast("long").alias("_ids"), F.collect_set(F.when(spare, v)).alias("_spare"))
    one = lambda k: F.when(F.col(f"lo_{k}") == F.col(f"hi_{k}"), F.col(f"lo_{k}"))
    names = [k for k in label if not k.startswith("topology")]
    d = document.select("doc_id", "pin_count", "has_exposed_pad").join(g, "doc_id", "left")
    seen = F.coalesce("_times", "_ids")
    count = F.when(seen > 2, seen).otherwise(F.col("pin_count")).cast("int")
    d = d.select("doc_id", "pin_count", "has_exposed_pad", "_ep_rows", "_shapes", "_counted", "_spare", "lo_shape", "hi_shape", seen.alias("_seen"), count.alias("count"), *[F.col(f"lo_topology_{a}").isNotNull().alias(f"has_{a}") for a in AXES], *[one(k).alias(k) for k in names])
    # A row that equals pad + exposed pad + 2 gaps stands as a center, if it is one distinct value.
    for a in AXES:
        d = d.withColumn(f"sum_{a}", F.col(f"pad_{a}") + F.col(f"ep_{a}") + 2 * F.col(f"ep_gap_{a}"))
    for a in AXES:
        near = F.filter("_spare", lambda x: F.abs(x - F.col(f"sum_{a}")) <= K.CONSISTENT + 1e-9)  # noqa: B023
        d = d.withColumn(f"aux_{a}", F.when(F.size(near) == 1, F.col(f"sum_{a}")))
    for a in AXES:
        d = d.withColumn(f"has_{a}", F.coalesce(f"has_{a}", F.lit(False)) | F.col(f"aux_{a}").isNotNull())
    return _solve(d)


def _solve(d: DataFrame) -> DataFrame:
    c = F.col
    n, four = c("count"), c("has_width") & c("has_height")
    sep = F.when(c("has_width"), "width").otherwise("height")
    along = lambda k: F.when(sep == "width", c(f"{k}_width")).otherwise(c(f"{k}_height"))
    across = lambda k: F.when(sep == "width", c(f"{k}_height")).otherwise(c(f"{k}_width"))
    d = d.withColumns({"sep": F.when(~four & (c("has_width") | c("has_height")), sep), **{f"s_{k}": along(k) for k in ("pad", "ep", "center", "inner", "outer", "ep_gap", "aux")}, **{f"x_{k}": across(k) for k in ("pad", "ep", "row_pitch")}})
    # Two rows.
    pad = _closed([c("s_pad"), _above(c("s_outer") - c("s_inner")) / 2, _above(c("s_center") - c("s_inner")), _above(c("s_outer") - c("s_center")), _above(c("s_center") - c("s_ep") - 2 * c("s_ep_gap"))])
    d = d.withColumn("t_pad", pad)
    center = [c("s_center"), c("s_aux"), c("s_inner") + c("t_pad"), c("s_outer") - c("t_pad"), c("s_ep") + 2 * c("s_ep_gap") + c("t_pad")]
    d = d.withColumns({"t_center": _closed(center), "t_rows": F.floor(n / 2).cast("int")})
    has = lambda *ks: reduce(lambda a, b: a & b, [c(k).isNotNull() for k in ks])
    two_done = has("t_pad", "x_pad", "x_row_pitch", "s_ep", "x_ep")
    two_clash = F.coalesce(c("t_center") <= c("t_pad"), F.lit(False)) | (c("t_center").isNotNull() & (c("t_rows") > 1) & F.coalesce(c("x_row_pitch") <= c("x_pad"), F.lit(False)))
    # Four sides: a common pitch, or one for each axis; both ways to take the two sizes.
    told = F.filter("_counted", lambda s: s["multiplicity"] == n - 4)
    together = F.array_distinct(F.concat(F.transform(told, lambda s: s["v"]), F.filter(F.array("pitch_common"), lambda x: x.isNotNull())))
    d = d.withColumns({"q_common": F.size(together), "q_shared": F.when(F.size(together) == 1, F.get(together, F.lit(0))), "q_rows": F.floor(n / 4).cast("int")})
    shared = lambda own: F.when(c("q_common") > 0, c("q_shared")).otherwise(own)
    d = d.withColumns({"q_px": shared(c("pitch_width")), "q_py": shared(c("pitch_height"))})
    ways = []
    for length, breadth in (("lo_shape", "hi_shape"), ("hi_shape", "lo_shape")):
        cx, cy = (_closed([c(f"center_{a}"), _above(c(f"outer_{a}") - c(length))]) for a in AXES)
        fits = (cx > c(length)) & (cy > c(length)) & ((c("q_rows") <= 1) | ((c("q_px") > c(breadth)) & (c("q_py") > c(breadth))))
        ways.append(F.when(F.coalesce(fits, F.lit(False)), F.struct(c(length).alias("pad_x"), c(breadth).alias("pad_y"), cx.alias("center_x"), cy.alias("center_y"))))
    d = d.withColumn("ways", F.filter(F.array(*ways), lambda w: w.isNotNull()))
    q = lambda k: F.when(F.size("ways") == 1, F.get("ways", F.lit(0))[k])
    reason = (
        F.when(F.coalesce(c("_ep_rows"), F.lit(0)) == 0, "no_exposed_pad_size").when((c("_seen") > 2) & c("pin_count").isNotNull() & ~c("pin_count").isin(0) & (c("pin_count") != n) & (c("pin_count") != n + 1), "count_differs")
        .when(n.isNull(), "no_count").when(~n.between(FEWEST, MOST), "count_out_of_range").when(~(c("has_width") | c("has_height")), "no_row_axis")
        .when(~four & (n % 2 == 1), "odd_count").when(~four & ~two_done, "chain_open").when(~four & two_clash, "pads_overlap")
        .when(four & (n % 4 != 0), "count_not_by_four").when(four & (c("_shapes") != 2), "shapes_not_a_pair").when(four & ~has("q_px", "q_py", "ep_width", "ep_height"), "pitch_or_exposed_pad_open").when(four & (F.size("ways") != 1), "orientation_not_unique")
    )
    d = d.withColumn("reason", F.when(~F.coalesce("has_exposed_pad", F.lit(False)), "no_evidence").otherwise(reason))
    ok = c("reason").isNull()
    status = F.when(c("reason") == "no_evidence", "not_applicable").when(~ok, "insufficient").when(~four & c("t_center").isNull(), "partial").otherwise("auto")
    pick = lambda two, quad: F.when(ok, F.when(four, quad).otherwise(two))
    tag = F.when(four, F.lit("REL_QUAD_EP_TWO_AXES")).otherwise(F.concat(F.lit("REL_QUAD_EP_"), c("sep"), F.lit("_TWO_ROW"), F.when(c("t_center").isNull(), "_PARTIAL_CENTER").otherwise("")))
    zero, rows = F.lit(0.0), F.when(four, c("q_rows")).otherwise(c("t_rows"))
    r = lambda x: F.round(x, 6)
    return d.select(
        "doc_id", status.alias("status"), F.coalesce("reason", F.lit("")).alias("reason"), F.when(ok, F.when(four, "four_sided").otherwise("two_row")).alias("form"), F.when(ok, tag).alias("formula"),
        r(pick(c("t_pad"), q("pad_x"))).alias("pad_x"), r(pick(c("x_pad"), q("pad_y"))).alias("pad_y"), r(pick(c("t_center"), q("center_x"))).alias("center_x"), r(pick(zero, q("center_y"))).alias("center_y"),
        r(pick(c("x_row_pitch"), c("q_py"))).alias("pitch_y"), r(pick(zero, c("q_px"))).alias("pitch_x"), r(pick(c("s_ep"), c("ep_width"))).alias("tab_x"), r(pick(c("x_ep"), c("ep_height"))).alias("tab_y"),
        F.when(ok, rows).alias("side_count"), F.when(ok, F.when(four, rows).otherwise(0)).cast("int").alias("end_count"),
    )
