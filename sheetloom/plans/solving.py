"""Queries of marks, body axes, exposed pads, dual rows, bounds and the solution gate over variants of drawings, with hand-made answers as SQL.

Each variant is a drawing as rows of a table; parts take one by the remainder of their key, with
values of their own. The SQL lists what each variant must give, and never repeats a rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import body as B
from ..operators import consensus as C
from ..operators import dimensions as D
from ..operators import dual as U
from ..operators import gate as G
from ..operators import marks as M
from ..operators import notation as N
from ..operators import quad as Q
from ..operators import relations as R
from . import fixtures as fx

L, P, A = "solder_land", "package_outline", "occupied_area"

# ---- D7, D11: (endpoints, then what they mean)
MARKS = [
    (0, "左焊盘左缘 -> 左焊盘右缘", "width", None, None, False, False, False, None),
    (1, "左焊盘中心线 -> 右焊盘中心线", "width", None, None, True, False, False, None),
    (2, "左焊盘左边缘 -> 右焊盘右边缘", "width", None, None, False, True, False, None),
    (3, "左焊盘右边缘 -> 右焊盘左边缘", "width", None, None, False, False, True, None),
    (4, "上排小焊盘中心线 到 下排小焊盘中心线", "height", "height", "height", True, False, False, "small"),
    (5, "left row small pad -> right row small pad", "width", "width", "width", False, False, False, "small"),
    (6, "ｌｅｆｔ pad centerline → middle pad centerline", "width", None, None, True, False, False, None),
    (7, "大焊盘上缘 至 大焊盘下缘", "height", None, None, False, False, False, "tab"),
    (8, "thermal pad edge", None, None, None, False, False, False, "tab"),
    (9, "", None, None, None, False, False, False, None),
]


def _marks(spark, sf_dir):
    rows = [(v, 0, "", "other", L, e, "", 100, 1) for v, e, *_ in MARKS]
    return fx.load(spark, sf_dir, fx.variants(rows, len(MARKS)))


def d7_marks(spark, sf_dir):
    m = M.marked(_marks(spark, sf_dir))
    return m.select("doc_id", "relation_axis", "opposing_axis", "dual_axis", "center_marked", "overall_marked", "gap_marked", "pad_kind")


PADS = [
    (0, 0, "左焊盘左缘 -> 左焊盘右缘", ""), (0, 1, "左焊盘右缘 -> 右焊盘左缘", ""),  # two pads
    (1, 0, "焊盘左缘 -> 焊盘右缘", " (4x)"),  # one name, four times
    (2, 0, "上排焊盘中心线 -> 下排焊盘中心线", ""), (2, 1, "左上焊盘左缘 -> 右上焊盘右缘", ""), (2, 2, "左下焊盘上缘 -> 左下焊盘下缘", ""),  # rows name groups: three single pads
    (3, 0, "左侧焊盘中心线 -> 右下焊盘中心线", ""), (3, 1, "左上焊盘左缘 -> 左下焊盘左缘", ""),  # the left side is its two corners
    (4, 0, "solder land 左右两处", ""),  # two places
    (5, 0, "edge -> edge", ""),  # nothing named
]
PAD_COUNTS = [(0, 2), (1, 4), (2, 3), (3, 3), (4, 2), (5, 1)]


def d11_pad_count(spark, sf_dir):
    rows = [(v, o, "", "pad_width", L, e, note, 100, 1) for v, o, e, note in PADS]
    return M.pad_count(fx.load(spark, sf_dir, fx.variants(rows, 6)))


# ---- D17 to D19: (variant, ord, symbol, role, endpoints, note, h, k)
WIDE, TALL = "本体左缘 -> 本体右缘", "本体上缘 -> 本体下缘"
BODY = [
    (0, 0, "E", "body_length", WIDE, "", 500, 1), (0, 1, "F", "body_width", TALL, "", 300, 1),
    (1, 0, "E", "body_length", WIDE, " max", 510, 1), (1, 1, "E", "body_length", WIDE, " min", 470, 1), (1, 2, "F", "body_width", TALL, "", 300, 1),
    (2, 0, "E", "body_length", WIDE, "", 500, 1), (2, 1, "E", "body_length", "外壳左缘 -> 外壳右缘", "", 520, 1), (2, 2, "F", "body_width", TALL, "", 300, 1),
    (3, 0, "E", "body_length", TALL, "", 500, 1), (3, 1, "F", "body_width", WIDE, "", 300, 1),
    (4, 0, "E", "body_length", WIDE, "", 500, 1), (4, 1, "H", "body_width", "本体高度 上缘 -> 下缘", "", 300, 1),
    (5, 0, "E", "body_length", WIDE, "", 500, 1), (5, 1, "E", "body_length", "inner 左缘 -> 右缘", "", 900, 1), (5, 2, "F", "body_width", TALL, "", 300, 1),
    (6, 0, "S", "body_length", "俯视图 本体左缘 -> 本体右缘", "", 500, 1), (6, 1, "T", "body_width", "俯视图 外壳上缘 -> 外壳下缘", "", 300, 1),
    (7, 0, "S", "body_length", WIDE, "", 500, 1), (7, 1, "T", "body_width", "外壳上缘 -> 外壳下缘", "", 300, 1),
    (8, 0, "S", "body_length", "俯视图 本体左缘 -> 本体右缘", "", 500, 1), (8, 1, "S", "body_width", "侧视图 外壳上缘 -> 外壳下缘", "", 300, 1),
    (9, 0, "S", "body_length", "俯视图 本体左缘 -> 本体右缘", "", 500, 1), (9, 1, "T", "body_width", "俯视图 本体上缘 -> 本体下缘", "", 300, 1), (9, 2, "U", "body_width", "俯视图 壳上缘 -> 壳下缘", "", 320, 1),
    (10, 0, "E", "body_length", WIDE, " max", 500, 1), (10, 1, "F", "body_width", TALL, "", 300, 1),
]
# Family and formula of the land solution of each variant; none where the drawing's own orientation must do.
SOLVED = [
    (0, "CHIP", "REL_GAP_PLUS_PAD_x"), (1, "SOT3", "REL_SOT3_TWO_AXES"), (2, "SMX", "REL_DIRECT_CENTER_x"), (3, "DUAL", "REL_DUAL_height_DIRECT_CENTER"), (4, "CHIP", "A+B+C"),
    (5, "GRID4", "REL_GRID4_TWO_AXES"), (6, "CHIP", None), (7, "CHIP", None), (8, "CHIP", None), (9, "CHIP", None), (10, "QUAD_EP", "REL_QUAD_EP_width_TWO_ROW_PARTIAL_CENTER"),
]
# field, status, axis, reason, h, k
BODIES = [
    (0, "body_x", "proven", "width", "", 500, 1), (0, "body_y", "proven", "height", "", 300, 1),
    (1, "body_x", "proven", "width", "", 510, 1), (1, "body_y", "proven", "height", "", 300, 1),
    (2, "body_x", "unresolved", None, "several_boundaries", None, 1), (2, "body_y", "withheld_pair_incomplete", "height", "", None, 1),
    (3, "body_x", "proven", "height", "", 500, 1), (3, "body_y", "proven", "width", "", 300, 1),
    (4, "body_x", "withheld_pair_incomplete", "width", "", None, 1), (4, "body_y", "unresolved", None, "no_candidate", None, 1),
    (5, "body_x", "proven", "width", "", 500, 1), (5, "body_y", "proven", "height", "", 300, 1),  # an inner boundary gives way
    (6, "body_x", "proven", "width", "", 500, 1), (6, "body_y", "proven", "height", "", 300, 1),
    (7, "body_x", "unresolved", None, "planar_pair_none", None, 1), (7, "body_y", "unresolved", None, "planar_pair_none", None, 1),
    (8, "body_x", "proven", "width", "", 500, 1), (8, "body_y", "proven", "height", "", 300, 1),
    (9, "body_x", "unresolved", None, "planar_pair_ambiguous", None, 1), (9, "body_y", "unresolved", None, "planar_pair_ambiguous", None, 1),
    (10, "body_x", "unresolved", None, "formula_names_no_axis", None, 1), (10, "body_y", "unresolved", None, "formula_names_no_axis", None, 1),
]


def _body(spark, sf_dir):
    return fx.load(spark, sf_dir, fx.variants([(v, o, s, r, P, e, n, h, k) for v, o, s, r, e, n, h, k in BODY], 11))


def d17_outer_max(spark, sf_dir):
    rows = M.marked(D.to_mm(_body(spark, sf_dir)))
    return B.outer_value(rows, ["doc_id", "role"]).select("doc_id", "role", "n", "status", F.round("value_mm", 6).alias("value_mm"), "reason")


OUTER = [
    (0, "body_length", 1, "unique", "direct", 500), (0, "body_width", 1, "unique", "direct", 300), (1, "body_length", 2, "unique", "min_max", 510), (1, "body_width", 1, "unique", "direct", 300),
    (2, "body_length", 2, "ambiguous", None, None), (2, "body_width", 1, "unique", "direct", 300), (3, "body_length", 1, "unique", "direct", 500), (3, "body_width", 1, "unique", "direct", 300),
    (4, "body_length", 1, "unique", "direct", 500), (4, "body_width", 1, "unique", "direct", 300), (5, "body_length", 2, "unique", "repeated", 500), (5, "body_width", 1, "unique", "direct", 300),
    (6, "body_length", 1, "unique", "direct", 500), (6, "body_width", 1, "unique", "direct", 300), (7, "body_length", 1, "unique", "direct", 500), (7, "body_width", 1, "unique", "direct", 300),
    (8, "body_length", 1, "unique", "direct", 500), (8, "body_width", 1, "unique", "direct", 300), (9, "body_length", 1, "unique", "direct", 500), (9, "body_width", 2, "ambiguous", None, None),
    (10, "body_length", 1, "unique", "direct", 500), (10, "body_width", 1, "unique", "direct", 300),
]


def d18_planar_pair(spark, sf_dir):
    return B.planar_pair(B.body_rows(_body(spark, sf_dir))).select("doc_id", "status", "groups", F.round("width_mm", 6).alias("width_mm"), F.round("height_mm", 6).alias("height_mm"))


PAIRS = [
    (0, "unique", 1, 500, 300), (1, "none", 0, None, None), (2, "unique", 1, 500, 300), (3, "unique", 1, 300, 500), (4, "none", 0, None, None), (5, "unique", 1, 500, 300),
    (6, "unique", 1, 500, 300), (7, "none", 0, None, None), (8, "unique", 1, 500, 300), (9, "ambiguous", 2, None, None), (10, "none", 0, None, None),
]


def d19_body_axes(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"))
    which = F.col("doc_id") % 11
    case = lambda i: F.coalesce(*[F.when(which == v, F.lit(x[i]).cast("string")) for v, *x in SOLVED])
    done = part.select("doc_id", case(0).alias("family"), case(1).alias("formula"))
    return B.assign_body(_body(spark, sf_dir), done).select("doc_id", "field", "status", F.round("value_mm", 6).alias("value_mm"), "source_axis", "reason")


# ---- R8: (variant, ord, symbol, role, endpoints, note, h, k)
ROWS = "左排小焊盘中心线 -> 右排小焊盘中心线"
EP_W, EP_H = "中央焊盘左缘 -> 中央焊盘右缘", "中央焊盘上缘 -> 中央焊盘下缘"
PAD_W, PAD_H = "小焊盘左缘 -> 小焊盘右缘", "小焊盘上缘 -> 小焊盘下缘"
INNER = "左排小焊盘右缘 -> 右排小焊盘左缘"
OUTER_W, OUTER_H = "左列小焊盘左缘 -> 右列小焊盘右缘", "上排小焊盘上缘 -> 下排小焊盘下缘"
_EP = lambda v: [(v, 0, "X2", "tab_width", EP_W, "", 200, 1), (v, 1, "Y2", "tab_height", EP_H, "", 150, 1)]
_SHAPE = lambda v: [(v, 2, "X1", "pad_width", PAD_W, "", 60, 0), (v, 3, "Y1", "pad_height", PAD_H, "", 30, 0), (v, 4, "E", "pitch", "pin pitch", "", 50, 0)]
QUAD = [
    *_EP(0), *_SHAPE(0), (0, 5, "C", "pad_center_distance", ROWS, "", 300, 1), (0, 6, "G", "pad_gap", INNER, "", 240, 1), (0, 7, "V", "other", "thermal via", "", 30, 0),  # closed: center = inner + pad
    *_EP(1), *_SHAPE(1), (1, 5, "C", "pad_center_distance", ROWS, "", 310, 1), (1, 6, "G", "pad_gap", INNER, "", 240, 1),  # center - inner is not the pad
    *_EP(2), *_SHAPE(2), (2, 5, "C", "pad_center_distance", ROWS, " max", 300, 1),  # a limit proves the axis, not the center
    *_EP(3), *_SHAPE(3), (3, 5, "C", "pad_center_distance", "左列小焊盘中心线 -> 右列小焊盘中心线", "", 300, 1), (3, 6, "D", "pad_center_distance", "上排小焊盘中心线 -> 下排小焊盘中心线", "", 300, 1),  # four sides: only length 60, breadth 30 leaves room for the pitch
    *_EP(4), *_SHAPE(4)[:2], (4, 4, "E", "pitch", "pin pitch", "", 80, 0), (4, 5, "C", "pad_center_distance", "左列小焊盘中心线 -> 右列小焊盘中心线", "", 300, 1), (4, 6, "D", "pad_center_distance", "上排小焊盘中心线 -> 下排小焊盘中心线", "", 300, 1),  # either way fits
    *_SHAPE(5), (5, 5, "C", "pad_center_distance", ROWS, "", 300, 1),  # no size of the exposed pad
    *_EP(6), *_SHAPE(6), (6, 5, "Z", "overall_span", "左排小焊盘左缘 -> 右排小焊盘右缘", "", 360, 1), (6, 6, "G", "pad_gap", INNER, "", 240, 1),  # pad and center from the outer and inner spans
    *_EP(7), *_SHAPE(7), (7, 5, "C", "pad_center_distance", ROWS, "", 300, 1),  # nine pins
]
PINS = {0: 8, 1: 8, 2: 8, 3: 16, 4: 16, 5: 8, 6: 9, 7: 9}
# status, reason, form, formula, pad_x, pad_y, center h, pitch_y, tab_x h, tab_y h, side, end
QUADS = [
    (0, "auto", "", "two_row", "REL_QUAD_EP_width_TWO_ROW", 60, 30, 300, 50, 200, 150, 4, 0), (1, "insufficient", "chain_open", None, None, None, None, None, None, None, None, None, None),
    (2, "partial", "", "two_row", "REL_QUAD_EP_width_TWO_ROW_PARTIAL_CENTER", 60, 30, None, 50, 200, 150, 4, 0), (3, "auto", "", "four_sided", "REL_QUAD_EP_TWO_AXES", 60, 30, 300, 50, 200, 150, 4, 4),
    (4, "insufficient", "orientation_not_unique", None, None, None, None, None, None, None, None, None, None), (5, "insufficient", "no_exposed_pad_size", None, None, None, None, None, None, None, None, None, None),
    (6, "insufficient", "odd_count", None, None, None, None, None, None, None, None, None, None), (7, "insufficient", "odd_count", None, None, None, None, None, None, None, None, None, None),
]


def _quad(spark, sf_dir):
    return fx.load(spark, sf_dir, fx.variants([(v, o, s, r, L, e, n, h, k) for v, o, s, r, e, n, h, k in QUAD], 8))


def r8_exposed_pad(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"))
    pins = F.coalesce(*[F.when(F.col("doc_id") % 8 == v, n) for v, n in PINS.items()])
    doc = part.select("doc_id", pins.cast("int").alias("pin_count"), F.lit(True).alias("has_exposed_pad"))
    return Q.quad_topology(_quad(spark, sf_dir), doc).select("doc_id", "status", "reason", "form", "formula", "pad_x", "pad_y", "center_x", "pitch_y", "tab_x", "tab_y", "side_count", "end_count")


# ---- R6, R7
IN_W, OUT_W = "左排小焊盘右缘 -> 右排小焊盘左缘", "左排小焊盘左缘 -> 右排小焊盘右缘"
_DUAL = lambda v: [(v, 0, "A", "pad_width", PAD_W, "", 90, 0), (v, 1, "B", "pad_height", PAD_H, "", 30, 0), (v, 2, "P", "pitch", "pin pitch", "", 65, 0)]
DUALS = [
    *_DUAL(0), (0, 3, "G", "pad_gap", IN_W, "", 400, 1), (0, 4, "Z", "overall_span", OUT_W, "", 584, 1),  # 490 and 494: their mean
    *_DUAL(1), (1, 3, "G", "pad_gap", IN_W, "", 400, 1), (1, 4, "Z", "overall_span", OUT_W, "", 600, 1), (1, 5, "C", "pad_center_distance", ROWS, "", 490, 1),  # 490 and 510: refused, whatever the center says
    *_DUAL(2), (2, 3, "C", "pad_center_distance", ROWS, "", 500, 1),
    *_DUAL(3), (3, 3, "G", "pad_gap", IN_W, "", 400, 1),
    *_DUAL(4), (4, 3, "Z", "overall_span", OUT_W, "", 600, 1),
    *_DUAL(5), (5, 3, "C", "pad_center_distance", ROWS, "", 500, 1),  # five pins: three and two
    *_DUAL(6), (6, 3, "C", "pad_center_distance", "左排焊盘 pin 1 pin 2 pin 3 pin 4 中心线 -> 右排焊盘 pin 5 中心线", "", 500, 1),  # five pins, four of them numbered in one row
    *_DUAL(7), (7, 3, "C", "pad_center_distance", ROWS, "", 500, 1), (7, 4, "A", "pad_width", PAD_W, "", 120, 0),  # two pad widths
    (8, 0, "A", "pad_width", PAD_W, "", 20, 0), (8, 1, "B", "pad_height", PAD_H, "", 30, 0), (8, 2, "P", "pitch", "pin pitch", "", 65, 0), (8, 3, "C", "pad_center_distance", ROWS, "", 500, 1),  # shorter across the rows
    *_DUAL(9), (9, 3, "C", "pad_center_distance", "左排焊盘中心线 -> 右排焊盘中心线", "", 500, 1),  # four pins
]
DUAL_PINS = {0: 8, 1: 8, 2: 8, 3: 8, 4: 8, 5: 5, 6: 5, 7: 8, 8: 8, 9: 4}
TOPOLOGY = [
    *[(v, "auto", "", "width", 4, 4) for v in range(5)], (5, "auto", "", "width", 3, 2), (6, "manual_required", "row_counts", None, None, None), (7, "manual_required", "pads_not_uniform", None, None, None),
    (8, "not_applicable", "pads_not_elongated", None, None, None), (9, "multi_family_conflict", "", "width", 2, 2),
]
# status, formula, h, k, score
CENTERS = [
    (0, "auto", "REL_DUAL_width_CHAIN_INNER_OUTER", 492, 1, 10), (1, "chain_conflict", None, None, 1, None), (2, "auto", "REL_DUAL_width_DIRECT_CENTER", 500, 1, 9), (3, "auto", "REL_DUAL_width_INNER_PLUS_PAD", 490, 1, 8),
    (4, "auto", "REL_DUAL_width_OUTER_MINUS_PAD", 510, 1, 7), (5, "auto", "REL_DUAL_width_DIRECT_CENTER", 500, 1, 9), (9, "auto", "REL_DUAL_width_DIRECT_CENTER", 500, 1, 9),
]


def _dual(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"))
    pins = F.coalesce(*[F.when(F.col("doc_id") % 10 == v, n) for v, n in DUAL_PINS.items()])
    doc = part.select("doc_id", pins.cast("int").alias("pin_count"), F.lit(False).alias("has_exposed_pad"), F.lit(False).alias("reflow_and_wave"))
    return fx.load(spark, sf_dir, fx.variants([(v, o, s, r, L, e, n, h, k) for v, o, s, r, e, n, h, k in DUALS], 10)), doc


def r6_dual_topology(spark, sf_dir):
    return U.dual_topology(*_dual(spark, sf_dir)).select("doc_id", "status", "reason", "separation_axis", "left_count", "right_count")


def r7_dual_center(spark, sf_dir):
    return U.rel_dual(*_dual(spark, sf_dir)).select("doc_id", "status", "formula", "center_x", "relation_score")


# ---- R2, R3
C_W, C_H = "左焊盘中心线 -> 右焊盘中心线", "上侧焊盘中心线 -> 下侧焊盘中心线"
SPAN_W = "左焊盘左边缘 -> 右焊盘右边缘"
THREE = [
    (0, 0, "", "pad_width", PAD_W, "", 60, 0), (0, 1, "", "pad_height", PAD_H, "", 80, 0), (0, 2, "", "pitch", C_W, "", 190, 1), (0, 3, "", "pad_center_distance", C_H, "", 200, 1),
    (1, 0, "", "pad_width", PAD_W, "", 60, 0), (1, 1, "", "pad_height", PAD_H, "", 80, 0), (1, 2, "", "pad_gap", "左焊盘右缘 -> 右焊盘左缘", "", 190, 1), (1, 3, "", "pad_center_distance", C_H, "", 200, 1),  # a gap is no pitch
    (2, 0, "", "other", PAD_W, "", 60, 0), (2, 1, "", "pad_height", PAD_H, "", 80, 0), (2, 2, "", "other", C_W, "", 190, 1), (2, 3, "", "pad_center_distance", C_H, "", 50, 0),  # the center is below the pad
]
ASYM = [
    *[(v, o, "", r, b, e, "", h, k) for v, p in ((0, 95), (1, 40), (2, 0)) for o, r, b, e, h, k in (
        (0, "pad_width", L, PAD_W, 60, 0), (1, "tab_width", L, "大焊盘左缘 -> 大焊盘右缘", 120, 0), (2, "pad_height", L, PAD_H, 50, 0), (3, "tab_height", L, "大焊盘上缘 -> 大焊盘下缘", 260, 0),
        (4, "overall_span", L, SPAN_W, 400, 1), (5, "half_pitch", L, "上侧中心线 -> 下侧", 95, 0), (6, "pitch", P, "端子 -> 端子", 2 * p, 0)) if h],
]


def r2_two_row(spark, sf_dir):
    d = fx.load(spark, sf_dir, fx.variants([(v, o, s, r, L, e, n, h, k) for v, o, s, r, e, n, h, k in THREE], 3))
    return R.rel_three(d).select("doc_id", "formula", "pad_x", "pad_y", "center_x", "pitch_y", "role_score")


def r3_asym(spark, sf_dir):
    d = fx.load(spark, sf_dir, fx.variants(ASYM, 3))
    return R.rel_asym(d, D.pitch_refs(d)).select("doc_id", "formula", "pad_x", "pad_y", "tab_x", "tab_y", "center_x", "pitch_y", "role_score")


# ---- N8, N9: (variant, place, line, max h, min h, unit)
BOUNDS = [
    (0, 0, 10, 310, 290, "mm"), (0, 1, 12, 175, 145, "mm"),
    (1, 0, 10, 310, 290, "in"), (1, 1, 10, 311, 291, "mm"), (1, 2, 10, 312, 292, "mm"),  # the metric one takes the first one's place; the third is near to it
    (2, 0, 10, 310, 290, "mm"), (2, 1, 10, 312, 292, "mm"), (2, 2, 10, 314, 294, "mm"),  # near to the second only, which is gone: it stays
    (3, 0, 10, 310, 290, "mm"), (3, 1, 11, 290, 270, "mm"), (3, 2, 12, 270, 250, "mm"),  # a chain of bounds
]
KEPT = [(0, 10, 0, 310, 290, "mm"), (0, 12, 0, 175, 145, "mm"), (1, 10, 0, 311, 291, "mm"), (2, 10, 0, 310, 290, "mm"), (2, 10, 1, 314, 294, "mm"), (3, 10, 0, 310, 290, "mm"), (3, 11, 0, 290, 270, "mm"), (3, 12, 0, 270, 250, "mm")]
# role, partition, h
FOLDS = [
    (0, 0, "body_length", P, 310), (0, 1, "body_length", P, 290), (0, 2, "body_width", P, 175), (0, 3, "body_height", P, 145), (0, 4, "pitch", P, 50), (0, 5, "pad_width", L, 310), (0, 6, "pad_width", L, 290),
    (1, 0, "body_length", P, 311), (1, 1, "body_length", P, 291), (1, 2, "body_length", P, 311), (1, 3, "body_length", P, 291),  # the second pair of the same bound stays
    (2, 0, "body_length", P, 310), (2, 1, "other", L, 290), (2, 2, "body_length", P, 290),  # no neighbours in one partition
    (3, 0, "body_length", P, 310), (3, 1, "body_length", P, 290), (3, 2, "body_width", P, 270), (3, 3, "body_width", P, 250),  # the middle bound finds its rows used
]
FOLDED = [
    (0, 0, "body_length", P, 310, True), (0, 2, "other", P, 175, True), (0, 4, "pitch", P, 50, False), (0, 5, "pad_width", L, 310, True),
    (1, 0, "body_length", P, 311, True), (1, 2, "body_length", P, 311, False), (1, 3, "body_length", P, 291, False),
    (2, 0, "body_length", P, 310, False), (2, 1, "other", L, 290, False), (2, 2, "body_length", P, 290, False),
    (3, 0, "body_length", P, 310, True), (3, 2, "body_width", P, 270, True),
]


def _bounds(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"))
    t = spark.sql(f"select * from {fx.values(BOUNDS, ('v', 'pos', 'line', 'hi', 'lo', 'source_unit'))}")
    step = (F.col("doc_id") * 7) % 50
    mm = lambda c: ((F.col(c) + step) / 100.0)
    return part.join(F.broadcast(t), F.col("doc_id") % 4 == F.col("v")).select("doc_id", F.lit(1).alias("page"), "pos", F.col("line").alias("max_line"), (F.col("line") + 1).alias("min_line"), mm("hi").alias("max_mm"), mm("lo").alias("min_mm"), "source_unit")


def n8_dedup_bounds(spark, sf_dir):
    return N.dedup_bounds(_bounds(spark, sf_dir)).select("doc_id", "max_line", "place", F.round("max_mm", 6).alias("max_mm"), F.round("min_mm", 6).alias("min_mm"), "source_unit")


def n9_fold_bounds(spark, sf_dir):
    d = D.to_mm(fx.load(spark, sf_dir, fx.variants([(v, o, "", r, b, "", "", h, 1) for v, o, r, b, h in FOLDS], 4)))
    out = N.demote_pairs(N.fold_bounds(d, N.dedup_bounds(_bounds(spark, sf_dir))))
    return out.select("doc_id", "ord", "role", "belongs_to", F.round("value_mm", 6).alias("value_mm"), "folded")


# ---- R13: one solution a source; (variant, source, rank, family, formula, pad_x, pad_y, center h, pitch, tab)
SOLUTIONS = [
    (0, "relation", 1, "CHIP", "REL_DIRECT_CENTER_x", 100, 80, 300), (0, "role", 2, "CHIP", "role_direct", 100, 80, 300),
    (1, "relation", 1, "CHIP", "REL_DIRECT_CENTER_x", 100, 80, 300),
    (2, "relation", 1, "CHIP", "REL_DIRECT_CENTER_x", 100, 80, 300), (2, "role", 2, "CHIP", "role_direct", 110, 80, 300),
    (3, "relation", 1, "CHIP", "REL_DIRECT_CENTER_x", 100, 80, 320), (4, "relation", 1, "CHIP", "REL_DIRECT_CENTER_x", 100, 80, 300),
    (5, "quad", 1, "QUAD_EP", "REL_QUAD_EP_width_TWO_ROW_PARTIAL_CENTER", 60, 30, None),
    (6, "relation", 1, "CHIP", "REL_DIRECT_CENTER_x", 100, 80, 300),
]
GATE_ROWS = [(v, 0, "C", "pad_center_distance", L, "left pad centerline -> right pad centerline", "", 300, 1) for v in (0, 1, 2, 3, 4, 6)] + [
    (v, o, s, r, P, e, "", h, 1) for v, long in ((0, 500), (6, 250)) for o, s, r, e, h in ((1, "E", "body_length", WIDE, long), (2, "F", "body_width", TALL, 300))
]
# family, exposed pad, what R8 said
GATE_DOCS = [(0, "CHIP", False, None), (1, "CHIP", False, None), (2, "CHIP", False, None), (3, "CHIP", False, None), (4, "CHIP", True, None), (5, "QUAD_EP", True, "partial"), (6, "CHIP", False, None)]
# status, solutions, sources, center h, body_x h, body_y h
GATED = [
    (0, "auto_unique", 1, "relation,role", 300, 500, 300), (1, "auto_pads", 1, "relation", 300, None, None), (2, "manual_select", 2, None, None, None, None), (3, "manual_select", 0, None, None, None, None),
    (4, "reject_ep", 1, None, None, None, None), (5, "partial_auto", 1, "quad", None, None, None), (6, "auto_pads", 1, "relation", 300, None, None),
]


def r13_prefill(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"))
    table = lambda rows, cols: part.join(F.broadcast(spark.createDataFrame(rows, cols)), F.col("doc_id") % 7 == F.col("v")).drop("v")
    step = (F.col("doc_id") * 7) % 50
    s = table(SOLUTIONS, "v int, source string, rank int, family string, formula string, px int, py int, cx int")
    quad = F.col("family") == "QUAD_EP"
    s = s.select("doc_id", "source", "rank", "family", "formula", (F.col("px") / 100).alias("pad_x"), (F.col("py") / 100).alias("pad_y"), ((F.col("cx") + step) / 100).alias("center_x"), *[F.when(quad, x).alias(n) for n, x in (("pitch_y", 0.5), ("tab_x", 2.0), ("tab_y", 1.5))])
    doc = table(GATE_DOCS, "v int, family string, has_exposed_pad boolean, quad_status string").withColumn("paste_ambiguous", F.lit(False))
    out = G.prefill(doc, fx.load(spark, sf_dir, fx.variants(GATE_ROWS, 7)), s)
    return out.select("doc_id", "status", "solutions", "sources", *[F.round(c, 6).alias(c) for c in ("center_x", "body_x", "body_y")])


# ---- R14: drawings of other sections and three of their own
_PLAIN = lambda v, name, o, w, h: [(v, o, "", "pad_width", f"{name}左缘 -> {name}右缘", "", w, 0), (v, o + 1, "", "pad_height", f"{name}上缘 -> {name}下缘", "", h, 0)]
LADDER = [
    *[(0, *x[1:]) for x in QUAD if x[0] == 0], *[(1, *x[1:]) for x in QUAD if x[0] == 1], *[(2, *x[1:]) for x in DUALS if x[0] == 2], *[(3, *x[1:]) for x in DUALS if x[0] == 9],
    *_PLAIN(4, "左焊盘", 0, 60, 80), *_PLAIN(4, "右焊盘", 2, 60, 80),
    *_PLAIN(5, "左焊盘", 0, 60, 80), *_PLAIN(5, "右焊盘", 2, 60, 80), *_PLAIN(5, "上焊盘", 4, 61, 80),
    *_PLAIN(6, "左小焊盘", 0, 60, 80), *_PLAIN(6, "右小焊盘", 2, 60, 80), *_PLAIN(6, "上大焊盘", 4, 180, 160),
    *_PLAIN(7, "左焊盘", 0, 60, 80), *_PLAIN(7, "右焊盘", 2, 60, 80), *_PLAIN(7, "上焊盘", 4, 90, 80),  # three pads of two widths
    *_PLAIN(8, "左焊盘", 0, 60, 80), *_PLAIN(8, "右焊盘", 2, 60, 80),  # two pads, three pins
]
LADDER_PINS = {0: 8, 1: 8, 2: 8, 3: 4, 4: None, 5: 3, 6: 3, 7: 3, 8: 3}
FAMILIES = [(0, "auto", "QUAD_EP"), (1, "reject_ep", None), (2, "auto", "DUAL"), (3, "multi_family_conflict", None), (4, "auto", "SMX"), (5, "auto", "SOT3"), (6, "auto", "ASYM3"), (7, "insufficient", None), (8, "insufficient", None)]


def r14_decide_family(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"))
    which = F.col("doc_id") % 9
    pins = F.coalesce(*[F.when(which == v, n) for v, n in LADDER_PINS.items() if n])
    doc = part.select("doc_id", pins.cast("int").alias("pin_count"), (which < 2).alias("has_exposed_pad"), F.lit(False).alias("reflow_and_wave"))
    d = fx.load(spark, sf_dir, fx.variants([(v, o, s, r, L, e, n, h, k) for v, o, s, r, e, n, h, k in LADDER], 9))
    return G.decide_family(doc, d, Q.quad_topology(d, doc), U.dual_topology(d, doc), R.rel_inline(d, doc), R.rel_grid(d, doc)).select("doc_id", "status", "family")


# ---- C4 on crowded buckets
def c4_crowded_slots(spark, sf_dir):
    """Three samples with three rows of one value: the ends decide which belong together."""
    pads = ("left pad left edge -> left pad right edge", "right pad left edge -> right pad right edge", "top pad left edge -> top pad right edge")
    rows = [(s, o, pads[(o + s) % 3]) for s in range(3) for o in range(3) if (s, o) != (2, 0)]
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"))
    d = part.join(F.broadcast(spark.createDataFrame(rows, "sample_idx int, ord int, endpoints string")))
    d = d.select("doc_id", "sample_idx", "ord", F.lit("1.00").alias("value"), F.lit("mm").alias("unit"), F.lit("pad_width").alias("role"), F.lit(L).alias("belongs_to"), "endpoints")
    return C.align_slots(d).groupBy("doc_id", "slot").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("endpoints").alias("ends"))


QUERIES = [
    d7_marks, d11_pad_count, d17_outer_max, d18_planar_pair, d19_body_axes, r8_exposed_pad, r6_dual_topology, r7_dual_center, r2_two_row, r3_asym, n8_dedup_bounds, n9_fold_bounds, r13_prefill, r14_decide_family, c4_crowded_slots,
]

_MM = lambda h, k="1": f"round(cast({h} + {k} * m as double) / 100, 6)"
_FIX = lambda h: f"round(cast({h} as double) / 100, 6)"
ORACLES = {
    "d7_marks": "select doc_id, relation_axis, opposing_axis, dual_axis, center_marked, overall_marked, gap_marked, pad_kind from " + fx.expected([(v, *x) for v, _, *x in MARKS], ("relation_axis", "opposing_axis", "dual_axis", "center_marked", "overall_marked", "gap_marked", "pad_kind"), len(MARKS)),
    "d11_pad_count": "select doc_id, cast(pads as bigint) as pads from " + fx.expected(PAD_COUNTS, ("pads",), 6),
    "d17_outer_max": f"select doc_id, role, cast(n as bigint) as n, status, {_MM('cast(h as int)')} as value_mm, reason from " + fx.expected(OUTER, ("role", "n", "status", "reason", "h"), 11),
    "d18_planar_pair": f"select doc_id, status, cast(groups as bigint) as groups, {_MM('cast(w as int)')} as width_mm, {_MM('cast(h as int)')} as height_mm from " + fx.expected(PAIRS, ("status", "groups", "w", "h"), 11),
    "d19_body_axes": f"select doc_id, field, status, {_MM('cast(h as int)')} as value_mm, source_axis, reason from " + fx.expected(BODIES, ("field", "status", "source_axis", "reason", "h", "k"), 11),
    "r8_exposed_pad": f"select doc_id, status, reason, form, formula, {_FIX('px')} as pad_x, {_FIX('py')} as pad_y, {_MM('cast(c as int)')} as center_x, {_FIX('p')} as pitch_y, {_MM('cast(tx as int)')} as tab_x, {_MM('cast(ty as int)')} as tab_y, cast(side as int) as side_count, cast(ends as int) as end_count from "
    + fx.expected(QUADS, ("status", "reason", "form", "formula", "px", "py", "c", "p", "tx", "ty", "side", "ends"), 8),
    "r6_dual_topology": "select doc_id, status, reason, axis as separation_axis, cast(l as int) as left_count, cast(r as int) as right_count from " + fx.expected(TOPOLOGY, ("status", "reason", "axis", "l", "r"), 10),
    "r7_dual_center": f"select doc_id, status, formula, {_MM('cast(h as int)')} as center_x, cast(score as int) as relation_score from " + fx.expected(CENTERS, ("status", "formula", "h", "k", "score"), 10),
    "r2_two_row": f"select doc_id, 'REL_SOT3_TWO_AXES' as formula, 0.8::double as pad_x, 0.6::double as pad_y, {_MM(200)} as center_x, {_MM(190)} as pitch_y, 8 as role_score from (select p_partkey as doc_id, (p_partkey * 7) % 50 as m from part where p_partkey % 3 = 0)",
    "r3_asym": f"select doc_id, 'REL_ASYM3_width_half_pitch_x2' as formula, 0.6::double as pad_x, 0.5::double as pad_y, 1.2::double as tab_x, 2.6::double as tab_y, {_MM(310)} as center_x, 1.9::double as pitch_y, 12 as role_score from (select p_partkey as doc_id, (p_partkey * 7) % 50 as m from part where p_partkey % 3 = 0)",
    "n8_dedup_bounds": f"select doc_id, line as max_line, place, {_MM('hi')} as max_mm, {_MM('lo')} as min_mm, source_unit from " + fx.expected(KEPT, ("line", "place", "hi", "lo", "source_unit"), 4),
    "n9_fold_bounds": f"select doc_id, ord, role, belongs_to, {_MM('h')} as value_mm, folded from " + fx.expected(FOLDED, ("ord", "role", "belongs_to", "h", "folded"), 4),
    "r13_prefill": f"select doc_id, status, cast(n as bigint) as solutions, sources, {_MM('cast(c as int)')} as center_x, {_MM('cast(x as int)')} as body_x, {_MM('cast(y as int)')} as body_y from " + fx.expected(GATED, ("status", "n", "sources", "c", "x", "y"), 7),
    "r14_decide_family": "select doc_id, status, family from " + fx.expected(FAMILIES, ("status", "family"), 9),
    "c4_crowded_slots": "select p_partkey as doc_id, '1.00|mm|' || s as slot, cast(case when s = 2 then 2 else 3 end as bigint) as rows, cast(1 as bigint) as ends from part cross join (values (0), (1), (2)) t(s)",
}
