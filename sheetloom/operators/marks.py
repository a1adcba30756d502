"""What the two ends of a dimension name, as columns: axes, kinds of span, nodes, pads.

Every mark is looked for in the NFKC form of the ends, computed once a row. Axes are ``width`` and
``height``; a mark that both or neither of two readings would take is null, never a guess.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, nfkc, once

# Edges that span an axis, by side.
SPAN_EDGES = {
    "left": ("左缘", "左边", "左侧", "左端", "左外缘", "左侧外缘", "leftedge", "leftouteredge"),
    "right": ("右缘", "右边", "右侧", "右端", "右外缘", "右侧外缘", "rightedge", "rightouteredge"),
    "top": ("上缘", "上边", "上侧", "上端", "上表面", "顶面", "顶部", "上外缘", "上侧外缘", "topedge", "upperedge", "topouteredge", "upperouteredge", "topsurface"),
    "bottom": ("下缘", "下边", "下侧", "下端", "下表面", "底面", "底部", "下外缘", "下侧外缘", "bottomedge", "loweredge", "bottomouteredge", "lowerouteredge", "bottomsurface"),
}
# Outer edges and faces of planar drawings.
PLANAR_WIDTH = ("左外缘", "右外缘", "左侧外缘", "右侧外缘", "左端面", "右端面")
PLANAR_HEIGHT = ("上外缘", "下外缘", "上侧外缘", "下侧外缘", "上端面", "下端面")
# Words of one axis anywhere in the ends.
BROAD_HEIGHT = ("上边", "下边", "上缘", "下缘", "上方", "下方", "上排", "下排", "topedge", "bottomedge", "upper", "lower", "vertical", "纵向")
BROAD_WIDTH = ("左边", "右边", "左缘", "右缘", "左上", "右上", "左下", "右下", "leftedge", "rightedge", "horizontal", "横向")
SIDE_WIDTH = ("左侧", "右侧", "左端", "右端", "left", "right")
SIDE_HEIGHT = ("上侧", "下侧", "上端", "下端", "top", "bottom")
# Pads that an end names.
ENTITIES = {
    "tab": r"大焊盘|tab|largepad", "small": r"小焊盘|smallpad|terminalpad", "left": r"左(?:侧)?[^>]{0,12}焊盘|leftpad", "right": r"右(?:侧)?[^>]{0,12}焊盘|rightpad",
    "upper": r"上(?:方|侧)?[^>]{0,12}焊盘|upperpad", "lower": r"下(?:方|侧)?[^>]{0,12}焊盘|lowerpad",
}
# First and second ends of outer spans and of gaps.
OVERALL = ((("左边缘", "左外缘", "左缘", "leftedge"), ("右边缘", "右外缘", "右缘", "rightedge")), (("上边缘", "上外缘", "上缘", "topedge"), ("下边缘", "下外缘", "下缘", "bottomedge")))
GAP = ((("右边缘", "右内缘", "右缘", "rightedge"), ("左边缘", "左内缘", "左缘", "leftedge")), (("下边缘", "下内缘", "下缘", "bottomedge"), ("上边缘", "上内缘", "上缘", "topedge")))
# Centers, of which a center distance names two.
CENTERS = ("中心线", "中心点", "centerline", "centreline", "centerpoint", "centrepoint")
# Kinds of pads.
TAB_PADS = ("大焊盘", "散热焊盘", "散热片", "thermalpad", "heatsinkpad", "exposedpad", "largepad", "tab")
SMALL_PADS = ("小焊盘", "端子焊盘", "terminalpad", "smallpad")
# Opposing rows around an exposed pad.
OPPOSING = {
    "left": ("左侧", "左列", "左排", "最左", "leftrow", "leftcolumn", "leftside", "leftmost", "leftsmall"),
    "right": ("右侧", "右列", "右排", "最右", "rightrow", "rightcolumn", "rightside", "rightmost", "rightsmall"),
    "top": ("上排", "上方", "上侧", "顶部", "最上", "toprow", "upperrow", "topside", "upperside", "topmost", "topsmall"),
    "bottom": ("下排", "下方", "下侧", "底部", "最下", "bottomrow", "lowerrow", "bottomside", "lowerside", "bottommost", "bottomsmall"),
}
# Spans within one row or column.
SAME_LINE = {"width": ("同排", "同一排", "每排", "samerow", "eachrow"), "height": ("同列", "同一列", "每列", "samecolumn", "eachcolumn")}
# Columns and rows of a grid.
GRID = {
    "left": ("左列", "左排", "左侧", "leftcolumn", "leftrow", "left"), "right": ("右列", "右排", "右侧", "rightcolumn", "rightrow", "right"),
    "top": ("上排", "上侧", "上方", "upperrow", "toprow", "upper", "top"), "bottom": ("下排", "下侧", "下方", "lowerrow", "bottomrow", "lower", "bottom"),
}
# The two rows of a dual part, and further names where there are not just four pins.
DUAL = {"top": ("上排", "上方一排", "toprow", "upperrow"), "bottom": ("下排", "下方一排", "bottomrow", "lowerrow"), "left": ("左排", "左侧一排", "leftrow"), "right": ("右排", "右侧一排", "rightrow")}
DUAL_MORE = {
    "top": ("顶部小焊盘", "顶部端子焊盘", "topcolumn"), "bottom": ("底部小焊盘", "底部端子焊盘", "bottomcolumn"),
    "left": ("左列", "左侧小焊盘", "左侧端子焊盘", "leftcolumn"), "right": ("右列", "右侧小焊盘", "右侧端子焊盘", "rightcolumn"),
}
# Nodes of three pads in a line.
NODES = {"left": ("左侧", "左边", "左端", "left"), "middle": ("中间", "中央", "居中", "middle", "center", "centre"), "right": ("右侧", "右边", "右端", "right")}
# How an end names a pad, names that say no more than that, and names of groups of pads.
PAD_NAMES = (
    r"((?:(?:左上|右上|左下|右下|上方|下方|上排|下排|左侧|右侧|左排|右排|左|右|上|下|第\s*\d+\s*号|大|小|散热|热)\s*)*焊盘)",
    r"((?:(?:left|right|top|bottom|upper|lower|large|small|thermal|heat\s*sink)\s+)?(?:solder\s+land|solder\s+pad|land|pad|tab)(?:\s*#?\s*[a-z0-9]+)?)",
)
GENERIC_PADS = ("pad", "land", "solderland", "solderpad", "焊盘", "大焊盘", "小焊盘", "端子", "tab")
GROUP_PADS = ("上排焊盘", "下排焊盘", "左排焊盘", "右排焊盘", "rowpad")
PAD_SIZES = ("大焊盘", "小焊盘", "焊盘")
CHILDREN = {"上方": ("左上", "右上"), "下方": ("左下", "右下"), "左侧": ("左上", "左下"), "右侧": ("右上", "右下")}
# How often a dimension holds.
MULTIPLICITY = r"(?U)(?:\(|\b)(\d+)\s*[x×](?:\)|\b)|左右\s*(?:两处|各一处)|两(?:个|处)"
ARROWS = r"\s*(?:->|→|至|到)\s*"


def lowered(column: str) -> Column:
    return F.lower(nfkc(F.coalesce(F.col(column), F.lit(""))))


def endpoint_key(text: Column) -> Column:
    """The ends in one word: no white space, joiners or arrows."""
    return F.regexp_replace(text, r"(?U)[\s_\-:/()→]+", "")


def joined(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s_\-]+", "")


def _one(found: dict[str, Column]) -> Column:
    """The name of the one condition that holds; null for none or several."""
    n = reduce(lambda a, b: a + b, [c.cast("int") for c in found.values()])
    return F.when(n == 1, F.coalesce(*[F.when(c, F.lit(k)) for k, c in found.items()]))


def _facing(a: Column, b: Column) -> Column:
    """The axis between two opposite sides."""
    pair = F.concat_ws(" ", F.least(a, b), F.greatest(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(pair == "left right", "width").when(pair == "bottom top", "height"))


def parts(dimension: DataFrame) -> DataFrame:
    """``dimension`` with its texts in one pass: ends as a whole (``_text``, ``_key``) and each (``_a``, ``_b``; null unless there are two), symbol (``_name``) and raw text (``_raw``)."""
    texts = {n: lowered(c) if c in dimension.columns else F.lit("") for n, c in (("_text", "endpoints"), ("_name", "symbol"), ("_raw", "raw"))}
    d = once(dimension.withColumns(texts))
    ends = F.split(F.trim("_text"), ARROWS, 2)
    a, b = F.trim(F.get(ends, F.lit(0))), F.trim(F.get(ends, F.lit(1)))
    two = F.coalesce((a != "") & (b != ""), F.lit(False))
    return once(d.withColumns({"_key": endpoint_key(F.col("_text")), "_a": F.when(two, joined(a)), "_b": F.when(two, joined(b))}))


def span_axis() -> Column:
    """Both edges of one axis, and not of the other."""
    k = F.col("_key")
    pair = lambda x, y: F.contains(k, F.lit(x)) & F.contains(k, F.lit(y))
    side = {s: any_of(k, m) for s, m in SPAN_EDGES.items()}
    wide, tall = pair("left", "right"), pair("top", "bottom")
    across = (side["left"] | wide) & (side["right"] | wide)
    upright = (side["top"] | tall) & (side["bottom"] | tall)
    return F.when(across & ~upright, "width").when(upright & ~across, "height")


def either_axis(width: Column, height: Column) -> Column:
    return F.when(width & ~height, "width").when(height & ~width, "height")


def entities(end: str) -> dict[str, Column]:
    return {name: F.coalesce(F.col(end).rlike(p), F.lit(False)) for name, p in ENTITIES.items()}


def marked(dimension: DataFrame) -> DataFrame:
    """``dimension(endpoints, symbol, raw, ...)`` with its marks.

    ``span_axis``, ``planar_axis``, ``relation_axis``, ``opposing_axis``, ``grid_axis``, ``dual_axis``
    and ``dual_axis_four`` (narrower names, for four pins) are axes; ``center_marked``,
    ``overall_marked``, ``gap_marked`` and ``same_line`` say what is spanned; ``pad_kind`` is tab or
    small; ``inline_edge`` joins two nodes of a line; ``multiplicity`` is the largest count named.
    Ends that are null or empty have no marks. Columns that begin with ``_`` are the texts looked at,
    in lower case.
    """
    d = parts(dimension)
    k, a, b = F.col("_key"), F.col("_a"), F.col("_b")
    ea, eb = entities("_a"), entities("_b")
    cross = lambda x, y: (ea[x] & eb[y]) | (ea[y] & eb[x])
    by_pads = F.when(cross("left", "right"), "width").when(cross("upper", "lower"), "height")
    relation = F.coalesce(F.col("span_axis"), either_axis(any_of(k, BROAD_WIDTH), any_of(k, BROAD_HEIGHT)), by_pads, either_axis(any_of(k, SIDE_WIDTH), any_of(k, SIDE_HEIGHT)))
    some = lambda es: reduce(lambda x, y: x | y, es.values())
    differ = reduce(lambda x, y: x | y, [ea[n] != eb[n] for n in ENTITIES])
    distinct = some(ea) & some(eb) & differ
    spans = lambda pairs: F.coalesce(distinct & reduce(lambda x, y: x | y, [any_of(a, p) & any_of(b, q) for p, q in pairs]), F.lit(False))
    side = lambda end, marks: _one({s: F.coalesce(any_of(end, m), F.lit(False)) for s, m in marks.items()})
    facing = lambda marks: _facing(side(a, marks), side(b, marks))
    meets = lambda x, y: F.coalesce((any_of(a, GRID[x]) & any_of(b, GRID[y])) | (any_of(b, GRID[x]) & any_of(a, GRID[y])), F.lit(False))
    more = {s: DUAL[s] + DUAL_MORE[s] for s in DUAL}
    twice = reduce(lambda x, y: x | y, [F.regexp_count(k, F.lit(m)) >= 2 for m in CENTERS])
    tab, small = any_of(k, TAB_PADS), any_of(k, SMALL_PADS)
    na, nb = side(a, NODES), side(b, NODES)
    d = once(d.withColumns({"span_axis": span_axis(), "opposing_axis": facing(OPPOSING)}))
    return d.withColumns({
        "planar_axis": F.coalesce(F.col("span_axis"), either_axis(any_of(k, PLANAR_WIDTH), any_of(k, PLANAR_HEIGHT))), "relation_axis": relation,
        "grid_axis": either_axis(meets("left", "right"), meets("top", "bottom")), "dual_axis": facing(more), "dual_axis_four": facing(DUAL),
        "center_marked": twice, "overall_marked": spans(OVERALL), "gap_marked": spans(GAP),
        "same_line": F.coalesce(F.when(F.col("opposing_axis") == "width", any_of(joined(F.col("_text")), SAME_LINE["width"])).when(F.col("opposing_axis") == "height", any_of(joined(F.col("_text")), SAME_LINE["height"])), F.lit(False)),
        "pad_kind": F.when(tab & ~small, "tab").when(small & ~tab, "small"), "inline_edge": F.when(na != nb, F.concat_ws("-", F.least(na, nb), F.greatest(na, nb))),
        "multiplicity": multiplicity(F.concat_ws(" ", "_name", "_raw", "_text"), numbers_only=True),
    })


def tolerance_only() -> Column:
    """Whether a row of ``parts`` is a tolerance and no size of its own."""
    return F.trim("_raw").rlike(r"^(?:±|\+/-|\+-)") | F.trim("_name").rlike(r"^(?:±|\+/-|\+-)") | any_of(F.col("_text"), ("公差", "tolerance"))


def multiplicity(text: Column, numbers_only: bool = False) -> Column:
    """The largest count that a text names ("4x"); words for a pair count as two unless only numbers do."""
    found = F.transform(F.regexp_extract_all(text, F.lit(MULTIPLICITY), F.lit(1)), lambda n: F.coalesce(n.try_cast("int"), F.lit(None if numbers_only else 2).cast("int")))
    return F.array_max(found)


def pad_identities(dimension: DataFrame) -> DataFrame:
    """``(doc_id, identity, multiplicity)``: each pad that an end of a land row names, and the counts that rows name."""
    d = dimension.where(F.col("belongs_to") == "solder_land")
    if "is_derived" in d.columns:
        d = d.where(~F.coalesce("is_derived", F.lit(False)))
    d = once(d.withColumn("_text", lowered("endpoints")))
    count = multiplicity(F.concat_ws(" ", F.col("_text"), *[lowered(c) for c in ("raw",) if c in dimension.columns]))
    ends = F.explode_outer(F.split(F.trim("_text"), ARROWS)).alias("_end")
    names = [F.regexp_extract("_end", p, 1) for p in PAD_NAMES]
    rows = d.select("doc_id", count.alias("multiplicity"), ends)
    return rows.select("doc_id", "multiplicity", joined(F.coalesce(*[F.when(n != "", n) for n in names])).alias("identity"))


def pad_count(dimension: DataFrame) -> DataFrame:
    """``(doc_id, pads)``: the pads that land rows name, or the largest count that one of them names if that is more.

    Named rows and groups (``上排焊盘``), and sides of which two corners are named, are no pads of their
    own while single pads are named; plain words (``pad``) count only where nothing better is. Land rows
    that name nothing stand for one pad; documents without a land row are absent.
    """
    i = F.col("identity")
    g = pad_identities(dimension).groupBy("doc_id").agg(
        F.collect_set(F.when(~i.isin(*GENERIC_PADS), i)).alias("specific"), F.collect_set(F.when(i.isin(*GENERIC_PADS), i)).alias("generic"), F.max("multiplicity").alias("times"),
    )

    def is_group(x: Column) -> Column:
        size = F.coalesce(*[F.when(F.contains(x, F.lit(s)), F.lit(s)) for s in PAD_SIZES])
        corners = lambda pair: F.size(F.filter("specific", lambda y: (y != x) & F.contains(y, size) & any_of(y, pair))) >= 2
        side = F.coalesce(*[F.when(F.contains(x, F.lit(s)), corners(pair)) for s, pair in CHILDREN.items()])
        return any_of(x, GROUP_PADS) | F.coalesce(side & size.isNotNull(), F.lit(False))

    single = F.size(F.filter("specific", lambda x: ~is_group(x)))
    seen = F.when(single > 0, single).when(F.size("specific") > 0, F.size("specific")).otherwise(F.size("generic"))
    return g.select("doc_id", F.greatest(seen, F.coalesce("times", F.lit(1))).cast("long").alias("pads"))
