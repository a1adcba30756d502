"""Parts with two rows of pads: the topology, and the distance between the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as K
from ..functions.text import any_of
from .dimensions import pattern_role, to_mm
from .marks import DUAL, DUAL_MORE, marked, pad_count, tolerance_only

PITCH = ("pitch", "pad_center_distance")
NUMBER = r"(?:pad|land|pin|焊盘|引脚)\s*#?\s*(\d+)"


def _rows(dimension: DataFrame, document: DataFrame) -> DataFrame:
    """Direct land rows with their marks, and ``row_axis`` between the two rows; four pins take only the plain names of rows."""
    texts = {c: F.lit("") for c in ("symbol", "raw") if c not in dimension.columns}
    d = to_mm(dimension.withColumns(texts)).where((F.col("belongs_to") == "solder_land") & F.col("value_mm").isNotNull())
    d = d.where(pattern_role(d) != "paste")
    if "is_derived" in dimension.columns:
        d = d.where(~F.coalesce("is_derived", F.lit(False)))
    m = marked(d.join(document.select("doc_id", "pin_count"), "doc_id"))
    m = m.where(~tolerance_only())
    return m.withColumns({"row_axis": F.when(F.coalesce(F.col("pin_count") == 4, F.lit(False)), F.col("dual_axis_four")).otherwise(F.col("dual_axis")), "axis": F.coalesce("relation_axis", "grid_axis")})


def _mean(condition: Column, tol: float = K.CONSISTENT) -> Column:
    """The mean of the rows that meet a condition when they agree, as an aggregate; null for none or a disagreement."""
    v = F.when(F.coalesce(condition, F.lit(False)), F.col("value_mm"))
    return F.when(F.max(v) - F.min(v) <= tol + 1e-9, F.avg(v))


def _numbers() -> Column:
    """Pad numbers that the ends of a row name, with the row of pads that each end names."""
    side = lambda end: F.coalesce(*[F.when(any_of(F.col(end), DUAL[s] + DUAL_MORE[s]), F.lit(s)) for s in DUAL])
    found = lambda end: F.transform(F.regexp_extract_all(F.coalesce(end, F.lit("")), F.lit(f"(?i){NUMBER}"), F.lit(1)), lambda n: F.struct(side(end).alias("side"), n.alias("number")))
    return F.filter(F.concat(found("_a"), found("_b")), lambda x: x["side"].isNotNull())


def _wide(dimension: DataFrame, document: DataFrame) -> DataFrame:
    """What ``dual_topology`` and ``rel_dual`` give and look at, by document: land rows are marked and brought together once."""
    rows = _rows(dimension, document)
    c = F.col
    shape = c("role").isin("pad_width", "pad_height")
    in_row = c("role").isin(*PITCH) & c("row_axis").isNull()
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    between = {"center": c("role").isin(*PITCH) & c("center_marked"), "gap": c("role").isin("pad_gap", "gap_between_pads") | c("gap_marked"), "outer": (c("role") == "overall_span") | c("overall_marked")}
    g = rows.withColumn("_named", _numbers()).groupBy("doc_id").agg(
        F.min("row_axis").alias("sep"), F.max("row_axis").alias("_sep2"), count(c("row_axis").isNotNull()).alias("_rows"), count(c("role").isin(*PITCH)).alias("_pitches"),
        *[count(shape & (c("axis") == a)).alias(f"_n_{a}") for a in ("width", "height")], *[_mean(shape & (c("axis") == a)).alias(f"_pad_{a}") for a in ("width", "height")],
        *[_mean(in_row & (c("axis").isNull() | (c("axis") == a))).alias(f"_pitch_{a}") for a in ("width", "height")],
        *[_mean((c("row_axis") == a) & cond).alias(f"_{n}_{a}") for n, cond in between.items() for a in ("width", "height")], F.collect_set("_named").alias("_named"),
    )
    named = lambda *s: F.size(F.array_distinct(F.transform(F.filter(F.flatten("_named"), lambda x: x["side"].isin(*s)), lambda x: x["number"])))
    g = g.withColumns({"first": named("left", "top"), "second": named("right", "bottom"), **{n: F.when(c("sep") == "width", c(f"_{n}_width")).otherwise(c(f"_{n}_height")) for n in between}})
    return _decided(document.join(g.drop("_named"), "doc_id", "left").join(pad_count(dimension), "doc_id", "left"))


def dual_topology(dimension: DataFrame, document: DataFrame) -> DataFrame:
    """``document(doc_id, pin_count, has_exposed_pad, reflow_and_wave)`` with the two rows of its lands, or why it has none.

    One axis between the rows, single pads of one size each way and longer across the rows, one pitch
    within a row wider than the pads, and n/2 pads a row or three and two: five pads of which the ends
    number four in one row are refused, as are more numbers in a row than it has pads. The first rule
    that fails gives the status: not_applicable, reject_ep, manual_required or insufficient. Four pads
    are ``multi_family_conflict``, since a grid of four has the same geometry; the rest are ``auto``.
    """
    return _wide(dimension, document).select(*TOPOLOGY)


TOPOLOGY = ("doc_id", "status", "reason", "separation_axis", "pad_x", "pad_y", "pitch_y", "left_count", "right_count")


def _decided(j: DataFrame) -> DataFrame:
    """``TOPOLOGY``, and the center, gap and outer span between the rows, of documents with what their rows say."""
    c = F.col
    wide = c("sep") == "width"
    along, across, pitch = (F.when(wide, c(a)).otherwise(c(b)) for a, b in (("_pad_width", "_pad_height"), ("_pad_height", "_pad_width"), ("_pitch_height", "_pitch_width")))
    n, known = c("pin_count"), c("pin_count").isNotNull()
    zero = lambda name: F.coalesce(name, F.lit(0))
    signal = ((~known | (n >= 4)) & (zero("_rows") > 0)) | (known & (n >= 4) & (zero("_n_width") > 0) & (zero("_n_height") > 0) & (zero("_pitches") > 0))
    first = F.when(n == 5, F.when(zero("second") == 3, 2).otherwise(3)).otherwise(F.floor(n / 2)).cast("int")
    second = (n - first).cast("int")
    no = lambda cond: F.coalesce(cond, F.lit(False))
    missing, uneven = (zero("_n_width") == 0) | (zero("_n_height") == 0), c("_pad_width").isNull() | c("_pad_height").isNull()
    rules = (
        (~signal, "not_applicable", "no_two_rows"), (no(c("has_exposed_pad")), "reject_ep", "exposed_pad"), (no(c("reflow_and_wave")), "manual_required", "reflow_and_wave"),
        (c("sep").isNull() | (c("sep") != c("_sep2")), "insufficient", "axis_not_unique"), (missing, "insufficient", "pad_size_missing"), (uneven, "manual_required", "pads_not_uniform"),
        (no(along <= across), "not_applicable", "pads_not_elongated"), (pitch.isNull() | no(pitch <= across), "insufficient", "pitch_open"), (~known | no(n < 4), "insufficient", "pin_count"),
        (no((n % 2 == 1) & (n != 5)), "manual_required", "row_counts"), (no((zero("first") > first) | (zero("second") > second)), "manual_required", "row_counts"),
        (c("pads").isNotNull() & ~c("pads").isin(1, 2) & no(c("pads") != n), "manual_required", "visible_pads_differ"),
    )
    status, reason = F.when(n == 4, "multi_family_conflict").otherwise("auto"), F.lit("")
    for bad, name, why in reversed(rules):
        status, reason = F.when(bad, name).otherwise(status), F.when(bad, why).otherwise(reason)
    j = j.withColumns({"status": status, "reason": reason})
    ok = c("status").isin("auto", "multi_family_conflict")
    r = lambda x: F.round(F.when(ok, x), 6)
    return j.select("doc_id", "status", "reason", F.when(ok, c("sep")).alias("separation_axis"), r(along).alias("pad_x"), r(across).alias("pad_y"), r(pitch).alias("pitch_y"), F.when(ok, first).alias("left_count"), F.when(ok, second).alias("right_count"), "center", "gap", "outer")


def rel_dual(dimension: DataFrame, document: DataFrame) -> DataFrame:
    """The distance between the rows of each document that ``dual_topology`` accepts.

    Inner gap and outer span must close within 0.05 and give their mean (score 10); a chain that
    doesn't close refuses the document, whatever else is known. Without both: a direct center (9), the
    gap and a pad (8), or the span less a pad (7). Values of one kind that disagree count as missing.
    """
    j = _wide(dimension, document).where("status in ('auto', 'multi_family_conflict')")
    c = F.col
    inner, outer = c("gap") + c("pad_x"), c("outer") - c("pad_x")
    both = inner.isNotNull() & outer.isNotNull()
    clash = both & (F.abs(inner - outer) > K.DUAL_CLOSURE + 1e-9)
    spare = F.when(outer > 0, outer)
    how = F.when(both, F.when(~clash, "CHAIN_INNER_OUTER")).when(c("center").isNotNull(), "DIRECT_CENTER").when(inner.isNotNull(), "INNER_PLUS_PAD").when(spare.isNotNull(), "OUTER_MINUS_PAD")
    value = F.when(both, (c("gap") + c("outer")) / 2).otherwise(F.coalesce("center", inner, spare))
    score = F.when(both, 10).when(c("center").isNotNull(), 9).when(inner.isNotNull(), 8).otherwise(7)
    ok = how.isNotNull()
    status = F.when(clash, "chain_conflict").when(~ok, "insufficient").otherwise("auto")
    return j.select(
        "doc_id", status.alias("status"), F.when(ok, F.concat_ws("_", F.lit("REL_DUAL"), "separation_axis", how)).alias("formula"), "pad_x", "pad_y", F.when(ok, F.round(value, 6)).alias("center_x"), "pitch_y",
        "left_count", "right_count", F.when(ok, score).cast("int").alias("relation_score"),
    )
