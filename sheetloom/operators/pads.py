"""Pads: layouts from parameters, boxes, signatures, differences and registry matches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import terms as K


def _pad(number: Column, x: Column, y: Column, w="pad_x", h="pad_y") -> Column:
    return F.struct(number.cast("string").alias("number"), x.cast("double").alias("at_x"), y.cast("double").alias("at_y"), F.col(w).cast("double").alias("size_x"), F.col(h).cast("double").alias("size_y"))


def _row(n: Column, pitch: str, start: Column, place, turn: int = 1, **size) -> Column:
    """``n`` pads along a row of pitch, numbered from ``start``; ``turn`` -1 walks it the other way."""
    at = lambda i: ((n - 1) / 2.0 - i) * F.col(pitch) * turn
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: _pad(start + i, *place(at(i)), **size))).otherwise(F.array().cast("array<struct<number:string,at_x:double,at_y:double,size_x:double,size_y:double>>"))


def expand_pads(geometry: DataFrame) -> DataFrame:
    """``(doc_id, family, number, at_x, at_y, size_x, size_y)`` of the eight layouts; counter-clockwise numbers."""
    c, n = F.col, F.lit
    h, p = c("center_x") / 2, c("pitch_y") / 2
    two = F.array(_pad(n(1), -h, n(0)), _pad(n(2), h, n(0)))
    sot = F.array(_pad(n(1), -h, p), _pad(n(2), -h, -p), _pad(n(3), h, n(0)))
    line = F.array(_pad(n(1), -c("center_x"), n(0)), _pad(n(2), n(0), n(0)), _pad(n(3), c("center_x"), n(0)))
    grid = F.array(_pad(n(1), -h, p), _pad(n(2), h, p), _pad(n(3), h, -p), _pad(n(4), -h, -p))
    free = F.array_except(F.array(n(1), n(2), n(3)), F.array(c("tab_pad_number").cast("int")))
    tab = _pad(c("tab_pad_number"), h, n(0), "tab_x", "tab_y")
    asym = F.when(c("small_pad_count") == 1, F.array(_pad(F.get(free, n(0)), -h, n(0)), tab)).otherwise(F.array(_pad(F.get(free, n(0)), -h, -p), _pad(F.get(free, n(1)), -h, p), tab))
    left, right = c("dual_left_count"), c("dual_right_count")
    dual = F.concat(_row(left, "pitch_y", n(1), lambda y: (-h, y)), _row(right, "pitch_y", left + 1, lambda y: (h, y), -1))
    ql, qb, qr, qt = (c(f"quad_{s}_count") for s in ("left", "bottom", "right", "top"))
    v = c("center_y") / 2
    quad = F.concat(
        _row(ql, "pitch_y", n(1), lambda y: (-h, y), -1), _row(qb, "pitch_x", ql + 1, lambda x: (x, v), -1, w="pad_y", h="pad_x"),
        _row(qr, "pitch_y", ql + qb + 1, lambda y: (h, y)), _row(qt, "pitch_x", ql + qb + qr + 1, lambda x: (x, -v), w="pad_y", h="pad_x"),
        F.array(_pad(n("EP"), n(0), n(0), "tab_x", "tab_y")),
    )
    f = c("family")
    pads = F.when(f == "SOT3", sot).when(f == "INLINE3", line).when(f == "GRID4", grid).when(f == "ASYM3", asym).when(f == "DUAL", dual).when(f == "QUAD_EP", quad).otherwise(two)
    return geometry.select("doc_id", "family", F.inline(pads))


def validate_geometry(geometry: DataFrame) -> DataFrame:
    """The rules that a geometry breaks."""
    c = F.col
    rules = {
        "positive": ~F.coalesce((c("pad_x") > 0) & (c("pad_y") > 0) & (c("center_x") > 0), F.lit(False)), "family": ~F.coalesce(c("family").isin(*K.FAMILIES), F.lit(False)),
        "overlap_x": F.coalesce(c("center_x") <= c("pad_x"), F.lit(False)), "overlap_y": F.coalesce(c("family").isin("SOT3", "GRID4", "DUAL", "QUAD_EP") & (c("pitch_y") <= c("pad_y")), F.lit(False)),
        "dual_counts": F.coalesce((c("family") == "DUAL") & ((c("dual_left_count") < 1) | (c("dual_left_count") + c("dual_right_count") > 48)), F.lit(False)),
        "quad_symmetry": F.coalesce((c("family") == "QUAD_EP") & ((c("quad_left_count") != c("quad_right_count")) | (c("quad_top_count") != c("quad_bottom_count"))), F.lit(False)),
    }
    reasons = F.filter(F.array(*[F.when(bad, F.lit(k)) for k, bad in rules.items()]), lambda x: x.isNotNull())
    return geometry.select("doc_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("valid"))


def bounds(pad: DataFrame, geometry: DataFrame, courtyard: float = 0.25) -> DataFrame:
    """Boxes of pads, of pads and body, and of the courtyard; a missing body is skipped."""
    e = lambda a, s, sign: F.col(a) + sign * F.col(s) / 2
    b = pad.groupBy("doc_id").agg(F.min(e("at_x", "size_x", -1)).alias("x0"), F.max(e("at_x", "size_x", 1)).alias("x1"), F.min(e("at_y", "size_y", -1)).alias("y0"), F.max(e("at_y", "size_y", 1)).alias("y1"))
    j = b.join(geometry.select("doc_id", F.when(F.col("body_x") > 0, F.col("body_x") / 2).alias("bx"), F.when(F.col("body_y") > 0, F.col("body_y") / 2).alias("by")), "doc_id")
    r = lambda c: F.round(c, 6)
    box = {"x0": F.least("x0", -F.col("bx")), "x1": F.greatest("x1", "bx"), "y0": F.least("y0", -F.col("by")), "y1": F.greatest("y1", "by")}
    return j.select("doc_id", *[r(v).alias(k) for k, v in box.items()], *[r(v + (courtyard if k[1] == "1" else -courtyard)).alias(f"court_{k}") for k, v in box.items()])


def visible_ranges(side: DataFrame, pad: DataFrame, clearance: float = 0.2, least: float = 0.25) -> DataFrame:
    """Parts of a body side that no pad covers: blocked intervals merged by a running maximum, gaps between them kept if long enough.

    ``side(doc_id, y, x0, x1)``.
    """
    hit = side.join(pad, "doc_id").where((F.col("at_y") - F.col("size_y") / 2 - clearance < F.col("y")) & (F.col("at_y") + F.col("size_y") / 2 + clearance > F.col("y")))
    blocked = hit.select("doc_id", "y", "x0", "x1", (F.col("at_x") - F.col("size_x") / 2 - clearance).alias("a"), (F.col("at_x") + F.col("size_x") / 2 + clearance).alias("b")).where("b > x0 and a < x1")
    ends = blocked.unionByName(side.select("doc_id", "y", "x0", "x1", F.col("x1").alias("a"), F.col("x1").alias("b")))
    w = W.partitionBy("doc_id", "y").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    gaps = ends.withColumn("from", F.greatest("x0", F.coalesce(F.max("b").over(w), F.col("x0")))).withColumn("to", F.least("a", "x1"))
    return gaps.where(F.col("to") - F.col("from") >= least - 1e-9).select("doc_id", "y", F.round("from", 6).alias("from_x"), F.round("to", 6).alias("to_x"))


def paste_size(geometry: DataFrame, ratio: float = 0.70) -> DataFrame:
    """P5: the thermal paste aperture: both axes by the square root of the area ratio."""
    s = F.sqrt(F.lit(ratio))
    return geometry.where("family = 'QUAD_EP'").select("doc_id", F.round(F.col("tab_x") * s, 6).alias("paste_x"), F.round(F.col("tab_y") * s, 6).alias("paste_y"))


# The fields of a pad that are compared, texts as they are and numbers within the tolerance.
PAD_TEXTS = ("number", "type", "shape", "layers", "extra_fields")
PAD_NUMBERS = ("at_x", "at_y", "rotation", "size_x", "size_y", "roundrect_rratio", "solder_mask_margin", "solder_paste_margin")
#: Canonical order of pads; other fields only break ties.
PAD_ORDER = ("number", "type", "shape", "layers", "at_x", "at_y", "size_x", "size_y")


def pad_lists(pad: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, pads)``: the pads of each key in canonical order, with all fields; a missing number is 0, a missing text stays null."""
    have = lambda c, t: (F.col(c) if c in pad.columns else F.lit(None)).cast(t)
    values = {c: have(c, "string") for c in PAD_TEXTS} | {c: F.round(F.coalesce(have(c, "double"), F.lit(0.0)), 9) for c in PAD_NUMBERS}
    fields = (*PAD_ORDER, *[c for c in values if c not in PAD_ORDER])
    return pad.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[values[c].alias(c) for c in fields]))).alias("pads"))


def pad_differences(a: Column, b: Column, tol: float = K.REGISTRY_TOL) -> Column:
    """Fields that differ between two pad lists, pad by pad up to the shorter one's end; unequal lengths count as one more."""
    def of(x: Column, y: Column) -> Column:
        texts = [(~x[c].eqNullSafe(y[c])).cast("int") for c in PAD_TEXTS]
        return sum(texts + [(F.abs(x[c] - y[c]) > tol + 1e-12).cast("int") for c in PAD_NUMBERS], F.lit(0))

    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), of)
    return F.aggregate(both, F.lit(0), lambda k, x: k + x) + (F.size(a) != F.size(b)).cast("int")


def geometry_signature(pad: DataFrame, places: int = 4) -> DataFrame:
    """Pads with number, type, shape and layers, numbers rounded half even, in canonical order, and the SHA-256 of that text."""
    f = lambda c: F.format_string(f"%.{places}f", F.bround(F.col(c), places) + 0.0)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PAD_TEXTS[:4] if c in pad.columns]
    text = F.concat_ws("/", *named, *map(f, ("at_x", "at_y", "size_x", "size_y")))
    g = pad.groupBy("doc_id", "family").agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias("signature"))
    return g.withColumn("digest", F.upper(F.sha2("signature", 256)))


def diff_pads(left: DataFrame, right: DataFrame, tol: float = K.REGISTRY_TOL) -> DataFrame:
    """``(pair_id, differences)``: pads paired by canonical ordinal, five texts and eight numbers compared, and counts.

    Both tables have ``pair_id`` and pad columns; a side without pads has an empty list.
    """
    none = F.array()
    a, b = (pad_lists(x, "pair_id").withColumnRenamed("pads", k) for x, k in ((left, "a"), (right, "b")))
    j = a.join(b, "pair_id", "full_outer").withColumns({k: F.coalesce(k, none.cast(a.schema["a"].dataType)) for k in ("a", "b")})
    return j.select("pair_id", pad_differences(F.col("a"), F.col("b"), tol).alias("differences"))


def match_registry(code: DataFrame, pad: DataFrame, entry: DataFrame, entry_pad: DataFrame) -> DataFrame:
    """``code(doc_id, package_code)`` against ``entry(entry_id, package_code)`` by exact upper-case code.

    One exact entry is a match, several are ambiguous; else the nearest by (differences, id) is shown; no code is incomplete.
    A document meets the entries of its own code only, with each side's pads as one list, so pads are shuffled once.
    """
    key = F.upper("package_code").alias("_key")
    own = code.select("doc_id", key).where("_key <> ''").join(pad_lists(pad, "doc_id"), "doc_id", "left")
    own = own.withColumn("pads", F.coalesce("pads", F.array().cast(own.schema["pads"].dataType)))  # a known code without pads differs from every entry
    known = entry.select("entry_id", key).join(pad_lists(entry_pad, "entry_id").withColumnRenamed("pads", "entry_pads"), "entry_id")
    scored = own.join(known, "_key").select("doc_id", "entry_id", pad_differences(F.col("pads"), F.col("entry_pads")).alias("differences"))
    g = scored.groupBy("doc_id").agg(F.count_if(F.col("differences") == 0).alias("exact"), F.min(F.struct("differences", "entry_id")).alias("n"))
    out = code.join(g, "doc_id", "left")
    status = F.when(F.coalesce("package_code", F.lit("")) == "", "incomplete").when(F.col("n").isNull(), "none").when(F.col("exact") == 1, "exact").when(F.col("exact") > 1, "ambiguous").otherwise("nearest")
    return out.select("doc_id", status.alias("status"), F.col("n.entry_id").alias("entry_id"), F.col("n.differences").alias("differences"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("code", T.StringType())])))
def _codes_in(text: pd.Series) -> pd.Series:
    """Every non-empty package token of a JSON text in upper case with its path, in the order of the text."""

    def walk(value, path: str, out: list) -> list:
        if isinstance(value, dict):
            for key, item in value.items():
                at = f"{path}.{key}" if path else str(key)
                if key == "package_code" and isinstance(item, str):
                    out.append((at, item))
                elif key == "package_tokens" and isinstance(item, list):
                    out += [(f"{at}[{i}]", t if isinstance(t, str) else json.dumps(t, ensure_ascii=False)) for i, t in enumerate(item)]
                walk(item, at, out)
        elif isinstance(value, list):
            for i, item in enumerate(value):
                walk(item, f"{path}[{i}]", out)
        return out

    def found(t: str | None) -> list[dict]:
        try:
            pairs = walk(json.loads(t), "", []) if t else []
        except (ValueError, RecursionError):
            pairs = []
        return [{"path": p, "code": c.strip().upper()} for p, c in pairs if c.strip()]

    return text.map(found)


def package_code_paths(record: DataFrame) -> DataFrame:
    """P10: ``record(doc_id, json)`` to one row for each package code or token at any depth: ``(doc_id, pos, path, package_code)``.

    Texts that are null or no JSON have none; escaped characters come out as they are meant.
    """
    return record.select("doc_id", F.posexplode(_codes_in(F.col("json").cast("string"))).alias("pos", "c")).select("doc_id", "pos", "c.path", F.col("c.code").alias("package_code"))


def package_codes(record: DataFrame) -> DataFrame:
    """P10: the distinct package codes of a document at any depth, through the gate, with the first path of the unique one."""
    g = package_code_paths(record).groupBy("doc_id").agg(F.count_distinct("package_code").alias("n"), F.min("package_code").alias("code"), F.min_by("path", "pos").alias("path"))
    out = record.select("doc_id").distinct().join(g, "doc_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("doc_id", F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("code")).alias("package_code"), F.when(n == 1, F.col("path")).alias("path"))


def compare_values(left: DataFrame, right: DataFrame, tol: float = K.PROVENANCE_TOL) -> DataFrame:
    """Fields of either side that differ: missing on one side, or beyond ``tol``."""
    j = left.select("doc_id", "field", F.col("value").alias("a")).join(right.select("doc_id", "field", F.col("value").alias("b")), ["doc_id", "field"], "full_outer")
    same = F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tol + 1e-12, F.lit(False))
    return j.where(~same).select("doc_id", "field", F.when(F.col("a").isNull(), "right_only").when(F.col("b").isNull(), "left_only").otherwise("differs").alias("kind"))


def unchanged(before: DataFrame, after: DataFrame, allowed: tuple[str, ...] = ("body_x", "body_y", "body_source")) -> DataFrame:
    """Rows that differ outside of the allowed columns, on either side; empty when the invariant holds."""
    cols = [c for c in before.columns if c not in allowed]
    return before.select(*cols).exceptAll(after.select(*cols)).unionByName(after.select(*cols).exceptAll(before.select(*cols)))
