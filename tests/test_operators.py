"""Hand-made rows for operators that SQL doesn't cover, and edge cases."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.functions.text import gate, lines_of, normalize
from sheetloom.operators import consensus as C
from sheetloom.operators import dimensions as D
from sheetloom.operators import notation as N
from sheetloom.operators import packages as M
from sheetloom.operators import pads as P
from sheetloom.operators import pages as T
from sheetloom.operators import review as V
from sheetloom.sources import intake as S
from sheetloom.streaming import streams as Z


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_lines_follow_splitlines(spark):
    texts = ["a\nb", "a\r\nb\r", "", "a\x0bb\x0cc\x1cd\x85e f", "x\n\ny\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: list(r[1]) for r in df.select("i", lines_of(F.col("t"))).collect()}
    assert got == {i: (t or "").splitlines() for i, t in enumerate(texts)}


def test_normal_forms(spark):
    df = spark.createDataFrame([("Ａ b_１  c",), (None,)], "t string")
    got = df.select(normalize(F.col("t"), "lower"), normalize(F.col("t"), "nfkc"), normalize(F.col("t"), "token"), normalize(F.col("t"), "key")).collect()
    assert tuple(got[0]) == ("ａ b_１ c", "A b_1 c", "AB1C", "ab1c") and tuple(got[1]) == ("", "", "", "")


def test_gate_keeps_ambiguity(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "k int, c string")
    assert rows(gate(df, ["k"], "c"), "k", "status", "value") == [(1, "unique", "a"), (2, "ambiguous", None), (3, "none", None)]


def test_page_score_and_veto(spark):
    page = spark.createDataFrame([(1, 1, "Recommended land pattern\nDimensions in mm"), (1, 2, "Tape and reel\n" + "word " * 30), (1, 3, None), (2, 1, "see the pcb layout")], "doc_id long, page int, text string")
    got = {(r.doc_id, r.page): r for r in T.score_pages(page).collect()}
    assert got[1, 1].page_class == "land" and got[1, 1].score > 30
    assert got[1, 2].vetoed and got[1, 2].score == 0
    assert (got[1, 3].score, got[1, 3].page_class) == (0, "none")
    assert got[2, 1].page_class == "none" and got[2, 1].score == 14 and list(got[2, 1].ambiguous_land_terms) == ["pcb layout"]


def test_dedup_keeps_first_path(spark):
    docs = spark.createDataFrame([(1, "/B.pdf", "X"), (2, "/a.pdf", "X"), (3, "/c.pdf", "Y"), (4, "/d.pdf", None), (5, "/e.pdf", None)], "doc_id long, path string, content_sha256 string")
    assert rows(S.dedup_exact(docs), "doc_id", "kept") == [(1, False), (2, True), (3, True), (4, True), (5, True)]


def test_scan_and_ledger(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(b"1")
    (tmp_path / "y.pdf").write_bytes(b"1")
    (tmp_path / "z.txt").write_bytes(b"1")
    assert S.scan_corpus(spark, str(tmp_path)).count() == 2
    (tmp_path / "l.json").write_text('{"documents":[{"canonical_path":" ","pdf_path":"p","sha256":"ab","tier":"A"},{"pdf_path":"q","sha256":"AB"},{"pdf_path":"r"},{"sha256":"cd"}]}')
    ok, bad = S.load_ledger(spark, str(tmp_path / "l.json"))
    assert rows(ok, "path", "content_sha256") == [("p", "AB")] and rows(bad, "reason") == [("missing_digest",), ("missing_path",)]


def test_redaction_reaches_nested_leaves(spark):
    df = spark.sql("select struct('Bearer abc' as a, array('sk-1234567890abcdef') as b) as s, map('k', 'Bearer x') as m, 1 as n")
    r = S.redact(df).first()
    assert r.s.a == "Bearer [REDACTED]" and r.s.b == ["[REDACTED_KEY]"] and r.m == {"k": "Bearer [REDACTED]"} and r.n == 1


def test_samples_load_bare_and_wrapped(spark):
    one = '{"dimensions":[{"symbol":"A","value":"1","unit":"mm","raw":"1 mm","role":"pitch","belongs_to":"other","endpoints":"","is_derived":false}],"pin_count":2}'
    raw = spark.createDataFrame([(1, 0, one), (1, 1, '{"transcription":' + one + "}"), (1, 2, "no json")], "doc_id long, sample_idx int, json string")
    assert rows(S.load_samples(raw), "sample_idx", "value", "pin_count") == [(0, "1", 2), (1, "1", 2)]


def test_slot_assignment_is_exact():
    assert C.assign(np.array([[5, 4], [5, -1]])) == [1, 0]


def test_hard_buckets_align(spark):
    dim = spark.createDataFrame([(1, 0, 0, "1.0", "mm", "pad_width", "solder_land", "left -> right"), (1, 0, 1, "1.00", "mm", "other", "package_outline", "top -> bottom"), (1, 1, 0, "1", "mm", "other", "package_outline", "top -> bottom"), (1, 1, 1, "1", "mm", "pad_width", "solder_land", "left -> right")], "doc_id long, sample_idx int, ord int, value string, unit string, role string, belongs_to string, endpoints string")
    slots = C.align_slots(dim)
    got = {(r.sample_idx, r.role): r.slot for r in slots.collect()}
    assert got[0, "pad_width"] == got[1, "pad_width"] != got[0, "other"] == got[1, "other"]
    assert rows(C.vote(slots), "role", "belongs_to", "present") == [("other", "package_outline", 2), ("pad_width", "solder_land", 2)]


def test_notation_claims(spark):
    text = "1.60 ± 0.10\n2.0 + 0.1\n- 0.2\n3.0\nMAX\n4.0 TYP\n5.08 (0.2)\n(0.1)\n2x 0.5\n\n6.0"
    page = spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")
    got = [(r.line_no, r.category, r.value) for r in N.classify_lines(T.explode_lines(page)).orderBy("line_no").collect()]
    assert got == [(1, "nominal_pm", 1.6), (2, "nominal_pm", 2.0), (3, None, None), (4, "qualifier", 3.0), (5, None, None), (6, "qualifier", 4.0), (7, "bare", 5.08), (8, "paren", None), (9, "excluded", None), (10, None, None), (11, "bare", 6.0)]


def test_runs_pair_by_ordinal_and_are_used_up(spark):
    page = spark.createDataFrame([(1, 1, "9\n5.08\n2.54\n(0.2)\n(0.1)\n7\n8")], "doc_id long, page int, text string")
    got = rows(N.pair_values(N.classify_lines(T.explode_lines(page))), "mode", "outer_line", "paren_line", "direction")
    assert got == [("grouped_by_ordinal", 2, 4, "outer_mm_paren_in"), ("grouped_by_ordinal", 3, 5, "outer_mm_paren_in"), ("interleaved", 3, 4, None)]


def test_terms_match_any_separator(spark):
    line = spark.createDataFrame([(1, 1, 1, "in SOT 23 case"), (1, 1, 2, "XSOT-23"), (1, 1, 3, "sot_23-x")], "doc_id long, page int, line_no int, norm string")
    term = spark.createDataFrame([("SOT-23", "SOT23", "", "declarative_package_label")], "term string, normalized_key string, alias_group_id string, evidence_class string")
    assert rows(M.match_terms(line, term), "line_no", "offset") == [(1, 3), (3, 0)]


def test_pad_layouts(spark):
    base = "1L as doc_id, '{}' as family, 0.5D as pad_x, 0.4D as pad_y, 2D as center_x, 3D as center_y, 0.6D as pitch_x, 1D as pitch_y, 1.5D as tab_x, 1.2D as tab_y, 3 as tab_pad_number, 2 as small_pad_count, 3 as dual_left_count, 2 as dual_right_count, 2 as quad_left_count, 2 as quad_right_count, 0 as quad_top_count, 0 as quad_bottom_count"
    at = lambda f: [(r.number, r.at_x, r.at_y) for r in P.expand_pads(spark.sql("select " + base.format(f))).collect()]
    assert at("SOT3") == [("1", -1, 0.5), ("2", -1, -0.5), ("3", 1, 0)]
    assert at("ASYM3") == [("1", -1, -0.5), ("2", -1, 0.5), ("3", 1, 0)]
    assert at("DUAL") == [("1", -1, 1), ("2", -1, 0), ("3", -1, -1), ("4", 1, -0.5), ("5", 1, 0.5)]
    assert at("QUAD_EP") == [("1", -1, -0.5), ("2", -1, 0.5), ("3", 1, 0.5), ("4", 1, -0.5), ("EP", 0, 0)]


def test_pads_differ_in_any_field(spark):
    cols = "pair_id int, number string, type string, shape string, layers string, extra_fields string, at_x double, at_y double, rotation double, size_x double, size_y double, roundrect_rratio double, solder_mask_margin double, solder_paste_margin double"
    base = ("1", "smd", "rect", "F.Cu", None, 1.0, 2.0, None, 0.5, 0.6, None, None, 0.1)
    with_ = lambda k, v: tuple(v if i == k else x for i, x in enumerate(base))
    right = [with_(k, "zz" if k < 5 else (base[k] or 0.0) + 0.002) for k in range(13)] + [with_(5, 1.0005), with_(7, 0.0)]
    left = [(i, *base) for i in range(len(right))] + [(50, *base), (51, *base), (51, *with_(0, "2"))]
    other = [(i, *r) for i, r in enumerate(right)] + [(51, *base), (52, *base)]
    got = dict(rows(P.diff_pads(spark.createDataFrame(left, cols), spark.createDataFrame(other, cols)), "pair_id", "differences"))
    assert got == {**{i: 1 for i in range(13)}, 13: 0, 14: 0, 50: 1, 51: 1, 52: 1}


def test_registry_match_by_code_and_pads(spark):
    code = spark.createDataFrame([(1, "a"), (2, "A"), (3, ""), (4, "c"), (5, "b"), (6, None)], "doc_id int, package_code string")
    pad = spark.createDataFrame([(d, "1", 0.0, 0.0, w, 1.0) for d, w in ((1, 1.0), (2, 2.5), (3, 1.0), (4, 1.0), (5, 1.0), (6, 1.0))], "doc_id int, number string, at_x double, at_y double, size_x double, size_y double")
    entry = spark.createDataFrame([("e1", "A"), ("e2", "a"), ("e3", "B"), ("e4", "B")], "entry_id string, package_code string")
    entry_pad = spark.createDataFrame([("e1", "1", 0.0, 0.0, 1.0005, 1.0), ("e2", "1", 0.0, 0.0, 2.0, 1.0), ("e3", "1", 0.0, 0.0, 1.0, 1.0), ("e4", "1", 0.0, 0.0, 1.0, 1.0)], "entry_id string, number string, at_x double, at_y double, size_x double, size_y double")
    got = rows(P.match_registry(code, pad, entry, entry_pad), "doc_id", "status", "entry_id", "differences")
    assert sorted(got) == [(1, "exact", "e1", 0), (2, "nearest", "e1", 1), (3, "incomplete", None, None), (4, "none", None, None), (5, "ambiguous", "e3", 0), (6, "incomplete", None, None)]


def test_hash_chain(spark):
    e = spark.sql("select 't' as txn_id, 1 as sequence, 'a' as event_type, timestamp'2024-01-01' as at, '' as previous_event_sha256, '{}' as details")
    e = e.withColumn("event_sha256", V.event_digest())
    assert V.verify_chain(e).first().ok
    assert not V.verify_chain(e.withColumn("details", F.lit("x"))).first().ok


def test_stream_dedup_and_states(spark, tmp_path):
    schema = "record_id string, timestamp timestamp, event_id long, action string"
    batch = spark.createDataFrame([("a", datetime(2024, 1, 2), 2, "x"), ("a", datetime(2024, 1, 1), 1, "y"), ("b", datetime(2024, 1, 1), 3, "z")], schema)
    batch.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "s"))
    q = Z.review_state(stream).writeStream.format("memory").queryName("zz").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("zz"), "record_id", "action", "events") == [("a", "x", 2), ("b", "z", 1)]
    q = Z.intake_dedup(stream.withColumnRenamed("record_id", "content_sha256"), time_col="timestamp").writeStream.format("memory").queryName("zd").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("zd").count() == 2


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_partition_count_changes_nothing(spark, parts):
    page = spark.createDataFrame([(d, p, "Package outline\n3.10\n2.90\n1.75\n1.45\nDimensions in mm") for d in range(5) for p in (1, 2)], "doc_id long, page int, text string").repartition(parts)
    got = rows(N.extract_bounds(page, T.explode_lines(page)), "doc_id", "page", "max_line", "max_mm", "min_mm")
    assert got == sorted((d, p, n, a, b) for d in range(5) for p in (1, 2) for n, a, b in ((2, 3.1, 2.9), (4, 1.75, 1.45)))


def test_anchors_stand_alone_among_digits(spark):
    page = spark.createDataFrame([(1, 1, "1.27mm, 2.5 and x0.5y; 3.0. 4-0.1 12.75"), (1, 2, "0.5")], "doc_id long, page int, text string")
    dim = spark.createDataFrame([(1, i, v) for i, v in enumerate(["1.27", "1", "2.5", "0.5", "3.0", "-0.1", "0.1", "2.75"])], "doc_id long, ord int, value string")
    got = {r.value: r.pages for r in N.anchor(dim, page).collect()}
    assert got == {"1.27": 1, "1": 0, "2.5": 1, "0.5": 2, "3.0": 0, "-0.1": 1, "0.1": 1, "2.75": 0}


def test_decimals_that_the_page_extends(spark):
    page = spark.createDataFrame([(1, 1, "0.65 1,275 3.10mm 2.501 2.509 7"), (1, 2, "4.5 4.50 9.99")], "doc_id long, page int, text string")
    dim = spark.createDataFrame([(1, i, v) for i, v in enumerate(["0.6", "1.27", "3.1", "2.50", "7.0", "4.5", "8", "9.9"])], "doc_id long, ord int, value string")
    got = {r.ord: (r.page, r.token) for r in N.decimal_extension(dim, page).collect()}
    assert got == {0: (1, "0.65"), 1: (1, "1.275"), 3: (1, "2.501"), 7: (2, "9.99")}


def test_pattern_roles_and_page_marks(spark):
    rows = [("solder_paste", "x", "", ""), ("package_outline", "pad_width", "A", "left pad edge"), ("package_outline", "pad_width", "A", "Copper-Land width"), (None, "paste_width", "", ""), ("solder_land", "other", "", "stencil"), (None, "other", "c", "cream opening"), (None, "other", "", "")]
    dim = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, belongs_to string, role string, symbol string, raw string")
    got = [r.p for r in dim.orderBy("ord").select(D.pattern_role(dim).alias("p"), "ord").orderBy("ord").collect()]
    assert got == ["paste", "other", "lands", "paste", "lands", "paste", "unknown"]
    page = spark.createDataFrame([(1, 1, "Solder Land and paste opening"), (1, 2, "land pattern, solder paste"), (1, 3, "Reflow or wave"), (1, 4, None)], "doc_id long, page int, text string")
    flags = {r.page: (r.land_and_paste, r.reflow_and_wave) for r in T.comention(page).where("page < 4").collect()}
    assert flags == {1: (True, False), 2: (False, False), 3: (False, True)}


def test_exposed_pad_evidence(spark):
    page = spark.createDataFrame([(1, 1, "an E-Pad, see thermal pad"), (2, 1, "pad"), (3, 1, ""), (4, 1, "")], "doc_id long, page int, text string")
    dim = spark.createDataFrame([(2, 1, "Thermal Pad (width)", "solder_land", "b"), (3, 2, "tab_width", "solder_land", "x2"), (4, 1, "tab_width", "package_outline", "x2")], "doc_id long, ord int, role string, belongs_to string, symbol string")
    got = {r.doc_id: r.reason for r in T.ep_evidence(page, dim).collect()}
    assert got == {1: "page:thermal pad", 2: "dimension:thermal_pad_width", 3: "dimension:X2 optional center pad", 4: "none"}


def test_rows_without_partition_go_to_explicit_slots():
    import pandas as pd

    rows = [(0, 0, "lands", "a"), (0, 1, "", "a"), (1, 0, "", "a")]
    pdf = pd.DataFrame(rows, columns=["sample_idx", "ord", "partition", "canon"]).assign(doc_id=7, value_key="1", unit_key="mm")
    (got,) = C._align_all(iter([pdf]))
    assert got["slot"].tolist() == ["1|mm|0", "1|mm|1", "1|mm|0"]
    # Buckets come out the same however batches cut them.
    many = pd.concat([pdf.assign(doc_id=i) for i in range(4)], ignore_index=True)
    parts = [many.iloc[a:b] for a, b in ((0, 1), (1, 5), (5, 5), (5, 8), (8, 12))]
    assert pd.concat(C._align_all(iter(parts)))["slot"].tolist() == got["slot"].tolist() * 4


def test_outline_pitches_and_their_range(spark):
    rows = [("pitch", "package_outline", "left -> right", "0.95"), ("half_pitch", "package_outline", "", "0.65"), ("pad_center_distance", "package_outline", "center terminal -> edge", "0.5"), ("body_length", "package_outline", "", "3"), ("pitch", "solder_land", "", "9")]
    dim = spark.createDataFrame([(1, i, *r, "mm") for i, r in enumerate(rows)], "doc_id long, ord int, role string, belongs_to string, endpoints string, value string, unit string")
    (row,) = D.pitch_refs(dim).collect()
    assert row.pitches == [0.95, 1.0, 1.3]
    many, one = F.array(F.lit(0.95), F.lit(1.3)), F.array(F.lit(1.0))
    got = spark.range(1).select(D.pitch_matches(F.lit(1.1), many), D.pitch_matches(F.lit(1.4), many), D.pitch_matches(F.lit(1.14), one), D.pitch_matches(F.lit(1.2), one)).first()
    assert list(got) == [True, False, True, False]
