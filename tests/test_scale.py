"""Work that must spread over tasks, and costly expressions that must be evaluated once."""

import re
import sys
import unicodedata

from pyspark.sql import functions as F

from sheetloom.functions import text as X
from sheetloom.operators import consensus as C
from sheetloom.operators import dimensions as D
from sheetloom.operators import dual as U
from sheetloom.operators import packages as M
from sheetloom.operators import pages as T
from sheetloom.operators import quad as Q
from sheetloom.operators import relations as R
from sheetloom.plans import fixtures as fx
from sheetloom.plans import notation

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_derived_rows_spread_over_tasks(spark):
    page = fx.load(spark, DIR, fx.PAGE)
    assert page.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    held = page.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(held) <= sum(held) / 4


def test_terms_normalise_a_text_once(spark):
    df = spark.createDataFrame([(1, 1, "Land  Pattern\nland pattern")], "doc_id int, page int, text string")
    got = T.term_counts(df, ("land pattern", "pattern", "pad"))
    assert plan(got).count("regexp_replace") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 1, "land pattern", 2), (1, 1, "pattern", 2)]


def test_suggestions_score_a_page_once(spark):
    rows = [(1, 1, "Recommended land pattern"), (1, 2, "nothing"), (2, 1, "x"), (2, 2, None), (2, 3, "y"), (3, 1, None)]
    got = T.suggest(spark.createDataFrame(rows, "doc_id int, page int, text string"))
    assert plan(got).count(" Window [") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 2, "ok", True, "1"), (2, 2, "ok", False, "1,2"), (3, 0, "pdf_parse_error", False, "1")]


def test_keys_of_a_line_read_it_once(spark):
    line = spark.createDataFrame([(1, 1, 1, "Case SOT-23 here")], "doc_id int, page int, line_no int, norm string")
    term = spark.createDataFrame([("SOT23",)], "term string")
    got = M.match_terms(line, term)
    assert plan(got).count("upper(norm") == 1
    assert [tuple(r) for r in got.select("line_no", "term", "offset").collect()] == [(1, "SOT23", 5)]


def test_terms_meet_lines_without_a_shuffle(spark):
    got = M.match_terms(notation._line(spark, DIR), notation._terms(spark))
    shown = got._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown


def test_short_endpoint_words_are_all_that_fit_ascii(spark):
    def long(text):
        text = text.strip().lower()
        for old, new in C.ENDPOINT_WORDS:
            text = text.replace(old, new)
        for pattern, new in C.ENDPOINT_PATTERNS:
            text = re.sub(pattern.removeprefix("(?U)"), new, text)
        return text

    texts = ["Solder Land left => solder pad -> [Tab]", "solder  pad->->x", "left edge → Solder Pad", "左侧端子焊盘外缘 至 solder land", "", "a,b;c: (d)/e\\f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(C.canonical_endpoints(F.col("t"))).collect()] == [long(t) for t in texts]
    assert {w for w, _ in C.ASCII_WORDS} == {"->", "=>", "solder land", "solder pad"}


def test_exposed_pads_read_their_rows_once(spark):
    dim = spark.createDataFrame([], "doc_id long, ord int, symbol string, role string, belongs_to string, endpoints string, unit string, value string, raw string")
    doc = spark.createDataFrame([], "doc_id long, pin_count int, has_exposed_pad boolean")
    shown = Q.quad_topology(dim, doc)._jdf.queryExecution().analyzed().toString()
    assert shown.count("Aggregate [doc_id") == 1


def test_stable_characters_need_no_normalisation(spark):
    stable = [c for c in map(chr, range(sys.maxunicode + 1)) if re.match(f"[{X.STABLE}]", c)]
    second = {unicodedata.normalize("NFD", chr(i))[-1] for i in range(sys.maxunicode + 1) if not 0xAC00 <= i < 0xD7A4 and len(unicodedata.normalize("NFD", chr(i))) > 1}
    assert len(stable) > 20_000 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in stable) and not second & set(stable)
    texts = ["左焊盘 → ±0.1×2", "ｌｅｆｔ→右", "e\u0301 左", "①", "", None, "\u3000x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.nfkc(F.col("t"))).collect()] == [t and unicodedata.normalize("NFKC", t) for t in texts]
    picked = df.select(F.col("t").rlike(f"[^{X.STABLE}]")).collect()
    assert [r[0] for r in picked] == [False, True, True, True, False, None, True]



def test_dual_rows_are_marked_once(spark):
    dim = spark.createDataFrame([], "doc_id long, ord int, symbol string, role string, belongs_to string, endpoints string, unit string, value string, raw string")
    doc = spark.createDataFrame([], "doc_id long, pin_count int, has_exposed_pad boolean, reflow_and_wave boolean")
    assert U.rel_dual(dim, doc)._jdf.queryExecution().analyzed().toString().count("Aggregate [doc_id") == 2


DIM = "doc_id long, sample_idx int, ord int, value string, unit string, role string, belongs_to string, endpoints string"


def test_aligned_slots_share_a_shuffle(spark):
    slot = C.align_slots(spark.createDataFrame([], DIM))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = C.vote(slot)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert shown.count("ArrowEvalPython") == 1 and "ReusedExchange" in shown


def test_statistics_align_each_input_once(spark):
    slot = C.align_slots(spark.createDataFrame([], DIM))
    assert plan(C.consensus_stats(slot, slot.where("sample_idx < 2"))).count("MapInPandas") == 2


def test_tasks_grow_with_rows(spark, monkeypatch):
    few = fx.table(spark, DIR, "part").rdd.getNumPartitions()
    n = spark.read.parquet(f"{DIR}/part.parquet").count()
    monkeypatch.setattr(fx, "ROWS", 2)
    assert few < n // 2 == fx.table(spark, DIR, "part").rdd.getNumPartitions()


def test_millimetres_are_made_once_a_row(spark):
    df = spark.createDataFrame([("1,5", "mm"), ("-1", "mm"), ("x", "mm"), (None, "mm"), ("1", "in")], "value string, unit string")
    got = D.to_mm(df).where("value_mm is not null").select("value_mm", (F.col("value_mm") * 2).alias("twice"))
    assert plan(got).count("decimal(20,6)") == 1
    assert [tuple(r) for r in got.collect()] == [(1.5, 3.0), (25.4, 50.8)]
    assert [r[0] for r in D.to_mm(df).select("value_mm").collect()] == [1.5, None, None, None, 25.4]


def test_roles_of_a_document_are_one_small_aggregate(spark):
    row = lambda doc, o, role, ends, v: (doc, 0, o, v, "mm", role, "solder_land", ends)
    width, height, center = "left pad left edge -> left pad right edge", "left pad top edge -> left pad bottom edge", "left pad centerline -> right pad centerline"
    rows = [row(1, 0, "pad_width", width, "0.5"), row(1, 1, "pad_width", width, "0.50"), row(1, 2, "pad_height", height, "0.6"), row(1, 3, "pad_center_distance", center, "2.0"), row(2, 0, "pad_width", width, "0.5"), row(2, 1, "pad_width", width, "0.7"), row(3, 0, "pad_width", width, "0.5")]
    got = R.role_direct(spark.createDataFrame(rows, DIM).withColumn("raw", F.col("value")))
    assert "Expand" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, "solved", 0.5, 0.6, 2.0, ""), (2, "conflict", None, None, None, "pad_x"), (3, "insufficient", 0.5, None, None, "")]
