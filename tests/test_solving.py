"""Assignment, scans, sinks and streams by hand and by exhaustive search; drawings are covered by their SQL."""

import itertools
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.operators import body as B
from sheetloom.operators import consensus as C
from sheetloom.operators import dimensions as D
from sheetloom.operators import dual as U
from sheetloom.operators import gate as G
from sheetloom.operators import marks as M
from sheetloom.operators import notation as N
from sheetloom.operators import pads as P
from sheetloom.operators import pages as T
from sheetloom.operators import quad as Q
from sheetloom.sources import intake as S
from sheetloom.streaming import streams as Z

DIM = "doc_id long, ord int, symbol string, role string, belongs_to string, endpoints string, unit string, value string, raw string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def exhaustive(worth):
    n, m = worth.shape
    best = None
    for opt in itertools.product([*range(m), None], repeat=n):
        used = [c for c in opt if c is not None]
        if len(used) == len(set(used)) and all(c is None or worth[r, c] >= 0 for r, c in enumerate(opt)):
            key = (-len(used), -sum(int(worth[r, c]) for r, c in enumerate(opt) if c is not None), tuple(m + 1 if c is None else c for c in opt))
            best = min(best or (key, opt), (key, opt), key=lambda x: x[0])
    return list(best[1])


def test_assignment_equals_exhaustive_search():
    rng = random.Random(4)
    for _ in range(800):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        worth = np.array([[rng.choice([-1, 0, 1, 1, 2, 5]) for _ in range(m)] for _ in range(n)])
        assert C.assign(worth) == exhaustive(worth)
    assert C.assign(np.zeros((0, 3), int)) == [] and C.assign(np.zeros((2, 0), int)) == [None, None]


def test_two_hundred_equal_rows_take_no_second():
    began = time.time()
    assert C.assign(np.full((200, 200), 110_000)) == list(range(200))
    assert time.time() - began < 1.5  # a second by itself, with room for a busy machine


def test_slots_keep_partitions_apart(spark):
    d = [(1, s, o, "1.0", "mm", "pad_width", b, e) for s, o, b, e in ((0, 0, "solder_land", "a"), (0, 1, "solder_paste", "b"), (1, 0, "solder_paste", "a"), (1, 1, "solder_land", "b"), (2, 0, "other", "a"), (2, 1, "package_outline", "a"))]
    df = spark.createDataFrame(d, "doc_id long, sample_idx int, ord int, value string, unit string, role string, belongs_to string, endpoints string")
    got = {(r.sample_idx, r.ord): r.slot[-1] for r in C.align_slots(df).collect()}
    assert got[0, 0] == got[1, 1] and got[0, 1] == got[1, 0] and got[2, 0] == got[0, 0] and got[2, 1] not in (got[0, 0], got[0, 1])
    with pytest.raises(ValueError, match="solder_land and solder_paste"):
        C._partition_of(["solder_paste", "", "solder_land"])


def test_the_representative_row_has_the_voted_role(spark):
    d = [(1, 0, 0, "1.0", "mm", "pad_width", "solder_land", "x -> y"), (1, 1, 0, "1.0", "mm", "pad_width", "solder_land", "left pad -> right pad"), (1, 2, 0, "1.0", "mm", "pitch", "solder_land", "left pad -> right pads")]
    df = spark.createDataFrame(d, "doc_id long, sample_idx int, ord int, value string, unit string, role string, belongs_to string, endpoints string")
    # Samples 0 and 1 agree on the role, so only they may stand; all ends differ, and the second is nearest to the rest.
    third = df.unionByName(df.limit(1).withColumns({"doc_id": F.lit(1).cast("long"), "ord": F.lit(5), "value": F.lit("9.0")}))
    assert rows(C.representative_row(C.align_slots(third)).where("slot like '1.00%'"), "sample_idx", "endpoints") == [(1, "left pad -> right pad")]


def test_bounds_depend_on_their_order(spark):
    cols = "doc_id long, page int, pos int, max_line int, min_line int, max_mm double, min_mm double, source_unit string"
    b = [(1, 1, 0, 5, 6, 3.10, 2.90, "in"), (1, 1, 1, 5, 6, 3.13, 2.93, "mm"), (1, 1, 2, 5, 6, 3.115, 2.915, "mm"), (2, 1, 0, 5, 6, 3.10, None, "mm"), (2, 1, 1, 5, 6, 3.10, None, "mm")]
    got = N.dedup_bounds(spark.createDataFrame(b, cols))
    # The third is near to both kept ones and takes the place of the first, which is not metric.
    assert rows(got.where("doc_id = 1"), "place", "max_mm") == [(0, 3.115), (1, 3.13)]
    assert got.where("doc_id = 2").count() == 2 and N.dedup_bounds(spark.createDataFrame([], cols)).isEmpty()


def test_folds_leave_derived_rows_and_used_rows(spark):
    dim = [(1, 0, P_, r, v, d) for P_, r, v, d in ()] + [(1, o, "package_outline", "body_length", v, d) for o, v, d in ((0, 3.1, True), (1, 2.9, False), (2, 3.1, False), (3, 2.9, False))]
    d = spark.createDataFrame(dim, "doc_id long, ord int, belongs_to string, role string, value_mm double, is_derived boolean")
    b = spark.createDataFrame([(1, 1, 7, 3.1, 2.9)], "doc_id long, page int, max_line int, max_mm double, min_mm double")
    assert rows(N.fold_bounds(d, b), "ord", "value_mm", "folded") == [(0, 3.1, False), (1, 2.9, False), (2, 3.1, True)]


def test_package_codes_with_escapes_and_paths(spark):
    js = json.dumps({"a": {"package_code": 'a"b\\c'}, "list": [[{"package_code": " a\"B\\C "}], {"package_tokens": ["", 'A"b\\C']}]})
    r = spark.createDataFrame([(1, js), (2, None), (3, "no json"), (4, '{"package_code": ["x"], "x": {"package_code": "q"}}'), (5, '{"package_tokens": ["a", "b"]}')], "doc_id long, json string")
    assert rows(P.package_code_paths(r).where("doc_id = 1"), "path", "package_code") == [("a.package_code", 'A"B\\C'), ("list[0][0].package_code", 'A"B\\C'), ("list[1].package_tokens[1]", 'A"B\\C')]
    assert rows(P.package_codes(r), "doc_id", "status", "path") == [(1, "unique", "a.package_code"), (2, "none", None), (3, "none", None), (4, "unique", "x.package_code"), (5, "ambiguous", None)]


def test_marks_are_looked_for_in_the_normal_form(spark):
    d = spark.createDataFrame([(1, "other", "other", "ＳＯＬＤＥＲ ＰＡＳＴＥ", "")], "doc_id long, belongs_to string, role string, symbol string, raw string")
    assert d.select(D.pattern_role(d)).first()[0] == "paste"
    page = spark.createDataFrame([(1, 1, "solder land and ＳＴＥＮＣＩＬ, re-flow or 波峰"), (1, 2, "回流 wave"), (1, 3, None)], "doc_id long, page int, text string")
    assert rows(T.comention(page), "page", "land_and_paste", "reflow_and_wave") == [(1, True, True), (2, False, True), (3, False, False)]
    t = spark.createDataFrame([(1, 0, "x", "", "ＰｏｗｅｒＰＡＤ edge"), (1, 1, "x", "", "散热片"), (1, 2, "x", "", "pad")], "doc_id long, ord int, role string, raw string, endpoints string")
    assert rows(T.thermal_evidence(t), "ord") == [(0,), (1,)]


def test_new_operators_take_null_and_missing_rows(spark):
    d = spark.createDataFrame([(1, 0, None, None, None, None, None, None, None), (2, 0, "E", "body_length", "package_outline", None, "mm", "1.0", None)], DIM)
    doc = spark.createDataFrame([(1, None, True, True, None, False), (2, 8, True, False, "auto", None), (3, 5, None, None, None, None)], "doc_id long, pin_count int, has_exposed_pad boolean, reflow_and_wave boolean, quad_status string, paste_ambiguous boolean")
    assert rows(Q.quad_topology(d, doc), "doc_id", "status", "reason") == [(1, "insufficient", "no_exposed_pad_size"), (2, "insufficient", "no_exposed_pad_size"), (3, "not_applicable", "no_evidence")]
    assert {r.status for r in U.dual_topology(d, doc).collect()} == {"not_applicable"} and U.rel_dual(d, doc).isEmpty()
    sol = spark.createDataFrame([(1, "CHIP", None), (2, "CHIP", "A+B"), (3, None, None)], "doc_id long, family string, formula string")
    got = {(r.doc_id, r.field): r.reason for r in B.assign_body(d, sol).collect()}
    assert got == {(1, "body_x"): "planar_pair_none", (1, "body_y"): "planar_pair_none", (2, "body_x"): "axis_not_proven", (2, "body_y"): "no_candidate", (3, "body_x"): "planar_pair_none", (3, "body_y"): "planar_pair_none"}
    none = spark.createDataFrame([], "doc_id long, source string, rank int, family string, formula string, pad_x double, pad_y double, center_x double")
    assert rows(G.prefill(doc.withColumn("family", F.lit("CHIP")), d, none), "doc_id", "status") == [(1, "reject_ep"), (2, "reject_ep"), (3, "manual_select")]
    assert M.pad_count(d).isEmpty() and M.marked(d).where("relation_axis is not null").isEmpty()


RECORD = "document_index long, status string, note string"


def test_results_are_written_once_however_often_a_run_dies(spark, tmp_path, monkeypatch):
    r = spark.createDataFrame([(i, "pending_model" if i % 3 == 0 else "ok", "Bearer abc") for i in range(50)] + [(None, "ok", None)], RECORD)
    path, commit = str(tmp_path / "out"), S._commit
    monkeypatch.setattr(S, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    for _ in range(2):
        with pytest.raises(RuntimeError):
            S.write_results(r, path, "r1")
    assert S.committed(spark, path) is None
    monkeypatch.setattr(S, "_commit", commit)
    folder = S.write_results(r, path, "r1")
    assert S.write_results(r.limit(3), path, "r1") == folder == S.committed(spark, path, "r1")
    lines = [json.loads(x) for f in sorted((tmp_path / "out" / folder.rsplit("/", 1)[1] / "results").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x.get("document_index") for x in lines] == [None, *range(50)] and {x.get("note") for x in lines} == {"Bearer [REDACTED]", None}
    assert spark.read.json(f"{folder}/queue").count() == 17 and rows(spark.read.json(f"{folder}/summary"), "status", "records") == [("ok", 34), ("pending_model", 17)]
    later = S.write_results(r.limit(1), path, "r2")
    assert S.committed(spark, path) == later and spark.read.parquet(f"{folder}/by_status").count() == 51


def test_page_ranking_goes_on_after_a_restart_and_takes_late_pages(spark, tmp_path):
    texts = ["Recommended land pattern\nDimensions in mm", "see dimensions", "nothing", "Package outline dimensions", "Tape and reel", "land pattern dimensions"]
    page = spark.createDataFrame([(d, p + 1, texts[(d + p) % 6]) for d in range(4) for p in range(6)], "doc_id long, page int, text string")
    folder = str(tmp_path / "s")
    waves = (page.where("page % 2 = 0 and doc_id < 3"), page.where("page % 2 = 1 or doc_id = 3").unionByName(page.where("page = 2 and doc_id = 0")))
    for wave in waves:
        wave.write.mode("append").parquet(f"{folder}/in")
        Z.run_ranking(spark.readStream.schema(page.schema).parquet(f"{folder}/in"), folder).awaitTermination()
    Z.run_ranking(spark.readStream.schema(page.schema).parquet(f"{folder}/in"), folder).awaitTermination()  # nothing new
    cols = ("doc_id", "page", "score", "page_class", "rank")
    assert rows(Z.ranking(spark, folder), *cols) == rows(T.rank_pages(T.score_pages(page)), *cols)


def test_page_ranking_holds_blocks_of_documents(spark, tmp_path):
    texts = ["Recommended land pattern\nDimensions in mm", "see dimensions", "land pattern dimensions"]
    page = spark.createDataFrame([(d, p, texts[(d + p) % 3]) for d in range(-3, 300) for p in range(1, 6)], "doc_id long, page int, text string")
    folder = str(tmp_path / "s")
    for wave in (page.where("page > 2"), page.where("page <= 2")):
        wave.write.mode("append").parquet(f"{folder}/in")
        query = Z.run_ranking(spark.readStream.schema(page.schema).parquet(f"{folder}/in"), folder)
        query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
    cols = ("doc_id", "page", "score", "page_class", "rank")
    assert rows(Z.ranking(spark, folder), *cols) == rows(T.rank_pages(T.score_pages(page)), *cols)
