"""Whitening, token files and importance resampling against brute force, round trips and edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheetloom.llm import importance, queries, token_files, whitening

DIR = "/root/testdata/sf0.001"
EXTRA = "n long, part string, start string, row string, component string, whitened string, bucket string"


# ---- whitening


def brute_whitening(vectors, k=8):
    """Components by a dense eigensolver over whole-number rows; deviations by exact arithmetic."""
    ok = {i: v for i, v in vectors if v is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in ok.values()], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums).astype(float) / n
    values, u = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:k]
    return dict(zip(ok, [int((r * r).sum()) for r in n * x - sums])), y @ u[:, order] / np.sqrt(values[order]), values[order] / values.sum(), list(ok)


def test_op11_equals_a_dense_solver(spark):
    rows = pq.read_table(f"{DIR}/embeddings.parquet").to_pylist()
    deviation, white, share, ids = brute_whitening([(r["vec_id"], r["embedding"]) for r in rows])
    got = queries.op11_whitening(spark, DIR).toPandas().sort_values(["component", "vec_id"])
    assert len(got) == 8 * len(ids) and set(got.n) == {len(ids)} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    at = np.argsort(ids)
    for c, g in got.groupby("component"):
        mine, want = g.whitened.to_numpy(), white[at, c - 1]
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert np.abs(g.explained / share[c - 1] - 1).max() < 1e-9
        assert dict(zip(g.vec_id, g.deviation)) == deviation


def test_whitening_drops_invalid_rows_and_keeps_repeated_ones(spark):
    rng = np.random.default_rng(3)
    good = [(i // 2 if i < 10 else i, rng.standard_normal(6).tolist()) for i in range(60)]
    bad = [(100, None), (101, [None, *[1.0] * 5]), (102, [math.nan] * 6), (103, [math.inf, *[0.0] * 5]), (104, []), (105, [1.0, 2.0]), (None, good[0][1])]
    df = spark.createDataFrame([(i, v, 1, *"abcdef") for i, v in good + bad], "vec_id long, embedding array<double>, " + EXTRA)
    got = whitening.components(df.repartition(7)).toPandas()
    assert len(got) == 61 * 6 and got.vec_id.isna().sum() == 6 and set(got.n) == {61} and got.identity_error.max() < 1e-9
    assert (got[got.vec_id == 0].groupby("component").size() == 2).all()
    assert whitening.components(df.limit(0)).isEmpty()
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whitening.components(same).isEmpty()  # no variance, no component


def test_merged_factors_are_the_factor_of_all_rows():
    rng = np.random.default_rng(5)
    x = rng.integers(-500, 500, (701, 9)) + 100000
    whole = None
    for lo in range(0, len(x), 13):
        part = whitening.Factor.of(x[lo : lo + 13])
        whole = part if whole is None else whole.merge(part)
    y = x - x.mean(axis=0)
    assert whole.n == 701 and whole.sums == x.sum(axis=0).tolist() and np.allclose(whole.r.T @ whole.r, y.T @ y, rtol=1e-12, atol=1e-6)


@pytest.mark.parametrize("shape", [(1, 30), (2, 30), (40, 200), (12, 5)])
def test_directions_equal_a_dense_solver(shape):
    d, m = shape
    y = np.random.default_rng(d).standard_normal((m, d)) * np.logspace(0, -6, d)
    values, vectors, trace = whitening.directions(np.linalg.qr(y, mode="r"))
    u, s, vt = np.linalg.svd(y, full_matrices=False)
    k = min(8, d, m)
    assert len(values) == k and np.allclose(values, s[:k] ** 2, rtol=1e-11) and math.isclose(trace, (s**2).sum(), rel_tol=1e-12)
    assert np.allclose(np.abs((vectors * vt[:k].T).sum(axis=0)), 1, atol=1e-10)


def test_dqds_keeps_small_values_accurate_and_clusters_get_orthogonal_vectors():
    a, b = np.array([1.0, 1e-5, 1e-9, 3.0]), np.array([1e-3, 1e-7, 1e-10])
    got = whitening.dqds(a, b)
    want = [float(x) for x in np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2]
    assert np.allclose(got[:3], want[:3], rtol=1e-12)
    # The product of all squares is that of the diagonal, exactly; a dense solver loses the smallest.
    exact = math.prod(Fraction(x) ** 2 for x in a)
    assert abs(float(math.prod(map(Fraction, got)) / exact) - 1) < 1e-12
    y = np.vstack([np.eye(6), -np.eye(6)]) * 500
    values, vectors, _ = whitening.directions(np.linalg.qr(y, mode="r"))
    assert np.allclose(values, 500000) and np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-12)


# ---- token files


def brute_tokens(rows):
    t = Tokenizer.from_file(P.path(queries.WORDS))
    t.encode_special_tokens = True
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_op12_equals_whole_text_encoding(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()]
    got = queries.op12_token_files(spark, DIR).collect()
    assert sorted(tuple(r) for r in got) == [r[:4] for r in brute_tokens(rows)]


ODD = [
    None, "", "   ", "\n\t\r\x0b\x1c\x85 ", "á b́", "e ́x", "ΣΑΣ σας ΟΔΟΣ", "İstanbul ǅ ﬁ", "don't they'll 'S'T x'", "12 345 ٣٤", "漢字かな 가각 각", "naïve<|endoftext|> <|startoftext|>",
    "emoji 👩‍👩‍👧 ok", "word " * 20_000, "x" * 50_000, "a\x00b ﻿ c​", "same", "same",
]


def test_pieces_encode_as_whole_texts():
    t = Tokenizer.from_file(P.path(queries.WORDS))
    t.encode_special_tokens = True
    encoder = token_files.Encoder(P.path(queries.WORDS))
    for text in ODD:
        want = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text or ""), "<u4").tolist() == want, text[:40]


def test_files_give_back_ids_in_order_and_by_document(spark, tmp_path):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(ODD)]
    rows[-1] = (16, "same")
    docs = spark.createDataFrame([(*r, 1, *"abcdef") for r in rows], "doc_id long, text string, " + EXTRA).repartition(5)
    folder = str(tmp_path / "tokens")
    token_files.write(docs, folder, P.path(queries.WORDS), block_bytes=200)
    want = brute_tokens(rows)
    got = token_files.read(spark, folder).collect()
    key = lambda r: (r[1],)
    assert [(r.doc_id, r.start, r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in sorted(got, key=key)] == [(*w[:3], w[4]) for w in want]
    entries = token_files.index(spark, folder)
    assert sorted((r.start, r.n_tokens) for r in entries.collect()) == [w[1:3] for w in want] and entries.select("part", "block").distinct().count() > 2
    only = token_files.read(spark, folder, only=spark.createDataFrame([(7,), (16,), (7,), (999,)], "doc_id long")).collect()
    assert sorted((r.start, bytes(r.ids)) for r in only) == sorted((r.start, bytes(r.ids)) for r in got if r.doc_id in (7, 16)) and len(only) == 3
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "frames" not in plan  # the index never reads a frame


def test_a_frame_needs_its_own_dictionary(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * 5) for i in range(300)], "doc_id long, text string")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    token_files.write(docs, a, P.path(queries.WORDS))
    token_files.write(docs.where("doc_id < 3"), b, P.path(queries.WORDS))
    other = spark.read.parquet(f"{b}/dictionary").first()
    spark.createDataFrame([tuple(other)], "sha256 string, dictionary binary").write.mode("overwrite").parquet(f"{a}/dictionary")
    with pytest.raises(Exception, match="needs the dictionary"):
        token_files.read(spark, a).count()
    empty = str(tmp_path / "empty")
    token_files.write(docs.limit(0), empty, P.path(queries.WORDS))
    assert token_files.read(spark, empty).isEmpty()


def test_the_shared_dictionary_makes_short_frames_smaller(spark, tmp_path):
    import zstandard

    folder = str(tmp_path / "t")
    token_files.write(spark.read.parquet(f"{DIR}/documents.parquet"), folder, P.path(queries.WORDS))
    plain = zstandard.ZstdCompressor(level=token_files.LEVEL)
    short = [r for r in token_files.read(spark, folder).where("n_tokens < 100").collect()]
    frames = {}
    for r in spark.read.parquet(f"{folder}/blocks").collect():
        frames |= {i: r.offsets[k + 1] - r.offsets[k] for k, i in enumerate(r.doc_ids)}
    assert sum(frames[r.doc_id] for r in short) < 0.8 * sum(len(plain.compress(bytes(r.ids))) for r in short)


# ---- importance


def brute_resample(docs, target, percent=25, least=20):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def grams(text):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    raw, want, rows = Counter(), Counter(), []
    for text in target:
        want.update(map(bucket, grams(text)[1]))
    for i, text in docs:
        w, f = grams(text)
        raw.update(found := [bucket(x) for x in f])
        rows.append((i, len(w), found))
    s, t = sum(raw.values()), sum(want.values())
    gain = [math.floor(1000 * math.log(((want[b] + 1) * (s + 10000)) / ((raw[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for i, n, found in rows:
        weight = sum(gain[b] for b in found) // max(1, len(found))
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in out]


def test_op13_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()]
    target = [r["text"] for r in pq.read_table(f"{DIR}/benchmark.parquet").to_pylist()]
    got = queries.op13_importance(spark, DIR)
    assert dict(got.dtypes) == dict.fromkeys(got.columns, "bigint")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_resample(docs, target)))


def test_resampling_of_odd_rows(spark):
    texts = [None, "", "...", "One two", "ÄÖ ä b x-y", "w" * 300 + " " + "v" * 5000 + " a", *[" ".join(f"t{(i * j) % 7}" for j in range(25)) for i in range(40)]]
    rows = [(i if i != 12 else None, t) for i, t in enumerate(texts)] + [(20, texts[20])] * 30
    docs = spark.createDataFrame([(*r, 1, *"abcdef") for r in rows], "doc_id long, text string, " + EXTRA).repartition(6)
    target = spark.createDataFrame([("t1 t2 t3",), (None,)], "text string")
    got = importance.resample(docs, target).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_resample(rows, ["t1 t2 t3", None])))
    assert importance.resample(docs.limit(0), target).isEmpty()
    assert importance.resample(docs, target.limit(0)).count() == len(rows)


@pytest.mark.parametrize("grams", [1, 2, 4])
def test_crcs_of_runs_come_from_two_running_values(monkeypatch, grams):
    monkeypatch.setattr(importance, "CHUNK", 7)
    words = importance.words_of("Ab c " + "d" * 63 + " " + "e" * 64 + " " + "f" * 70_000 + " g h ij klm 12 éa ß Z z y x w")
    got = Counter(np.concatenate(list(importance.crcs(words, grams))).tolist())
    assert got == Counter(zlib.crc32(b" ".join(words[i : i + g])) for g in range(1, grams + 1) for i in range(len(words) - g + 1))
