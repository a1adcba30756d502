"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints are 64-bit majority votes over the XXH64 of three-word shingles. For radius r the
positions 0..63 are labelled with vectors of r + 1 bits; for each of the 2^(r+1) - 1 nonzero
vectors v a mask keeps the positions whose label has an odd inner product with v. The labels of
any r differing positions leave a nonzero v orthogonal to them all, so every pair within the radius
agrees on at least one mask: no link can be missed.

Equal fingerprints are collapsed before the tables are built, buckets that hold more than
``block`` fingerprints are dealt out as pairs of salted blocks, and a block pair returns a spanning
forest of its links rather than the links, so output stays linear in the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Fingerprints of a bucket that one block holds; a task works on two blocks at a time.
BLOCK = 2048
#: Shingles whose bits are counted at once, which bounds memory on very long texts.
CHUNK = 65536


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks: one for each nonzero vector of radius + 1 bits."""
    n = 1 << (radius + 1)
    label = [1 + i % (n - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (label[i] & v).bit_count() % 2) for v in range(1, n)]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text; 0 for null and for texts without a word."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n, total = max(1, len(w) - shingle + 1), np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, CHUNK):
        h = np.array([digest(b" ".join(w[i : i + shingle]), seed) for i in range(lo, min(n, lo + CHUNK))], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInPandas(run, "doc_id long, fp long")


def _forest(fp: np.ndarray, side: np.ndarray, within: bool, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between the two blocks, or within the one block."""
    x = fp.view(np.uint64)
    left, right = (np.arange(len(x)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    root = list(range(len(x)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in left:
        near = right[np.bitwise_count(x[right] ^ x[i]) <= radius]
        for j in near:
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(fp[i]), int(fp[j])))
    return out


def links(reps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints whose closure is that of all links.

    ``reps`` has one row per distinct ``fp``.
    """
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for t, m in enumerate(masks(radius))]))
    keyed = reps.select("fp", table.alias("x")).select("x.t", "x.k", "fp")
    full = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # A row of block b goes to the pairs (i, b) for i < b, (b, b) and (b, j) for j > b.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    dealt = keyed.join(full, ["t", "k"]).withColumn("blocks", n).withColumn("own", own).select("t", "k", "fp", "own", F.explode(pairs).alias("p"))
    dealt = dealt.select("t", "k", "p.i", "p.j", "fp", F.when(F.col("own") == F.col("p.i"), 0).otherwise(1).alias("side"))
    parts = reps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    key = ["t", "k", "i", "j"]
    dealt = dealt.repartition(int(parts), *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            k = pdf[key].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            if not len(cuts):
                rest = pdf
                continue
            rest = pdf.iloc[cuts[-1] :]
            yield solve(pdf.iloc[: cuts[-1]], np.r_[0, cuts])
        if rest is not None and len(rest):
            k = rest[key].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            yield solve(rest, np.r_[0, cuts, len(rest)])

    def solve(pdf: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        fp, side, i, j = (pdf[c].to_numpy() for c in ("fp", "side", "i", "j"))
        out = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo == 2 and i[lo] == j[lo]:
                if ((int(fp[lo]) ^ int(fp[lo + 1])) & (1 << 64) - 1).bit_count() <= radius:
                    out.append((int(fp[lo]), int(fp[lo + 1])))
            elif hi - lo > 1:
                out += _forest(fp[lo:hi], side[lo:hi], i[lo] == j[lo], radius)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``radius`` bits; component_id is the
    smallest doc_id that links reach, the document itself included. Null and word-less texts have
    fingerprint zero and link like any other. A null doc_id stays a row; it never names a component
    unless no other id is in it, when component_id is null. Repeated rows stay repeated. An empty
    table gives an empty result. Other columns of ``docs`` are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = connected_components(links(reps.select("fp"), radius, block))
    named = reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    out = fps.join(by_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their group; rows without a doc_id stay."""
    kept = near_duplicates(docs, **options).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
