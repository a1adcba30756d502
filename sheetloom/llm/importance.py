"""Resampling documents towards a target distribution by hashed n-gram importance.

A text is normalised to its words with one space between, and scanned once: the running CRC-32 is
kept at the start and the end of every word. CRCs are linear over GF(2), so the CRC of any run of
words follows from the two running values at its ends: the earlier one is moved over the bytes of
the run, which is a fixed linear map for each length, and cancelled. No n-gram is ever built as a
string. What a document is needed for later are its buckets, two bytes a feature, which are
written once and read for the counts of all buckets and again for the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, ready, store
from .order import ROW_BITS, bases, dealt

GRAMS, BUCKETS = 2, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, "7"
#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
#: Lengths up to this have a map of their own; longer ones are put together from powers of two.
DIRECT = 64
#: Words that are worked on at once, which bounds memory on very long texts.
CHUNK = 1 << 18
#: Letters A-Z are lowered, ASCII letters and digits and all other bytes stay, the rest separates.
BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _by_bytes(columns: np.ndarray) -> np.ndarray:
    """The linear map whose image of bit i is ``columns[i]``, as one table of 256 for each byte."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            has = (np.arange(256) >> bit & 1).astype(bool)
            out[byte, has] ^= columns[8 * byte + bit]
    return out


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0, x & 255] ^ table[1, x >> 8 & 255] ^ table[2, x >> 16 & 255] ^ table[3, x >> 24]


class Shift:
    """Moves CRC-32 values over bytes: the map for each short length, and for each power of two."""

    _made: Shift | None = None

    @classmethod
    def of(cls) -> Shift:
        cls._made = cls._made or cls()
        return cls._made

    def __init__(self):
        one = [np.uint32(1 << i) for i in range(32)]
        for _ in range(8):  # a zero bit at a time
            one = [np.uint32((int(c) >> 1) ^ (POLYNOMIAL if c & 1 else 0)) for c in one]
        step = _by_bytes(np.array(one, np.uint32))
        columns = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
        direct = []
        for _ in range(DIRECT):
            direct.append(_by_bytes(columns))
            columns = _apply(step, columns)
        #: Indexed by length, then byte, then value.
        self.direct = np.stack(direct)
        self.powers = [step]
        for _ in range(31):
            t = self.powers[-1]
            self.powers.append(_by_bytes(_apply(t, _apply(t, (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)))))

    def over(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each CRC as it is after ``length`` further zero bytes, up to what those bytes add themselves."""
        n = np.minimum(length, DIRECT - 1)
        t = self.direct
        out = t[n, 0, crc & 255] ^ t[n, 1, crc >> 8 & 255] ^ t[n, 2, crc >> 16 & 255] ^ t[n, 3, crc >> 24]
        if len(far := np.flatnonzero(length >= DIRECT)):
            x, rest = crc[far], length[far].copy()
            for table in self.powers:
                if not rest.any():
                    break
                x = np.where(rest & 1, _apply(table, x), x)
                rest >>= 1
            out[far] = x
        return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


def crcs(words: list[bytes], grams: int = GRAMS) -> Iterator[np.ndarray]:
    """CRC-32 of every run of 1 to ``grams`` of the words, joined by one space; one array for each chunk and run length."""
    shift = Shift.of()
    for lo in range(0, len(words), CHUNK):
        own = words[lo : lo + CHUNK + grams - 1]
        at, starts, ends = 0, [], []
        for w in own:
            starts.append(at)
            at = crc32(w, at)
            ends.append(at)
            at = crc32(b" ", at)
        start, end = np.array(starts, np.uint32), np.array(ends, np.uint32)
        stop = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1  # where each word ends
        begin = np.r_[0, stop[:-1] + 1]
        for g in range(1, grams + 1):
            n = min(CHUNK, len(own) - g + 1)
            if n > 0:
                last = slice(g - 1, g - 1 + n)
                yield end[last] ^ shift.over(start[:n], stop[last] - begin[:n])


def features(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, buckets binary)`` of every row; buckets are little-endian unsigned shorts, one for each feature."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit two bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, out = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = [(c % np.uint32(buckets)).astype("<u2") for c in crcs(words, grams)]
                n.append(len(words))
                m.append(sum(map(len, found)))
                out.append(b"".join(f.tobytes() for f in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` over all features; each task adds up its own documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_buffer(), "<u2"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket: 1000 times the log ratio of its smoothed shares in target and raw counts, rounded down."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    rows = both.select("bucket", "s", "t").toPandas().sort_values("bucket")
    s, t = rows["s"].to_numpy(np.int64), rows["t"].to_numpy(np.int64)
    ratio = ((t + 1.0) * (s.sum() + float(buckets))) / ((s + 1.0) * (t.sum() + float(buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: the floored mean of the gains of each document's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[np.frombuffer(b.as_buffer(), "<u2")].sum()) // max(n, 1) for b, n in zip(batch.column(3), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return found.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noisy(weighed_docs: DataFrame, seed: str = SEED) -> DataFrame:
    """With ``score``: the weight plus Gumbel noise that depends on seed and doc_id alone, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed_docs.withColumn("score", F.col("weight") + noise.cast("long"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED,
    grams: int = GRAMS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs``; rank is null where it isn't drawn.

    Features are runs of 1 to ``grams`` words, in hashed buckets; the weight is the mean log ratio
    of target to raw shares. Of the documents with ``least_words`` words or more, ``percent`` in a
    hundred with the highest weight plus Gumbel noise are drawn, a sample without replacement in
    proportion to importance; ties go to the smaller doc_id, and between repeated rows are any.
    Null and empty texts have no features and weight 0; a null id has noise of its own and comes
    last in ties. An empty target gives weights towards an even spread. An empty table gives an
    empty result. Other columns are not read.
    """
    ready(docs.sparkSession)
    found = store(features(docs, grams, buckets, id_col, text_col))
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text_col).alias("text"))
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(wanted, grams, buckets), buckets), buckets)
    scored = noisy(weighed(found, gain))
    # Ranks: a distributed sort, written once; positions are those in each part plus what earlier parts hold.
    able = F.col("n_words") >= least_words
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = store(dealt(scored.where(able), *order).withColumn("_at", F.monotonically_increasing_id()))
    parts = ranked.select(F.shiftright("_at", ROW_BITS).alias("part"), F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("place"), "*")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    draw = percent * (sizes.agg(F.sum("size")).first()[0] or 0) // 100
    rank = F.col("base") + F.col("place") + 1
    drawn = parts.join(bases(sizes), "part").withColumn("rank", F.when(rank <= draw, rank))
    columns = ["doc_id", "n_features", "weight", "score"]
    short = noisy(weighed(found.where(~able), gain)).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*columns, "rank").unionByName(short.select(*columns, "rank"))
