"""Token ids as binary files: one zstandard frame a document, a shared dictionary, an offset index.

A folder of this format has three tables. ``dictionary`` holds the shared dictionary and its SHA-256.
``blocks`` has one row for each run of neighbouring documents: their frames one after the other, and
beside them the index (doc_ids, byte offsets, and the ids before each document and block) and the hash of the dictionary they need; the index
columns are read without the frames. ``starts`` has the number of ids before each part of the files.
Ids are little-endian unsigned 32-bit integers. Spark writes and commits the tables, so a lost
executor repeats its own part only, and any file system that Spark knows will do.

The shared dictionary is trained on the id arrays of short documents, since a frame of its own gives
them little to refer back to. It changes sizes, never ids.
"""

from __future__ import annotations

import gc
import hashlib
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import LATIN, byte_table
from .common import ready
from .order import bases, dealt

END_ID = 2
#: Documents that the dictionary is trained on, the most code points that one of them has, and the dictionary's size.
TRAIN_ROWS, TRAIN_CHARS, DICTIONARY_BYTES = 1000, 4000, 65536
#: A block is closed once its frames pass so many bytes.
BLOCK_BYTES = 1 << 18
LEVEL = 3
#: Pieces that a worker remembers before it starts afresh.
CACHE = 400_000
#: Marks of which a run after a word is one pre-token.
MARKS = ".,;:!?)"


class Encoder:
    """Ids of whole texts by a tokenizer file whose pre-tokens never hold white space; built once per worker.

    Spaces and line feeds are then boundaries between independent pieces, and each distinct piece is
    encoded once. A piece of Latin letters is one pre-token, as is a run of marks after it: those go
    to the library's BPE model directly, in its byte characters. All others go through the whole
    tokenizer.
    """

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.split = self.tokenizer.model.tokenize
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.table = byte_table()
        self.known: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {"": b""}

    def stem(self, word: str) -> bytes:
        """Ids of one pre-token in lower case."""
        got = self.stems.get(word)
        if got is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
            got = self.stems[word] = b"".join([self.bytes_of[t.id] for t in self.split(shown)])
        return got

    def learn(self, pieces: list[str]) -> None:
        rest = []
        for piece in pieces:
            word = piece.rstrip(MARKS)
            low = word.lower()
            if (low.isalpha() and max(low) < LATIN) or not low:
                self.known[piece] = self.stem(low) if len(word) == len(piece) else self.stem(low) + self.stem(piece[len(word) :])
            else:
                rest.append(piece)
        if rest:
            for piece, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                self.known[piece] = b"".join([self.bytes_of[i] for i in got.ids])

    def encode(self, text: str) -> bytes:
        parts, known = text.replace("\n", " ").split(" "), self.known
        found = list(map(known.get, parts))
        if None in found:
            if len(known) > CACHE:
                for held in (known, self.stems):
                    held.clear()
                    held[""] = b""
            self.learn([p for p in set(parts) if p not in known])
            found = list(map(known.get, parts))
        return b"".join(found)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def train_dictionary(texts: DataFrame, encode: Callable[[str], bytes], rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, size: int = DICTIONARY_BYTES) -> DataFrame:
    """One row ``(dictionary)`` from ``rows`` short texts, the smallest hashes of a drawn share, in one task on an executor.

    Where they are too few to train on, their ids themselves are the dictionary; without any there is no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        samples = [encode(t) for pdf in batches for t in pdf["text"]]
        try:
            made = zstandard.train_dictionary(size, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            made = b"".join(samples)[-size:]
        yield pd.DataFrame({"dictionary": [made]})

    # About four times as many rows as wanted pass by their hash, so that what the tasks send on does not grow with their number.
    share = min(1.0, 4 * rows / max(1, texts.count()))
    short = texts.select("text", F.xxhash64("doc_id", "text").alias("_h")).where(F.col("_h") <= min(2**63 - 1, int(-(2**63) + share * (2**64 - 1))))
    sample = short.where(F.length("text").between(1, chars)).orderBy("_h", "text").limit(rows).select("text")
    return sample.repartition(1).sortWithinPartitions("text").mapInPandas(run, "dictionary binary")


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


BLOCK = pa.schema([
    ("part", pa.int64()), ("block", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("dictionary", pa.string()), ("frames", pa.binary()),
])
BLOCK_DDL = "part long, block long, first_id long, last_id long, before long, n_ids long, doc_ids array<long>, offsets array<long>, starts array<long>, dictionary string, frames binary"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> None:
    """Encode every whole text, append ``end_id`` and write the files in ascending doc_id order.

    A null text counts as empty and has the end id alone. Null ids come first; rows that share an id
    are ordered by text. An empty table gives a folder without documents. Other columns are not read.
    """
    spark = ready(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    encode = lambda text: Encoder.of(tokenizer).encode(text) + end
    texts = _texts(docs, id_col, text_col)
    trained = train_dictionary(texts, encode).first()  # none where no text is short
    raw = bytes(trained["dictionary"]) if trained else b""
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, raw)], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        gc.freeze()
        gc.set_threshold(200_000, 50, 50)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw)).compress
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, offsets, starts, frames = [], [0], [0], []

        def block() -> pa.RecordBatch:
            named = [i for i in ids if i is not None]
            row = {
                "part": part, "block": number, "first_id": min(named, default=None), "last_id": max(named, default=None), "before": before, "n_ids": starts[-1], "doc_ids": ids,
                "offsets": offsets, "starts": starts, "dictionary": digest, "frames": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=BLOCK)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                coded = encode(text.as_py())
                frame = press(coded)
                ids.append(doc_id)
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
                starts.append(starts[-1] + len(coded) // 4)
                if offsets[-1] >= block_bytes:
                    yield block()
                    number, before = number + 1, before + starts[-1]
                    ids, offsets, starts, frames = [], [0], [0], []
        if ids:
            yield block()

    sorted_texts = dealt(texts.withColumn("_h", F.xxhash64("text")), F.col("doc_id"), F.col("_h")).select("doc_id", "text")
    # Frames are compressed already.
    sorted_texts.mapInArrow(run, BLOCK_DDL).write.option("compression", "none").parquet(f"{folder}/blocks")
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("size"))
    bases(sizes).write.parquet(f"{folder}/starts")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, part, block, slot, start, n_tokens)`` of every document, from the index columns alone."""
    rows = _with_starts(spark, folder, spark.read.parquet(f"{folder}/blocks")).select("part", "block", "start", "starts", F.posexplode("doc_ids").alias("slot", "doc_id"))
    at = lambda k: F.col("starts")[F.col("slot") + k]
    return rows.select("doc_id", "part", "block", "slot", (F.col("start") + at(0)).alias("start"), (at(1) - at(0)).alias("n_tokens"))


def _with_starts(spark: SparkSession, folder: str, blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``start``, the number of ids before each: what earlier parts hold, one row a part, and earlier blocks of its own."""
    return blocks.join(spark.read.parquet(f"{folder}/starts"), "part").withColumn("start", F.col("base") + F.col("before"))


def read(spark: SparkSession, folder: str, only: DataFrame | None = None, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids binary)`` of the documents in the files, each frame decompressed by itself.

    ``only``, a table with doc_ids, gives just those: their blocks are found in the index and their
    frames cut out by offset, the others are not decompressed. ``digest`` gives the unsigned CRC-32
    of the ids as ``ids_crc32`` in place of them. A frame whose dictionary is not the folder's raises.
    """
    stored = spark.read.parquet(f"{folder}/dictionary").first()
    raw, name = bytes(stored["dictionary"]), stored["sha256"]
    if hashlib.sha256(raw).hexdigest() != name:
        raise ValueError(f"the dictionary of {folder} is not the one it names")
    blocks = spark.read.parquet(f"{folder}/blocks")
    columns = ["doc_ids", "offsets", "starts", "dictionary", "start", "frames"]
    if only is None:
        rows = _with_starts(spark, folder, blocks).select(*columns, F.lit(None).cast("array<int>").alias("slots"))
    else:
        wanted = only.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        light = blocks.select("part", "block", F.posexplode("doc_ids").alias("slot", "doc_id"))
        slots = light.join(wanted, "doc_id").groupBy("part", "block").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
        rows = _with_starts(spark, folder, blocks.join(slots, ["part", "block"])).select(*columns, "slots")
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["frames"]).to_pylist()):
                if row["dictionary"] != name:
                    raise ValueError(f"a block needs the dictionary {row['dictionary']}, the folder has {name}")
                frames, offsets, starts = memoryview(batch["frames"][i].as_buffer()), row["offsets"], row["starts"]
                out = []
                for k in range(len(starts) - 1) if row["slots"] is None else row["slots"]:
                    coded = press(frames[offsets[k] : offsets[k + 1]], max_output_size=4 * (starts[k + 1] - starts[k]))
                    out.append((row["doc_ids"][k], row["start"] + starts[k], len(coded) // 4, zlib.crc32(coded) if digest else coded))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every row of ``docs``, read back from files in the shared checkpoint folder."""
    spark = ready(docs.sparkSession)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer, end_id)
    return read(spark, folder, digest=True)
