"""Chat formatting as a prefix tree: turns that conversations share from the start are emitted once.

A node is a distinct beginning of a conversation, named by a chained hash of its turns. Nodes are
laid out depth-first in one token sequence. A node carries its tokens, its loss mask (the text of
assistant turns), its first position id (the tokens of its ancestors) and the token intervals that
it attends to: its ancestors and itself, neighbouring intervals joined.

Depth-first order needs no tree walk: conversations sorted by their chain of hashes keep those with
a common beginning together, a node belongs to the first of them, and (owner, depth) is the order of
the nodes. Both sorts are range partitioned on keys that no two rows share, and starts are running
sums whose base per partition is the only thing that reaches the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec
from .common import cut

# The template: <|role|>\n text </s>\n. No text holds "<" or "[", so none can hold a control string.
OPEN, SHUT, END = "<|", "|>\n", "</s>\n"
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}
_BACK = {v[1]: k for k, v in ESCAPES.items()}
_TURN = re.compile(r"<\|([^<]*?)\|>\n([^<]*)</s>\n")


def escape(text: str, bars: bool = False) -> str:
    """``text`` without "<" and "[" (and "|" for roles); ``unescape`` gives it back."""
    return re.sub(r"[\\<\[|]" if bars else r"[\\<\[]", lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; anything else than turns is an error."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text outside of turns")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("text after the last turn")
    return out


def chains(conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, key, path, role, text)``: a row per turn; key names the beginning that ends with it.

    Turns are ordered by turn, then role and text; a null turn comes first, a null role or text is empty.
    """
    slim = conversations.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    convs = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for conv, turns in zip(pdf["conv_id"], pdf["turns"]):
                key, rows, path = b"", [], []
                for d, t in enumerate(turns):
                    role, text = (t["role"].encode("utf-8", "surrogatepass"), t["text"].encode("utf-8", "surrogatepass"))
                    key = hashlib.sha256(key + b"%d:%b:%b" % (len(role), role, text)).digest()
                    path.append(key.hex()[:16])
                    rows.append((conv, d, key.hex()[:32], t["role"], t["text"]))
                out = pd.DataFrame(rows, columns=["conv_id", "depth", "key", "role", "text"])
                out["path"] = [None] * (len(rows) - 1) + ["".join(path)]
                yield out

    id_type = dict(conversations.dtypes)["conv_id"]
    return convs.mapInPandas(run, f"conv_id {id_type}, depth int, key string, role string, text string, path string")


def build(conversations: DataFrame, vocab: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The tree as two tables.

    Nodes: ``key, parent_key, depth, start, n_tokens, position, attends array<struct<start,end>>,
    ids array<int>, loss array<boolean>``; start and attends count tokens of the one depth-first
    sequence. Paths: ``conv_id, depth, key``. A conversation is the only unit that is ever gathered
    in one place.
    """
    rows = cut(chains(conversations))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.where(F.col("path").isNotNull()).select("conv_id", "path")
    ranked = cut(ends.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").select(F.col("conv_id").alias("_c"), F.monotonically_increasing_id().alias("rank")))
    placed = rows.drop("path").join(ranked, F.col("conv_id").eqNullSafe(F.col("_c")))
    owner = placed.groupBy("key").agg(F.min("rank").alias("owner"))
    nodes = placed.join(owner, "key").where("rank = owner").select("key", "owner", "depth", "role", "text")

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(vocab, pattern)
        for pdf in batches:
            ids, loss = [], []
            for role, text in zip(pdf["role"], pdf["text"]):
                a, b, c = codec.encode(OPEN + escape(role, bars=True) + SHUT), codec.encode(escape(text)), codec.encode(END)
                ids.append(a + b + c)
                loss.append([False] * len(a) + [role == "assistant"] * len(b) + [False] * len(c))
            yield pd.DataFrame({"key": pdf["key"], "owner": pdf["owner"], "depth": pdf["depth"], "ids": ids, "loss": loss})

    made = nodes.mapInPandas(tokens, "key string, owner long, depth int, ids array<int>, loss array<boolean>")
    made = made.repartitionByRange(parts, "owner", "depth").sortWithinPartitions("owner", "depth").withColumn("part", F.spark_partition_id())

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for pdf in batches:
            n = pdf["ids"].map(len).astype("int64")
            yield pdf.assign(n_tokens=n, start=at + n.cumsum() - n)
            at += int(n.sum())

    made = cut(made.mapInPandas(running, "key string, owner long, depth int, ids array<int>, loss array<boolean>, part int, n_tokens long, start long"))
    base, at = {}, 0
    for r in sorted(made.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).collect()):
        base[r["part"]], at = at, at + r["n"]
    if base:
        shift = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in (kv[0], int(kv[1]))]), F.col("part"))
        made = made.withColumn("start", F.col("start") + shift.cast("long"))
    paths = rows.select("conv_id", "depth", "key")
    spans = paths.join(ranked, F.col("conv_id").eqNullSafe(F.col("_c"))).join(made.select("key", "owner", "start", "n_tokens"), "key")
    per_conv = spans.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "owner", "start", "n_tokens"))).alias("nodes"))

    def attend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rank, chain in zip(pdf["rank"], pdf["nodes"]):
                seen: list[tuple[int, int]] = []
                position, parent = 0, None
                for x in chain:
                    s, e = int(x["start"]), int(x["start"] + x["n_tokens"])
                    if seen and seen[-1][1] == s:
                        seen[-1] = (seen[-1][0], e)
                    else:
                        seen.append((s, e))
                    if x["owner"] == rank:
                        out.append((x["key"], parent, position, [{"start": a, "end": b} for a, b in seen]))
                    position += int(x["n_tokens"])
                    parent = x["key"]
            yield pd.DataFrame(out, columns=["key", "parent_key", "position", "attends"])

    links = per_conv.mapInPandas(attend, "key string, parent_key string, position long, attends array<struct<start:long,end:long>>")
    return made.drop("part", "owner").join(links, "key"), paths


def read_back(nodes: DataFrame, paths: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from the two tables alone."""
    full = paths.join(nodes.select("key", "ids", "loss"), "key")
    convs = full.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "ids", "loss"))).alias("nodes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(vocab, pattern)
        for pdf in batches:
            out = []
            for conv, chain in zip(pdf["conv_id"], pdf["nodes"]):
                text = codec.decode([i for x in chain for i in x["ids"]])
                under = unescape(codec.decode([i for x in chain for i, m in zip(x["ids"], x["loss"]) if m]))
                turns = parse(text)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), _sha(said), len(under), _sha(under), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    id_type = dict(paths.dtypes)["conv_id"]
    return convs.mapInPandas(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def format_conversations(conversations: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """Build the tree of ``conversations`` (conv_id, turn, role, text) and read each conversation back from it.

    Null texts and roles are empty, a null conv_id is a conversation of its own, repeated rows are
    repeated turns, an empty table gives no rows; other columns are not read.
    """
    nodes, paths = build(conversations, vocab, pattern)
    return read_back(nodes, paths, vocab, pattern)
