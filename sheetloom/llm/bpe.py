"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file gives byte strings; byte-level BPE works on one printable character per byte. The
merges that a rank file leaves out are derived from it: a token's merge is the pair that is left
when its bytes are merged with lower ranks only.

A boundary between a non-space character and a following space is always a boundary of the split
pattern, since every alternative has white space only at its start. Texts are cut there, and each
distinct piece is split by the pattern, mapped to byte characters and merged by the library's BPE
model once per worker, and then looked up: the result is that of encoding the whole text, a text of
any length needs memory for its ids only, and common words cost a dictionary lookup. Offsets come
from the byte lengths of the tokens and the byte-to-character table of the text.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a worker remembers before it starts afresh.
CACHE = 300_000
#: Below this letter, isalpha() and the letters of the split pattern agree.
LATIN = "\u0250"
#: Marks that a word is often followed by; each is its own byte character.
MARKS = ".,;:!?"


def byte_table() -> dict[int, str]:
    """The printable character for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last merge that makes ``token``; None for single bytes."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= own:
            raise ValueError(f"rank {own} can't be reached by merges")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(parts) if len(parts) == 2 else None


class Codec:
    """Encoder and decoder for one rank file; built once per Python worker."""

    _made: dict[tuple[str, str], Codec] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import models

        ranks, table = read_ranks(path), byte_table()
        shown = lambda t: "".join(table[b] for b in t)
        merges = [tuple(map(shown, m)) for t in sorted(ranks, key=ranks.get) if (m := merge_of(t, ranks))]
        self.model = models.BPE({shown(t): r for t, r in ranks.items()}, merges)
        self.table, self.find = table, regex.compile(pattern).findall
        back = {c: b for b, c in table.items()}
        #: The reversed byte table, by id.
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = bytes(back[c] for c in shown(t))
        #: Of a piece without its leading space: ids, and the ids as text. None: not a piece.
        self.known: dict[str, tuple[tuple[int, ...], str] | None] = {}

    def _encode_piece(self, piece: str) -> tuple[tuple[int, ...], str]:
        """Ids of a piece. A space and Latin letters are one match of the pattern, as is a single mark after them."""
        if max(piece) < LATIN and piece[0] == " " and len(piece) > 2:
            word, mark = (piece, "") if piece[1:].isalpha() else (piece[:-1], piece[-1])
            if word[1:].isalpha() and (not mark or mark in MARKS):
                ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.table))]
                ids += [t.id for t in self.model.tokenize(mark)] if mark else []
                return tuple(ids), ",".join(map(str, ids))
        ids = [t.id for w in self.find(piece) for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.table))]
        return tuple(ids), ",".join(map(str, ids))

    def encode_pieces(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """Ids, and ids as text, of the pieces of ``text`` in order."""
        if not text:
            return []
        parts, known = text.split(" "), self.known
        if len(known) > CACHE:
            known.clear()
        rest = parts[1:]
        found = list(map(known.get, rest))
        if None in found:
            for p in {p for p, x in zip(rest, found) if x is None}:
                known[p] = self._encode_piece(" " + p) if p and not p[-1].isspace() else None
            found = list(map(known.get, rest))
        if None in found[:-1] or parts[0] == "" or parts[0][-1].isspace():
            return [self._encode_piece(p) for p in self.pieces(parts)]
        if found and found[-1] is None:
            found[-1] = self._encode_piece(" " + parts[-1])
        return [self._encode_piece(parts[0]), *found]

    @staticmethod
    def pieces(parts: list[str]) -> list[str]:
        """The text, split at spaces, put together again but for spaces after a character other than white space."""
        out, held = [], [parts[0]]
        for p in parts[1:]:
            if held[-1] and not held[-1][-1].isspace():
                out.append(" ".join(held))
                held = ["", p]
            else:
                held.append(p)
        return [x for x in (*out, " ".join(held)) if x]

    def encode(self, text: str | None) -> list[int]:
        return [i for x in self.encode_pieces(text or "") for i in x[0]]

    def encode_with_offsets(self, text: str | None) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and the code points [start, end) that each covers; tokens that split a character share it."""
        text = text or ""
        ids = self.encode(text)
        char_at = [i for i, c in enumerate(text) for _ in c.encode()]  # of each byte
        spans, at = [], 0
        for i in ids:
            end = at + len(self.bytes_of[i])
            spans.append((char_at[at], char_at[end - 1] + 1))
            at = end
        return ids, spans

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of ids; a character whose bytes are spread over tokens comes out whole, stray bytes as U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _slim(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, starts array<int>, ends array<int>)`` for every row of ``docs``.

    Starts and ends are code point offsets. A null text counts as empty and has no ids. Repeated
    rows and null ids of documents stay; an empty table gives an empty result; other columns are
    not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(path, pattern)
        for pdf in batches:
            got = [codec.encode_with_offsets(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [g[0] for g in got], "starts": [[s for s, _ in g[1]] for g in got], "ends": [[e for _, e in g[1]] for g in got]})

    id_type = dict(docs.dtypes)["doc_id"]
    return _slim(docs, text_col).mapInPandas(run, f"doc_id {id_type}, ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, text)`` from rows of ``(doc_id, ids)``; null ids decode to the empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(path, pattern)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [codec.decode(i if i is not None else ()) for i in pdf["ids"]]})

    id_type = dict(tokens.dtypes)["doc_id"]
    return tokens.select("doc_id", "ids").mapInPandas(run, f"doc_id {id_type}, text string")


def digest(docs: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each text encoded, and its ids decoded again.

    ``with_ids`` adds the ids themselves. Rows are treated as in ``encode``; ids and bytes are hashed
    piece by piece as they are made.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(path, pattern)
        gc.freeze()  # the tables hold no cycles; walking them again and again costs a fifth of the time
        gc.set_threshold(200_000, 50, 50)
        for pdf in batches:
            n, a, b, ids = [], [], [], []
            for text in pdf["text"]:
                found = codec.encode_pieces(text)
                n.append(sum(len(x[0]) for x in found))
                a.append(hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest())
                if with_ids:
                    ids.append(list(chain.from_iterable([x[0] for x in found])))
                b.append(hashlib.sha256(codec.decode_bytes(chain.from_iterable([x[0] for x in found]))).hexdigest())
            out = {"doc_id": pdf["doc_id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}
            yield pd.DataFrame(out | ({"ids": ids} if with_ids else {}))

    id_type = dict(docs.dtypes)["doc_id"]
    return _slim(docs, text_col).mapInPandas(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' if with_ids else ''}")
