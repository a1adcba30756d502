"""Text helpers: normalisation, lines, counts of terms, the uniqueness gate."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .terms import LINE_ENDS


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Characters that NFKC leaves as they are, whatever other of them stand beside them: ASCII, a few marks, and unified ideographs.
STABLE = "\\x00-\\x7F±×→、。\u4E00-\u9FFF"


def nfkc(text: Column) -> Column:
    """NFKC form; rows of ``STABLE`` characters only never leave the JVM's strings (the function gets null for them)."""
    return F.coalesce(_nfkc(F.when(text.rlike(f"[^{STABLE}]"), text)), text)


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def normalize(text: Column, mode: str = "lower") -> Column:
    """One of six forms of a text; null counts as empty.

    lower: squeezed and lower case. folded: NFKC, squeezed and lower case. nfkc: NFKC, squeezed. token: NFKC, upper case, no white space or
    underscores. code: upper case letters and digits only. key: NFKC, lower case letters and digits only.
    """
    text = F.coalesce(text, F.lit(""))
    forms = {
        "lower": lambda: F.lower(squeeze(text)),
        "folded": lambda: F.lower(squeeze(nfkc(text))),
        "nfkc": lambda: squeeze(nfkc(text)),
        "token": lambda: F.regexp_replace(F.upper(nfkc(text)), r"(?U)[\s_]+", ""),
        "code": lambda: F.regexp_replace(F.upper(text), "[^A-Z0-9]", ""),
        "key": lambda: F.regexp_replace(F.lower(nfkc(text)), "[^a-z0-9]", ""),
    }
    return forms[mode]()


def lines_of(text: Column) -> Column:
    """Array of lines by Python's splitlines rules: many separators, no trailing empty line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of ``term`` in ``text``."""
    return ((F.char_length(text) - F.char_length(F.replace(text, term, F.lit("")))) / F.char_length(term)).cast("int")


def term_hits(text: Column, terms) -> Column:
    """``array<struct<term, n>>`` of the terms that a normalised text holds, each counted on its own.

    One plain condition a term, so that they compile; only terms that occur are counted.
    """
    every = [F.when(F.contains(text, F.lit(t)), F.struct(F.lit(t).alias("term"), occurrences(text, F.lit(t)).alias("n"))) for t in terms]
    return F.array_compact(F.array(*every))


def stem_hits(text: Column, stems: dict[str, str]) -> Column:
    """Like ``term_hits`` for patterns, by name."""
    every = F.array(*[F.struct(F.lit(k).alias("term"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?iU)" + p)).alias("n")) for k, p in stems.items()])
    return F.filter(every, lambda x: x["n"] > 0)


def once(df: DataFrame) -> DataFrame:
    """``df`` with its columns evaluated here, once per row.

    The optimizer merges neighbouring projections, which repeats a costly expression wherever its
    result is used; a generator of one row between them keeps them apart.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.explode(F.array(row)).alias("_row")).select("_row.*")


def any_of(text: Column, marks) -> Column:
    """Whether a text holds one of the marks, as one compiled pattern."""
    return F.rlike(text, F.lit("|".join(rf"\Q{m}\E" for m in marks)))


def names(hits: Column) -> Column:
    return F.transform(hits, lambda x: x["term"])


def total(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda a, x: a + x["n"])


def ordered_distinct(items: Column) -> Column:
    """Distinct items in the order of their first occurrence."""
    return F.array_distinct(items)


def gate(rows: DataFrame, keys: list[str], candidate: str, evidence: Column | None = None) -> DataFrame:
    """The uniqueness gate: none, unique or ambiguous candidates per key, with all the evidence.

    Null candidates count as none. ``value`` is set only where it is unique; the evidence stays in
    every case, sorted, so that an ambiguous result never turns into a silent pick.
    """
    seen = F.col(candidate) if evidence is None else evidence
    out = rows.groupBy(*keys).agg(F.count_distinct(candidate).alias("n"), F.min(candidate).alias("_v"), F.array_sort(F.collect_set(seen)).alias("evidence"))
    status = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return out.select(*keys, status.alias("status"), F.when(F.col("n") == 1, F.col("_v")).alias("value"), F.col("n").cast("long").alias("n"), "evidence")
