"""Quality rules as a short-circuit cascade, in SQL functions only.

The base counts come first: they are results of their own. Every further rule has a reject
condition and a unit of work (one column, every word, every character). On a bounded sample one
aggregate job measures each rule's rejection rate and its work; rules then run in the order of
rejections per unit of work inside one CASE, which stops at the first rule that rejects. The order
changes only the work: a text is kept when no rule rejects it.

All counting stays inside the row (arrays and higher-order functions), so nothing is shuffled and
no key can be hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SYMBOLS, let, words

#: Words of a window in which repetition is looked for.
WINDOW = 5
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 256


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the base columns and ``text``; ``work`` what it visits."""

    name: str
    rejects: str
    work: str


RULES = (
    Rule("symbol_share", "10 * n_symbols > n_words", "1"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines", "1"),
    Rule("word_length", "word_chars > 20 * n_words or word_chars < 2 * n_words", "1"),
    Rule("shouting", r"10 * regexp_count(text, '\\p{Lu}') > 4 * word_chars", "n_chars"),
    Rule("exclamation", "10 * regexp_count(text, '!!') > n_words", "n_chars"),
    Rule("few_distinct_words", "50 * size(array_distinct(words)) < n_words", "n_words"),
)


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words which occurs twice or more in the text.

    Windows are compared by 64-bit hash. The positions of repeated windows are looked for only in
    texts that have one, by sorting (hash, position) pairs: O(n log n) however long the text is.
    """
    starts = lambda v: F.sequence(F.lit(1), F.size(v) - (window - 1))
    hashes = lambda v: F.transform(starts(v), lambda i: F.xxhash64(F.slice(v, i, window)))

    def positions(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda s, x, i: (F.get(s, i)["h"] == x["h"])
        again = lambda s: F.filter(s, lambda x, i: F.coalesce(same(s, x, i - 1), F.lit(False)) | F.coalesce(same(s, x, i + 1), F.lit(False)))
        return F.sort_array(F.transform(let(pairs, again), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    by_hash = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(positions(h), covered))
    return F.when(F.size(w) < window, F.lit(0)).otherwise(let(w, lambda v: let(hashes(v), by_hash)))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and helper columns
    ``words``, ``n_lines`` and ``n_chars``; a null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    out = docs.withColumns({"words": words(text), "_lines": lines})
    return out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("words")).cast("long"),
            "n_chars": F.char_length(text).cast("long"),
        }
    )


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def drawn(docs: DataFrame, rows: int) -> DataFrame:
    """``rows`` rows of ``docs``, those of the least hashes of doc_id; of rows that share the last hash the first in the files.

    One hash and one row number are sent to the driver, and no text; however many rows share an id,
    or have none, no more than ``rows`` are drawn.
    """
    key = F.struct(F.xxhash64("doc_id").alias("h"), F.monotonically_increasing_id().alias("row"))
    numbered = docs.withColumn("_key", key)
    last = numbered.select("_key").orderBy("_key").limit(rows).agg(F.max("_key").alias("m")).first()["m"]
    if last is None:
        return docs.limit(0)
    inside = (F.col("_key.h") < last["h"]) | ((F.col("_key.h") == last["h"]) & (F.col("_key.row") <= last["row"]))
    return numbered.where(inside).drop("_key")


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per unit of work on a sample of ``docs`` (doc_id, text), best first.

    The sample has at most ``sample_rows`` rows and is aggregated where it lies. On an empty
    table, or where nothing is rejected, the cheapest rule comes first; equal rules keep the order in
    which they were given.
    """
    sample = base_counts(drawn(docs, sample_rows)).where(~F.expr(BASE_FAILED))
    per_rule = [x for i, r in enumerate(rules) for x in (F.avg(F.expr(f"cast({r.rejects} as int)")).alias(f"r{i}"), F.avg(F.expr(f"cast({r.work} as double)")).alias(f"w{i}"))]
    row = sample.agg(*per_rule).first()
    rate = [(row[f"r{i}"] or 0.0) / max(row[f"w{i}"] or 1.0, 1.0) for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-rate[i], row[f"w{i}"] or 1.0, i))]


def verdict(order: list[Rule]) -> Column:
    """One CASE that stops at the first rule that rejects; the base rule comes first."""
    out = F.when(F.expr(BASE_FAILED), False)
    for r in order:
        out = out.when(F.expr(r.rejects), False)
    return out.otherwise(True)


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)``.

    One row per row of ``docs``: repeated rows and null ids stay. A null or empty text has zero
    counts, fails the base rule and is not kept. Texts of any length are counted whole. An empty
    table gives an empty result. Columns other than doc_id and the text are not read, so their
    names can't clash.
    """
    slim = docs.select("doc_id", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ordered(slim, rules, sample_rows)
    return base_counts(slim).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(BASE_FAILED).alias("base_failed"), verdict(order).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns and without any join.

    A kept row is an array of one row that is exploded, a rejected one is null: as a filter on the
    counts, they would be evaluated once for every rule that names them.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text)
    order = ordered(docs.select("doc_id", text), rules)
    kept = base_counts(packed).select(F.when(verdict(order), F.array("row")).alias("kept"))
    return kept.select(F.explode_outer("kept").alias("row")).where("row is not null").select("row.*")


ORACLE_SQL = rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
g as (select rid, unnest(range(1, len(w) - 3)) as p, w from d where len(w) >= 5),
h as (select rid, p, list_slice(w, p, p + 4) as win from g),
r as (select rid, p, count(*) over (partition by rid, win) as n from h),
c as (select rid, count(distinct p + k) as n_repeat from r, unnest(range(0, 5)) as t(k) where n > 1 group by rid),
b as (
  select d.*, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         len(regexp_extract_all(text, '[{SYMBOLS}]')) as n_symbols, len(ls) as n_lines,
         len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat, 0) as n_repeat_words,
         len(list_distinct(w)) as n_distinct,
         len(regexp_extract_all(text, '\p{{Lu}}')) as n_upper, len(regexp_extract_all(text, '!!')) as n_excl
  from d left join c using (rid)),
f as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from b)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
       cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
       cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > n_words or 2 * n_dup_lines > n_lines
            or word_chars > 20 * n_words or word_chars < 2 * n_words or 10 * n_upper > 4 * word_chars
            or 10 * n_excl > n_words or 50 * n_distinct < n_words) as kept
from f
"""
