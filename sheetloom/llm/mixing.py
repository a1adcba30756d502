"""Mixing sources to target weights by iterative proportional fitting.

The token counts of all documents are summed into cells (source, language, topic). Raking then
scales the cells so that each margin in turn meets its targets; only the cell table takes part, as
sums per margin joined back. A common scale is calibrated so that the expected tokens of the sample
are ``rate`` of all tokens with no probability above one, and each document is kept by a uniform
number that depends on its id alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

#: Margins in the order in which they are raked.
MARGINS = ("source", "lang", "topic")
SWEEPS, CALIBRATIONS = 8, 6
#: Without stated targets, shares are the observed ones to this power, which lifts the rare.
TEMPER = 0.7
#: Expected share of all tokens that the sample has.
RATE = 0.6
#: Cells that are broadcast; more are joined by shuffle.
BROADCAST_CELLS = 20_000
#: Null sources and languages form a group of this name.
NONE = "(none)"


def topic_rule(text: Column, n_tokens: Column) -> Column:
    """The default topic of a text, by its form: legal, contact, brief, long or prose."""
    return (
        F.when(text.contains("icense") | text.contains("ights reserved"), "legal")
        .when(text.contains("@"), "contact").when(n_tokens < 60, "brief").when(n_tokens >= 1500, "long").otherwise("prose")
    )


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(row, doc_id, source, lang, topic, n_tokens)``: each row of ``docs`` packed, with what mixing needs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"))
    out = packed.withColumn("n_tokens", F.size(words(F.col("text"))).cast("long"))
    group = lambda c: F.coalesce(F.col(f"row.{c}").cast("string"), F.lit(NONE)).alias(c)
    return out.select("row", F.col("row.doc_id").alias("doc_id"), group("source"), group("lang"), topic_rule(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens")


def targets_of(cells: DataFrame, margin: str, stated: dict[str, float] | None, temper: float) -> DataFrame:
    """``(margin, t_margin)`` with shares that sum to one over the groups that have tokens."""
    have = cells.where("tokens > 0").groupBy(margin).agg(F.sum("tokens").cast("double").alias("_n"))
    if stated:
        pairs = F.create_map(*[F.lit(x) for kv in stated.items() for x in kv])
        share = have.withColumn("_s", F.coalesce(F.element_at(pairs, F.col(margin)), F.lit(0.0)))
    else:
        share = have.withColumn("_s", F.pow("_n", F.lit(temper)))
    total = float(share.agg(F.sum("_s")).first()[0] or 1)
    return share.select(margin, (F.col("_s") / total).alias(f"t_{margin}"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS, temper: float = TEMPER) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``w``: cell shares raked to the target margins.

    Groups without a stated target get weight zero; cells without tokens keep weight zero.
    """
    for m in MARGINS:
        cells = cells.join(targets_of(cells, m, (targets or {}).get(m), temper), m, "left")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    cells = cut(cells.withColumn("w", F.col("tokens") / F.lit(float(total))))
    for _ in range(sweeps):
        for m in MARGINS:
            sums = cells.groupBy(m).agg(F.sum("w").alias("_s"))
            cells = cells.join(sums, m).withColumn("w", F.when(F.col("_s") > 0, F.col("w") * F.col(f"t_{m}") / F.col("_s")).otherwise(0.0)).drop("_s")
        cells = cut(cells)
    return cells


def probabilities(cells: DataFrame, rate: float = RATE, steps: int = CALIBRATIONS) -> DataFrame:
    """``cells`` with ``weight`` (raked over observed share) and ``probability`` min(1, c * weight).

    c starts at ``rate`` and is corrected by the ratio of wanted to expected tokens, ``steps`` times.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    cells = cut(cells.withColumn("weight", F.when(F.col("tokens") > 0, F.col("w") * total / F.col("tokens")).otherwise(0.0)))
    c = rate
    for _ in range(steps):
        got = cells.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(c) * F.col("weight")))).first()[0]
        c = c * rate * total / got if got else c
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(c) * F.col("weight")))


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from 32 bits of the MD5 of the id; null ids share one."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` packed as ``row`` with doc_id, source, lang, topic, n_tokens, weight, probability, kept.

    A null text counts as empty (no tokens; weight and probability of its cell, zero where the
    whole cell has none). Null sources and languages form the group "(none)". Repeated rows share
    their fate. An empty table gives an empty result. Only ``row`` carries the other columns.
    """
    rows = measured(docs, text_col)
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    n = cells.count()
    cells = cut(probabilities(rake(cells, targets), rate).select(*MARGINS, "weight", "probability"))
    cells = F.broadcast(cells) if n <= BROADCAST_CELLS else cells
    return rows.join(cells, list(MARGINS)).withColumn("kept", uniform(F.col("doc_id")) < F.col("probability"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs``, with their own columns."""
    return mix(docs, **options).where("kept").select("row.*")


def oracle_sql(table: str = "documents", rate: float = RATE) -> str:
    """The same in SQL: the sweeps written out one after the other."""
    ctes = [
        rf"""m as (select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang, text,
       len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens from {table})""",
        """d as (select doc_id, source, lang, cast(n_tokens as bigint) as n_tokens,
       case when contains(coalesce(text, ''), 'icense') or contains(coalesce(text, ''), 'ights reserved') then 'legal'
            when contains(coalesce(text, ''), '@') then 'contact' when n_tokens < 60 then 'brief'
            when n_tokens >= 1500 then 'long' else 'prose' end as topic from m)""",
        "c as (select source, lang, topic, cast(sum(n_tokens) as double) as tokens from d group by all)",
        "total as (select sum(tokens) as n from c)",
    ]
    for m in MARGINS:
        ctes.append(f"g_{m} as (select {m}, pow(sum(tokens), {TEMPER}) as s from c where tokens > 0 group by all)")
        ctes.append(f"t_{m} as (select {m}, s / sum(s) over () as t_{m} from g_{m})")
    ctes.append("r0 as (select c.*, tokens / n as w, t_source, t_lang, t_topic from c cross join total left join t_source using (source) left join t_lang using (lang) left join t_topic using (topic))")
    k = 0
    for _ in range(SWEEPS):
        for m in MARGINS:
            ctes.append(f"r{k + 1} as materialized (select * replace (coalesce(w * t_{m} / nullif(sum(w) over (partition by {m}), 0), 0) as w) from r{k})")
            k += 1
    ctes.append(f"p as (select r{k}.*, case when tokens > 0 then w * n / tokens else 0 end as weight from r{k} cross join total)")
    ctes.append(f"k0 as (select cast({rate} as double) as c)")
    for i in range(CALIBRATIONS):
        ctes.append(f"k{i + 1} as materialized (select k{i}.c * {rate} * (select n from total) / nullif((select sum(tokens * least(1.0, k{i}.c * weight)) from p), 0) as c from k{i})")
    return (
        "with " + ",\n".join(ctes) + f"""
select doc_id, topic, n_tokens, round(weight, 6) as weight, round(least(1.0, c * weight), 6) as probability,
       cast('0x' || substr(md5('mix:' || cast(doc_id as varchar)), 1, 8) as bigint) / 4294967296.0 < least(1.0, c * weight) as kept
from d join p using (source, lang, topic) cross join k{CALIBRATIONS}"""
    )
