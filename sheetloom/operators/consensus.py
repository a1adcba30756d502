"""Consensus over repeated samples of one document's dimensions: alignment, votes, statistics.

Input: ``dimension(doc_id, sample_idx, ord, value, unit, role, belongs_to, endpoints[, is_derived])``.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nfkc, once

# Spellings of units.
UNIT_NAMES = {"mm": ("mm", "millimeter", "millimeters", "millimetre", "millimetres", "毫米"), "in": ("in", "inch", "inches", '"', "英寸")}
# Endpoint wordings in the order in which they are replaced.
ENDPOINT_WORDS = (
    ("->", "→"), ("=>", "→"), ("至", "→"), ("到", "→"), ("产品外形图中", ""), ("推荐焊盘图中", ""), ("建议焊盘图中", ""),
    ("俯视图中", ""), ("侧视图中", ""), ("右视图中", ""), ("俯视图", ""), ("侧视图", ""), ("右视图", ""), ("上方方形视图", ""),
    ("小焊盘/端子焊盘", "小焊盘"), ("端子焊盘", "小焊盘"), ("solder land", "焊盘"), ("solder pad", "焊盘"), ("封装本体", "本体"),
    ("本体外形", "本体"), ("封装外形", "本体"), ("产品外形", "本体"), ("封装", "本体"), ("左侧", "左"), ("右侧", "右"), ("上侧", "上"),
    ("下侧", "下"), ("左端", "左"), ("右端", "右"), ("上端", "上"), ("下端", "下"), ("左边缘", "左缘"), ("右边缘", "右缘"),
    ("上边缘", "上缘"), ("下边缘", "下缘"), ("左外缘", "左缘"), ("右外缘", "右缘"), ("上外缘", "上缘"), ("下外缘", "下缘"),
    ("左侧面", "左缘"), ("右侧面", "右缘"), ("上表面", "上缘"), ("下表面", "下缘"), ("最外缘", "缘"), ("边缘", "缘"), ("同一", ""),
)
ENDPOINT_PATTERNS = (
    ("左小焊盘(?:的)?外?缘", "左小焊盘左缘"), ("右小焊盘(?:的)?外?缘", "右小焊盘右缘"), ("左焊盘(?:的)?外?缘", "左焊盘左缘"), ("右焊盘(?:的)?外?缘", "右焊盘右缘"),
    (r"(?U)[\s，,。；;：:、/\\()（）\[\]{}]+", ""), ("→+", "→"),
)


def sample_gate(sample: DataFrame, least: int = 2) -> DataFrame:
    """``sample(doc_id, sample_idx, status, error_type)`` to successes, failures, errors and whether there are enough."""
    out = sample.groupBy("doc_id").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.coalesce(F.col("status") != "ok", F.lit(True))).alias("failed"), F.array_join(F.array_sort(F.collect_set("error_type")), ",").alias("errors"))
    return out.withColumn("enough", F.col("ok") >= least)


def value_key(value: Column) -> Column:
    """A number rounded half up to two places; other texts in lower case."""
    number = F.replace(value, F.lit(","), F.lit(".")).try_cast("decimal(38,12)")
    return F.coalesce(F.round(number, 2).cast("decimal(38,2)").cast("string"), F.lower(F.trim(value)))


def unit_key(unit: Column) -> Column:
    text = F.replace(F.lower(F.trim(F.coalesce(unit, F.lit("")))), F.lit(" "), F.lit(""))
    out = text
    for name, spellings in UNIT_NAMES.items():
        out = F.when(text.isin(*spellings), name).otherwise(out)
    return out


def partition_key(belongs_to: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(belongs_to, F.lit(""))))
    return F.when(text == "other", "").otherwise(text)


def with_keys(dimension: DataFrame) -> DataFrame:
    """Value, unit and partition keys."""
    d = dimension if "is_derived" in dimension.columns else dimension.withColumn("is_derived", F.lit(False))
    return d.withColumns({"value_key": value_key(F.col("value")), "unit_key": unit_key(F.col("unit")), "partition": partition_key(F.col("belongs_to"))})


# The words and patterns that can fit a text of ASCII; what they put in starts none of the others.
ASCII_WORDS = tuple(w for w in ENDPOINT_WORDS if w[0].isascii())
ASCII_PATTERNS = ENDPOINT_PATTERNS[-2:]


def canonical_endpoints(text: Column) -> Column:
    """Endpoint wording without synonyms, white space and marks; texts of ASCII skip the words that can't be in them."""
    text = F.coalesce(text, F.lit(""))

    def replaced(out: Column, words, patterns) -> Column:
        for old, new in words:
            out = F.replace(out, F.lit(old), F.lit(new))
        for pattern, new in patterns:
            out = F.regexp_replace(out, pattern, new)
        return out

    short = replaced(F.lower(F.trim(text)), ASCII_WORDS, ASCII_PATTERNS)
    return F.when(text.rlike(r"[^\x00-\x7F]"), replaced(F.lower(F.trim(nfkc(text))), ENDPOINT_WORDS, ENDPOINT_PATTERNS)).otherwise(short)


def similarity(left: str, right: str) -> int:
    if not left or not right:
        return 0
    return 10_000 if left == right else round(SequenceMatcher(None, left, right).ratio() * 9_000)


def align_slots(dimension: DataFrame) -> DataFrame:
    """C4: rows with ``slot``: within a document, rows of several samples that stand for one dimension.

    Buckets of one value and unit are single slots when no sample has two rows in them and no two
    partitions are explicit in them: that covers nearly all rows and stays native. The others are
    aligned bucket by bucket, in time that grows with the cube of a sample's rows in it; a bucket has
    the rows of one value of one document.
    """
    d = once(with_keys(dimension).withColumn("canon", canonical_endpoints(F.col("endpoints"))))
    key = ["doc_id", "value_key", "unit_key"]
    bucket = W.partitionBy(*key)
    named = F.collect_set(F.when(F.col("partition") != "", F.col("partition"))).over(bucket)
    d = d.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*key, "sample_idx")))
    d = once(d.withColumn("easy", (F.max("_n").over(bucket) == 1) & (F.size(named) <= 1)).drop("_n"))  # the same columns for both branches, so that they share the shuffle
    names = F.concat_ws("|", "value_key", "unit_key")
    plain = d.where("easy").drop("easy").withColumn("slot", F.concat(names, F.lit("|0")))
    hard = d.where("not easy").drop("easy")
    hard = hard.repartition(*key).sortWithinPartitions(*key, "sample_idx", "ord")
    return plain.unionByName(hard.mapInPandas(_align_all, T.StructType([*hard.schema.fields, T.StructField("slot", T.StringType())])))


def _align_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slots of sorted buckets, one after the other; a bucket that a batch cuts off waits for the rest of it."""
    key, rest = ["doc_id", "value_key", "unit_key"], None

    def aligned(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        keys = list(zip(*[pdf[c].tolist() for c in key]))
        sample, part, canon = (pdf[c].tolist() for c in ("sample_idx", "partition", "canon"))
        out, lo = [], 0
        for hi in range(1, len(keys) + 1):
            if hi == len(keys) or keys[hi] != keys[lo]:
                out += [f"{keys[lo][1]}|{keys[lo][2]}|{k}" for k in _slots(sample[lo:hi], part[lo:hi], canon[lo:hi])]
                lo = hi
        return pdf.assign(slot=out)

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        last = pdf[key].iloc[-1].tolist()
        same = len(pdf)
        while same and pdf[key].iloc[same - 1].tolist() == last:
            same -= 1
        if same:
            yield aligned(pdf.iloc[:same])
        rest = pdf.iloc[same:]
    if rest is not None and len(rest):
        yield aligned(rest)


# What it is worth that a row and a slot name their partition.
PARTITION_SCORES = {(True, True): 100_000, (True, False): 80_000, (False, True): 60_000, (False, False): 40_000}


def _slots(sample: list[int], part: list[str], canon: list[str]) -> list[int]:
    """A slot for each row of a bucket in order of samples. The largest sample (the earliest of equals) opens one slot a row; each other sample is assigned to the slots as a whole."""
    samples: dict[int, list[int]] = {}
    for i, s in enumerate(sample):
        samples.setdefault(s, []).append(i)
    first = max(samples, key=lambda s: (len(samples[s]), -s))
    slots = [[i] for i in samples[first]]
    near = cache(similarity)
    for s in sorted(set(samples) - {first}):
        hints = [_partition_of([part[i] for i in slot]) for slot in slots]
        worth = np.full((len(samples[s]), len(slots)), -1, dtype=np.int64)
        for at, r in enumerate(samples[s]):
            for k, slot in enumerate(slots):
                if not (part[r] and hints[k]) or part[r] == hints[k]:
                    worth[at, k] = PARTITION_SCORES[bool(part[r]), bool(hints[k])] + max(near(canon[r], canon[i]) for i in slot)
        for r, k in zip(samples[s], assign(worth), strict=True):
            slots.append([r]) if k is None else slots[k].append(r)
    of = {i: k for k, slot in enumerate(slots) for i in slot}
    return [of[i] for i in range(len(sample))]


def _partition_of(named: list[str]) -> str:
    """The partition that the rows of a slot name; two different ones are refused."""
    explicit = sorted({p for p in named if p})
    if len(explicit) > 1:
        raise ValueError(f"a slot holds rows of {' and '.join(explicit)}")
    return explicit[0] if explicit else ""


def assign(worth: np.ndarray) -> list[int | None]:
    """A column for each row of ``worth``, each used once: most rows placed, then the highest total, then the smallest columns row by row.

    Negative entries never meet. The assignment of least cost is found by shortest augmenting paths
    in cubic time, over real columns and one column of its own for each row that stays alone. Its
    prices tell all assignments of that cost: they use tight edges and leave no priced column free.
    Among those, rows take the smallest column in turn that still leaves the others a place.
    """
    n, m = worth.shape
    if n == 0:
        return []
    big = int(worth.max(initial=0) + 1) * (n + 1)
    cost = np.full((n, m + n), 4 * big * (n + 1), dtype=np.int64)  # never
    cost[:, :m] = np.where(worth >= 0, -big - worth, cost[:, :m])
    cost[np.arange(n), m + np.arange(n)] = 0
    row_of, u, v = _shortest_paths(cost)
    tight = (cost - u[:, None] - v[None, :]) == 0
    at = {int(r): c for c, r in enumerate(row_of) if r >= 0}
    for r in range(n):
        for c in np.flatnonzero(tight[r, : at[r]]):
            if (row_of[c] < 0 or row_of[c] > r) and _take(r, int(c), at[r], row_of, tight, v == 0):
                at = {int(x): k for k, x in enumerate(row_of) if x >= 0}
                break
    return [at[r] if at[r] < m else None for r in range(n)]


def _take(r: int, c: int, old: int, row_of: np.ndarray, tight: np.ndarray, free: np.ndarray) -> bool:
    """Give column ``c`` to row ``r`` if later rows can move so that ``old`` is covered again; a column without a row may change with any unpriced one."""
    came, todo = {c: c}, [c]
    while todo and old not in came:
        x = todo.pop()
        mover = int(row_of[x])
        for k in np.flatnonzero(tight[mover] if mover >= 0 else free):
            k = int(k)
            if k not in came and (k == old or row_of[k] < 0 or row_of[k] > r):
                came[k] = x
                todo.append(k)
    if old not in came:
        return False
    x = old
    while x != c:
        row_of[x] = row_of[came[x]]
        x = came[x]
    row_of[c] = r
    return True


def _shortest_paths(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of each column or -1, row prices, column prices)`` of a least-cost assignment of all rows; prices prove it optimal."""
    n, m = cost.shape
    u, v, row_of = np.zeros(n, np.int64), np.zeros(m, np.int64), np.full(m, -1)
    for start in range(n):
        slack, via, done = cost[start] - u[start] - v, np.full(m, -1), np.zeros(m, bool)
        reached: list[tuple[int, int, int]] = []  # row, column, and the distance at which it was reached
        while True:
            open_slack = np.where(done, np.iinfo(np.int64).max, slack)
            c = int(open_slack.argmin())
            far = int(open_slack[c])
            if row_of[c] < 0:
                break
            done[c] = True
            r = int(row_of[c])
            reached.append((r, c, far))
            step = far + cost[r] - u[r] - v
            better = ~done & (step < slack)
            slack[better], via[better] = step[better], c
        u[start] += far
        for r, k, d in reached:
            u[r] += far - d
            v[k] -= far - d
        while via[c] >= 0:
            row_of[c] = row_of[via[c]]
            c = int(via[c])
        row_of[c] = start
    return row_of, u, v


def needs_third(slot: DataFrame) -> DataFrame:
    """Whether the first two samples differ in the presence, role, partition or derivation of any slot."""
    two = slot.where("sample_idx < 2").groupBy("doc_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("role").alias("r"), F.count_distinct("belongs_to").alias("b"), F.count_distinct("is_derived").alias("v"))
    return two.groupBy("doc_id").agg(F.bool_or((F.col("n") != 2) | (F.col("r") > 1) | (F.col("b") > 1) | (F.col("v") > 1)).alias("needs_third"))


def used_samples(slot: DataFrame) -> DataFrame:
    """The rows that vote: two samples, or three where the first two differ."""
    third = needs_third(slot)
    return slot.join(third, "doc_id", "left").where((F.col("sample_idx") < 2) | F.coalesce("needs_third", F.lit(True)))


def _voting(slot: DataFrame) -> DataFrame:
    """``(doc_id, slot, all, rows, samples, present)``: the rows of each slot brought together once, ``rows`` those of samples that vote.

    Whether a document needs its third sample and how many samples vote are windows over its slots.
    """
    row = F.struct("sample_idx", "ord", "value", "unit_key", "role", "belongs_to", "is_derived")
    g = slot.groupBy("doc_id", "slot").agg(F.array_sort(F.collect_list(row)).alias("all"))
    doc = W.partitionBy("doc_id")
    some = F.exists("all", lambda r: r["sample_idx"] < 2)
    g = g.withColumn("_third", F.max(some & _differs(F.col("all"))).over(doc) | ~F.max(some).over(doc))
    g = g.withColumn("rows", F.filter("all", lambda r: (r["sample_idx"] < 2) | F.col("_third")))
    used = F.array_distinct(F.transform("rows", lambda r: r["sample_idx"]))
    return once(g.withColumns({"samples": F.size(F.array_distinct(F.flatten(F.collect_list(used).over(doc)))), "present": F.size(used)}))


def _differs(rows: Column) -> Column:
    """Whether the first two samples differ in the presence, role, partition or derivation of a slot."""
    pair = F.filter(rows, lambda r: r["sample_idx"] < 2)
    kinds = lambda c: F.size(F.array_distinct(F.transform(pair, lambda r: r[c])))
    return (F.size(pair) != 2) | (kinds("role") > 1) | (kinds("belongs_to") > 1) | (kinds("is_derived") > 1)


def _most(c: str, default) -> Column:
    """The value that more than half of the samples give a slot, else the default."""
    held = F.transform("rows", lambda r: r[c])
    won = F.filter(F.array_distinct(held), lambda v: F.size(F.filter(held, lambda x: x.eqNullSafe(v))) * 2 > F.col("samples"))
    return F.when(F.size(won) > 0, F.get(won, F.lit(0))).otherwise(F.lit(default))


def vote(slot: DataFrame) -> DataFrame:
    """Slots present in most samples, with role, partition and derivation by strict majority of all samples.

    Undecided roles and partitions become ``other``; an undecided derivation becomes true, which bars
    the row from geometry.
    """
    g = _voting(slot).where(F.col("present") * 2 > F.col("samples"))
    least = lambda c: F.array_min(F.transform("rows", lambda r: r[c]))
    votes = [_most(c, default).alias(c) for c, default in (("role", "other"), ("belongs_to", "other"), ("is_derived", True))]
    return g.select("doc_id", "slot", F.get("rows", F.lit(0))["value"].alias("value"), least("unit_key").alias("unit"), *votes, "present", "samples", least("ord").alias("first_ord"))


@F.pandas_udf(T.IntegerType())
def _closeness(own: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([sum(similarity(a or "", b or "") for b in bs) for a, bs in zip(own, others)])


def representative_row(slot: DataFrame) -> DataFrame:
    """Of each slot the row that stands for it, among those with the voted role, partition and derivation.

    Where no row has all three, those with role and partition count, and where none has both, all. A
    vote of ``other`` binds no row. Ends that more than half of the voting samples have win, in the
    earliest sample that may stand; else the row most similar to all of the slot, the earliest of equals.
    """
    rows, won = used_samples(slot), vote(slot).select("doc_id", "slot", F.col("role").alias("_role"), F.col("belongs_to").alias("_part"), F.col("is_derived").alias("_derived"), F.col("samples").alias("_n"))
    own = W.partitionBy("doc_id", "slot")
    r = rows.join(won, ["doc_id", "slot"]).withColumns({"same": F.count(F.lit(1)).over(W.partitionBy("doc_id", "slot", "canon")), "others": F.collect_list("canon").over(own)})
    meant = ((F.col("_role") == "other") | (F.col("role") == F.col("_role"))) & ((F.col("_part") == "other") | (F.col("belongs_to") == F.col("_part")))
    tier = F.when(F.coalesce(meant & (F.col("is_derived") == F.col("_derived")), F.lit(False)), 2).when(F.coalesce(meant, F.lit(False)), 1).otherwise(0)
    r = r.withColumn("tier", tier).withColumn("_best", F.max("tier").over(own)).where("tier = _best")
    most = (F.col("same") * 2 > F.col("_n")) & (F.col("canon") != "")
    settled = F.max(most.cast("int")).over(own) == 1
    r = r.withColumns({"most": most, "settled": settled})
    r = r.withColumn("near", F.when(~F.col("settled"), _closeness(F.col("canon"), F.when(~F.col("settled"), F.col("others")).otherwise(F.array().cast("array<string>")))).otherwise(0))
    order = F.struct(F.col("most").cast("int"), "near", -F.col("sample_idx"), -F.col("ord"))
    return r.groupBy("doc_id", "slot").agg(F.max_by(F.struct("sample_idx", "ord", "endpoints"), order).alias("m")).select("doc_id", "slot", "m.sample_idx", "m.ord", "m.endpoints")


def vote_document(sample: DataFrame) -> DataFrame:
    """Family, pin count and land flag by strict majority, paste by any, unmarked roles as an ordered distinct union.

    ``sample(doc_id, sample_idx, family_proposal, pin_count, recommended_land_pattern, paste_evidence, unmarked_roles)``.
    """
    n = sample.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("paste_evidence", F.lit(False))).alias("paste_evidence"), F.array_sort(F.collect_list(F.struct("sample_idx", "unmarked_roles"))).alias("_u"))
    out = n.withColumn("unmarked_roles", F.array_distinct(F.flatten(F.transform("_u", lambda s: s["unmarked_roles"])))).drop("_u")
    for column, default in (("family_proposal", F.lit("other")), ("pin_count", F.lit(None)), ("recommended_land_pattern", F.lit(False))):
        per = sample.groupBy("doc_id", column).agg(F.count(F.lit(1)).alias("_c")).groupBy("doc_id").agg(F.max(F.struct("_c", column)).alias("_m"))
        out = out.join(per, "doc_id").withColumn(column, F.when(F.col("_m._c") * 2 > F.col("n"), F.col(f"_m.{column}")).otherwise(default)).drop("_m")
    return out


def consensus_stats(slot: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Per document how its samples agree, in one aggregate over slots.

    ``initial`` are the slots of the first two samples aligned by themselves; without it, the slots of
    all samples stand for them. ``initial_*`` compare the first two, the other counts are of the vote:
    slots kept and dropped, kept ones whose voting rows differ, roles downgraded to ``other``, and
    kept ones that the first two left open and the vote gave a role.
    """
    count = lambda cond, name: F.count_if(cond).alias(name)
    of = lambda rows, i: F.exists(rows, lambda r: r["sample_idx"] == i)
    kinds = lambda rows, c: F.size(F.array_distinct(F.transform(rows, lambda r: r[c])))
    g = _voting(slot)
    role, kept, roles = _most("role", "other"), F.col("present") * 2 > F.col("samples"), F.transform("rows", lambda r: r["role"])
    g = g.withColumns({"role": role, "kept": kept, "open": _differs(F.col("rows")), "named": F.exists(roles, lambda r: r != "other"), **{f"k_{c}": kinds("rows", c) for c in ("role", "belongs_to", "is_derived")}})
    g = g.where(F.size("rows") > 0)
    votes = g.groupBy("doc_id").agg(
        F.flatten(F.collect_list(F.transform("rows", lambda r: r["sample_idx"]))).alias("_of"),
        F.max("samples").alias("sample_success_count"), F.count(F.lit(1)).alias("aligned_slot_count"), count(F.col("kept"), "consensus_dimension_count"), count(~F.col("kept"), "dropped_no_presence_majority_count"),
        *[count(F.col("kept") & (F.col(f"k_{c}") > 1), name) for c, name in (("role", "role_vote_disagreement_count"), ("belongs_to", "belongs_to_disagreement_count"), ("is_derived", "is_derived_disagreement_count"))],
        count(F.col("kept") & (F.col("role") == "other") & F.col("named"), "downgraded_other_count"), count(F.col("kept") & F.col("open") & (F.col("role") != "other"), "third_sample_majority_resolved_count"),
    )
    two = slot.where("sample_idx < 2") if initial is None else initial
    i = two.groupBy("doc_id", "slot").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "role", "belongs_to", "is_derived"))).alias("rows"))
    both = of("rows", 0) & of("rows", 1)
    differ = lambda c: both & (kinds("rows", c) > 1)
    first = i.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("initial_key_union_count"), count(both & (kinds("rows", "role") == 1), "initial_role_agreement_count"), count(differ("role"), "initial_role_disagreement_count"),
        count(differ("belongs_to"), "initial_belongs_to_disagreement_count"), count(differ("is_derived"), "initial_is_derived_disagreement_count"), count(of("rows", 0) != of("rows", 1), "initial_presence_disagreement_count"),
        count(_differs(F.col("rows")), "initial_disagreement_count"),
    )
    per = F.transform(F.array_sort(F.array_distinct("_of")), lambda x: F.size(F.filter("_of", lambda y: y.eqNullSafe(x))).cast("long"))
    out = votes.withColumn("sample_dimension_counts", per).drop("_of").join(first, "doc_id", "left").withColumn("input_max_sample_dimension_count", F.array_max("sample_dimension_counts"))
    third = F.coalesce(F.col("initial_disagreement_count") > 0, F.lit(True))
    return out.withColumns({
        "requested_base_samples": F.lit(2), "third_sample_triggered": third, "sample_attempt_count": F.when(third, 3).otherwise(2), "consensus_throughput_vs_max_sample": F.col("consensus_dimension_count") / F.col("input_max_sample_dimension_count"),
    })


def token_votes(token: DataFrame, least: int = 2) -> DataFrame:
    """``token(doc_id, sample_idx, token)`` to the tokens that at least two samples have."""
    per = token.groupBy("doc_id", "token").agg(F.count_distinct("sample_idx").alias("samples"))
    return per.withColumn("accepted", F.col("samples") >= least)
