"""Number notation on page lines: classes of lines, value pairs, units, minimum and maximum runs.

Input: ``line(doc_id, page, line_no, norm)`` from ``explode_lines``. Windows are per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms as K
from .pages import declared_units, section_context

# Forms of a line.
NUM = r"(\d+(?:[.,]\d+)?|[.,]\d+)"
QUAL = r"(max(?:imum)?|min(?:imum)?|ref(?:erence)?|typ(?:ical)?)"
UNIT = r"(mm|millimeters?|millimetres?|in(?:ch(?:es)?)?|[\"'])?"
PAIRED = rf"(?i)^\s*(?:(typ(?:ical)?)[\s.:]*)?{NUM}\s*\(\s*{NUM}\s*{UNIT}\s*\)\s*{QUAL}?[\s.]*$"
PAREN_ONLY = rf"(?i)^\s*\(\s*{NUM}\s*{UNIT}\s*\)\s*$"
PLUS_MINUS = rf"^\s*{NUM}\s*\+\s*{NUM}\s*/\s*[-−]\s*{NUM}\s*$"
SYMMETRIC = rf"^\s*{NUM}\s*(?:±|\+\s*/\s*[-−]|\+\s*/\s*)\s*{NUM}\s*$"
PLUS = rf"^\s*{NUM}\s*\+\s*{NUM}\s*$"
MINUS_ONLY = rf"^\s*[-−]\s*{NUM}\s*$"
QUALIFIED = rf"(?i)^\s*{NUM}\s*{QUAL}[\s.]*$"
QUALIFIER_ONLY = rf"(?i)^\s*{QUAL}[\s.]*$"
BARE = rf"^\s*{NUM}(?:\s+(?:[A-Z](?:\s+[A-Z])*))?\s*$"
MULTIPLE = r"×|\d\s*[xX]|[xX]\s*\d"


def by_page():
    """The window over a page's lines in order."""
    return W.partitionBy("doc_id", "page").orderBy("line_no")


def number(text: Column) -> Column:
    """A positive number with either decimal mark, else null."""
    v = F.replace(text, F.lit(","), F.lit(".")).try_cast("decimal(20,6)").cast("double")
    return F.when(v > 0, v)


def classify_lines(line: DataFrame) -> DataFrame:
    """Each line with its category, value, parenthetical value and qualifier; the first form that fits counts.

    A line that only qualifies or only gives the lower tolerance is claimed by the line before it and
    classifies nothing itself; such a line can never claim, so one lag is enough.
    """
    t = F.trim("norm")
    m = lambda p: F.col("_t").rlike(p)
    g = lambda p, i: F.regexp_extract("_t", p, i)
    d = line.withColumn("_t", t).withColumn("_next", F.lead("_t").over(by_page()))
    next_is = lambda p: F.coalesce(F.col("_next").rlike(p), F.lit(False))
    kind = (
        F.when(F.col("_t") == "", None).when(m(MULTIPLE), "excluded").when(m(PLUS_MINUS) | m(SYMMETRIC), "nominal_pm").when(m(PLUS) & next_is(MINUS_ONLY), "split_pm")
        .when(m(QUALIFIED), "qualified").when(m(PAIRED), "paired").when(m(PAREN_ONLY), "paren").when(m(BARE), "bare")
    )
    d = d.withColumn("_k", kind)
    claims = (F.col("_k") == "split_pm") | (F.col("_k").isin("paired", "bare") & next_is(QUALIFIER_ONLY))
    d = d.withColumn("_claims", F.coalesce(claims, F.lit(False))).withColumn("_claimed", F.coalesce(F.lag("_claims").over(by_page()), F.lit(False)))
    d = d.withColumn("_k", F.when(~F.col("_claimed"), F.col("_k")))
    inline = F.concat(g(PAIRED, 5), g(PAIRED, 1))
    qualifier = F.upper(F.when(F.col("_k").isin("paired", "bare") & next_is(QUALIFIER_ONLY), F.regexp_extract("_next", QUALIFIER_ONLY, 1)).when(F.col("_k") == "paired", inline).when(F.col("_k") == "qualified", g(QUALIFIED, 2)).otherwise(""))
    d = d.withColumn("qualifier", qualifier)
    category = F.when(F.col("_k").isin("nominal_pm", "split_pm"), "nominal_pm").when(F.col("_k") == "qualified", "qualifier").when(F.col("_k").isin("paired", "bare"), F.when(F.col("qualifier") != "", "qualifier").otherwise("bare")).otherwise(F.col("_k"))
    value = (
        F.when(m(PLUS_MINUS), g(PLUS_MINUS, 1)).when(m(SYMMETRIC), g(SYMMETRIC, 1)).when(F.col("_k") == "split_pm", g(PLUS, 1)).when(F.col("_k") == "qualified", g(QUALIFIED, 1))
        .when(F.col("_k") == "paired", g(PAIRED, 2)).when(F.col("_k") == "bare", g(BARE, 1))
    )
    paren = F.when(F.col("_k") == "paired", g(PAIRED, 3)).when(F.col("_k") == "paren", g(PAREN_ONLY, 1))
    out = d.withColumns({"category": category, "value": number(value), "paren_value": number(paren)})
    return out.withColumn("accepted", F.col("category").isin("nominal_pm", "bare") & F.col("value").isNotNull()).select("doc_id", "page", "line_no", "norm", F.col("_k").alias("form"), "category", "value", "paren_value", "qualifier", "accepted")


def notation_summary(token: DataFrame) -> DataFrame:
    """Lines of each category and accepted ones, per page."""
    t = token.where("category is not null")
    return t.groupBy("doc_id", "page").agg(*[F.count_if(F.col("category") == c).alias(c) for c in ("nominal_pm", "qualifier", "bare", "paren", "excluded")], F.count_if(F.coalesce("accepted", F.lit(False))).alias("accepted"))


def pair_values(token: DataFrame) -> DataFrame:
    """Outer and parenthetical values that stand for each other: in one line, on the next line, or by ordinal in two runs of one length.

    Runs are islands of bare or of parenthetical lines. A run pairs with the run after it if both
    have at least two lines; of a longer first run the last lines pair, and a run that has been
    paired as the second is used up. Only that is sequential: it is folded over the runs of a page.
    """
    inline = token.where("form = 'paired'").select("doc_id", "page", F.col("line_no").alias("outer_line"), F.col("line_no").alias("paren_line"), F.col("value").alias("outer"), F.col("paren_value").alias("paren"), F.lit("inline").alias("mode"))
    nxt = lambda c: F.lead(c).over(by_page())
    t = token.withColumns({"_nk": nxt("form"), "_nl": nxt("line_no"), "_np": nxt("paren_value")})
    beside = t.where("form in ('bare', 'nominal_pm', 'qualified') and _nk = 'paren'").select("doc_id", "page", F.col("line_no").alias("outer_line"), F.col("_nl").alias("paren_line"), F.col("value").alias("outer"), F.col("_np").alias("paren"), F.lit("interleaved").alias("mode"))
    kind = F.when(F.col("norm").rlike(BARE), "b").when(F.col("norm").rlike(PAREN_ONLY), "p")
    r = token.withColumn("_k", kind).withColumn("_new", F.when(F.col("_k").eqNullSafe(F.lag("_k").over(by_page())), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by_page()))
    v = F.when(F.col("_k") == "b", number(F.regexp_extract("norm", BARE, 1))).otherwise(number(F.regexp_extract("norm", PAREN_ONLY, 1)))
    runs = r.where("_k is not null").groupBy("doc_id", "page", "_run", "_k").agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("n"), v.alias("v")))).alias("x"))
    seq = runs.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(F.col("_run").alias("r"), F.col("_k").alias("k"), "x"))).alias("s"))
    zero = F.struct(F.lit(False).alias("used"), F.array().cast("array<struct<a:struct<r:bigint,k:string,x:array<struct<n:int,v:double>>>,b:struct<r:bigint,k:string,x:array<struct<n:int,v:double>>>>>").alias("pairs"))

    def step(acc: Column, i: Column) -> Column:
        a, b = F.get("s", i), F.get("s", i + 1)
        fits = ~acc["used"] & (a["r"] + 1 == b["r"]) & (a["k"] != b["k"]) & (F.size(b["x"]) >= 2) & (F.size(a["x"]) >= F.size(b["x"]))
        return F.struct(F.coalesce(fits, F.lit(False)).alias("used"), F.when(F.coalesce(fits, F.lit(False)), F.concat(acc["pairs"], F.array(F.struct(a.alias("a"), b.alias("b"))))).otherwise(acc["pairs"]).alias("pairs"))

    folded = seq.withColumn("f", F.aggregate(F.when(F.size("s") > 1, F.sequence(F.lit(0), F.size("s") - 2)).otherwise(F.array().cast("array<int>")), zero, step)).select("doc_id", "page", F.explode("f.pairs").alias("p"))
    z = folded.select("doc_id", "page", F.col("p.a.k").alias("k"), F.inline(F.arrays_zip(F.slice("p.a.x", F.size("p.a.x") - F.size("p.b.x") + 1, F.size("p.b.x")).alias("a"), F.col("p.b.x").alias("b"))))
    outer, paren = (F.when(F.col("k") == side, F.col("a")).otherwise(F.col("b")) for side in ("b", "p"))
    grouped = z.select("doc_id", "page", outer.getField("n").alias("outer_line"), paren.getField("n").alias("paren_line"), outer.getField("v").alias("outer"), paren.getField("v").alias("paren"), F.lit("grouped_by_ordinal").alias("mode"))
    first = inline.unionByName(beside)
    new = grouped.join(first, ["doc_id", "page", "outer_line", "paren_line"], "left_anti").select(*first.columns)
    return first.unionByName(new).where("outer is not null and paren is not null").withColumn("direction", ratio_direction())


def ratio_direction() -> Column:
    """Which of two values is in millimetres, by a ratio within 1 % of 25.4; null for neither."""
    off = lambda r: F.abs(r - 25.4) / 25.4 <= K.UNIT_RATIO_TOL
    return F.when(off(F.col("outer") / F.col("paren")), "outer_mm_paren_in").when(off(F.col("paren") / F.col("outer")), "outer_in_paren_mm")


def resolve_units(page: DataFrame, pair: DataFrame) -> DataFrame:
    """Whether a page's header and its value ratios agree on one direction."""
    u = declared_units(page)
    n = page.select("doc_id", "page", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\([^)\n]*\d[^)\n]*\)")).alias("parens"))
    seen = pair.where("direction is not null").groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("direction")).alias("d"))
    want = F.when((F.col("outer_unit") == "mm") & (F.col("paren_unit") == "in"), "outer_mm_paren_in").when((F.col("outer_unit") == "in") & (F.col("paren_unit") == "mm"), "outer_in_paren_mm")
    j = u.join(n, ["doc_id", "page"]).join(seen, ["doc_id", "page"], "left").withColumn("expected", want)
    ok = F.col("expected").isNotNull() & (F.size("d") == 1) & F.array_contains("d", F.col("expected"))
    return j.select("doc_id", "page", "outer_unit", "paren_unit", "expected", F.when(F.col("parens") == 0, "not_applicable").when(F.coalesce(ok, F.lit(False)), "resolved").otherwise("unresolved").alias("status"))


def accepted_values(page: DataFrame, line: DataFrame) -> DataFrame:
    """Lines with ``value_mm``; a parenthetical metric value replaces the outer one only where units are resolved and its pair agrees."""
    token = classify_lines(line)
    pair = pair_values(token)
    u = resolve_units(page, pair)
    agreed = pair.where("mode = 'inline'").select("doc_id", "page", F.col("outer_line").alias("line_no"), F.col("direction").alias("_d"))
    j = token.join(u.select("doc_id", "page", "outer_unit", "paren_unit", "expected", "status"), ["doc_id", "page"]).join(agreed, ["doc_id", "page", "line_no"], "left")
    factor = F.when(F.col("outer_unit") == "mm", 1.0).when(F.col("outer_unit") == "in", 25.4)
    paren_ok = (F.col("status") == "resolved") & (F.col("_d") == F.col("expected")) & (F.col("category") == "bare")
    mm = F.when(paren_ok & (F.col("paren_unit") == "mm"), F.col("paren_value")).otherwise(F.col("value") * factor)
    return j.select("doc_id", "page", "line_no", "category", "accepted", F.round(mm, 6).alias("value_mm"), F.coalesce(paren_ok, F.lit(False)).alias("paren_accepted"))


def extract_bounds(page: DataFrame, line: DataFrame) -> DataFrame:
    """Descending pairs of neighbouring values in package sections: the longest unbroken chain of either parity, two pairs at least.

    One chain per run; of equal chains the first, and parity 0 before 1.
    """
    v = accepted_values(page, line).where("category = 'bare' and accepted and value_mm is not null").select("doc_id", "page", "line_no", "value_mm")
    s = section_context(line).select("doc_id", "page", "line_no", "section")
    atoms = v.join(s, ["doc_id", "page", "line_no"]).where("section = 'package_outline'")
    a = atoms.withColumn("_run", F.col("line_no") - F.row_number().over(by_page()))
    run = W.partitionBy("doc_id", "page", "_run")
    a = a.withColumns({"_start": F.min("line_no").over(run), "_next": F.lead("value_mm").over(run.orderBy("line_no"))})
    a = a.withColumn("parity", ((F.col("line_no") - F.col("_start")) % 2).cast("int")).withColumn("ok", F.coalesce(F.col("value_mm") > F.col("_next") + 1e-12, F.lit(False)))
    side = W.partitionBy("doc_id", "page", "_run", "parity").orderBy("line_no")
    a = a.withColumn("_chain", F.sum((~F.col("ok")).cast("int")).over(side)).where("ok")
    chain = a.groupBy("doc_id", "page", "_run", "parity", "_chain").agg(F.count(F.lit(1)).alias("pairs"), F.min("line_no").alias("_first"))
    best = chain.withColumn("r", F.row_number().over(W.partitionBy("doc_id", "page", "_run").orderBy(F.desc("pairs"), "parity", "_first"))).where("r = 1 and pairs >= 2")
    out = a.join(best.select("doc_id", "page", "_run", "parity", "_chain", "pairs"), ["doc_id", "page", "_run", "parity", "_chain"])
    return out.select("doc_id", "page", F.col("line_no").alias("max_line"), (F.col("line_no") + 1).alias("min_line"), F.col("value_mm").alias("max_mm"), F.col("_next").alias("min_mm"), F.col("pairs").cast("int").alias("block_pair_count"))


def dedup_bounds(bound: DataFrame, tol: float = K.CONSISTENT) -> DataFrame:
    """Of the bounds on one pair of lines, those whose maxima and minima both lie within ``tol`` are one.

    ``bound(doc_id, page, pos, max_line, min_line, max_mm, min_mm, source_unit)``. A scan in the order
    of ``pos``: a bound joins the first kept one that it is near to, so clusters depend on the order
    and never chain; a metric bound takes the place of one in another unit, where it stands.
    ``place`` is the place among the kept bounds of the pair of lines. Null lines form a pair of
    their own; a bound with a null value is near to none.
    """
    key = ["doc_id", "page", "max_line", "min_line"]
    g = bound.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "max_mm", "min_mm", "source_unit"))).alias("all"))
    near = lambda a, b: F.coalesce((F.abs(a["max_mm"] - b["max_mm"]) <= tol + 1e-12) & (F.abs(a["min_mm"] - b["min_mm"]) <= tol + 1e-12), F.lit(False))
    metric = lambda a: F.coalesce(a["source_unit"] == "mm", F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: near(k, x)), F.lit(True))
        swapped = F.transform(kept, lambda k, i: F.when((i == at - 1) & ~metric(k) & metric(x), x).otherwise(k))
        return F.when(at == 0, F.concat(kept, F.array(x))).otherwise(swapped)

    none = F.slice("all", 1, 0)
    rows = g.select(*key, F.posexplode(F.aggregate("all", none, step)).alias("place", "b"))
    return rows.select(*key, "place", "b.pos", "b.max_mm", "b.min_mm", "b.source_unit")


def fold_bounds(dimension: DataFrame, bound: DataFrame, tol: float = K.PROVENANCE_TOL) -> DataFrame:
    """Two neighbouring rows of one partition at a bound's maximum and minimum become one row at the maximum.

    Bounds come in the order of their pages and lines. Each folds in every partition the first pair
    of rows that no earlier bound has used; derived rows neither fold nor are used. The role of both
    stays, else it is ``other`` and the first row's own is kept in ``role_original``. One scan over
    the hits of a partition, which carries the rows used so far.
    """
    own = F.coalesce("is_derived", F.lit(False)) if "is_derived" in dimension.columns else F.lit(False)
    w = W.partitionBy("doc_id").orderBy("ord")
    d = dimension.withColumn("_own", ~own)
    d = d.withColumns({n: F.lead(c).over(w) for n, c in (("_n", "value_mm"), ("_o", "ord"), ("_r", "role"), ("_p", "belongs_to"), ("_f", "_own"))})
    bucket = lambda c: F.floor(F.col(c) / (2 * tol))
    pairs = d.where((F.col("_o") == F.col("ord") + 1) & (F.col("_p") == F.col("belongs_to")) & F.col("_own") & F.col("_f")).withColumn("_b", bucket("value_mm"))
    page = F.col("page") if "page" in bound.columns else F.lit(0)
    b = bound.select("doc_id", F.struct(page.alias("page"), "max_line", F.col("max_mm").alias("hi"), F.col("min_mm").alias("lo")).alias("bound"), F.explode(F.array(*[bucket("max_mm") + i for i in (-1, 0, 1)])).alias("_b"))
    hit = pairs.join(b, ["doc_id", "_b"]).where((F.abs(F.col("value_mm") - F.col("bound.hi")) <= tol + 1e-12) & (F.abs(F.col("_n") - F.col("bound.lo")) <= tol + 1e-12))
    role = F.when(F.col("role") == F.col("_r"), F.col("role")).otherwise("other")
    kept = F.when((role == "other") & (F.col("role") != "other"), F.col("role"))
    g = hit.groupBy("doc_id", "belongs_to").agg(F.array_sort(F.collect_set(F.struct("bound", "ord", role.alias("role"), kept.alias("role_original")))).alias("hits"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.slice("hits", 1, 0).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        o = x["ord"].cast("int")
        again = F.exists(acc["out"], lambda y: y["bound"] == x["bound"])
        free = ~again & ~F.array_contains(acc["used"], o) & ~F.array_contains(acc["used"], o + 1)
        return F.struct(F.when(free, F.concat(acc["used"], F.array(o, o + 1))).otherwise(acc["used"]).alias("used"), F.when(free, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    done = g.select("doc_id", "belongs_to", F.explode(F.aggregate("hits", start, step)["out"]).alias("x"))
    folded = done.select("doc_id", "belongs_to", F.col("x.ord").alias("ord"), "x.role", F.col("x.bound.hi").alias("value_mm"), "x.role_original", F.lit(True).alias("folded"))
    eaten = folded.select("doc_id", "belongs_to", F.explode(F.array(F.col("ord"), F.col("ord") + 1)).alias("ord"))
    before = F.col("role_original") if "role_original" in dimension.columns else F.lit(None).cast("string")
    rest = dimension.join(eaten, ["doc_id", "belongs_to", "ord"], "left_anti").select("doc_id", "belongs_to", "ord", "role", "value_mm", before.alias("role_original"), F.lit(False).alias("folded"))
    return rest.unionByName(folded)


def demote_pairs(folded: DataFrame) -> DataFrame:
    """Of several folded rows for one body role the smallest keeps it, the others become ``other``."""
    n = F.row_number().over(W.partitionBy("doc_id", "role", "folded").orderBy("value_mm", "ord"))
    many = F.col("folded") & F.col("role").startswith("body") & (F.col("_n") > 1)
    return folded.withColumn("_n", n).withColumn("role", F.when(many, "other").otherwise(F.col("role"))).drop("_n")


def page_numbers(page: DataFrame) -> DataFrame:
    """Numbers of a page in their order, each once, with a point for a comma."""
    text = F.coalesce("text", F.lit(""))
    found = F.regexp_extract_all(text, F.lit(r"[0-9]+[.,][0-9]+|\.[0-9]+|[0-9]+"), F.lit(0))
    return page.select("doc_id", "page", F.posexplode(F.array_distinct(F.transform(found, lambda x: F.translate(x, ",", ".")))).alias("pos", "token"))


def page_runs(page: DataFrame) -> DataFrame:
    """Longest runs of digits, points and commas of a page, each once; runs after a sign also with it."""
    text = F.coalesce("text", F.lit(""))
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return page.select("doc_id", "page", F.explode(F.array_distinct(F.concat(found(r"[\p{Nd}.,]+"), found(r"[+-][\p{Nd}.,]+")))).alias("token"))


def anchor(dimension: DataFrame, page: DataFrame) -> DataFrame:
    """Whether a dimension's verbatim value stands on one of the document's pages, and on how many.

    No digit, point or comma may touch the value; letters may ("1.27mm"). A signed value may follow a number.
    """
    hits = dimension.select("doc_id", "ord", F.col("value").alias("token")).join(page_runs(page), ["doc_id", "token"]).groupBy("doc_id", "ord").agg(F.count_distinct("page").alias("pages"))
    return dimension.select("doc_id", "ord", "value").join(hits, ["doc_id", "ord"], "left").withColumn("pages", F.coalesce("pages", F.lit(0))).withColumn("anchored", F.col("pages") > 0)


def decimal_extension(dimension: DataFrame, page: DataFrame) -> DataFrame:
    """Decimal values without a number of equal size where a number extends their decimals by more digits; the first as evidence."""
    whole = lambda c: F.regexp_extract(c, r"^0*([0-9]*)", 1)
    tokens = page_numbers(page).withColumn("_i", whole("token"))
    d = dimension.withColumn("_v", F.translate(F.trim("value"), ",", ".")).where(F.col("_v").rlike(r"^[0-9]*\.[0-9]+$"))
    d = d.select("doc_id", "ord", "_v", whole("_v").alias("_i"))
    number = lambda c: F.regexp_replace(F.regexp_replace(F.concat(F.col(c), F.when(F.contains(c, F.lit(".")), "").otherwise(".")), "0+$", ""), r"^0+", "")
    equal = number("token") == number("_v")
    extends = F.startswith(F.col("token"), F.col("_v")) & (F.length("token") > F.length("_v")) & ~equal
    j = d.join(tokens, ["doc_id", "_i"])
    g = j.groupBy("doc_id", "ord").agg(F.bool_or(equal).alias("equal"), F.min(F.when(extends, F.struct("page", "pos", "token"))).alias("x"))
    return g.where("not equal and x is not null").select("doc_id", "ord", "x.page", "x.token")


def anchor_used(value: DataFrame, dimension: DataFrame, page: DataFrame, tol: float = K.PROVENANCE_TOL) -> DataFrame:
    """``value(doc_id, field, value_mm)``: whether any dimension of the same value (within ``tol``) stands verbatim on a page; null without one."""
    a = anchor(dimension, page).select("doc_id", "ord", "anchored").join(dimension.select("doc_id", "ord", "value_mm"), ["doc_id", "ord"])
    width = 2 * tol
    bucket = F.floor(F.col("value_mm") / width)
    v = value.select("doc_id", "field", F.col("value_mm").alias("_v"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    hit = v.join(a.withColumn("_b", F.floor(F.col("value_mm") / width)), ["doc_id", "_b"]).where(F.abs(F.col("value_mm") - F.col("_v")) <= tol + 1e-12)
    per = hit.groupBy("doc_id", "field").agg(F.bool_or("anchored").alias("anchored"))
    return value.select("doc_id", "field").join(per, ["doc_id", "field"], "left")


def apply_decimal_guard(value: DataFrame, dimension: DataFrame, suspicion: DataFrame) -> DataFrame:
    """Fields whose source value looks cut off are blanked, with the source text kept; all others stay.

    ``value(doc_id, field, ord, value_mm)``: ord is the dimension that a field came from.
    """
    j = value.join(suspicion.select("doc_id", "ord", F.col("token").alias("extends_to")), ["doc_id", "ord"], "left").join(dimension.select("doc_id", "ord", F.col("value").alias("source_text")), ["doc_id", "ord"], "left")
    bad = F.col("extends_to").isNotNull()
    return j.select("doc_id", "field", F.when(~bad, F.col("value_mm")).alias("value_mm"), "source_text", bad.alias("suspicious"), "extends_to")
