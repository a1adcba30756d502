"""Page text scoring and ranking: rows of pages in, decisions out. Nothing here shuffles by text.

Inputs are ``page(doc_id, page, text[, heading])``. A null text counts as empty everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms as K
from ..functions.text import any_of, lines_of, names, nfkc, normalize, once, stem_hits, term_hits, total

HEADING_LINES, SUGGESTIONS, RADIUS = 12, 3, 12


def explode_lines(page: DataFrame) -> DataFrame:
    """``(doc_id, page, line_no, raw, norm)``, line numbers from 1; norm is NFKC, squeezed."""
    raw = page.select("doc_id", "page", F.posexplode(lines_of(F.col("text"))).alias("_p", "raw"))
    return raw.select("doc_id", "page", (F.col("_p") + 1).alias("line_no"), "raw", normalize(F.col("raw"), "nfkc").alias("norm"))


def _full_lines(text: Column) -> Column:
    return F.filter(F.transform(lines_of(text), lambda x: normalize(x, "lower")), lambda x: x != "")


def term_counts(page: DataFrame, terms) -> DataFrame:
    """``(doc_id, page, term, n)`` for the terms that a page holds."""
    p = once(page.select("doc_id", "page", normalize(F.col("text"), "lower").alias("_t")))
    return p.select("doc_id", "page", F.inline(term_hits(F.col("_t"), tuple(dict.fromkeys(terms)))).alias("term", "n"))


def stem_counts(page: DataFrame) -> DataFrame:
    """T4: counts of the three stem patterns."""
    return page.select("doc_id", "page", *[F.regexp_count(F.coalesce("text", F.lit("")), F.lit("(?iU)" + p)).cast("long").alias(k) for k, p in K.STEMS.items()])


def _median(sizes: Column) -> Column:
    n = F.size(sizes)
    s = F.array_sort(sizes)
    mid = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0
    return F.when(n == 0, 0.0).otherwise(mid)


def page_shape(page: DataFrame) -> DataFrame:
    """T5: median length of non-empty lines, words, and whether the page is prose."""
    out = page.select("doc_id", "page", F.transform(_full_lines(F.col("text")), lambda x: F.char_length(x)).alias("_s"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?U)\b\w+\b")).cast("long").alias("word_count"))
    out = out.withColumn("median_line_length", _median(F.col("_s")))
    return out.select("doc_id", "page", "median_line_length", "word_count", ((F.col("median_line_length") >= 20) | (F.col("word_count") >= 400)).alias("prose_page"))


def _heading(text: Column) -> Column:
    full = F.transform(_full_lines(text), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    top = F.filter(full, lambda s: (s["i"] < HEADING_LINES) | s["x"].rlike("(?iU)" + K.CAPTION))
    return F.array_join(F.array_distinct(F.transform(top, lambda s: s["x"])), "\n")


def infer_heading(page: DataFrame) -> DataFrame:
    """The first twelve non-empty lines and every caption, distinct, in order."""
    return page.select("doc_id", "page", _heading(F.col("text")).alias("heading"))


def heading_from_blocks(page: DataFrame, block: DataFrame) -> DataFrame:
    """Lines of blocks in the top 28 % of the page and captions, in block order; T6 where there are none.

    ``block(doc_id, page, block_no, y0, page_height, text)``; a page height of zero counts as one.
    """
    line = F.explode(F.transform(_full_lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), x.alias("x"))))
    rows = block.select("doc_id", "page", "block_no", (F.col("y0") <= 0.28 * F.when(F.col("page_height") == 0, 1.0).otherwise(F.col("page_height"))).alias("top"), line.alias("s"))
    rows = rows.where(F.col("top") | F.col("s.x").rlike("(?iU)" + K.CAPTION))
    found = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block_no", F.col("s.i").alias("i"), F.col("s.x").alias("x")))).alias("_l"))
    joined = page.select("doc_id", "page", "text").join(found, ["doc_id", "page"], "left")
    by_place = F.array_join(F.array_distinct(F.transform("_l", lambda s: s["x"])), "\n")
    return joined.select("doc_id", "page", F.coalesce(by_place, _heading(F.col("text"))).alias("heading"))


def score_pages(page: DataFrame) -> DataFrame:
    """Score, class, veto and the terms behind them, one row per page and no shuffle.

    A ``heading`` column is used where there is one and it is not null, else the inferred heading.
    """
    land = tuple(dict.fromkeys((*K.BASE_LAND_TERMS, *K.ADDED_LAND_TERMS)))
    heading = F.coalesce(F.col("heading"), _heading(F.col("text"))) if "heading" in page.columns else _heading(F.col("text"))
    p = once(page.select("doc_id", "page", "text", heading.alias("_h")))
    p = once(p.withColumns({"_t": normalize(F.col("text"), "lower"), "_hn": normalize(F.col("_h"), "lower")}))
    p = p.withColumns(
        {
            "_land": term_hits(F.col("_t"), land), "_dim": term_hits(F.col("_t"), K.DIMENSION_TERMS),
            "_head": names(term_hits(F.col("_hn"), tuple(dict.fromkeys((*land, *K.DIMENSION_TERMS))))),
            "_stem": stem_hits(F.col("text"), K.STEMS), "_hstem": names(stem_hits(F.col("_h"), K.STEMS)),
            "_bad": names(term_hits(F.col("_t"), K.FORBIDDEN_TERMS)),
        }
    )
    p = once(p.drop("text", "_h", "_t", "_hn"))
    lits = lambda xs: F.array(*map(F.lit, xs))
    p = p.withColumns({"_heads": F.concat("_head", "_hstem"), "_amb": F.array_intersect(names(F.col("_land")), lits(K.AMBIGUOUS_LAND_TERMS))})
    back = F.when(F.size("_dim") > 0, F.array_intersect("_amb", "_head")).otherwise(F.array().cast("array<string>"))
    p = p.withColumn("_eff", F.concat(F.array_except(names(F.col("_land")), lits(K.AMBIGUOUS_LAND_TERMS)), back, names(F.col("_stem"))))
    added = F.filter("_land", lambda x: F.array_contains(lits(K.ADDED_LAND_TERMS), x["term"]))
    p = once(p)
    raw = 20 * total(added) + 10 * (total(F.col("_land")) - total(added) + total(F.col("_stem"))) + 3 * total(F.col("_dim")) + 4 * F.size("_heads")
    p = p.withColumns({"_raw": raw, "vetoed": (F.size("_bad") > 0) & (F.size("_heads") == 0)})
    score = F.when(F.col("vetoed"), 0).when(F.size("_bad") > 0, F.greatest(F.lit(1), F.col("_raw") - 2 * F.size("_bad"))).otherwise(F.col("_raw"))
    kind = F.when(F.size("_eff") > 0, "land").when(F.size("_dim") > 0, "dimension").otherwise("none")
    return p.select(
        "doc_id", "page", score.cast("long").alias("score"), kind.alias("page_class"), "vetoed",
        F.array_sort(names(F.col("_land"))).alias("land_terms"), F.array_sort(names(F.col("_dim"))).alias("dimension_terms"),
        F.array_sort("_heads").alias("heading_terms"), F.array_sort("_bad").alias("forbidden_terms"),
        F.array_sort("_eff").alias("effective_land_terms"), F.array_sort("_amb").alias("ambiguous_land_terms"),
        F.array_sort(names(F.col("_stem"))).alias("stem_terms"),
    )


def class_rank(kind: Column) -> Column:
    return F.when(kind == "land", 2).when(kind == "dimension", 1).otherwise(0)


def rank_pages(decision: DataFrame, k: int = SUGGESTIONS) -> DataFrame:
    """The ``k`` best pages of each document by class, score and page. The window is per document: its pages only."""
    order = W.partitionBy("doc_id").orderBy(class_rank(F.col("page_class")).desc(), F.col("score").desc(), "page")
    ok = decision.where((F.col("score") > 0) & ~F.col("vetoed"))
    return ok.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", "page", "score", "page_class", "rank")


def fallback_pages(page: DataFrame, ranked: DataFrame, k: int = SUGGESTIONS) -> DataFrame:
    """Pages 1..k, flagged with the reason, for documents without a ranked page."""
    docs = page.groupBy("doc_id").agg(F.count("text").alias("n"))
    none = docs.join(ranked.select("doc_id"), "doc_id", "left_anti")
    reason = F.when(F.col("n") > 0, "no_positive_page_after_veto").otherwise("pdf_parse_error")
    return none.select("doc_id", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.lit(1), F.col("n").cast("int"))))).alias("page"), reason.alias("fallback_reason"))


def suggest(page: DataFrame, k: int = SUGGESTIONS) -> DataFrame:
    """Per document the page count, parse status, whether any suggestion is a land page, and the suggestions; pages are scored once, the fallback of T10 fills the rest."""
    picks = rank_pages(score_pages(page), k).groupBy("doc_id").agg(F.bool_or(F.col("page_class") == "land").alias("land"), F.array_sort(F.collect_list(F.struct("rank", "page"))).alias("_p"))
    docs = page.groupBy("doc_id").agg(F.count("text").alias("page_count"))
    spare = F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.lit(1), F.col("page_count").cast("int"))))
    pages = F.coalesce(F.transform("_p", lambda s: s["page"].cast("string")), F.transform(spare, lambda i: i.cast("string")))
    return docs.join(picks, "doc_id", "left").select("doc_id", "page_count", F.when(F.col("page_count") > 0, "ok").otherwise("pdf_parse_error").alias("parse_status"), F.coalesce("land", F.lit(False)).alias("has_land_signal"), F.array_join(pages, ",").alias("pages"))


def select_page(page: DataFrame) -> DataFrame:
    """The best page of each document, or none: ``pending_model`` or ``no_candidate``."""
    best = rank_pages(score_pages(page), 1).select("doc_id", F.col("page").alias("selected_page"), "page_class")
    docs = page.select("doc_id").distinct()
    return docs.join(best, "doc_id", "left").withColumn("status", F.when(F.col("selected_page").isNull(), "no_candidate").otherwise("pending_model"))


def extract_tokens(page: DataFrame) -> DataFrame:
    """``(doc_id, page, ord, token, kind)`` of package tokens; the first pattern and place of a token count."""
    p = page.select("doc_id", "page", nfkc(F.coalesce("text", F.lit(""))).alias("_t"))

    def found(no: int, kind: str, pattern: str, group: int) -> Column:
        lead = F.lit("CASE" if kind == "case_code" else "")
        token = lambda x: F.regexp_replace(F.upper(F.concat(lead, x)), r"[\s_]+", "")
        hits = F.regexp_extract_all("_t", F.lit(pattern), F.lit(group))
        return F.transform(hits, lambda x, i: F.struct((F.lit(no * 100_000) + i).alias("at"), token(x).alias("token"), F.lit(kind).alias("kind")))

    arrays = [found(no, *p) for no, p in enumerate(K.TOKEN_PATTERNS)]
    rows = p.select("doc_id", "page", F.inline(F.concat(*arrays))).where((F.col("token") != "") & ~F.col("token").isin(*K.TOKEN_STOPS))
    first = rows.groupBy("doc_id", "page", "token").agg(F.min(F.struct("at", "kind")).alias("m"))
    return first.select("doc_id", "page", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("m.at")).alias("ord"), "token", "m.kind")


def token_occurs(token: Column, text: Column) -> Column:
    """Two to five letters need boundaries; anything else may stand anywhere in the text without spaces."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    bounded = F.regexp_like(upper, F.concat(F.lit("(^|[^A-Z0-9])"), token, F.lit("($|[^A-Z0-9])")))
    return F.when(token.rlike("^[A-Z]{2,5}$"), bounded).otherwise(F.contains(F.regexp_replace(upper, r"[\s_]+", ""), token))


def body_page_score(page: DataFrame) -> DataFrame:
    """Four for each body term a page has, minus eight for each term of other pages."""
    low = F.lower(nfkc(F.coalesce("text", F.lit(""))))
    p = page.select("doc_id", "page", "text", low.alias("_t"))
    n = lambda terms: F.size(term_hits(F.col("_t"), terms))
    return p.select("doc_id", "page", "text", (4 * n(K.BODY_TERMS) - 8 * n(K.NON_BODY_TERMS)).cast("long").alias("body_score"))


def companion_page(page: DataFrame, chosen: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each chosen land page the body page that shares a package token.

    ``chosen(doc_id, land_page)``. Within ``radius`` pages and with a positive body score; preceding
    pages first, then the nearest, then the better. Else the page before, where there are tokens: a
    binding is still required. Else no page is safe.
    """
    land = chosen.join(page.select("doc_id", F.col("page").alias("land_page"), "text"), ["doc_id", "land_page"], "left").select("doc_id", F.col("land_page").alias("page"), "text")
    tokens = extract_tokens(land).select("doc_id", F.col("page").alias("land_page"), "token")
    scored = body_page_score(page)
    near = tokens.join(scored, "doc_id").where((F.abs(F.col("page") - F.col("land_page")) <= radius) & (F.col("page") != F.col("land_page")) & (F.col("body_score") > 0) & token_occurs(F.col("token"), F.col("text")))
    per = near.groupBy("doc_id", "land_page", "page").agg(F.max("body_score").alias("s"), F.array_sort(F.collect_set("token")).alias("matched"))
    better = F.struct((F.col("page") < F.col("land_page")).cast("int").alias("before"), (-F.abs(F.col("page") - F.col("land_page"))).alias("near"), "s", (-F.col("page")).alias("p"), "matched")
    best = per.groupBy("doc_id", "land_page").agg(F.max(better).alias("b"))
    has = tokens.groupBy("doc_id", "land_page").agg(F.count(F.lit(1)).alias("tokens"))
    prev = page.select("doc_id", (F.col("page") + 1).alias("land_page"), F.lit(True).alias("has_prev"))
    out = chosen.join(best, ["doc_id", "land_page"], "left").join(has, ["doc_id", "land_page"], "left").join(prev, ["doc_id", "land_page"], "left")
    bind = F.col("tokens").isNotNull() & F.col("has_prev").isNotNull()
    status = F.when(F.col("b").isNotNull(), "selected_text_bound").when(bind, "selected_model_binding_required").otherwise("no_safe_page")
    body = F.when(F.col("b").isNotNull(), -F.col("b.p")).when(bind, F.col("land_page") - 1)
    return out.select("doc_id", "land_page", status.alias("status"), body.cast("int").alias("body_page"), F.array_join("b.matched", ",").alias("matched"))


# Marks of lands and of paste in texts without blanks and joiners, phrases of exposed pads, names of their roles.
LAND_MARKS = ("solderland", "solderlands", "copperland", "copperpad", "landcenter", "铜箔", "铜焊盘")
PASTE_MARKS = ("solderpaste", "pasteopening", "stencil", "cream", "钢网", "焊膏", "锡膏", "はんだ")
EP_PHRASES = ("exposed thermal pad", "exposed die pad", "exposed pad", "thermal pad", "e-pad")
EP_ROLES = (
    "center_pad_width", "center_pad_length", "center_pad_height", "optional_center_pad_width", "optional_center_pad_length", "optional_center_pad_height",
    "thermal_pad_width", "thermal_pad_length", "thermal_pad_height", "exposed_pad_width", "exposed_pad_length", "exposed_pad_height",
)
# Words of the two ways of soldering, and of parts that carry heat.
REFLOW, WAVE = r"re[\s-]*flow|回流", r"wave|波峰"
THERMAL_MARKS = ("thermal pad", "exposed pad", "exposed", "heat sink", "heatsink", "exposed die pad", "powerpad", "epad", "散热焊盘", "散热片", "中央焊盘", "中心焊盘")


def compact(text: Column) -> Column:
    """A text in lower case without blanks and joiners, as marks are looked for."""
    return F.regexp_replace(normalize(text, "folded"), r"[\s_\-:/()]+", "")


def comention(page: DataFrame) -> DataFrame:
    """Whether a page names land and paste, and reflow and wave soldering."""
    p = once(page.select("doc_id", "page", normalize(F.col("text"), "folded").alias("_t")))
    p = p.withColumn("_c", F.regexp_replace("_t", r"[\s_\-:/()]+", ""))
    both = any_of(F.col("_c"), LAND_MARKS) & any_of(F.col("_c"), PASTE_MARKS)
    return p.select("doc_id", "page", both.alias("land_and_paste"), (F.col("_t").rlike(REFLOW) & F.col("_t").rlike(WAVE)).alias("reflow_and_wave"))


def thermal_evidence(dimension: DataFrame) -> DataFrame:
    """``(doc_id, ord)`` of the rows whose role, raw text or ends name a part that carries heat."""
    texts = [normalize(F.col(c), "folded") for c in ("role", "raw", "endpoints") if c in dimension.columns]
    return dimension.withColumn("_t", F.concat_ws(" ", *texts)).where(any_of(F.col("_t"), THERMAL_MARKS)).select("doc_id", "ord")


def ep_evidence(page: DataFrame, dimension: DataFrame) -> DataFrame:
    """Per document the first exposed-pad phrase of its first page with one, else the first dimension with such a role.

    A role counts in the wording of ``role`` or, where there is that column, ``role_original``; a tab
    of a land whose symbol is X2 or Y2 is an optional center pad.
    """
    p = page.select("doc_id", "page", normalize(F.col("text"), "folded").alias("_t"))
    phrase = F.coalesce(*[F.when(F.contains("_t", F.lit(x)), F.lit(x)) for x in EP_PHRASES])
    text = p.withColumn("phrase", phrase).where("phrase is not null").groupBy("doc_id").agg(F.min(F.struct("page", "phrase")).alias("p"))
    plain = lambda c: F.regexp_replace(F.regexp_replace(normalize(F.col(c), "folded"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    why = [F.when(plain(c).isin(*EP_ROLES), plain(c)) for c in ("role", "role_original") if c in dimension.columns]
    if "symbol" in dimension.columns:
        symbol = F.trim(normalize(F.col("symbol"), "folded"))
        tab = (F.col("belongs_to") == "solder_land") & F.col("role").isin("tab_width", "tab_height") & symbol.isin("x2", "y2")
        why.append(F.when(tab, F.concat(F.upper(symbol), F.lit(" optional center pad"))))
    named = dimension.withColumn("why", F.coalesce(*why)).where("why is not null").groupBy("doc_id").agg(F.min(F.struct("ord", "why")).alias("d"))
    docs = page.select("doc_id").union(dimension.select("doc_id")).distinct()
    out = docs.join(text, "doc_id", "left").join(named, "doc_id", "left")
    reason = F.when(F.col("p").isNotNull(), F.concat(F.lit("page:"), F.col("p.phrase"))).when(F.col("d").isNotNull(), F.concat(F.lit("dimension:"), F.col("d.why"))).otherwise("none")
    return out.select("doc_id", (F.col("p").isNotNull() | F.col("d").isNotNull()).alias("has_exposed_pad"), reason.alias("reason"))


# Headings that open a package or a land section.
PACKAGE_SECTION = r"(?i)(?:package|case)\s+outline|physical\s+dimensions?|mechanical\s+dimensions?"
LAND_SECTION = r"(?i)land\s*pattern|pad\s*layout|solder(?:ing|\s+lands?)|footprint|reflow|焊盘|焊膏|钢网"


def section_context(line: DataFrame) -> DataFrame:
    """Each line with the section of the last heading at or above it on its page."""
    own = F.when(F.col("norm").rlike(LAND_SECTION), "solder_land").when(F.col("norm").rlike(PACKAGE_SECTION), "package_outline")
    w = W.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return line.withColumn("section", F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit("unknown")))


# Declarations of millimetres.
MM_MARKS = ("dimensions in mm", "dimension in mm", "all dimensions are in millimeters", "unit : mm", "unit: mm", "dimensions in millimeters")


def declared_units(page: DataFrame) -> DataFrame:
    """Units outside and inside parentheses that a page declares; the first declaration that fits counts."""
    t = F.lower(nfkc(F.coalesce("text", F.lit(""))))
    p = page.select("doc_id", "page", t.alias("_t"))
    in_mm = F.col("_t").rlike(r"inches?\s*\(\s*millimeters?\s*\)")
    mm_in = F.col("_t").rlike(r"(?:mm|millimeters?|millimetres?)\s*\(\s*(?:inches?|in\.?)[\s.]*\)")
    mm = F.exists(F.array(*map(F.lit, MM_MARKS)), lambda m: F.contains(F.col("_t"), m))
    inch = F.col("_t").rlike(r"dimensions?\s+in\s+inches?")
    return p.select("doc_id", "page", F.when(in_mm, "in").when(mm_in | mm, "mm").when(inch, "in").alias("outer_unit"), F.when(in_mm, "mm").when(mm_in, "in").alias("paren_unit"))
