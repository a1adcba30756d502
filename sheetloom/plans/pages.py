"""Queries of the page operators over the derived page table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as K
from ..operators import pages as P
from . import fixtures as fx


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.load(spark, sf_dir, fx.PAGE)


def _dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.load(spark, sf_dir, fx.DIMENSION)


def t2_lines(spark, sf_dir):
    return P.explode_lines(_page(spark, sf_dir))


def t3_term_counts(spark, sf_dir):
    return P.term_counts(_page(spark, sf_dir), (*K.BASE_LAND_TERMS, *K.ADDED_LAND_TERMS, *K.DIMENSION_TERMS))


def t3_document_terms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page"), "text")
    return P.term_counts(docs, ("license", "the", "de")).select("doc_id", "term", "n")


def t4_stem_counts(spark, sf_dir):
    return P.stem_counts(_page(spark, sf_dir))


def t5_page_shape(spark, sf_dir):
    return P.page_shape(_page(spark, sf_dir))


def t6_headings(spark, sf_dir):
    return P.infer_heading(_page(spark, sf_dir))


def t7_block_headings(spark, sf_dir):
    page = _page(spark, sf_dir)
    block = page.where("doc_id % 4 <> 0").select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("block_no", "text")).withColumns({"y0": F.col("block_no") * 100.0, "page_height": F.lit(800.0)})
    return P.heading_from_blocks(page, block)


def t8_score_pages(spark, sf_dir):
    got = P.score_pages(_page(spark, sf_dir))
    arrays = [c for c, t in got.dtypes if t.startswith("array")]
    return got.withColumns({c: F.array_join(c, "|") for c in arrays})


def t9_rank_pages(spark, sf_dir):
    return P.rank_pages(P.score_pages(_page(spark, sf_dir)))


def _some_empty(spark, sf_dir):
    """All pages; every third document has text on one page only."""
    return _page(spark, sf_dir).withColumn("text", F.when(F.expr("(doc_id + page) % 5 = 4 or doc_id % 3 <> 0"), F.col("text")).otherwise(""))


def t10_fallback_pages(spark, sf_dir):
    page = _some_empty(spark, sf_dir)
    return P.fallback_pages(page, P.rank_pages(P.score_pages(page)))


def t11_suggest(spark, sf_dir):
    return P.suggest(_page(spark, sf_dir))


def t12_select_page(spark, sf_dir):
    return P.select_page(_some_empty(spark, sf_dir))


def t13_package_tokens(spark, sf_dir):
    return P.extract_tokens(_page(spark, sf_dir))


def t15_body_page_score(spark, sf_dir):
    return P.body_page_score(_page(spark, sf_dir)).drop("text")


def t16_companion_page(spark, sf_dir):
    page = _page(spark, sf_dir)
    land = page.where("(doc_id + page) % 5 = 0").select("doc_id", F.col("page").alias("land_page"))
    return P.companion_page(page, land)


def t18_comention(spark, sf_dir):
    return P.comention(_page(spark, sf_dir))


def t19_ep_evidence(spark, sf_dir):
    """Every fourth document names an exposed pad on its third page, in full-width letters; the next one in the role that a reading gave."""
    k = F.col("doc_id") % 4
    page = _page(spark, sf_dir).withColumn("text", F.when((k == 0) & (F.col("page") == 3), F.concat("text", F.lit("\nＥxposed  Pad"))).otherwise(F.col("text")))
    dim = _dim(spark, sf_dir).withColumn("role_original", F.when((k == 1) & (F.col("ord") == 3), "Thermal Pad-Width").otherwise(""))
    return P.ep_evidence(page, dim)


def t20_section_context(spark, sf_dir):
    return P.section_context(P.explode_lines(_page(spark, sf_dir))).select("doc_id", "page", "line_no", "section")


def t21_declared_units(spark, sf_dir):
    return P.declared_units(_page(spark, sf_dir))


QUERIES = [
    t2_lines, t3_term_counts, t3_document_terms, t4_stem_counts, t5_page_shape, t6_headings, t7_block_headings, t8_score_pages,
    t9_rank_pages, t10_fallback_pages, t11_suggest, t12_select_page, t13_package_tokens, t15_body_page_score, t16_companion_page,
    t18_comention, t19_ep_evidence, t20_section_context, t21_declared_units,
]

_PAGE = f"page as ({fx.duck(fx.PAGE)})"
_LAND = tuple(dict.fromkeys((*K.BASE_LAND_TERMS, *K.ADDED_LAND_TERMS)))


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def norm(x: str) -> str:
    return rf"lower(trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g')))"


def hits(x: str, terms) -> str:
    return f"list_filter(list_transform({_list(terms)}, lambda t: struct_pack(term := t, n := (length({x}) - length(replace({x}, t, ''))) // length(t))), lambda h: h.n > 0)"


def names(x: str) -> str:
    return f"list_transform({x}, lambda h: h.term)"


def total(x: str) -> str:
    return f"coalesce(list_sum(list_transform({x}, lambda h: h.n)), 0)"


def stems(x: str) -> str:
    parts = ", ".join(f"struct_pack(term := '{k}', n := len(regexp_extract_all({x}, '(?i){p}')))" for k, p in K.STEMS.items())
    return f"list_filter([{parts}], lambda h: h.n > 0)"


_LINES = r"""lines as (select doc_id, page, unnest(string_split(text, chr(10))) as raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from page)"""
_FULL = rf"""full_lines as (select doc_id, page, line_no, {norm('raw')} as x from lines where {norm('raw')} <> ''),
numbered as (select *, row_number() over (partition by doc_id, page order by line_no) as i from full_lines)"""
_HEAD = rf"""picked as (select doc_id, page, x, min(i) as i from numbered where i <= {P.HEADING_LINES} or regexp_matches(x, '(?i){K.CAPTION}') group by all),
heading as (select doc_id, page, string_agg(x, chr(10) order by i) as heading from picked group by all)"""
_SCORED = f"""s0 as (select page.*, heading, {norm('text')} as txt, {norm('heading')} as hd from page left join heading using (doc_id, page)),
s1 as (select *, {hits('txt', _LAND)} as land, {hits('txt', K.DIMENSION_TERMS)} as dim, {names(hits('hd', tuple(dict.fromkeys((*_LAND, *K.DIMENSION_TERMS)))))} as head,
  {stems('text')} as stem, {names(stems("coalesce(heading, '')"))} as hstem, {names(hits('txt', K.FORBIDDEN_TERMS))} as bad from s0),
s2 as (select *, list_concat(head, hstem) as heads, list_filter({names('land')}, lambda x: list_contains({_list(K.AMBIGUOUS_LAND_TERMS)}, x)) as amb from s1),
s3 as (select *, list_concat(list_concat(list_filter({names('land')}, lambda x: not list_contains({_list(K.AMBIGUOUS_LAND_TERMS)}, x)),
     case when len(dim) > 0 then list_filter(amb, lambda x: list_contains(head, x)) else [] end), {names('stem')}) as eff,
  {total(f"list_filter(land, lambda q: list_contains({_list(K.ADDED_LAND_TERMS)}, q.term))")} as added, {total('land')} as all_land, {total('stem')} as n_stem, {total('dim')} as n_dim,
  len(bad) > 0 and len(heads) = 0 as vetoed from s2),
s4 as (select *, 20 * added + 10 * (all_land - added + n_stem) + 3 * n_dim + 4 * len(heads) as raw_score from s3),
decision as (select doc_id, page, cast(case when vetoed then 0 when len(bad) > 0 then greatest(1, raw_score - 2 * len(bad)) else raw_score end as bigint) as score,
  case when len(eff) > 0 then 'land' when len(dim) > 0 then 'dimension' else 'none' end as page_class, vetoed,
  {', '.join(f"array_to_string(list_sort({src}), '|') as {dst}" for src, dst in ((names('land'), 'land_terms'), (names('dim'), 'dimension_terms'), ('heads', 'heading_terms'), ('bad', 'forbidden_terms'), ('eff', 'effective_land_terms'), ('amb', 'ambiguous_land_terms'), (names('stem'), 'stem_terms')))} from s4),
ranked as (select *, row_number() over (partition by doc_id order by case page_class when 'land' then 2 when 'dimension' then 1 else 0 end desc, score desc, page) as rank from decision where score > 0 and not vetoed)"""
_DECIDED = f"{_PAGE}, {_LINES}, {_FULL}, {_HEAD}, {_SCORED}"
_SOME = _DECIDED.replace(_PAGE, f"all_page as ({fx.duck(fx.PAGE)}), page as (select doc_id, page, case when (doc_id + page) % 5 = 4 or doc_id % 3 <> 0 then text else '' end as text from all_page)")

_TOKENS = ", ".join(
    f"list_transform(regexp_extract_all(text, '{p}', {g}), lambda x: struct_pack(no := {no}, token := upper(regexp_replace({chr(39) + 'CASE' + chr(39) + ' || ' if kind == 'case_code' else ''}x, '[\\s_]+', '', 'g')), kind := '{kind}'))"
    for no, (kind, p, g) in enumerate(K.TOKEN_PATTERNS)
)
_TOKEN_CTE = "tk0 as (select doc_id, page, flatten([" + _TOKENS + "]) as l from page),\n" + f"""tk1 as (select doc_id, page, unnest(l) as h, unnest(range(1, len(l) + 1)) as pos from tk0),
tk2 as (select doc_id, page, h.token as token, arg_min(h.kind, pos) as kind, min(pos) as pos from tk1 where h.token <> '' and not list_contains({_list(K.TOKEN_STOPS)}, h.token) group by all),
tokens as (select doc_id, page, cast(row_number() over (partition by doc_id, page order by pos) as int) as ord, token, kind from tk2)"""
_BODY = f"body as (select doc_id, page, text, cast(4 * len({hits('lower(text)', K.BODY_TERMS)}) - 8 * len({hits('lower(text)', K.NON_BODY_TERMS)}) as bigint) as body_score from page)"


def _any(x: str, marks) -> str:
    return "(" + " or ".join(f"contains({x}, '{m}')" for m in marks) + ")"


ORACLES = {
    "t2_lines": rf"with {_PAGE}, {_LINES} select doc_id, page, cast(line_no as int) as line_no, raw, trim(regexp_replace(raw, '\s+', ' ', 'g')) as norm from lines",
    "t3_term_counts": f"with {_PAGE}, c as (select doc_id, page, unnest({hits(norm('text'), tuple(dict.fromkeys((*_LAND, *K.DIMENSION_TERMS))))}) as h from page) select doc_id, page, h.term as term, cast(h.n as int) as n from c",
    "t3_document_terms": f"with c as (select doc_id, unnest({hits(norm('text'), ('license', 'the', 'de'))}) as h from documents) select doc_id, h.term as term, cast(h.n as int) as n from c",
    "t4_stem_counts": f"with {_PAGE} select doc_id, page, " + ", ".join(f"cast(len(regexp_extract_all(text, '(?i){p}')) as bigint) as {k}" for k, p in K.STEMS.items()) + " from page",
    "t5_page_shape": rf"""with {_PAGE}, {_LINES}, {_FULL}, m as (select doc_id, page, median(length(x)) as med from numbered group by all),
q as (select page.doc_id, page.page, coalesce(med, 0.0) as median_line_length, cast(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) as bigint) as word_count from page left join m using (doc_id, page))
select *, median_line_length >= 20 or word_count >= 400 as prose_page from q""",
    "t6_headings": f"with {_PAGE}, {_LINES}, {_FULL}, {_HEAD} select page.doc_id, page.page, coalesce(heading, '') as heading from page left join heading using (doc_id, page)",
    "t7_block_headings": f"""with {_PAGE}, {_LINES}, {_FULL}, {_HEAD},
b as (select doc_id, page, x, min(line_no) as pos from full_lines where doc_id % 4 <> 0 and ((line_no - 1) * 100.0 <= 0.28 * 800.0 or regexp_matches(x, '(?i){K.CAPTION}')) group by all),
bh as (select doc_id, page, string_agg(x, chr(10) order by pos) as bh from b group by all)
select page.doc_id, page.page, coalesce(bh, heading, '') as heading from page left join bh using (doc_id, page) left join heading using (doc_id, page)""",
    "t8_score_pages": f"with {_DECIDED} select * from decision",
    "t9_rank_pages": f"with {_DECIDED} select doc_id, page, score, page_class, cast(rank as int) as rank from ranked where rank <= {P.SUGGESTIONS}",
    "t10_fallback_pages": f"""with {_SOME}, n as (select doc_id, count(text) as n from page group by all)
select doc_id, unnest(range(1, least({P.SUGGESTIONS}, greatest(1, n)) + 1))::int as page, 'no_positive_page_after_veto' as fallback_reason from n where doc_id not in (select doc_id from ranked)""",
    "t11_suggest": f"""with {_DECIDED}, n as (select doc_id, count(text) as page_count from page group by all),
p as (select doc_id, bool_or(page_class = 'land') as land, string_agg(cast(page as varchar), ',' order by rank) as pages from ranked where rank <= {P.SUGGESTIONS} group by all)
select doc_id, page_count, 'ok' as parse_status, land as has_land_signal, pages from n join p using (doc_id)""",
    "t12_select_page": f"""with {_SOME}, d as (select distinct doc_id from page)
select d.doc_id, page as selected_page, page_class, case when page is null then 'no_candidate' else 'pending_model' end as status from d left join (select * from ranked where rank = 1) r using (doc_id)""",
    "t13_package_tokens": f"with {_PAGE}, {_TOKEN_CTE} select * from tokens",
    "t15_body_page_score": f"with {_PAGE}, {_BODY} select doc_id, page, body_score from body",
    "t16_companion_page": f"""with {_PAGE}, {_TOKEN_CTE}, {_BODY},
land as (select doc_id, page as land_page from page where (doc_id + page) % 5 = 0),
lt as (select land.doc_id, land_page, token from land join tokens on tokens.doc_id = land.doc_id and tokens.page = land.land_page),
near as (select lt.doc_id, land_page, b.page, max(body_score) as s, string_agg(distinct token, ',' order by token) as matched from lt join body b on b.doc_id = lt.doc_id
  where abs(b.page - land_page) <= {P.RADIUS} and b.page <> land_page and body_score > 0 and case when regexp_full_match(token, '[A-Z]{{2,5}}')
    then regexp_matches(upper(text), '(^|[^A-Z0-9])' || token || '($|[^A-Z0-9])') else contains(regexp_replace(upper(text), '[\\s_]+', '', 'g'), token) end group by all),
best as (select *, row_number() over (partition by doc_id, land_page order by (page < land_page)::int desc, abs(page - land_page), s desc, page) as r from near),
has as (select distinct doc_id, land_page from lt)
select land.doc_id, land.land_page, case when best.page is not null then 'selected_text_bound' when has.doc_id is not null and land.land_page > 1 then 'selected_model_binding_required' else 'no_safe_page' end as status,
  cast(case when best.page is not null then best.page when has.doc_id is not null and land.land_page > 1 then land.land_page - 1 end as int) as body_page, matched
from land left join best on best.doc_id = land.doc_id and best.land_page = land.land_page and r = 1 left join has on has.doc_id = land.doc_id and has.land_page = land.land_page""",
    "t18_comention": rf"with {_PAGE}, c as (select *, regexp_replace(lower(text), '[\s_\-:/()]+', '', 'g') as k from page) select doc_id, page, {_any('k', P.LAND_MARKS)} and {_any('k', P.PASTE_MARKS)} as land_and_paste, regexp_matches(lower(text), 're[\s-]*flow|回流') and regexp_matches(lower(text), 'wave|波峰') as reflow_and_wave from c",
    "t19_ep_evidence": f"""with {_PAGE}, d as (select distinct doc_id from ({fx.duck(fx.DIMENSION)}) where ord = 3), p as (select distinct doc_id from page union select doc_id from ({fx.duck(fx.DIMENSION)}))
select p.doc_id, p.doc_id % 4 = 0 or (p.doc_id % 4 = 1 and d.doc_id is not null) as has_exposed_pad, case when p.doc_id % 4 = 0 then 'page:exposed pad' when p.doc_id % 4 = 1 and d.doc_id is not null then 'dimension:thermal_pad_width' else 'none' end as reason from p left join d using (doc_id)""",
    "t20_section_context": f"""with {_PAGE}, {_LINES}, o as (select *, case when regexp_matches(raw, '{P.LAND_SECTION}') then 'solder_land' when regexp_matches(raw, '{P.PACKAGE_SECTION}') then 'package_outline' end as own from lines)
select doc_id, page, cast(line_no as int) as line_no, coalesce(last_value(own ignore nulls) over (partition by doc_id, page order by line_no rows between unbounded preceding and current row), 'unknown') as section from o""",
    "t21_declared_units": rf"""with {_PAGE}, f as (select doc_id, page, regexp_matches(lower(text), 'inches?\s*\(\s*millimeters?\s*\)') as a,
  regexp_matches(lower(text), '(?:mm|millimeters?|millimetres?)\s*\(\s*(?:inches?|in\.?)[\s.]*\)') as b, {_any('lower(text)', P.MM_MARKS)} as c, regexp_matches(lower(text), 'dimensions?\s+in\s+inches?') as d from page)
select doc_id, page, case when a then 'in' when b or c then 'mm' when d then 'in' end as outer_unit, case when a then 'mm' when b then 'in' end as paren_unit from f""",
}
