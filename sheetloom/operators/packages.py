"""Dictionary matching: package terms in lines, the relation gate, identities through the uniqueness gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms as K
from ..functions.text import once

CONTEXT = 3


def term_pattern(term: Column) -> Column:
    """A pattern in which letter and digit runs of a term may be joined by spaces, hyphens, underscores or slashes."""
    pieces = F.regexp_extract_all(term, F.lit("([A-Za-z]+|[0-9]+)"), F.lit(1))
    return F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), F.array_join(pieces, r"[\s\-_/]*"), F.lit("(?![A-Za-z0-9])"))


def runs_of(text: Column) -> Column:
    """Upper-case letter and digit runs of a text."""
    return F.regexp_extract_all(F.upper(text), F.lit("([A-Z]+|[0-9]+)"), F.lit(1))


def keys_of(runs: Column) -> Column:
    """Runs of a line and their joins of up to six runs: what a term's key may equal. ``runs`` is a column, so that no join reads the line again."""
    joined = F.transform(F.sequence(F.lit(1), F.greatest(F.size(runs), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda n: F.array_join(F.slice(runs, i, n), "")))
    return F.array_distinct(F.flatten(joined))


def match_terms(line: DataFrame, term: DataFrame) -> DataFrame:
    """M1: ``line(doc_id, page, line_no, norm)`` by ``term(term, ...)``: hits with the offset of the first.

    Lines are first joined to terms on equal keys (runs of letters and digits put together), a hash
    join that no dictionary size turns into a nested loop; the exact pattern then decides.
    """
    t = term.withColumns({"_key": F.array_join(runs_of(F.col("term")), ""), "_pattern": term_pattern(F.col("term"))})
    runs = once(line.where("norm <> ''").withColumn("_runs", runs_of(F.col("norm"))))
    rows = runs.withColumn("_key", F.explode(keys_of(F.col("_runs")))).drop("_runs")
    hit = rows.join(t, "_key").where(F.regexp_like("norm", F.col("_pattern")))
    return hit.withColumn("offset", F.regexp_instr("norm", F.col("_pattern")) - 1).drop("_key", "_pattern").dropDuplicates(["doc_id", "page", "line_no", "term"])


def context(line: DataFrame, n: int = CONTEXT) -> DataFrame:
    """M2: each non-empty line with the ``n`` non-empty lines around it, joined by " | "."""
    w = W.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(-n, n)
    return line.where("norm <> ''").withColumn("context", F.array_join(F.collect_list("norm").over(w), " | "))


def relation_mode() -> Column:
    """M3: the mode in which line or context relate a term of its evidence class to a package; null where they don't."""
    has = lambda c, m: F.col(c).rlike("(?iU)" + K.MARKERS[m])
    ctx = lambda m, mode: F.when(has("context", m), mode)
    k = F.col("evidence_class")
    return (
        F.when(k == "authorized_passive_size_relation", F.when(has("norm", "passive") & has("norm", "paired_size"), "authorized_passive_size_relation"))
        .when(k == "table_package_column", F.when(has("norm", "relation"), "declarative_same_line").when(has("context", "header"), "table_package_header_relation"))
        .when(k == "declarative_package_drawing_dimensions", ctx("drawing", "declarative_drawing_dimensions_context"))
        .when(k == "declarative_package_label", ctx("label", "declarative_package_label_context"))
        .when(k == "declarative_case_label", ctx("case", "declarative_case_label_context"))
        .when(k == "declarative_case_label_plus_table", F.when(has("context", "case") | has("context", "header"), "declarative_case_or_table_context"))
        .when(k == "declarative_package_outline", ctx("outline", "declarative_package_outline_context"))
        .otherwise(ctx("relation", "declarative_relation_context"))
    )


def relation_gate(line: DataFrame, term: DataFrame) -> DataFrame:
    """M1 to M3: hits whose line or context relates them to a package."""
    hits = match_terms(context(line), term)
    return hits.withColumn("mode", relation_mode()).where("mode is not null")


def identity() -> Column:
    """The alias group, else the term's own key."""
    return F.coalesce(F.when(F.trim("alias_group_id") != "", F.trim("alias_group_id")), F.concat(F.lit("TERM:"), F.upper("normalized_key")))


def resolve_identity(docs: DataFrame, hit: DataFrame) -> DataFrame:
    """M4: per document none, unique or ambiguous identities, all identities as evidence."""
    g = hit.withColumn("identity", identity()).groupBy("doc_id").agg(F.count_distinct("identity").alias("n"), F.array_join(F.array_sort(F.collect_set("identity")), ",").alias("identities"))
    out = docs.select("doc_id").distinct().join(g, "doc_id", "left")
    status = F.when(F.col("n").isNull(), "no_approved_package_relation").when(F.col("n") == 1, "unique_package_relation").otherwise("ambiguous_package_relations")
    return out.select("doc_id", status.alias("status"), F.coalesce("identities", F.lit("")).alias("identities"))


def representative(hit: DataFrame, term: DataFrame) -> DataFrame:
    """M5: for documents with one identity the dictionary's first term of it, the first evidence and the sorted aliases.

    ``term`` has ``pos``, the dictionary order.
    """
    h = hit.withColumn("identity", identity())
    one = h.groupBy("doc_id").agg(F.count_distinct("identity").alias("n"), F.min("identity").alias("identity"), F.array_sort(F.array_distinct(F.concat(F.collect_set("term"), F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>"))))))).alias("names"), F.min(F.struct("page", "norm", "offset", "term")).alias("first")).where("n = 1")
    rep = term.withColumn("identity", identity()).groupBy("identity").agg(F.min(F.struct("pos", "term")).alias("r"))
    return one.join(rep, "identity", "left").select("doc_id", "identity", F.coalesce("r.term", "first.term").alias("package_name"), F.col("first.page").alias("source_page"), F.array_join("names", ",").alias("names"))


def frozen_match(document: DataFrame, term: DataFrame) -> DataFrame:
    """M6: terms whose source is the document itself and whose line still has its digest; through the gate."""
    ok = term.where(F.upper(F.sha2(F.col("source_line").cast("binary"), 256)) == F.upper("source_line_sha256")).withColumn("identity", identity())
    j = document.select("doc_id", F.upper("content_sha256").alias("_h")).join(ok.withColumn("_h", F.upper("source_pdf_sha256")), "_h")
    return j.groupBy("doc_id").agg(F.count_distinct("identity").alias("n"), F.array_join(F.array_sort(F.collect_set("identity")), ",").alias("identities")).select("doc_id", F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("status"), "identities")


def lookup_canonical(name: DataFrame, group: DataFrame) -> DataFrame:
    """M7: ``name(doc_id, name)`` against approved groups' codes and aliases, normalised: unique, ambiguous or not_found."""
    code = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    keys = group.where("approval_status = 'user_approved'").select("group_id", F.explode(F.array_distinct(F.array(code(F.col("package_code")), code(F.col("alias"))))).alias("_k"))
    hit = name.select("doc_id", code(F.col("name")).alias("_k")).join(keys, "_k").groupBy("doc_id").agg(F.count_distinct("group_id").alias("n"), F.min("group_id").alias("g"))
    out = name.select("doc_id").distinct().join(hit, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("g")).alias("group_id"))


def body_cross_check(pair: DataFrame, tol: float = 0.2) -> DataFrame:
    """M8: ``pair(doc_id, doc_x, doc_y, entry_x, entry_y)``: conflict only when neither the direct nor the swapped axes fit; missing values allow."""
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tol + 1e-12
    known = F.col("doc_x").isNotNull() & F.col("doc_y").isNotNull() & F.col("entry_x").isNotNull() & F.col("entry_y").isNotNull()
    fits = (near("doc_x", "entry_x") & near("doc_y", "entry_y")) | (near("doc_x", "entry_y") & near("doc_y", "entry_x"))
    return pair.select("doc_id", F.when(~known, "not_comparable").when(fits, "consistent").otherwise("conflict").alias("body_status"))


def route_fallback(record: DataFrame, frozen: DataFrame, matched: DataFrame, canonical: DataFrame, body: DataFrame) -> DataFrame:
    """M9: the final status of records: a candidate skips the dictionary; else frozen, then text match, then registry, then the body check."""
    j = record.join(frozen.select("doc_id", F.col("status").alias("_f")), "doc_id", "left").join(matched.select("doc_id", F.col("status").alias("_m")), "doc_id", "left")
    j = j.join(canonical.select("doc_id", F.col("status").alias("_c"), "group_id"), "doc_id", "left").join(body, "doc_id", "left")
    found = (F.coalesce("_f", F.lit("")) == "unique") | (F.coalesce("_m", F.lit("")) == "unique_package_relation")
    final = (
        F.when(F.col("has_candidate"), "existing_candidate").when(~found, F.coalesce("_m", F.lit("no_approved_package_relation")))
        .when(F.coalesce("_c", F.lit("not_found")) != "unique", "c3_package_recognized_missing_canonical").when(F.col("body_status") == "conflict", "c3_body_conflict_manual_review")
        .otherwise("canonical_match_ready_for_review")
    )
    return j.select("doc_id", final.alias("final_status"), F.when(final == "canonical_match_ready_for_review", F.col("group_id")).alias("group_id"))
