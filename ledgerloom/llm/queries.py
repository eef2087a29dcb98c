"""Queries of the text problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.copies import collapse_records, copy_members
from ledgerloom.llm.homoglyphs import regular_items
from ledgerloom.llm.leaks import find_leaks, remove_leaks
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.reading import level_profile, reading_levels
from ledgerloom.llm.scans import repair_scans, scan_findings
from ledgerloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = copy_members(table(spark, sf_dir, "standards_evidence"), "evidence_id", "evidence")
    return pairs.withColumnRenamed("id", "evidence_id")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_records(table(spark, sf_dir, "standards_evidence"), "evidence_id", "evidence")
    return found.select("first_id", "copies")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_findings(table(spark, sf_dir, "ocr_pages"), table(spark, sf_dir, "run_states"))


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_scans(table(spark, sf_dir, "ocr_pages"), table(spark, sf_dir, "run_states"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_items(table(spark, sf_dir, "run_states"), changed_only=True).drop("changed").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "grade_labels"))


def p9_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return out.select("doc_id", F.round("leaked_share", 6).alias("leaked_share"), "text")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_profile(p10_levels(spark, sf_dir), table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "p2_found": p2_found,
        "p2_records": p2_records,
        "p6_found": p6_found,
        "p6_paragraphs": p6_paragraphs,
        "p7_found": p7_found,
        "p8_containers": p8_containers,
        "p9_found": p9_found,
        "p9_cleaned": p9_cleaned,
        "p10_levels": p10_levels,
        "p10_profile": p10_profile,
    }


_REDUCED = "regexp_replace(lower(coalesce(json_extract_string(evidence, '$.{}'), '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')"
_KEYS = f"SELECT evidence_id, {_REDUCED.format('phase')} p, {_REDUCED.format('name')} n, {_REDUCED.format('text')} t FROM standards_evidence WHERE evidence IS NOT NULL"
_WORDS = "regexp_extract_all(strip_accents(lower(replace({}, 'ß', 'ss'))), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = "SELECT DISTINCT {0}, hash(w[i:i + 11]) g FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) i FROM (SELECT {0}, {1} w FROM {2}))"

_RAW = "[\\p{L}\\p{N}][\\p{L}\\p{N}\\x{0300}-\\x{036f}]*"
_FOLDED = "list_transform({}, lambda v: strip_accents(lower(replace(v, 'ß', 'ss'))))"

#: Written apart from the operators: their statements in TESTDATA.md as plain SQL.
ORACLES = {
    "p2_found": f"SELECT first_id, evidence_id FROM (SELECT evidence_id, min(evidence_id) OVER (PARTITION BY p, n, t) first_id FROM ({_KEYS})) WHERE first_id < evidence_id",
    "p2_records": f"SELECT min(evidence_id) first_id, count(*) copies FROM ({_KEYS}) GROUP BY p, n, t",
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format('doc_id', _WORDS.format('text'), 'documents')}) JOIN ({_GRAMS.format('item_id', _WORDS.format('item_text'), 'eval_items')}) USING (g)",
    "p9_cleaned": f"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{_RAW}') w, string_split_regex(text, '{_RAW}') g FROM documents), n AS (SELECT *, {_FOLDED.format("w")} f FROM d),
 i AS (SELECT {_FOLDED.format(f"regexp_extract_all(item_text, '{_RAW}')")} f FROM eval_items), x AS (SELECT DISTINCT hash(f[k:k + 11]) h FROM (SELECT f, unnest(range(1, len(f) - 10)) k FROM i)),
 y AS (SELECT doc_id, k, hash(f[k:k + 11]) h FROM (SELECT doc_id, f, unnest(range(1, len(f) - 10)) k FROM n)), z AS (SELECT DISTINCT doc_id, unnest(range(k, k + 12)) k FROM y WHERE h IN (SELECT h FROM x)),
 u AS (SELECT n.doc_id, unnest(w) w, unnest(g[2:]) a, generate_subscripts(w, 1) k FROM n WHERE doc_id IN (SELECT doc_id FROM z)),
 t AS (SELECT u.doc_id, string_agg(CASE WHEN z.k IS NULL THEN u.w || u.a ELSE '' END, '' ORDER BY u.k) b, count(z.k) / count(*) s FROM u LEFT JOIN z ON z.doc_id = u.doc_id AND z.k = u.k GROUP BY 1)
 SELECT n.doc_id, round(coalesce(s, 0), 6) leaked_share, CASE WHEN s IS NULL THEN text ELSE g[1] || b END AS text FROM n LEFT JOIN t ON t.doc_id = n.doc_id WHERE coalesce(s, 0) <= 0.5""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
