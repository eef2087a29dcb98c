"""Queries of the reference operators over the procurement tables, each with its SQL twin.

Every query reads its whole tables. Lists are shown as joined texts and doubles are rounded, so
that both engines give the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import lots as lot_ops
from ledgerloom.operators import reconcile, reports, runs, scoring, shapes, spans, standards
from ledgerloom.operators.contain import contained
from ledgerloom.operators.nested import procurement_tables
from ledgerloom.operators.skew import skew_rank
from ledgerloom.session import cut, table
from ledgerloom.sources.records import duplicate_audit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CODE = "[0-9]{8}[-‐‑–][0-9]"
HEADING = r"^[0-9]+\. "
KEYWORDS = {"criterion": "kriterij", "points": "punkt", "price": "price", "deadline": "deadline", "share": "ipatsvar", "lowest": "viszemak"}
ALIASES = {"iso": "(?i)\\biso\\b", "cpv": "(?i)\\bcpv\\b", "sia": "\\bSIA\\b", "eur": "\\bEUR\\b", "vat": "(?i)\\bpvn\\b|without tax"}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(names: dict[str, str]) -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in names.items())


# --- spans in text ------------------------------------------------------------------------------


def spans_sql(pattern: str = CODE) -> str:
    """Common table expressions that end in ``s(doc_id, eis_id, text, hit, start)``."""
    return f"""WITH d AS (SELECT doc_id, eis_id, text, string_split_regex(text, '{pattern}') g, regexp_extract_all(text, '{pattern}') h FROM documents WHERE text IS NOT NULL),
 u AS (SELECT *, unnest(range(1, len(h) + 1)) i FROM d),
 s AS (SELECT doc_id, eis_id, text, h[i] hit, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS INT) AS start FROM u)"""


@query(
    spans_sql()
    + """, c AS (SELECT eis_id, hit code, doc_id, start, substring(text, greatest(0, start - 200) + 1, least(length(text), start + length(hit) + 200) - greatest(0, start - 200)) context FROM s),
 f AS (SELECT eis_id, code, count(*) n_hits, min(struct_pack(d := doc_id, s := start, c := context)) m FROM c GROUP BY ALL)
 SELECT eis_id, code, n_hits, m.c first_context, row_number() OVER (PARTITION BY eis_id ORDER BY m.d, m.s) AS rank FROM f"""
)
def pattern_candidates(spark: SparkSession, d: str) -> DataFrame:
    out = spans.pattern_candidates(table(spark, d, "documents"), ["eis_id"], ["doc_id"], "text", CODE)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(spans_sql() + " SELECT doc_id, hit, start, substring(text, greatest(0, start - 50) + 1, least(length(text), start + length(hit) + 50) - greatest(0, start - 50)) context FROM s")
def pattern_windows(spark: SparkSession, d: str) -> DataFrame:
    s = spans.spans_of(table(spark, d, "documents"), ["doc_id"], "text", CODE)
    return s.select("doc_id", "hit", "start", spans.window_around(F.col("text"), F.col("start"), F.col("stop"), 50).alias("context"))


@query(
    f"SELECT doc_id, name, n_hits FROM (SELECT doc_id, k.name, len(regexp_extract_all(translate(lower(text), '{T.ACCENTED}', '{T.UNACCENTED}'), '(^|[^\\p{{L}}\\p{{N}}_])' || k.stem))::BIGINT n_hits "
    f"FROM documents, (VALUES {values(KEYWORDS)}) k(name, stem)) WHERE n_hits > 0"
)
def folded_keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    out = spans.folded_hits(table(spark, d, "documents"), ["doc_id"], "text", KEYWORDS)
    return out.withColumn("n_hits", F.col("n_hits").cast("long"))


@query(f"SELECT doc_id, k.name FROM documents, (VALUES {values(ALIASES)}) k(name, alias) WHERE regexp_matches(text, k.alias)")
def catalog_hits(spark: SparkSession, d: str) -> DataFrame:
    """All aliases are tested in one pass over the text; no join multiplies the texts."""
    flags = F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in ALIASES.items()])
    return table(spark, d, "documents").select("doc_id", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("name"))


LINES_SQL = r"l AS (SELECT doc_id, eis_id, (i - 1)::INT line_no, line FROM (SELECT doc_id, eis_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents WHERE text IS NOT NULL))"


@query(
    f"WITH {LINES_SQL}, h AS (SELECT *, last_value(CASE WHEN regexp_matches(trim(line), '{HEADING}') THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) heading FROM l) "
    f"SELECT doc_id, line_no, coalesce(heading, 'unknown') phase FROM h WHERE regexp_matches(line, '{CODE}')"
)
def phase_asof(spark: SparkSession, d: str) -> DataFrame:
    return spans.labelled_hits(table(spark, d, "documents"), ["doc_id"], "text", CODE, HEADING)


@query(
    f"WITH {LINES_SQL}, h AS (SELECT *, regexp_matches(trim(line), '{HEADING}') hd FROM l), s AS (SELECT *, (sum(hd::INT) OVER w)::INT section, "
    "last_value(CASE WHEN hd THEN trim(regexp_replace(line, '[\\s\\p{Z}]+', ' ', 'g')) END IGNORE NULLS) OVER w heading FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)) "
    "SELECT doc_id, section, heading, count(*) n_lines, sum(length(line))::BIGINT n_chars FROM s GROUP BY ALL"
)
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    out = spans.sections(table(spark, d, "documents"), ["doc_id"], "text", HEADING)
    return out.select("doc_id", "section", "heading", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_chars").cast("long").alias("n_chars"))


@query(
    f"WITH {LINES_SQL}, n AS (SELECT *, max(CASE WHEN regexp_matches(lower(line), 'cpv') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) near FROM l), "
    "k AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) island FROM n WHERE near = 1), "
    "p AS (SELECT doc_id, min(line_no) first_line, max(line_no) last_line, string_agg(line, chr(10) ORDER BY line_no) passage FROM k GROUP BY doc_id, island), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(passage, '[\\s\\p{Z}]+', ' ', 'g')) ORDER BY first_line) twin FROM p), "
    "c AS (SELECT *, sum(length(passage)) OVER (PARTITION BY doc_id) chars FROM t WHERE twin = 1) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) passage_no, first_line, last_line, passage FROM c WHERE chars <= 12000"
)
def line_context_windows(spark: SparkSession, d: str) -> DataFrame:
    out = spans.line_windows(table(spark, d, "documents"), ["doc_id"], "text", "cpv", before=1, after=3)
    return out.withColumn("passage_no", F.col("passage_no").cast("long"))


@query(
    f"WITH {LINES_SQL}, n AS (SELECT *, max(CASE WHEN regexp_matches(lower(line), 'cpv') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 40 PRECEDING AND 1 FOLLOWING) near FROM l), "
    "k AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) island FROM n WHERE near = 1), "
    "p AS (SELECT doc_id, min(line_no) first_line, max(line_no) last_line, string_agg(line, chr(10) ORDER BY line_no) passage FROM k GROUP BY doc_id, island), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(passage, '[\\s\\p{Z}]+', ' ', 'g')) ORDER BY first_line) twin FROM p), "
    "c AS (SELECT *, sum(length(passage)) OVER (PARTITION BY doc_id) chars FROM t WHERE twin = 1) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) passage_no, first_line, last_line, passage, chars > 12000 oversized FROM c"
)
def line_context_passages(spark: SparkSession, d: str) -> DataFrame:
    """The window of the reference, and all texts: those over its budget are marked, not left out."""
    out = spans.line_passages(table(spark, d, "documents"), ["doc_id"], "text", "cpv")
    return out.withColumn("passage_no", F.col("passage_no").cast("long"))


@query(
    spans_sql("[0-9]{2,}")
    + f""", d2 AS (SELECT doc_id, string_split_regex(text, '{CODE}') g, regexp_extract_all(text, '{CODE}') h FROM documents WHERE text IS NOT NULL), u2 AS (SELECT *, unnest(range(1, len(h) + 1)) i FROM d2),
 t AS (SELECT doc_id, h[i] hit, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS INT) AS start FROM u2)
 SELECT doc_id, hit, start FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = s.doc_id AND s.start < t.start + length(t.hit) AND s.start + length(s.hit) > t.start)"""
)
def span_overlap_anti(spark: SparkSession, d: str) -> DataFrame:
    return spans.overlap_anti(table(spark, d, "documents"), ["doc_id"], "text", "[0-9]{2,}", CODE).select("doc_id", "hit", "start")


@query(
    f"WITH RECURSIVE {LINES_SQL}, r AS (SELECT doc_id, line_no, 1 chunk_no, length(line) used FROM l WHERE line_no = 0 UNION ALL SELECT l.doc_id, l.line_no, CASE WHEN r.used + 1 + length(l.line) <= 400 THEN r.chunk_no ELSE r.chunk_no + 1 END, "
    "CASE WHEN r.used + 1 + length(l.line) <= 400 THEN r.used + 1 + length(l.line) ELSE length(l.line) END FROM r JOIN l ON l.doc_id = r.doc_id AND l.line_no = r.line_no + 1) SELECT doc_id, chunk_no, min(line_no) first_line, max(line_no) last_line FROM r GROUP BY 1, 2"
)
def greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    return spans.line_chunks(table(spark, d, "documents"), ["doc_id"], "text", 400)


@query("SELECT page_id, lead(page_id) OVER (PARTITION BY eis_id, name ORDER BY page_no, page_id) next_page FROM ocr_pages")
def next_passage(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("eis_id", "name").orderBy("page_no", "page_id")
    return table(spark, d, "ocr_pages").select("page_id", F.lead("page_id").over(w).alias("next_page"))


_SCORES = {"strength": r"(?i)kopā [0-9]+ punkt|maximum", "weak": r"(?i)punkt|points"}


@query(
    "WITH p AS (SELECT eis_id, doc_id, source_file, CASE WHEN regexp_matches(text, '(?i)kopā [0-9]+ punkt|maximum') THEN 2 WHEN regexp_matches(text, '(?i)punkt|points') THEN 1 ELSE 0 END strength, "
    "(contains(lower(text), 'cena')::INT + contains(lower(text), 'price')::INT + contains(lower(text), 'quality')::INT + contains(lower(text), 'kvalit')::INT) n_terms, md5(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))) sig FROM documents WHERE text IS NOT NULL), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY eis_id, sig ORDER BY strength DESC, n_terms DESC, doc_id) twin FROM p WHERE strength > 0 OR n_terms > 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY eis_id ORDER BY strength DESC, n_terms DESC, doc_id) AS rank FROM o WHERE twin = 1) SELECT eis_id, doc_id, strength, n_terms, rank FROM r WHERE rank <= 6"
)
def ranked_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The six best texts per procurement by cue strength and number of terms (a top-k is the feature)."""
    t = F.col("text")
    strength = F.when(t.rlike(_SCORES["strength"]), 2).when(t.rlike(_SCORES["weak"]), 1).otherwise(0)
    terms = sum((F.lower(t).contains(w).cast("int") for w in ("cena", "price", "quality", "kvalit")), F.lit(0))
    p = table(spark, d, "documents").where(t.isNotNull()).select("eis_id", "doc_id", strength.alias("strength"), terms.alias("n_terms"), F.md5(T.collapse(t)).alias("sig"))
    out = spans.ranked_passages(p.where("strength > 0 OR n_terms > 0"), ["eis_id"], ["strength", "n_terms"], [F.col("sig")], "doc_id")
    return out.select("eis_id", "doc_id", "strength", "n_terms", F.col("rank").cast("long").alias("rank"))


_ORDER_SQL = "strength DESC, n_terms DESC, source NULLS FIRST, start NULLS FIRST, id"


@query(
    "WITH c AS (SELECT eis_id, page_id id, name source, page_no start, text, CASE WHEN regexp_matches(text, '(?i)kopā [0-9]+ punkt|maximum') THEN 2 WHEN regexp_matches(text, '(?i)punkt|points') THEN 1 ELSE 0 END strength, "
    "contains(lower(text), 'cena')::INT + contains(lower(text), 'price')::INT + contains(lower(text), 'kvalit')::INT n_terms FROM ocr_pages), "
    f"o AS (SELECT * FROM c WHERE strength > 0 OR n_terms > 0 QUALIFY row_number() OVER (PARTITION BY eis_id, md5(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'))) ORDER BY {_ORDER_SQL}) = 1), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY eis_id ORDER BY {_ORDER_SQL}) r FROM o QUALIFY r <= 6), "
    "n AS (SELECT r.eis_id, arg_min(c.id, struct_pack(a := c.start, b := c.id)) id FROM r JOIN c ON c.eis_id IS NOT DISTINCT FROM r.eis_id AND c.source IS NOT DISTINCT FROM r.source AND c.start > r.start WHERE r.r = 1 GROUP BY 1), "
    "u AS (SELECT eis_id, id, CASE WHEN r = 1 THEN 0 ELSE r END o FROM r UNION ALL SELECT eis_id, id, 1 FROM n), l AS (SELECT eis_id, id, min(o) o FROM u GROUP BY ALL) "
    "SELECT eis_id, row_number() OVER (PARTITION BY eis_id ORDER BY o) AS \"position\", id FROM l QUALIFY \"position\" <= 6"
)
def ranked_search(spark: SparkSession, d: str) -> DataFrame:
    """The six best scanned pages per procurement, the best one's next page right behind it (a top-k is the feature)."""
    t, none = F.col("text"), F.lit(None).cast("string")
    pages = table(spark, d, "ocr_pages").select("eis_id", F.col("page_id").alias("id"), F.col("name").alias("source"), F.lit(1).alias("section"), F.col("page_no").alias("start"), none.alias("heading"), none.alias("table_header"), "text", F.lit("text").alias("kind"), none.alias("lot_hint"))
    strength = F.when(t.rlike(_SCORES["strength"]), 2).when(t.rlike(_SCORES["weak"]), 1).otherwise(0)
    out = spans.ranked_search(pages, ["eis_id"], ["cena", "price", "kvalit"], strength, F.array().cast("array<string>"), F.lit(False))
    return out.withColumn("position", F.col("position").cast("long"))


@query(
    "WITH RECURSIVE c AS (SELECT finding_id, criterion_id, loaded_at, length(coalesce(name, ''))::BIGINT n, row_number() OVER (PARTITION BY finding_id ORDER BY criterion_id, loaded_at, length(coalesce(name, ''))) i FROM worker_criteria), "
    "r AS (SELECT finding_id, criterion_id, loaded_at, i, n <= 40 packed, CASE WHEN n <= 40 THEN n ELSE 0 END used FROM c WHERE i = 1 UNION ALL SELECT c.finding_id, c.criterion_id, c.loaded_at, c.i, r.used + c.n <= 40, CASE WHEN r.used + c.n <= 40 THEN r.used + c.n ELSE r.used END "
    "FROM r JOIN c ON c.finding_id = r.finding_id AND c.i = r.i + 1) SELECT finding_id, criterion_id, loaded_at, packed FROM r"
)
def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "worker_criteria").withColumn("chars", F.length(F.coalesce("name", F.lit(""))))
    return spans.budget_pack(c, ["finding_id"], ["criterion_id", "loaded_at"], "chars", 40)


_NORMAL_SQL = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+', '', 'g')"


@query(
    f"WITH i AS (SELECT item_id, {_NORMAL_SQL.format('item_text')} t FROM eval_items), n AS (SELECT item_id, substring(t, ((length(t) - 80) // 2 + 1)::BIGINT, 80) needle FROM i WHERE length(t) >= 80), "
    f"d AS (SELECT doc_id, {_NORMAL_SQL.format('text')} t FROM documents WHERE text IS NOT NULL) SELECT doc_id, item_id FROM d JOIN n ON contains(d.t, n.needle)"
)
def passage_containment(spark: SparkSession, d: str) -> DataFrame:
    """Needles are the fixed side; one automaton finds all of them in one pass over each text."""
    normal = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{Nd}\p{Pc}]+", "")
    needles = table(spark, d, "eval_items").select("item_id", spans.support_needle(normal(F.col("item_text"))).alias("needle"))
    docs = table(spark, d, "documents").select("doc_id", normal(F.col("text")).alias("text"))
    return contained(docs, needles.where("needle IS NOT NULL"), "doc_id", "text", "item_id", "needle")


@query("SELECT min(doc_id) first_doc, count(*) n_docs FROM documents WHERE text IS NOT NULL GROUP BY trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))")
def text_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.groupBy(T.collapse(F.col("text")).alias("sig")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs")).drop("sig")


@query(
    f"SELECT k.name, count(CASE WHEN contains(f, k.stem) THEN 1 END) docs_hit, coalesce(sum((length(f) - length(replace(f, k.stem, ''))) // length(k.stem)), 0)::BIGINT total FROM (SELECT translate(lower(text), '{T.ACCENTED}', '{T.UNACCENTED}') f FROM documents), (VALUES {values(KEYWORDS)}) k(name, stem) GROUP BY 1"
)
def keyword_census(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all keywords in one aggregate over the texts; dead keywords show with 0."""
    docs = table(spark, d, "documents").select(T.fold(F.col("text")).alias("f"))
    count = lambda k: F.floor((F.length("f") - F.length(F.replace(F.col("f"), F.lit(k), F.lit("")))) / len(k))
    one = docs.agg(*[x for n, k in KEYWORDS.items() for x in (F.count(F.when(F.col("f").contains(k), 1)).alias(f"d_{n}"), F.coalesce(F.sum(count(k)), F.lit(0)).alias(f"t_{n}"))])
    args = ", ".join(f"'{n}', d_{n}, cast(t_{n} as bigint)" for n in KEYWORDS)
    return one.selectExpr(f"stack({len(KEYWORDS)}, {args}) as (name, docs_hit, total)")


# --- evidence -----------------------------------------------------------------------------------


@query(
    "WITH r AS (SELECT category, evidence_id, row_number() OVER (PARTITION BY category ORDER BY evidence_id) i, count(*) OVER (PARTITION BY category) n FROM standards_evidence), "
    "k AS (SELECT DISTINCT category, n, CASE WHEN n <= 4 THEN j + 1 ELSE 1 + (j * (n - 1)) // 3 END i FROM r, range(0, 4) t(j)) SELECT r.category, r.evidence_id FROM r JOIN k ON r.category IS NOT DISTINCT FROM k.category AND r.i = k.i"
)
def evidence_sample(spark: SparkSession, d: str) -> DataFrame:
    """Four evenly spaced records per category, by ranks counted in parallel (a sample is the feature)."""
    ranked = skew_rank(table(spark, d, "standards_evidence").select("category", "evidence_id"), ["category"], "evidence_id")
    i, n = F.col("rank"), F.col("group_size")
    picked = sum((((i - 1) == F.floor(F.lit(j) * (n - 1) / 3)).cast("int") for j in range(4)), F.lit(0)) > 0
    return ranked.where((n <= 4) | picked).select("category", "evidence_id")


@query(
    "WITH e AS (SELECT name, json_extract_string(evidence, '$.phase') phase, category, evidence_id FROM standards_evidence WHERE name IS NOT NULL AND evidence IS NOT NULL), "
    "p AS (SELECT name, lower(trim(phase)) phase, min(evidence_id) f, count(*) c FROM e GROUP BY 1, 2) "
    "SELECT p.name, sum(c)::BIGINT n, string_agg(phase, ',' ORDER BY f) FILTER (phase IS NOT NULL) phases, any_value(x.category) category FROM p JOIN (SELECT name, arg_min(coalesce(category, '-'), evidence_id) category FROM e GROUP BY 1) x USING (name) GROUP BY p.name"
)
def findings_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "standards_evidence").where("name IS NOT NULL AND evidence IS NOT NULL")
    e = e.select("name", F.lower(F.trim(F.get_json_object("evidence", "$.phase"))).alias("phase"), F.coalesce("category", F.lit("-")).alias("category"), "evidence_id")
    p = e.groupBy("name", "phase").agg(F.min(F.struct("evidence_id", "category")).alias("f"), F.count("*").alias("c"))
    listed = F.array_sort(F.collect_list(F.when(F.col("phase").isNotNull(), F.struct("f.evidence_id", "phase"))))
    out = p.groupBy("name").agg(F.sum("c").alias("n"), listed.alias("l"), F.min("f")["category"].alias("category"))
    phases = F.transform("l", lambda x: x["phase"])
    return out.select("name", "n", F.when(F.size("l") > 0, F.array_join(phases, ",")).alias("phases"), "category")


@query(
    "WITH v AS (SELECT name, model, max(lower(json_extract_string(evidence, '$.phase'))) p FROM (SELECT name, coalesce(model, 'none') model, CASE WHEN evidence IS NOT NULL THEN evidence END evidence FROM standards_evidence) GROUP BY 1, 2), "
    "w AS (SELECT name, max(p) FILTER (model = 'model_a') a, max(p) FILTER (model = 'model_b') b, max(p) FILTER (model = 'model_c') c FROM v GROUP BY 1) "
    "SELECT name, coalesce(a, '-') model_a, coalesce(b, '-') model_b, coalesce(c, '-') model_c, CASE WHEN len(list_distinct(list_filter([a, b, c], lambda x: x IS NOT NULL))) <= 1 THEN true END agree FROM w"
)
def verdict_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "standards_evidence").select("name", F.coalesce("model", F.lit("none")).alias("model"), F.lower(F.get_json_object("evidence", "$.phase")).alias("p"))
    return runs.verdict_pivot(e, "name", "model", F.col("p"), ["model_a", "model_b", "model_c"])


# --- criteria and lots --------------------------------------------------------------------------

_LOT_TEXT = "lower(trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g')))"
_LOT_SQL = (
    f"CASE WHEN {{0}} IS NULL OR {_LOT_TEXT} IN ('', 'null') THEN 'all' "
    f"WHEN len(regexp_extract_all({{0}}, '\\p{{{{Nd}}}}+')) = 1 AND regexp_matches({_LOT_TEXT}, '(^|[^\\p{{{{L}}}}\\p{{{{N}}}}_])\\p{{{{Nd}}}}+($|[^\\p{{{{L}}}}\\p{{{{N}}}}_])') "
    f"AND (regexp_matches({_LOT_TEXT}, '(^|[^\\p{{{{L}}}}\\p{{{{N}}}}_])(daļ|lots?($|[^\\p{{{{L}}}}\\p{{{{N}}}}_]))') OR regexp_matches({_LOT_TEXT}, '^\\p{{{{Nd}}}}+\\.*$')) "
    f"THEN coalesce(nullif(ltrim(regexp_extract({{0}}, '\\p{{{{Nd}}}}+'), '0'), ''), '0') ELSE {_LOT_TEXT} END"
)


@query(f"SELECT {_LOT_SQL.format('lot')} lot_key, count(*) n FROM worker_criteria GROUP BY 1")
def lot_key_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "worker_criteria").groupBy(T.lot_key(F.col("lot")).alias("lot_key")).agg(F.count("*").alias("n"))


@query(
    "WITH w AS (SELECT weight_text, trim(weight_text) t, string_split_regex(lower(trim(weight_text)), '\\s+') x, string_split_regex(regexp_replace(trim(weight_text), '\\s+%', '%', 'g'), '[\\s;|/]+') p FROM worker_criteria), "
    "y AS (SELECT *, CASE WHEN x[2] IN ('point', 'points') THEN list_concat(x[1:1], x[3:]) ELSE x END z, list_transform(p, lambda v: CASE WHEN regexp_matches(v, '^[+]?[0-9]+([.,][0-9]+)?%?$') THEN CAST(replace(replace(replace(v, '+', ''), '%', ''), ',', '.') AS DECIMAL(18,3)) END) q FROM w), "
    "r AS (SELECT *, len(z) = 4 AND z[2] = 'out' AND z[3] = 'of' said, TRY_CAST(replace(z[1], ',', '.') AS DECIMAL(18,3)) n, TRY_CAST(replace(z[4], ',', '.') AS DECIMAL(18,3)) m FROM y) "
    "SELECT weight_text, count(*) n, coalesce(CASE WHEN t IS NULL OR t = '' THEN '' WHEN said THEN CASE WHEN r.n >= 0 AND m > 0 AND r.n <= m THEN CAST(r.n AS VARCHAR) ELSE '' END WHEN len(list_filter(q, lambda v: v IS NULL)) = 0 THEN array_to_string(list_transform(q, lambda v: CAST(v AS VARCHAR)), ';') ELSE '' END, '') weights FROM r GROUP BY ALL"
)
def weight_parse(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "worker_criteria").groupBy("weight_text").agg(F.count("*").alias("n"))
    shown = F.transform(T.parse_weights(F.col("weight_text")), lambda x: x.cast("decimal(18,3)").cast("string"))
    return t.select("weight_text", "n", F.array_join(shown, ";").alias("weights"))


_LATEST_SQL = "(SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY {1} ORDER BY loaded_at DESC) = 1)"
_SCALE_SQL = "CASE WHEN lower(trim(weight_scale)) IN ('points', 'punkti', 'pts') THEN 'points' WHEN lower(trim(weight_scale)) IN ('fraction', 'daļa') THEN 'fraction' ELSE 'unknown' END"


def _scale() -> F.Column:
    s = F.lower(F.trim("weight_scale"))
    return F.when(s.isin("points", "punkti", "pts"), "points").when(s.isin("fraction", "daļa"), "fraction").otherwise("unknown")


def _criteria_with_findings(spark: SparkSession, d: str) -> DataFrame:
    c = runs.latest_per_key(table(spark, d, "worker_criteria"), ["criterion_id"], ["loaded_at"])
    f = runs.latest_per_key(table(spark, d, "worker_findings").select("finding_id", "loaded_at", "weight_scale", "status", "scope_unclear", "source_conflict", "evidence_incomplete"), ["finding_id"], ["loaded_at"])
    return c.drop("loaded_at").join(f.drop("loaded_at"), "finding_id")


@query(
    f"WITH c AS {_LATEST_SQL.format('worker_criteria', 'criterion_id')}, f AS {_LATEST_SQL.format('worker_findings', 'finding_id')}, "
    f"a AS (SELECT finding_id, {_LOT_SQL.format('lot')} lot_key, count(*) n_criteria, count(*) - count(weight) n0, sum(CAST(weight AS DECIMAL(18,6))) t0, nullif({_SCALE_SQL}, 'unknown') k0, bool_or(coalesce(scope_unclear, false) OR coalesce(source_conflict, false) OR coalesce(evidence_incomplete, false)) bad "
    "FROM c JOIN f USING (finding_id) GROUP BY finding_id, lot_key, k0), b AS (SELECT *, n_criteria = 1 AND n0 = 1 sole FROM a), e AS (SELECT *, CASE WHEN sole THEN coalesce(k0, 'points') ELSE k0 END k FROM b), "
    "g AS (SELECT *, CASE k WHEN 'points' THEN 100 WHEN 'fraction' THEN 1 END target FROM e), h AS (SELECT *, CASE WHEN sole THEN target ELSE t0 END total FROM g) "
    "SELECT finding_id, lot_key, n_criteria, CASE WHEN sole THEN 0 ELSE n0 END missing, round(CAST(total AS DOUBLE), 4) total, CAST(target AS DOUBLE) target, CASE WHEN bad THEN 'unresolved' WHEN NOT sole AND n0 > 0 THEN 'missing_weights' WHEN k IS NULL THEN 'unknown_scale' "
    "WHEN abs(total - target) > CASE WHEN k = 'points' THEN 0.5 ELSE 0.005 END THEN 'total_mismatch' ELSE 'reconciled' END status FROM h"
)
def lot_reconcile(spark: SparkSession, d: str) -> DataFrame:
    rows = _criteria_with_findings(spark, d).withColumn("lot_key", T.lot_key(F.col("lot")))
    bad = F.coalesce("scope_unclear", F.lit(False)) | F.coalesce("source_conflict", F.lit(False)) | F.coalesce("evidence_incomplete", F.lit(False))
    out = reconcile.lot_status(rows, ["finding_id", "lot_key"], "weight", _scale(), bad)
    return out.withColumn("total", F.round(F.col("total").cast("double"), 4)).withColumn("target", F.col("target").cast("double"))


@query(
    f"WITH c AS {_LATEST_SQL.format('worker_criteria', 'criterion_id')}, l AS (SELECT finding_id, eis_id, {_LOT_SQL.format('lot')} k, sum(CAST(weight AS DECIMAL(18,6))) t, count(*) n, count(weight) m FROM c GROUP BY ALL), "
    "s AS (SELECT *, CASE WHEN n <> m THEN 'incomplete' WHEN abs(t - 100) <= 0.5 THEN 'available' ELSE 'total_mismatch' END status FROM l) "
    "SELECT eis_id, coalesce(arg_min(status, struct_pack(a := finding_id, b := k)) FILTER (status <> 'available'), 'available') record_status, count(*) n_lots FROM s GROUP BY 1"
)
def reference_eligibility(spark: SparkSession, d: str) -> DataFrame:
    c = runs.latest_per_key(table(spark, d, "worker_criteria"), ["criterion_id"], ["loaded_at"])
    lots = c.groupBy("eis_id", "finding_id", T.lot_key(F.col("lot")).alias("k")).agg(F.sum(F.col("weight").cast("decimal(18,6)")).alias("t"), F.count("*").alias("n"), F.count("weight").alias("m"))
    status = F.when(F.col("n") != F.col("m"), "incomplete").when(F.abs(F.col("t") - 100) <= 0.5, "available").otherwise("total_mismatch")
    lots = lots.withColumn("status", status).withColumn("o", F.struct("finding_id", "k"))
    return reconcile.record_status(lots, ["eis_id"], "o", "status").join(lots.groupBy("eis_id").agg(F.count("*").alias("n_lots")), "eis_id")


@query(
    f"WITH c AS (SELECT DISTINCT eis_id, {_LOT_SQL.format('lot')} k FROM worker_criteria), f AS (SELECT DISTINCT eis_id, {_LOT_SQL.format('lot_label')} k FROM worker_findings), "
    "a AS (SELECT eis_id, count(*) FILTER (k <> 'all') named, count(*) FILTER (k = 'all') unnamed, count(*) FILTER (len(regexp_extract_all(k, '[0-9]+')) > 1) several FROM c GROUP BY 1), "
    "b AS (SELECT eis_id, count(*) FILTER (k <> 'all') declared, count(*) FILTER (len(regexp_extract_all(k, '[0-9]+')) > 1) several FROM f GROUP BY 1) "
    "SELECT a.eis_id, CASE WHEN a.several + coalesce(b.several, 0) > 0 THEN 'multiple_numbers' WHEN named > 0 AND unnamed > 0 THEN 'mixed' WHEN unnamed > 0 AND declared > 1 THEN 'several_unlabelled' END problem FROM a LEFT JOIN b ON a.eis_id IS NOT DISTINCT FROM b.eis_id"
)
def scope_validator(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a procurement's criteria against the lots that its findings declare."""
    declared = table(spark, d, "worker_findings").select("eis_id", F.col("lot_label").alias("lot"))
    return reconcile.scope_problem(table(spark, d, "worker_criteria"), "eis_id", "lot", F.lit(False), declared)


@query(
    f"SELECT finding_id, {_LOT_SQL.format('lot')} lot_key, lower(trim(regexp_replace(name, '[\\s\\p{{Z}}]+', ' ', 'g'))) name_key, weight, count(*) n_rows, array_to_string(list_sort(list_distinct(flatten(list(coalesce(evidence_ids, []))))), ',') evidence FROM worker_criteria GROUP BY 1, 2, 3, 4"
)
def near_dup_merge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "worker_criteria").withColumn("lot_key", T.lot_key(F.col("lot")))
    out = reconcile.merge_exact(c, ["finding_id", "lot_key"], "name", "weight", "evidence_ids")
    return out.withColumn("evidence", F.array_join("evidence", ","))


@query(
    f"WITH c AS (SELECT DISTINCT finding_id, {_LOT_SQL.format('lot')} k FROM worker_criteria), f AS (SELECT DISTINCT finding_id, {_LOT_SQL.format('lot_label')} k FROM worker_findings) "
    "SELECT coalesce(c.finding_id, f.finding_id) finding_id, coalesce(c.k, f.k) lot_key, c.k IS NOT NULL in_criteria, f.k IS NOT NULL in_finding FROM c FULL JOIN f ON c.finding_id = f.finding_id AND c.k = f.k"
)
def lots_full_outer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "worker_criteria").select("finding_id", T.lot_key(F.col("lot")).alias("lot_key")).distinct().withColumn("in_criteria", F.lit(True))
    f = table(spark, d, "worker_findings").select("finding_id", T.lot_key(F.col("lot_label")).alias("lot_key")).distinct().withColumn("in_finding", F.lit(True))
    return c.join(f, ["finding_id", "lot_key"], "full").fillna(False, ["in_criteria", "in_finding"])


@query(
    "WITH g AS (SELECT eis_id, list_sort(list_distinct(list(trim(lot_label)) FILTER (lot_label IS NOT NULL AND trim(lot_label) <> ''))) l FROM worker_findings GROUP BY 1) "
    "SELECT eis_id, i::INT task_no, l[i] lot_label, false fallback FROM (SELECT eis_id, l, unnest(range(1, len(l) + 1)) i FROM g WHERE len(l) > 0) UNION ALL SELECT eis_id, 1, NULL, true FROM g WHERE len(coalesce(l, [])) = 0"
)
def task_plan(spark: SparkSession, d: str) -> DataFrame:
    label = F.trim("lot_label")
    g = table(spark, d, "worker_findings").groupBy("eis_id").agg(F.array_sort(F.collect_set(F.when(label != "", label))).alias("labels"))
    return runs.task_plan(g, "eis_id", "labels")


@query(
    f"WITH c AS {_LATEST_SQL.format('worker_criteria', 'criterion_id')} SELECT criterion_id, coalesce(weight, TRY_CAST(replace(regexp_extract(trim(weight_text), '^([0-9]+([.,][0-9]+)?)\\s*%?$', 1), ',', '.') AS DOUBLE)) weight, weight IS NULL AND regexp_matches(trim(weight_text), '^([0-9]+([.,][0-9]+)?)\\s*%?$') corrected FROM c"
)
def correction_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """A second pass over failing rows only; what it can't read keeps its first result."""
    c = runs.latest_per_key(table(spark, d, "worker_criteria"), ["criterion_id"], ["loaded_at"])
    second = F.regexp_extract(F.trim("weight_text"), r"^([0-9]+([.,][0-9]+)?)\s*%?$", 1)
    fixed = F.replace(second, F.lit(","), F.lit(".")).try_cast("double")
    return c.select("criterion_id", F.coalesce("weight", fixed).alias("weight"), (F.col("weight").isNull() & F.trim("weight_text").rlike(r"^([0-9]+([.,][0-9]+)?)\s*%?$")).alias("corrected"))


# --- agreement ----------------------------------------------------------------------------------

_NUMBERS_SQL = "list_transform(regexp_extract_all({0}, '[0-9]+(?:[.,][0-9]+)?'), lambda x: CAST(replace(x, ',', '.') AS DECIMAL(18,6)))"


def _numbers(c: str) -> F.Column:
    found = F.regexp_extract_all(F.col(c), F.lit("[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("decimal(18,6)"))


_BAGS_SQL = (
    f"p AS (SELECT row_no, unnest({_NUMBERS_SQL.format('weights_extracted')}) v FROM validation_gemma4_e4b), g AS (SELECT row_no, unnest({_NUMBERS_SQL.format('weights_truth')}) v FROM validation_gemma4_e4b), "
    "pc AS (SELECT row_no, v, count(*) p FROM p GROUP BY ALL), gc AS (SELECT row_no, v, count(*) g FROM g GROUP BY ALL), t AS (SELECT row_no, sum(least(coalesce(p, 0), coalesce(g, 0)))::BIGINT tp, sum(greatest(coalesce(p, 0) - coalesce(g, 0), 0))::BIGINT fp, sum(greatest(coalesce(g, 0) - coalesce(p, 0), 0))::BIGINT fn FROM pc FULL JOIN gc USING (row_no, v) GROUP BY 1)"
)


def _bags(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "validation_gemma4_e4b")
    p = v.select("row_no", F.explode(_numbers("weights_extracted")).alias("v"), F.lit(True).alias("pred"))
    return p.unionByName(v.select("row_no", F.explode(_numbers("weights_truth")).alias("v"), F.lit(False).alias("pred")))


def _tallies(spark: SparkSession, d: str) -> DataFrame:
    return scoring.multiset_tally(_bags(spark, d), ["row_no"], F.col("v"), F.col("pred"))


@query(f"WITH {_BAGS_SQL} SELECT row_no, tp, fp, fn FROM t")
def multiset_prf(spark: SparkSession, d: str) -> DataFrame:
    return _tallies(spark, d)


@query(
    f"WITH p AS (SELECT row_no, unnest({_NUMBERS_SQL.format('weights_extracted')}) v FROM validation_gemma4_e4b), g AS (SELECT row_no, unnest({_NUMBERS_SQL.format('weights_truth')}) v FROM validation_gemma4_e4b) "
    "SELECT 'both' side, count(*) n FROM (SELECT * FROM p INTERSECT ALL SELECT * FROM g) UNION ALL SELECT 'extracted_only', count(*) FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM g) UNION ALL SELECT 'truth_only', count(*) FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM p)"
)
def bag_intersect_except(spark: SparkSession, d: str) -> DataFrame:
    b = _bags(spark, d)
    p, g = b.where("pred").drop("pred"), b.where("NOT pred").drop("pred")
    parts = {"both": p.intersectAll(g), "extracted_only": p.exceptAll(g), "truth_only": g.exceptAll(p)}
    out = None
    for name, x in parts.items():
        one = x.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"WITH RECURSIVE v AS (SELECT row_no, list_sort(coalesce({_NUMBERS_SQL.format('weights_extracted')}, [])) p, list_sort(coalesce({_NUMBERS_SQL.format('weights_truth')}, [])) g, weights_extracted IS NULL OR weights_truth IS NULL blank FROM validation_gemma4_e4b), "
    "w AS (SELECT row_no, p, g, 1 i, 1 j, 0 m FROM v UNION ALL SELECT row_no, p, g, CASE WHEN p[i] <= g[j] + 0.01 THEN i + 1 ELSE i END, CASE WHEN p[i] >= g[j] - 0.01 THEN j + 1 ELSE j END, m + (abs(p[i] - g[j]) <= 0.01)::INT FROM w WHERE i <= len(p) AND j <= len(g)), "
    "b AS (SELECT row_no, max(m)::BIGINT matched FROM w GROUP BY 1) SELECT row_no, CASE WHEN blank THEN 0 ELSE matched END matched, len(p)::BIGINT n_pred, len(g)::BIGINT n_gold FROM v JOIN b USING (row_no)"
)
def tolerance_match(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "validation_gemma4_e4b")
    p, g = F.array_sort(_numbers("weights_extracted")), F.array_sort(_numbers("weights_truth"))
    pair = v.select("row_no", p.alias("p"), g.alias("g"))
    # the number of matches at tolerance 0.01, beside the exact bag
    return pair.select("row_no", scoring.tolerance_match(F.col("p"), F.col("g"), 0.01).cast("long").alias("matched"), F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("n_pred"), F.coalesce(F.size("g"), F.lit(0)).cast("long").alias("n_gold"))


@query(
    f"SELECT row_no, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) f1 FROM (SELECT row_no, list_distinct(regexp_extract_all(coalesce(additional_cpv_extracted, ''), '{CODE}')) a, list_distinct(regexp_extract_all(coalesce(additional_cpv_truth, ''), '{CODE}')) b FROM validation_gemma4_e4b)"
)
def set_f1(spark: SparkSession, d: str) -> DataFrame:
    codes = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CODE), F.lit(0))
    return table(spark, d, "validation_gemma4_e4b").select("row_no", F.round(scoring.set_f1(codes("additional_cpv_extracted"), codes("additional_cpv_truth")), 6).alias("f1"))


_SCALAR_SQL = (
    "s AS (SELECT cpv_status, criteria_reference, (p IS NOT NULL AND p = g)::INT tp, (p IS NOT NULL AND p IS DISTINCT FROM g)::INT fp, (g IS NOT NULL AND p IS DISTINCT FROM g)::INT fn FROM "
    f"(SELECT cpv_status, criteria_reference, nullif(regexp_replace(main_cpv_extracted, '[\\s\\p{{Z}}]+', '', 'g'), '') p, nullif(regexp_replace(main_cpv_truth, '[\\s\\p{{Z}}]+', '', 'g'), '') g FROM validation_gemma4_e4b) WHERE g IS NOT NULL)"
)
_PRF_SQL = "round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) \"precision\", round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1"


def _scalar(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "validation_gemma4_e4b")
    p, g = (F.nullif(F.regexp_replace(c, r"[\s\p{Z}]+", ""), F.lit("")) for c in ("main_cpv_extracted", "main_cpv_truth"))
    return v.where(g.isNotNull()).select("cpv_status", "criteria_reference", scoring.scalar_tally(p, g).alias("t")).select("cpv_status", "criteria_reference", "t.*")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c in ("precision", "recall", "f1") or c.startswith("macro_")})


@query(f"WITH {_SCALAR_SQL} SELECT tp, fp, fn, {_PRF_SQL} FROM (SELECT sum(tp)::BIGINT tp, sum(fp)::BIGINT fp, sum(fn)::BIGINT fn FROM s)")
def prf_micro(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.pooled(_scalar(spark, d), []))


@query(
    f"WITH {_BAGS_SQL}, r AS (SELECT coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) r FROM t) SELECT count(*) records, round(avg(p), 6) macro_precision, round(avg(r), 6) macro_recall, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) macro_f1 FROM r"
)
def prf_macro(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.averaged(_tallies(spark, d), []))


@query(f"WITH {_SCALAR_SQL} SELECT cpv_status, criteria_reference, level, tp, fp, fn, {_PRF_SQL} FROM (SELECT cpv_status, criteria_reference, grouping(cpv_status, criteria_reference)::BIGINT AS level, sum(tp)::BIGINT tp, sum(fp)::BIGINT fp, sum(fn)::BIGINT fn FROM s GROUP BY ROLLUP (cpv_status, criteria_reference))")
def prf_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    s = _scalar(spark, d).rollup("cpv_status", "criteria_reference").agg(F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return _rounded(s.select("cpv_status", "criteria_reference", "level", "tp", "fp", "fn", *scoring.prf(F.col("tp"), F.col("fp"), F.col("fn"))))


@query(
    "WITH a AS (SELECT DISTINCT eis_id FROM validation_gemma4_e4b WHERE eis_id IS NOT NULL), b AS (SELECT DISTINCT eis_id FROM reference_records WHERE eis_id IS NOT NULL) SELECT coalesce(a.eis_id, b.eis_id) eis_id, CASE WHEN b.eis_id IS NULL THEN 'no_reference' WHEN a.eis_id IS NULL THEN 'no_output' ELSE 'matched' END coverage FROM a FULL JOIN b ON a.eis_id = b.eis_id"
)
def coverage_worklists(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "validation_gemma4_e4b").select("eis_id").dropna().distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "reference_records").select("eis_id").dropna().distinct().withColumn("b", F.lit(1))
    coverage = F.when(F.col("b").isNull(), "no_reference").when(F.col("a").isNull(), "no_output").otherwise("matched")
    return a.join(b, "eis_id", "full").select("eis_id", coverage.alias("coverage"))


@query(
    "SELECT 'union' op, count(*) n FROM (SELECT eis_id FROM documents UNION SELECT eis_id FROM ocr_pages) UNION ALL SELECT 'intersect', count(*) FROM (SELECT eis_id FROM documents INTERSECT SELECT eis_id FROM ocr_pages) UNION ALL SELECT 'except', count(*) FROM (SELECT eis_id FROM documents EXCEPT SELECT eis_id FROM ocr_pages)"
)
def id_set_ops(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "documents").select("eis_id"), table(spark, d, "ocr_pages").select("eis_id")
    n = lambda name, x: x.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return n("union", a.union(b).distinct()).unionByName(n("intersect", a.intersect(b))).unionByName(n("except", a.subtract(b)))


# --- runs, logs, reviews ------------------------------------------------------------------------


@query(
    "WITH v AS (SELECT * FROM validation_gemma4_e4b QUALIFY row_number() OVER (PARTITION BY eis_id, run_no ORDER BY row_no DESC) = 1), a AS (SELECT * FROM v WHERE run_no = 1), b AS (SELECT * FROM v WHERE run_no = 2) "
    "SELECT eis_id, array_to_string(list_filter([CASE WHEN a.main_cpv_extracted IS DISTINCT FROM b.main_cpv_extracted THEN 'main_cpv_extracted' END, CASE WHEN a.weights_extracted IS DISTINCT FROM b.weights_extracted THEN 'weights_extracted' END, CASE WHEN a.cpv_status IS DISTINCT FROM b.cpv_status THEN 'cpv_status' END], lambda x: x IS NOT NULL), ',') changed, "
    "((a.main_cpv_extracted IS DISTINCT FROM b.main_cpv_extracted)::INT + (a.weights_extracted IS DISTINCT FROM b.weights_extracted)::INT + (a.cpv_status IS DISTINCT FROM b.cpv_status)::INT)::BIGINT n_changed FROM a JOIN b USING (eis_id)"
)
def run_diff(spark: SparkSession, d: str) -> DataFrame:
    fields = ["main_cpv_extracted", "weights_extracted", "cpv_status"]
    v = runs.latest_per_key(table(spark, d, "validation_gemma4_e4b").select("eis_id", "run_no", "row_no", *fields), ["eis_id", "run_no"], ["row_no"])
    return runs.run_diff(v.where("run_no = 1"), v.where("run_no = 2"), ["eis_id"], fields)


@query("SELECT finding_id, max(loaded_at) loaded_at, count(*) n_deliveries FROM worker_findings GROUP BY 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "worker_findings")
    last = runs.latest_per_key(f, ["finding_id"], ["loaded_at"]).select("finding_id", "loaded_at")
    return last.join(f.groupBy("finding_id").agg(F.count("*").alias("n_deliveries")), "finding_id")


@query(
    "WITH v AS (SELECT eis_id, run_no, row_no, main_cpv_match = 'True' ok FROM validation_gemma4_e4b WHERE main_cpv_match IN ('True', 'False')), f AS (SELECT eis_id, arg_min(ok::INT, struct_pack(a := run_no, b := row_no)) first_ok, arg_max(ok::INT, struct_pack(a := run_no, b := row_no)) last_ok FROM v GROUP BY 1) "
    "SELECT eis_id, first_ok, last_ok, CASE WHEN last_ok > first_ok THEN 'improved' WHEN last_ok < first_ok THEN 'worsened' ELSE 'unchanged' END change FROM f"
)
def first_last_change(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "validation_gemma4_e4b")
    good = F.when(F.col("main_cpv_match").isin("True", "False"), F.col("main_cpv_match") == "True")
    return runs.first_last_change(v, ["eis_id"], ["run_no", "row_no"], good)


@query(
    "WITH n AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT session_no FROM n) SELECT user_id, session_no, count(*) n_events FROM s GROUP BY ALL"
)
def log_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return runs.sessions(e, ["user_id"], "ts", 1800).groupBy("user_id", "session_no").agg(F.count("*").alias("n_events"))


@query("SELECT event_type stage, count(*) n_runs, round(sum(value), 2) total_s FROM events GROUP BY 1")
def stage_timing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n_runs"), F.round(F.sum("value"), 2).alias("total_s"))


@query(
    "WITH r AS (SELECT attempts, feedback, CASE WHEN cpv_seconds >= 0 AND NOT isnan(cpv_seconds) AND NOT isinf(cpv_seconds) THEN cpv_seconds END s FROM run_states) SELECT attempts, feedback, count(*) n, count(*) - count(s) n_missing, round(sum(s), 2) total_s, round(avg(s), 2) mean_s, round(median(s), 2) median_s FROM r GROUP BY GROUPING SETS ((attempts), (feedback), ())"
)
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return runs.latency_summary(table(spark, d, "run_states").select("attempts", "feedback", "cpv_seconds"), ["attempts", "feedback"], "cpv_seconds")


@query(
    "WITH o AS (SELECT count(*)::DOUBLE pages, count(DISTINCT eis_id)::DOUBLE procurements, sum(chars)::DOUBLE chars, round(sum(ocr_seconds), 2) secs FROM ocr_pages) SELECT unnest(['pages', 'procurements', 'chars', 'seconds']) measure, unnest([pages, procurements, chars, secs]) \"value\" FROM o"
)
def kpi_unpivot(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "ocr_pages").agg(F.count("*").alias("pages"), F.countDistinct("eis_id").alias("procurements"), F.sum("chars").alias("chars"), F.round(F.sum("ocr_seconds"), 2).alias("seconds"))
    return runs.kpi_rows(one, ["pages", "procurements", "chars", "seconds"])


@query(
    "SELECT eis_id, count(*) candidates, count(status) attempted, count(*) FILTER (status = 'completed') decided, count(*) FILTER (status <> 'completed') unresolved, count(*) FILTER (status IS NULL) not_attempted, count(*) FILTER (source_conflict) human_reviewed, count(*) FILTER (status = 'completed' AND NOT scope_unclear) applies, sum(evidence_incomplete::INT)::BIGINT pauses, count(*) FILTER (scope_unclear) overridden, count(*) FILTER (status = 'completed') = count(*) complete FROM worker_findings GROUP BY 1"
)
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "worker_findings")
    out = runs.review_summary(
        f, ["eis_id"], ~F.col("scope_unclear"), F.when(F.col("status") == "completed", "decided").otherwise(F.col("status")), F.col("source_conflict").cast("int"), F.col("evidence_incomplete").cast("int"), F.col("scope_unclear"), F.lit(None).cast("double")
    )
    return out.drop("seconds", "seconds_each")


_ACTIONS = {"view": "start", "click": "propose", "error": "pause", "purchase": "approve", "signup": "edit"}


@query(
    "WITH RECURSIVE e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS \"day\", CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'propose' WHEN 'error' THEN 'pause' WHEN 'purchase' THEN 'approve' WHEN 'signup' THEN 'edit' END a, event_id, event_id::VARCHAR v, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) i FROM events), "
    "f AS (SELECT user_id, \"day\", 0::BIGINT i, 'new' state, NULL::VARCHAR proposal, NULL::VARCHAR verdict, false edited, 0 pauses FROM (SELECT DISTINCT user_id, \"day\" FROM e) UNION ALL "
    "SELECT f.user_id, f.\"day\", e.i, CASE WHEN a = 'pause' THEN 'pending' WHEN a IN ('approve', 'edit') THEN 'decided' WHEN a = 'start' THEN 'open' ELSE state END, CASE WHEN a = 'propose' THEN v ELSE proposal END, CASE WHEN a = 'edit' THEN v WHEN a = 'approve' AND NOT edited THEN proposal ELSE verdict END, edited OR coalesce(a = 'edit', false), pauses + coalesce(a = 'pause', false)::INT "
    "FROM f JOIN e ON e.user_id = f.user_id AND e.\"day\" = f.\"day\" AND e.i = f.i + 1) SELECT user_id, \"day\", state, verdict, pauses, i n_events FROM f QUALIFY i = max(i) OVER (PARTITION BY user_id, \"day\")"
)
def review_fold(spark: SparkSession, d: str) -> DataFrame:
    """Each user's session of a day as a review; proposals are called by their event."""
    action = F.create_map(*[F.lit(x) for kv in _ACTIONS.items() for x in kv])
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", action[F.col("event_type")].alias("action"), F.col("event_id").cast("string").alias("value"))
    return runs.fold_session(e, ["user_id", "day"], "event_id", "action", "value")


@query(
    "WITH t AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'call' WHEN 'purchase' THEN 'reply' WHEN 'error' THEN 'reply' END role, json_extract_string(props, '$.k') k, event_type = 'purchase' ok FROM events), c AS (SELECT user_id, max(event_id) call_at, arg_max(k, event_id) k FROM t WHERE role = 'call' GROUP BY 1), r AS (SELECT user_id, k, max(event_id) reply_at, arg_max(ok, event_id) ok FROM t WHERE role = 'reply' GROUP BY ALL) "
    "SELECT user_id, k, call_at, reply_at, coalesce(ok AND reply_at > call_at, false) valid FROM c LEFT JOIN r USING (user_id, k)"
)
def last_call_reply(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("event_type") == "click", "call").when(F.col("event_type").isin("purchase", "error"), "reply")
    t = table(spark, d, "events").select("user_id", "event_id", role.alias("role"), F.get_json_object("props", "$.k").alias("k"), (F.col("event_type") == "purchase").alias("ok"))
    return runs.last_call_reply(t, ["user_id"], "event_id", "role", "k", F.col("ok"))


@query(
    "WITH h AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':2026'), doc_id) pick, count(*) OVER (PARTITION BY lang) population FROM documents) SELECT lang, doc_id, pick, population FROM h WHERE pick <= 5"
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five documents per language by a seeded hash (a sample is the feature)."""
    out = runs.stratified_sample(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 5)
    return out.withColumn("pick", F.col("pick").cast("long"))


@query(
    "SELECT state_id, loaded_at, CASE WHEN cpv_seconds > 100 THEN 'input_budget_exceeded' WHEN cpv_seconds IS NULL THEN 'error' WHEN feedback IS NOT NULL AND trim(feedback) <> '' THEN 'unresolved' WHEN candidates IS NOT NULL AND len(candidates) > 0 AND attempts = 1 THEN 'accepted' WHEN len(candidates) > 0 THEN 'not_reviewed' WHEN coalesce(len(candidates), 0) = 0 THEN 'no_candidates' ELSE 'unresolved' END status FROM run_states"
)
def status_precedence(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size("candidates"), F.lit(0))
    has = n > 0
    verdict = F.when(F.trim("feedback") != "", "revise").when(F.col("attempts") == 1, "accept")
    status = runs.final_status(F.coalesce(F.col("cpv_seconds") > 100, F.lit(False)), F.when(F.col("cpv_seconds").isNull(), "timing"), verdict, F.when(has, "code"), F.lit(0), has, n)
    return table(spark, d, "run_states").select("state_id", "loaded_at", status.alias("status"))


@query("SELECT record_id, regexp_extract(body, '/Procurement/([0-9]+)', 1) procurement, eis_id = regexp_extract(body, '/Procurement/([0-9]+)', 1) same FROM reference_records WHERE regexp_matches(body, '/Procurement/[0-9]+')")
def url_fields(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference_records").withColumn("procurement", T.url_number(F.col("body"))).where("procurement IS NOT NULL")
    return r.select("record_id", "procurement", (F.col("eis_id") == F.col("procurement")).alias("same"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT k, json_valid(props) is_json FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.try_cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$").isNotNull(), F.lit(False)).alias("is_json"))


@query(
    "WITH g AS (SELECT eis_id || '/' || run_no AS run_key, row_no AS \"position\", md5(concat_ws('|', coalesce(main_cpv_extracted, '~'), coalesce(weights_extracted, '~'))) h FROM validation_gemma4_e4b), w AS (SELECT run_key, count(*) n, count(DISTINCT h) = 1 identical FROM g GROUP BY 1 HAVING count(*) > 1) "
    "SELECT run_key, \"position\" AS row_no, n, identical FROM g JOIN w USING (run_key)"
)
def audit_duplicates(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "validation_gemma4_e4b").withColumn("run_key", F.concat_ws("/", "eis_id", "run_no"))
    return duplicate_audit(v, "run_key", "row_no", ["main_cpv_extracted", "weights_extracted"])


@query(
    "SELECT row_no, ord, field, \"value\" FROM (SELECT row_no, unnest([1, 2, 3, 4]) ord, unnest(['main', 'additional', 'weights', 'names']) field, unnest([main_cpv_extracted, additional_cpv_extracted, weights_extracted, criteria_names_extracted]) \"value\" FROM validation_gemma4_e4b) WHERE \"value\" IS NOT NULL"
)
def record_unpivot(spark: SparkSession, d: str) -> DataFrame:
    names = {"main": "main_cpv_extracted", "additional": "additional_cpv_extracted", "weights": "weights_extracted", "names": "criteria_names_extracted"}
    args = ", ".join(f"{i}, '{n}', {c}" for i, (n, c) in enumerate(names.items(), 1))
    return table(spark, d, "validation_gemma4_e4b").selectExpr("row_no", f"stack({len(names)}, {args}) as (ord, field, value)").where("value IS NOT NULL")


@query("SELECT o_orderpriority, count(*) n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def star_rollup(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# --- standards, lots, shapes ----------------------------------------------------------------------

#: the sections and schemes that these tables write about
_CATALOG = standards.Catalog(
    schemes={"Certificate": ["sertifikacijas apliecinajum", "sertifikats"], "Safety plan": ["darba aizsardzibas plan"]},
    markers={"award": ["cenas-kvalitates", "vertesanas tabul"], "specification": ["pielikums", "nolikuma pielikum"], "selection": ["lieta", "atsauce"]},
    cues=["sertifik", "kvalitat"],
)
_BODY_SQL = "(LVS|EN|ISO(/IEC)?|IEC)"
_STANDARD_SQL = f"(?i)(^|[^\\p{{L}}\\p{{N}}_])({_BODY_SQL}[\\s\\p{{Z}}]+)*{_BODY_SQL}[\\s\\p{{Z}}]*[0-9]{{3,5}}(-[0-9]{{1,3}}($|[^\\p{{L}}\\p{{N}}_]))?(:[\\s\\p{{Z}}]?[0-9]{{4}})?($|[^\\p{{L}}\\p{{N}}_])"


@query(
    f"WITH t AS (SELECT evidence_id, json_extract_string(evidence, '$.text') t FROM standards_evidence WHERE evidence IS NOT NULL), h AS (SELECT unnest(regexp_extract_all(t, '{_STANDARD_SQL}')) hit FROM t) "
    "SELECT upper(regexp_replace(regexp_replace(hit, '^[^\\p{L}]+|[^0-9]+$', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) name, count(*) n FROM h GROUP BY 1"
)
def coded_standards(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "standards_evidence").select(F.get_json_object("evidence", "$.text").alias("t"))
    refs = standards.find_references(e, [], "t").where("category = 'standard'")
    return refs.groupBy("name").agg(F.count("*").alias("n"))


@query()
def standard_references(spark: SparkSession, d: str) -> DataFrame:
    """References in all evidence texts with their section, rolled up by name (tests hold golden texts; ``coded_standards`` has a twin)."""
    e = table(spark, d, "standards_evidence").select("evidence_id", F.get_json_object("evidence", "$.text").alias("t"))
    out = standards.rollup_references(cut(standards.find_references(e, ["evidence_id"], "t", _CATALOG)), [], "evidence_id")
    return out.select("name", "category", "n", F.array_join("phases", ",").alias("phases"), F.array_join("evidence", " | ").alias("evidence"))


_SCHEME_SQL = {"Certificate": "sertifikacijas apliecinajum|sertifikats", "Safety plan": "darba aizsardzibas plan"}


@query(
    f"WITH t AS (SELECT translate(lower(json_extract_string(evidence, '$.text')), '{T.ACCENTED}', '{T.UNACCENTED}') t FROM standards_evidence WHERE evidence IS NOT NULL) "
    f"SELECT k.name, sum(len(regexp_extract_all(t, '(^|[^\\p{{L}}\\p{{N}}_])(' || replace(k.a, ' ', '[\\s\\p{{Z}}]+') || ')')))::BIGINT n FROM t, (VALUES {values(_SCHEME_SQL)}) k(name, a) GROUP BY 1"
)
def scheme_aliases(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "standards_evidence").select(F.get_json_object("evidence", "$.text").alias("t"))
    return standards.find_references(e, [], "t", _CATALOG).where("category = 'scheme'").groupBy("name").agg(F.count("*").alias("n"))


def _true_criteria(spark: SparkSession, d: str) -> DataFrame:
    """``record_id, lot_no, criterion_no, eis_id, name, number, lot`` of all records of each procurement; equal deliveries of a record count once."""
    records = table(spark, d, "reference_records")
    tables = procurement_tables(records)
    column = lambda t, c: F.col(c) if c in t.columns else F.lit(None).cast("string")
    lots = tables.get("lots", spark.createDataFrame([], "record_id long, lot_no int"))
    crit = tables.get("criteria", spark.createDataFrame([], "record_id long, lot_no int, criterion_no int"))
    lots = lots.select("record_id", "lot_no", column(lots, "sequenceNumber").alias("lot"))
    crit = crit.select("record_id", "lot_no", "criterion_no", column(crit, "winnerCriterionName").alias("name"), column(crit, "winnerCriterionNumber").alias("number"))
    kept = lot_ops.distinct_records(records, list(tables.values()), "eis_id", "record_id")
    return crit.join(lots, ["record_id", "lot_no"]).join(kept, "record_id")


@query()
def lots_compared(spark: SparkSession, d: str) -> DataFrame:
    """Criteria of the workers against the ground-truth records, lot by lot (tests hold a brute-force twin).

    The lots of all records of a procurement are its truth; the lots that its findings name are
    what it declares.
    """
    gold = _true_criteria(spark, d)
    gold = gold.withColumn("weight", F.replace(F.regexp_extract("number", "[0-9]+(?:[.,][0-9]+)?", 0), F.lit(","), F.lit(".")).try_cast("double"))
    pred = runs.latest_per_key(table(spark, d, "worker_criteria"), ["criterion_id"], ["loaded_at"])
    sets = [cut(lot_ops.lot_sets(x, "eis_id", "lot", "weight", e)) for x, e in ((pred, None), (gold, ["record_id", "lot_no"]))]
    declared = table(spark, d, "worker_findings").select("eis_id", F.col("lot_label").alias("lot"))
    return lot_ops.compare_lots(*sets, "eis_id", declared=declared)


@query(
    "WITH e AS (SELECT name, json_extract_string(evidence, '$.phase') phase, json_extract_string(evidence, '$.text') t, evidence_id FROM standards_evidence WHERE evidence IS NOT NULL) SELECT name, phase, md5(t) text_key, count(*) n_copies, min(evidence_id) \"first\" FROM e GROUP BY 1, 2, 3"
)
def evidence_grouping(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "standards_evidence").where("evidence IS NOT NULL")
    e = e.select("evidence_id", "name", F.get_json_object("evidence", "$.phase").alias("phase"), F.md5(F.get_json_object("evidence", "$.text")).alias("text_key"))
    return shapes.evidence_copies(e, ["name", "phase", "text_key"], "evidence_id")


@query(
    "SELECT state_id, loaded_at, len(source_files)::BIGINT n_files, coalesce(len(candidates), 0)::BIGINT n_candidates, coalesce(list_sum(list_transform(candidates, lambda c: c.hits)), 0)::BIGINT n_hits, round(coalesce(CASE WHEN cpv_seconds >= 0 THEN cpv_seconds END, 0) + coalesce(CASE WHEN criteria_seconds >= 0 THEN criteria_seconds END, 0), 1) model_seconds FROM run_states"
)
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    hits = F.aggregate(F.coalesce(F.transform("candidates", lambda c: F.coalesce(c["hits"].cast("long"), F.lit(0))), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    s = table(spark, d, "run_states")
    return s.select("state_id", "loaded_at", F.size("source_files").cast("long").alias("n_files"), n("candidates").alias("n_candidates"), hits.alias("n_hits"), shapes.model_seconds(F.col("cpv_seconds"), F.col("criteria_seconds")).alias("model_seconds"))


@query()
def candidate_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Codes of each state with the passages that fit the prompt's budget (a sequential spread; tests hold golden cases)."""
    s = table(spark, d, "run_states").where("candidates IS NOT NULL")
    c = s.select("state_id", "loaded_at", F.posexplode("candidates").alias("ord", "c")).select("state_id", "loaded_at", "ord", F.coalesce("c.code", F.lit("")).alias("code"), F.col("c.contexts").alias("contexts"))
    out = shapes.pick_contexts(c, ["state_id", "loaded_at"])
    return out.select("state_id", "loaded_at", "code", F.size("passages").cast("long").alias("n_passages"), "listed")


@query(
    "SELECT f.finding_id, coalesce(len(list_distinct(flatten(list(c.evidence_ids)))), 0)::BIGINT n_cited FROM (SELECT DISTINCT finding_id FROM worker_findings) f LEFT JOIN worker_criteria c USING (finding_id) GROUP BY 1"
)
def citations(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "worker_criteria").select("finding_id", F.explode("evidence_ids").alias("e")).distinct().groupBy("finding_id").agg(F.count("*").alias("n_cited"))
    return table(spark, d, "worker_findings").select("finding_id").distinct().join(cited, "finding_id", "left").fillna(0, ["n_cited"])


@query("SELECT finding_id, criterion_id FROM worker_criteria c WHERE NOT EXISTS (SELECT 1 FROM worker_findings f WHERE f.finding_id = c.finding_id AND f.status = 'completed')")
def unfinished_criteria(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "worker_findings").where("status = 'completed'").select("finding_id")
    return table(spark, d, "worker_criteria").join(done, "finding_id", "left_anti").select("finding_id", "criterion_id")


@query()
def name_review(spark: SparkSession, d: str) -> DataFrame:
    """Names of the workers' criteria and of the ground-truth records beside each other, lot by lot (tests hold golden rows)."""
    return reports.name_review(table(spark, d, "worker_criteria"), _true_criteria(spark, d), "eis_id", "lot", "name")


@query(
    "WITH o AS (SELECT DISTINCT eis_id FROM ocr_pages), t AS (SELECT DISTINCT eis_id FROM reference_records) SELECT s.state_id, s.loaded_at, o.eis_id IS NOT NULL has_ocr, t.eis_id IS NOT NULL has_truth, "
    "CASE WHEN o.eis_id IS NULL AND t.eis_id IS NULL THEN 'missing: ocr, truth' WHEN o.eis_id IS NULL THEN 'missing: ocr' WHEN t.eis_id IS NULL THEN 'missing: truth' END note FROM run_states s LEFT JOIN o ON o.eis_id = s.eis_id LEFT JOIN t ON t.eis_id = s.eis_id"
)
def artifact_scan(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "run_states").select("eis_id", "state_id", "loaded_at")
    out = reports.with_artifacts(s, {"ocr": table(spark, d, "ocr_pages"), "truth": table(spark, d, "reference_records")}, "eis_id")
    return out.drop("eis_id")


@query("SELECT eis_id worker, count(*) n_calls, count(*) FILTER (attempts > 1) n_retries, count(*) FILTER (contains(lower(feedback), 'correct')) n_corrections, round(sum(CASE WHEN cpv_seconds >= 0 THEN cpv_seconds END), 2) \"seconds\" FROM run_states GROUP BY 1")
def correction_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.correction_rows(table(spark, d, "run_states").withColumnRenamed("eis_id", "worker"), "worker", "feedback", "attempts", "cpv_seconds")
