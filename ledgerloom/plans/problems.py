"""Queries of the general data problems: units (1), copies (3), nested records (4), packed fields (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.compare import canonical_code, canonical_numbers, compare_copies
from ledgerloom.operators.nested import criterion_positions, procurement_tables
from ledgerloom.operators.packed import unpack_values
from ledgerloom.operators.units import harmonise_weights, stated_weights
from ledgerloom.session import table


def p1_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonise_weights(table(spark, sf_dir, "worker_criteria"), table(spark, sf_dir, "worker_findings"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria whose scale is stated or follows from an exact total; what only the mixture settles is in ``p1_weights``."""
    return stated_weights(table(spark, sf_dir, "worker_criteria"), table(spark, sf_dir, "worker_findings"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {
        "main_cpv_extracted": canonical_code,
        "main_cpv_truth": canonical_code,
        "weights_extracted": canonical_numbers,
        "weights_truth": canonical_numbers,
    }
    main, copy = (table(spark, sf_dir, f"validation_gemma4_e4b{x}") for x in ("", "_copy"))
    return compare_copies(main, copy, ["eis_id", "run_no"], fields).select("eis_id", "run_no", "finding")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return criterion_positions(table(spark, sf_dir, "reference_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack_values(table(spark, sf_dir, "validation_gemma4_e4b"), "row_no").distinct()


#: query -> (table, its columns: name in the result -> name in the table); a column that no body has is null
RECORD_TABLES = {
    "p4_records": ("records", {"record_id": "record_id", "documents_url": "tenderingProcess_documentsURL", "cpv_type": "cpvType", "buyer_title": "tenderingProcess_buyer_title", "buyer_town": "tenderingProcess_buyer_address_town", "buyer_zone": "tenderingProcess_buyer_address_zone", "n_children": "n_children"}),
    "p4_lots": ("lots", {"record_id": "record_id", "lot_no": "lot_no", "sequence_number": "sequenceNumber", "title": "title", "n_children": "n_children"}),
    "p4_criteria": ("criteria", {"record_id": "record_id", "lot_no": "lot_no", "criterion_no": "criterion_no", "name": "winnerCriterionName", "number": "winnerCriterionNumber", "n_children": "n_children"}),
    "p4_sub_criteria": ("sub_criteria", {"record_id": "record_id", "lot_no": "lot_no", "criterion_no": "criterion_no", "sub_no": "sub_no", "name": "winnerCriterionName", "number": "winnerCriterionNumber", "n_children": "n_children"}),
    "p4_additional_codes": ("additional_codes", {"record_id": "record_id", "item_no": "item_no", "value": "value"}),
}


def record_table(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    name, columns = RECORD_TABLES[query]
    found = procurement_tables(table(spark, sf_dir, "reference_records")).get(name)
    if found is None:
        numbers = ("lot_no", "criterion_no", "sub_no", "item_no", "n_children")
        return spark.createDataFrame([], ", ".join(f"{c} {'long' if c == 'record_id' else 'int' if c in numbers else 'string'}" for c in columns))
    return found.select(*[(F.col(c) if c in found.columns else F.lit(None).cast("string")).alias(n) for n, c in columns.items()])


def _record_table(query: str):  # noqa: ANN202
    return lambda spark, sf_dir: record_table(spark, sf_dir, query)


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_weights": p1_weights,
        "p3_found": p3_found,
        "p4_found": p4_found,
        **{q: _record_table(q) for q in RECORD_TABLES},
        "p5_found": p5_found,
    }


_PARTS = r"^([^0-9]*?)([0-9]+(?:[.,][0-9]+)?)\s*(%|proc[a-z]*|percent|‰|promil[a-z]*|per mille|punkt[a-zāēīū]*|points?|pts|p\.)?\s*\(?(?:(?:/|no|out of|of)\s*([0-9]+(?:[.,][0-9]+)?))?\s*\)?\s*(punkt[a-zāēīū]*|points?|pts)?[^0-9]*$"
_WORD_NUMBERS = {
    "desmit": 10, "divdesmit": 20, "trīsdesmit": 30, "četrdesmit": 40, "piecdesmit": 50, "sešdesmit": 60, "septiņdesmit": 70, "astoņdesmit": 80, "deviņdesmit": 90,
    "ten": 10, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}

#: Written apart from the operators: their statements in TESTDATA.md as plain SQL.
ORACLES = {
    "p1_found": rf"""WITH c AS (SELECT * FROM worker_criteria QUALIFY row_number() OVER (PARTITION BY criterion_id ORDER BY loaded_at DESC) = 1),
 f AS (SELECT finding_id, lower(trim(weight_scale)) s FROM worker_findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY loaded_at DESC) = 1),
 t AS (SELECT *, trim(replace(lower(weight_text), chr(160), ' ')) w, lower(scope_evidence) e FROM c),
 p AS (SELECT *, CASE WHEN regexp_matches(w, '{_PARTS}') AND NOT regexp_matches(w, '[0-9]\. punkt') THEN replace(regexp_extract(w, '{_PARTS}', 2), ',', '.') END n, regexp_extract(w, '{_PARTS}', 1) a, regexp_extract(w, '{_PARTS}', 3) u, nullif(replace(regexp_extract(w, '{_PARTS}', 4), ',', '.'), '') o, regexp_extract(w, '{_PARTS}', 5) z, regexp_extract(w, '^([^ ]+) (punkti|points)$', 1) sp FROM t),
 q AS (SELECT p.*, sw.v sv FROM p LEFT JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in _WORD_NUMBERS.items())}) sw(k, v) ON sw.k = p.sp),
 r AS (SELECT criterion_id, finding_id, e, CASE WHEN n IS NOT NULL THEN CAST(n AS DECIMAL(18,6)) WHEN sv IS NOT NULL THEN CAST(sv AS DECIMAL(18,6)) ELSE CAST(weight AS DECIMAL(18,6)) END fig,
  CASE WHEN n IS NOT NULL THEN CASE WHEN o IS NOT NULL THEN CAST(o AS DECIMAL(18,6)) WHEN u = '%' OR starts_with(u, 'proc') OR u = 'percent' THEN 100 WHEN u = '‰' OR starts_with(u, 'promil') OR u = 'per mille' THEN 1000 WHEN u <> '' OR z <> '' THEN 100 WHEN regexp_matches(a, 'koef|daļa|fraction') THEN 1 END WHEN sv IS NOT NULL THEN 100 END full1 FROM q),
 x AS (SELECT r.*, CAST(nullif(regexp_extract(e, '(?:kopskaits ir|given out of|kopā|skala: [0-9]+-)\s*([0-9]+)', 1), '') AS DECIMAL(18,6)) full2, CASE WHEN f.s IN ('points', 'punkti', 'pts', '%', 'procenti', 'percent') THEN 100 WHEN f.s IN ('fraction', 'daļa') THEN 1 WHEN f.s IN ('‰', 'promiles', 'permille') THEN 1000 END full3 FROM r LEFT JOIN f USING (finding_id)),
 g AS (SELECT finding_id, CASE WHEN count(*) = count(fig) AND sum(fig) IN (1, 100, 1000) THEN sum(fig) END full4 FROM x GROUP BY 1),
 y AS (SELECT criterion_id, fig, coalesce(full1, full2, full3, full4) m FROM x LEFT JOIN g USING (finding_id))
 SELECT criterion_id, CAST(round(CAST(fig AS DOUBLE) * 10000 / CAST(m AS DOUBLE), 0) AS BIGINT) centipoints FROM y WHERE fig IS NOT NULL AND m IS NOT NULL""",
    "p3_found": r"""WITH m AS (SELECT eis_id, run_no, max(struct_pack(a := a, b := b, c := c, d := d)) r FROM (SELECT eis_id, run_no, coalesce(regexp_replace(regexp_replace(main_cpv_extracted, '[\s\p{Z}]', '', 'g'), '[‐‑–−]', '-', 'g'), '') a, coalesce(regexp_replace(regexp_replace(main_cpv_truth, '[\s\p{Z}]', '', 'g'), '[‐‑–−]', '-', 'g'), '') b,
 coalesce(array_to_string(list_sort(list_transform(regexp_extract_all(weights_extracted, '[0-9]+(?:[.,][0-9]+)?'), lambda v: CAST(CAST(replace(v, ',', '.') AS DECIMAL(18,6)) AS VARCHAR))), ' '), '') c, coalesce(array_to_string(list_sort(list_transform(regexp_extract_all(weights_truth, '[0-9]+(?:[.,][0-9]+)?'), lambda v: CAST(CAST(replace(v, ',', '.') AS DECIMAL(18,6)) AS VARCHAR))), ' '), '') d FROM validation_gemma4_e4b) GROUP BY 1, 2),
 o AS (SELECT eis_id, run_no, max(struct_pack(a := a, b := b, c := c, d := d)) r FROM (SELECT eis_id, run_no, coalesce(regexp_replace(regexp_replace(main_cpv_extracted, '[\s\p{Z}]', '', 'g'), '[‐‑–−]', '-', 'g'), '') a, coalesce(regexp_replace(regexp_replace(main_cpv_truth, '[\s\p{Z}]', '', 'g'), '[‐‑–−]', '-', 'g'), '') b,
 coalesce(array_to_string(list_sort(list_transform(regexp_extract_all(weights_extracted, '[0-9]+(?:[.,][0-9]+)?'), lambda v: CAST(CAST(replace(v, ',', '.') AS DECIMAL(18,6)) AS VARCHAR))), ' '), '') c, coalesce(array_to_string(list_sort(list_transform(regexp_extract_all(weights_truth, '[0-9]+(?:[.,][0-9]+)?'), lambda v: CAST(CAST(replace(v, ',', '.') AS DECIMAL(18,6)) AS VARCHAR))), ' '), '') d FROM validation_gemma4_e4b_copy) GROUP BY 1, 2),
 j AS (SELECT coalesce(m.eis_id, o.eis_id) eis_id, coalesce(m.run_no, o.run_no) run_no, m.r x, o.r y FROM m FULL JOIN o ON m.eis_id = o.eis_id AND m.run_no = o.run_no)
 SELECT eis_id, run_no, unnest(list_filter([CASE WHEN x IS NULL THEN 'row_missing_in_main' END, CASE WHEN y IS NULL THEN 'row_missing_in_copy' END, CASE WHEN x.a <> y.a THEN 'main_cpv_extracted' END, CASE WHEN x.b <> y.b THEN 'main_cpv_truth' END, CASE WHEN x.c <> y.c THEN 'weights_extracted' END, CASE WHEN x.d <> y.d THEN 'weights_truth' END], lambda f: f IS NOT NULL)) finding FROM j""",
    "p4_found": r"""WITH b AS (SELECT record_id, body::JSON j FROM reference_records WHERE json_valid(body)),
 l0 AS (SELECT record_id, coalesce(nullif(j->'$.lots', 'null'::JSON), nullif(j->'$.tenderingProcess.lots', 'null'::JSON)) l FROM b), l1 AS (SELECT record_id, CASE WHEN json_type(l) = 'VARCHAR' AND json_valid(l->>'$') THEN (l->>'$')::JSON ELSE l END l FROM l0),
 l2 AS (SELECT record_id, CASE WHEN json_type(l) = 'OBJECT' AND json_exists(l, '$.lot') THEN l->'$.lot' ELSE l END l FROM l1),
 l3 AS (SELECT record_id, CASE WHEN l IS NULL OR json_type(l) = 'NULL' THEN [] WHEN json_type(l) = 'ARRAY' THEN from_json(l, '["JSON"]') ELSE [l] END l FROM l2),
 lots AS (SELECT record_id, unnest(l) lot, generate_subscripts(l, 1)::INT lot_no FROM l3),
 c1 AS (SELECT record_id, lot_no, lot->'$.criterion' c FROM lots), c2 AS (SELECT record_id, lot_no, CASE WHEN c IS NULL OR json_type(c) = 'NULL' THEN [] WHEN json_type(c) = 'ARRAY' THEN from_json(c, '["JSON"]') ELSE [c] END c FROM c1),
 crit AS (SELECT record_id, lot_no, unnest(c) k, generate_subscripts(c, 1)::INT criterion_no FROM c2),
 s1 AS (SELECT record_id, lot_no, criterion_no, k->'$.subCriterion' s FROM crit), s2 AS (SELECT record_id, lot_no, criterion_no, CASE WHEN s IS NULL OR json_type(s) = 'NULL' THEN [] WHEN json_type(s) = 'ARRAY' THEN from_json(s, '["JSON"]') ELSE [s] END s FROM s1)
 SELECT record_id, 0 lot_no, 0 criterion_no, 0 sub_no FROM l3 WHERE len(l) = 0 UNION ALL SELECT record_id, lot_no, 0, 0 FROM c2 WHERE len(c) = 0 UNION ALL SELECT record_id, lot_no, criterion_no, 0 FROM crit UNION ALL SELECT record_id, lot_no, criterion_no, unnest(range(1, len(s) + 1))::INT FROM s2""",
}

_P4_ENTRIES = ORACLES["p4_found"].partition(" SELECT record_id, 0 lot_no")[0]
_P4_CODES = """, a1 AS (SELECT record_id, j->'$.additionalCpvType' a FROM b), a2 AS (SELECT record_id, CASE WHEN json_type(a) = 'ARRAY' THEN from_json(a, '["VARCHAR"]') WHEN json_type(a) = 'VARCHAR' THEN [a->>'$'] ELSE [] END v FROM a1),
 a3 AS (SELECT record_id, list_filter(v, lambda x: trim(x) <> '') v FROM a2)"""
ORACLES |= {
    "p4_lots": f"""{_P4_ENTRIES} SELECT l.record_id, l.lot_no, lot->>'$.sequenceNumber' sequence_number, lot->>'$.title' title, len(c)::INT n_children FROM lots l JOIN c2 USING (record_id, lot_no)""",
    "p4_criteria": f"""{_P4_ENTRIES} SELECT k.record_id, k.lot_no, k.criterion_no, k->>'$.winnerCriterionName' AS name, k->>'$.winnerCriterionNumber' AS number, len(s)::INT n_children FROM crit k JOIN s2 USING (record_id, lot_no, criterion_no)""".replace("k->>", "k.k->>"),
    "p4_sub_criteria": f"""{_P4_ENTRIES}, s3 AS (SELECT record_id, lot_no, criterion_no, unnest(s) x, generate_subscripts(s, 1)::INT sub_no FROM s2) SELECT record_id, lot_no, criterion_no, sub_no, x->>'$.winnerCriterionName' AS name, x->>'$.winnerCriterionNumber' AS number, 0 n_children FROM s3""",
    "p4_records": f"""{_P4_ENTRIES}{_P4_CODES} SELECT record_id, j->>'$.tenderingProcess.documentsURL' documents_url, j->>'$.cpvType' cpv_type, j->>'$.tenderingProcess.buyer.title' buyer_title, j->>'$.tenderingProcess.buyer.address.town' buyer_town, j->>'$.tenderingProcess.buyer.address.zone' buyer_zone, (len(l) + len(v))::INT n_children FROM b JOIN l3 USING (record_id) JOIN a3 USING (record_id)""",
    "p4_additional_codes": f"""{_P4_ENTRIES}{_P4_CODES} SELECT record_id, generate_subscripts(v, 1)::INT item_no, unnest(v) AS "value" FROM a3""",
    "p5_found": r"""WITH c AS (SELECT DISTINCT row_no, unnest(['additional_cpv_extracted', 'weights_truth', 'criteria_names_extracted']) f, unnest([additional_cpv_extracted, weights_truth, criteria_names_extracted]) x FROM validation_gemma4_e4b),
 n AS (SELECT *, list_transform(regexp_extract_all(x, '[\s\p{Z}]*(?:,[\s\p{Z}]*)?"(?:[^"]|"")*"|[^;|\n\r\t"][^;|\n\r\t]*'), lambda v: regexp_replace(v, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) k FROM c WHERE x IS NOT NULL),
 t AS (SELECT row_no, f, CASE WHEN starts_with(trim(x), '[') AND json_valid(trim(x)) THEN from_json(trim(x)::JSON, '["VARCHAR"]') WHEN f = 'additional_cpv_extracted' THEN regexp_extract_all(x, '[0-9]{8}[‐‑–-][0-9]') WHEN f = 'weights_truth' THEN regexp_extract_all(x, '[0-9]+(?:[.,][0-9]+)?(?:[\s\p{Z}]*%)?')
  ELSE list_filter(list_transform(k, lambda v: CASE WHEN regexp_matches(v, '^[\s,]*".*"$', 's') THEN replace(regexp_replace(v, '^[\s\p{Z},]*"|"$', '', 'g'), '""', '"') ELSE v END), lambda v: v <> '') END v FROM n),
 u AS (SELECT row_no, f, unnest(v) v, generate_subscripts(v, 1)::INT i FROM t) SELECT row_no, f field_name, i value_pos, regexp_replace(v, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') value_text FROM u""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
