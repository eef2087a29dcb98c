"""Saved records: JSON, JSON lines, evaluation CSV, run logs; and the checks on their keys."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import codes_in, url_number
from ledgerloom.operators.skew import hot_join
from ledgerloom.operators.standards import Catalog
from ledgerloom.session import cut

RECORD_SCHEMA = """eis_id string, source_files array<string>, attempts int, model_seconds double, lot_seconds double,
 candidates array<struct<code:string,context:string,contexts:array<string>,count:bigint>>,
 extracted struct<found:boolean,main_cpv:string,additional_cpv:array<string>,reasoning:string,status:string,retry_exhausted:boolean>,
 critique struct<verdict:string,problem:string>,
 evaluation_criteria struct<found:boolean,criteria:array<struct<lot:string,name:string,weight:double,evidence_ids:array<string>,scope_evidence:string,raw_weight:double>>,weight_scale:string,extraction_status:string>,
 standards array<struct<name:string,category:string,count:bigint,phases:array<string>,evidence:array<struct<phase:string,text:string>>>>"""
TRUTH_SCHEMA = """tenderingProcess struct<documentsURL:string>, cpvType string, additionalCpvType array<string>,
 lots array<struct<sequenceNumber:string,criterion:array<struct<winnerCriterionName:string,winnerCriterionNumber:string>>>>"""


class DuplicateKey(ValueError):
    """A key that must be unique occurs more than once."""


def require_unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df``, or DuplicateKey naming the smallest repeated key; null keys are left out of the check."""
    twice = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").orderBy(key).limit(1).collect()
    if twice:
        raise DuplicateKey(f"{what} {twice[0][0]} occurs {twice[0][1]} times")
    return df


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Saved extraction records of any age; a missing id falls back to the file's stem, a missing status to legacy_unlabelled."""
    raw = spark.read.schema(RECORD_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    df = raw.withColumn("eis_id", F.coalesce("eis_id", stem)).withColumn("status", F.coalesce("extracted.status", F.lit("legacy_unlabelled")))
    return require_unique(df, "eis_id", "procurement")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth with the procurement id from its URL; records without one keep a null id."""
    raw = spark.read.schema(TRUTH_SCHEMA).option("multiLine", True).json(path)
    return require_unique(raw.withColumn("eis_id", url_number(F.col("tenderingProcess.documentsURL"))), "eis_id", "procurement")


def flatten_truth(truth: DataFrame) -> DataFrame:
    """``eis_id, lot_no, lot, criterion_no, name, weight_text``: anonymous lots apart, empty lots kept."""
    lots = truth.select("eis_id", F.posexplode_outer("lots").alias("lot_no", "l"))
    rows = lots.select("eis_id", "lot_no", F.col("l.sequenceNumber").alias("lot"), F.posexplode_outer("l.criterion").alias("criterion_no", "c"))
    return rows.select("eis_id", "lot_no", "lot", "criterion_no", F.col("c.winnerCriterionName").alias("name"), F.col("c.winnerCriterionNumber").alias("weight_text"))


def duplicate_audit(df: DataFrame, key: str, position: str, fields: list[str]) -> DataFrame:
    """``key, position, n, identical``: where repeated keys stand and whether their fields agree.

    One row per place, so that a key that fills the table is no list in one task.
    """
    content = F.xxhash64(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    rows = df.where(F.col(key).isNotNull()).select(key, position, content.alias("_h"))
    groups = cut(rows.groupBy(key).agg(F.count("*").alias("n"), (F.min("_h") == F.max("_h")).alias("identical"), F.count("*").alias("_w")).where("n > 1"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return hot_join(rows.drop("_h"), groups, key, "_w", total)


def read_review_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One run per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation CSV with a header; a byte-order mark is tolerated, repeated ids are an error."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    first = df.columns[0].lstrip("﻿")
    return require_unique(df.withColumnRenamed(df.columns[0], first), "eis_id", "procurement")


def parse_run_log(lines: DataFrame, source: str = "source", order: str = "line_no", text: str = "value") -> DataFrame:
    """Attempts in a terminal log: ``source, section, attempt, main, additional, n_revise``.

    A line ``=== id ===`` opens the section of a procurement, ``attempt n: main=… additional=[…]``
    is an attempt, ``revise`` in a line counts for the section. Lines before the first header have no section.
    """
    w = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    header = F.regexp_extract(text, r"^=+ *([0-9]+) *=+$", 1)
    rows = lines.withColumn("section", F.last(F.when(header != "", header), ignorenulls=True).over(w))
    rows = rows.withColumn("attempt", F.regexp_extract(text, r"(?i)\battempt ([0-9]+)", 1).try_cast("int"))
    revise = F.count(F.when(F.lower(text).contains("revise"), 1)).over(Window.partitionBy(source, "section"))
    rows = rows.withColumn("n_revise", revise).where("attempt IS NOT NULL AND section IS NOT NULL")
    main = F.regexp_extract(text, r"main=\s*([0-9]{8}-[0-9])?", 1)
    additional = codes_in(F.regexp_extract(text, r"additional=\s*\[([^\]]*)\]", 1))
    return rows.select(source, "section", "attempt", F.when(main != "", main).alias("main"), F.array_join(additional, ",").alias("additional"), "n_revise")


def read_ids(spark: SparkSession, path: str, given: list[str] | None = None) -> DataFrame:
    """``eis_id, ord``: given ids, then those of a file, one per line, trimmed; each once, where it stood first."""
    lines = spark.read.text(path).select(F.trim("value").alias("eis_id"), (F.monotonically_increasing_id() + len(given or [])).alias("ord"))
    first = spark.createDataFrame([(x.strip(), i) for i, x in enumerate(given or [])], "eis_id string, ord long")
    return first.unionByName(lines).where("eis_id <> ''").groupBy("eis_id").agg(F.min("ord").alias("ord"))


def read_catalog(path: str) -> Catalog:
    """A catalog file: ``schemes`` (name to aliases), ``section_markers`` and ``scheme_cues``; a small file of the driver."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    schemes = {name: [a for a in (x["aliases"] if isinstance(x, dict) else x)] for name, x in raw.get("schemes", {}).items()}
    return Catalog(schemes, raw.get("section_markers", {}), raw.get("scheme_cues", []))
