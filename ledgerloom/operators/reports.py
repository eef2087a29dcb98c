"""Reports and checks around extraction runs: worklists, reviews by name, corrections, provenance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import lot_key
from ledgerloom.operators.runs import finite


def check_parameters(total: float, tolerance: float) -> None:
    """ValueError unless the expected total is finite and positive and the tolerance lies in [0, total)."""
    if not (math.isfinite(total) and total > 0 and 0 <= tolerance < total):
        raise ValueError(f"expected total {total} and tolerance {tolerance} don't fit")


def name_review(pred: DataFrame, gold: DataFrame, key: str, lot: str, name: str) -> DataFrame:
    """``key, lot_key, extracted_names, true_names``: names of both sides beside each other, lot by lot."""

    def side(df: DataFrame, out: str) -> DataFrame:
        named = df.select(key, lot_key(F.col(lot)).alias("lot_key"), F.trim(F.col(name)).alias("n")).where("n <> ''")
        counted = named.groupBy(key, "lot_key", "n").agg(F.count("*").alias("c"))
        shown = F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: F.when(x["c"] > 1, F.concat(x["n"], F.lit(" x"), x["c"].cast("string"))).otherwise(x["n"]))
        return counted.groupBy(key, "lot_key").agg(F.array_join(shown, " | ").alias(out))

    return side(pred, "extracted_names").join(side(gold, "true_names"), [key, "lot_key"], "full")


def correction_rows(calls: DataFrame, worker: str, stage: str, attempt: str, seconds: str) -> DataFrame:
    """``worker, n_calls, n_retries, n_corrections, seconds`` of each worker's model calls."""
    return calls.groupBy(worker).agg(
        F.count("*").alias("n_calls"),
        F.count(F.when(F.col(attempt) > 1, 1)).alias("n_retries"),
        F.count(F.when(F.lower(stage).contains("correct"), 1)).alias("n_corrections"),
        F.round(F.sum(finite(F.col(seconds))), 2).alias("seconds"),
    )


def with_artifacts(records: DataFrame, artifacts: dict[str, DataFrame], key: str) -> DataFrame:
    """Records with whether each kind of artifact exists, and a note that names the missing ones."""
    out = records
    for kind, df in artifacts.items():
        out = out.join(df.select(key).distinct().withColumn(f"has_{kind}", F.lit(True)), key, "left").fillna(False, [f"has_{kind}"])
    missing = F.filter(F.array(*[F.when(~F.col(f"has_{k}"), F.lit(k)) for k in artifacts]), lambda x: x.isNotNull())
    return out.withColumn("note", F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))))


def decision_problem(name: Column, proposed_name: Column, applies: Column, reason: Column) -> Column:
    """Why a human decision can't be taken, null where it can."""
    return (
        F.when(name.isNull() | (name != proposed_name), "other name")
        .when(applies.isNull(), "no decision")
        .when(reason.isNull() | (F.trim(reason) == ""), "no reason")
    )


def feedback_history(actions: Column) -> Column:
    """Numbered lines of an array of ``type, message``; empty messages are left out."""
    said = F.filter(actions, lambda a: F.trim(F.coalesce(a["message"], F.lit(""))) != "")
    return F.array_join(F.transform(said, lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a["type"], F.lit(": "), F.trim(a["message"]))), "\n")


def foreign_lots(criteria: DataFrame, tasks: DataFrame, key: str, lot: str, task_lot: str) -> DataFrame:
    """Criteria that name a lot their task didn't ask for; a task without lots (fallback) takes all."""
    asked = tasks.where(F.col(task_lot).isNotNull()).select(key, lot_key(F.col(task_lot)).alias("_k")).distinct()
    named = criteria.withColumn("_k", lot_key(F.col(lot))).where("_k <> 'all'")
    limited = named.join(asked.select(key).distinct(), key, "left_semi")
    return limited.join(asked, [key, "_k"], "left_anti").drop("_k")


def default_usage(rows: DataFrame, by: list[str], source: str, default: str = "default") -> DataFrame:
    """How many weights were set by default, by group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col(source) == default, 1)).alias("n_default"))


def stage_totals(df: DataFrame, model: str, measures: Sequence[str]) -> DataFrame:
    """Chosen measures as rows, models as values: ``measure, model, value``."""
    sums = df.groupBy(model).agg(*[F.sum(m).cast("double").alias(m) for m in measures])
    args = ", ".join(f"'{m}', `{m}`" for m in measures)
    return sums.selectExpr(f"stack({len(measures)}, {args}) as (measure, value)", f"`{model}`").select("measure", model, "value")


def run_audit(records: DataFrame, evaluation: DataFrame, log: DataFrame, traces: DataFrame, key: str = "eis_id") -> DataFrame:
    """``key, problem, main_before, main_after``: each saved record against its evaluation row, its log and its traces.

    ``records`` and ``evaluation`` hold ``main, additional`` (codes as an array), ``evaluation``
    also ``truth``; ``log`` holds ``attempt, main, additional`` of every attempt, ``traces`` one
    row a call. Problems, first rule that holds: missing_evaluation, missing_log, missing_trace,
    log_disagrees (its last attempt isn't what was saved), evaluation_disagrees. ``main_before``
    and ``main_after`` tell whether the first attempt and the saved record had the true code,
    null where none is known. Keys must be unique in records and evaluation.
    """
    ordered = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    side = lambda df, tag, *more: df.select(key, F.coalesce("main", F.lit("")).alias(f"{tag}_main"), ordered(F.col("additional")).alias(f"{tag}_additional"), *more, F.lit(True).alias(f"_{tag}"))
    row = F.struct("attempt", F.coalesce("main", F.lit("")).alias("main"), ordered(F.col("additional")).alias("additional"))
    said = log.groupBy(key).agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    calls = traces.groupBy(key).agg(F.count("*").alias("_calls"))
    all_ = side(records, "r").join(side(evaluation, "e", F.trim("truth").alias("_truth")), key, "left").join(said, key, "left").join(calls, key, "left")
    same = lambda main, additional: (F.col("r_main") == main) & (F.col("r_additional") == additional)
    problem = (
        F.when(F.col("_e").isNull(), "missing_evaluation")
        .when(F.col("_last").isNull(), "missing_log")
        .when(F.col("_calls").isNull(), "missing_trace")
        .when(~same(F.col("_last.main"), F.col("_last.additional")), "log_disagrees")
        .when(~same(F.col("e_main"), F.col("e_additional")), "evaluation_disagrees")
    )
    known = F.col("_truth") != ""
    return all_.select(key, problem.alias("problem"), F.when(known & (F.col("_first.attempt") == 1), F.col("_first.main") == F.col("_truth")).alias("main_before"), F.when(known, F.col("r_main") == F.col("_truth")).alias("main_after"))


def markdown(df: DataFrame, labels: dict[str, str] | None = None, most: int = 1000) -> str:
    """A small frame as a Markdown table, numbers right, nulls as ``Not available``; ValueError above ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    numeric = [f.dataType.typeName() in ("integer", "long", "double", "float", "decimal") for f in df.schema.fields]
    show = lambda v: "Not available" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [[(labels or {}).get(c, c) for c in df.columns], ["---:" if n else "---" for n in numeric], *[[show(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"
