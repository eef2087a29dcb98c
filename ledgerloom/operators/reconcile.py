"""Weights of criteria against what they should add up to, lot by lot."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import collapse, lot_key

# --- fixed values: tolerances -----------------------------------------------------------------
POINTS_TOLERANCE, FRACTION_TOLERANCE = 0.5, 0.005
# ----------------------------------------------------------------------------------------------


def lot_status(rows: DataFrame, keys: list[str], weight: str, scale: Column, flagged: Column, fallback: Column | None = None, completed: Column | None = None) -> DataFrame:
    """``keys, n_criteria, missing, total, target, status`` per lot, first rule that holds:

    not_completed, no_criteria, unresolved, missing_weights, unknown_scale, total_mismatch,
    reconciled. ``scale`` is points, fraction or anything else for unknown. A sole criterion
    without weight takes the whole target (points where the scale is unknown), but never in a
    fallback. Rows whose weight column is null count as criteria without weight; a row with a
    null ``_criterion`` (a lot without criteria) counts as none.
    """
    has = F.col("_criterion").isNotNull() if "_criterion" in rows.columns else F.lit(True)
    exact = F.col(weight).cast("decimal(18,6)")
    kind = F.max(F.when(scale.isin("points", "fraction"), scale))
    agg = rows.groupBy(*keys).agg(
        F.count(F.when(has, 1)).alias("n_criteria"),
        F.count(F.when(has & F.col(weight).isNull(), 1)).alias("missing"),
        F.sum(F.when(has, exact)).alias("total"),
        kind.alias("kind"),
        F.max(flagged.cast("int")).alias("flagged"),
        F.max((F.lit(False) if fallback is None else fallback).cast("int")).alias("fallback"),
        F.min((F.lit(True) if completed is None else completed).cast("int")).alias("completed"),
    )
    sole = (F.col("n_criteria") == 1) & (F.col("missing") == 1) & (F.col("fallback") == 0)
    kind = F.when(sole, F.coalesce("kind", F.lit("points"))).otherwise(F.col("kind"))
    target = F.when(kind == "points", F.lit(100).cast("decimal(18,6)")).when(kind == "fraction", F.lit(1).cast("decimal(18,6)"))
    total = F.when(sole, target).otherwise(F.col("total"))
    off = F.abs(total - target) > F.when(kind == "points", F.lit(POINTS_TOLERANCE)).otherwise(F.lit(FRACTION_TOLERANCE))
    status = (
        F.when(F.col("completed") == 0, "not_completed")
        .when(F.col("n_criteria") == 0, "no_criteria")
        .when((F.col("flagged") == 1) | (F.col("fallback") == 1), "unresolved")
        .when(~sole & (F.col("missing") > 0), "missing_weights")
        .when(kind.isNull(), "unknown_scale")
        .when(off, "total_mismatch")
        .otherwise("reconciled")
    )
    return agg.select(*keys, "n_criteria", F.when(sole, 0).otherwise(F.col("missing")).cast("long").alias("missing"), total.alias("total"), target.alias("target"), status.alias("status"))


def global_status(lots: DataFrame, keys: list[str], status: str, complete: Column) -> DataFrame:
    """``keys, n_lots, reconciled``: true only where there are lots, the inventory is complete and every lot reconciles."""
    all_good = F.bool_and(F.coalesce(F.col(status) == "reconciled", F.lit(False)))
    return lots.groupBy(*keys).agg(F.count("*").alias("n_lots"), (all_good & F.coalesce(F.bool_and(complete), F.lit(False))).alias("reconciled"))


def correct_once(first: DataFrame, failing: DataFrame, second: Callable[[DataFrame], DataFrame], key: str, fields: list[str]) -> DataFrame:
    """``first`` with a second pass over the failing keys only: what it gives replaces the fields, what it leaves null stays.

    ``second`` takes the failing rows and gives ``key`` and ``fields``, at most one row a key; it
    sees no other rows. ``corrected`` tells which rows changed.
    """
    again = second(first.join(failing.select(key).distinct(), key, "left_semi")).select(key, F.struct(*fields).alias("_new"))
    both = first.join(again, key, "left")
    changed = reduce(lambda a, b: a | b, [F.col(f"_new.{f}").isNotNull() & ~F.col(f"_new.{f}").eqNullSafe(F.col(f)) for f in fields])
    kept = [F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in first.columns]
    return both.select(*kept, F.coalesce(changed, F.lit(False)).alias("corrected"))


def reference_status(values: Column, expected: float = 100.0, tolerance: float = 0.5) -> Column:
    """missing, incomplete, available or total_mismatch of one lot's true weights (nulls: unparsable)."""
    total = F.aggregate(F.transform(values, lambda x: x.cast("decimal(18,6)")), F.lit(0).cast("decimal(28,6)"), lambda a, x: (a + x).cast("decimal(28,6)"))
    return (
        F.when(values.isNull() | (F.size(values) == 0), "missing")
        .when(F.exists(values, lambda x: x.isNull()), "incomplete")
        .when(F.abs(total - expected) <= tolerance, "available")
        .otherwise("total_mismatch")
    )


def record_status(lots: DataFrame, keys: list[str], order: str, status: str) -> DataFrame:
    """The status of a record: that of its first lot that isn't available, else available."""
    bad = F.col(status) != "available"
    first = F.min(F.when(bad, F.struct(F.col(order), F.col(status))))
    return lots.groupBy(*keys).agg(F.coalesce(first[status], F.lit("available")).alias("record_status"))


def merge_exact(rows: DataFrame, keys: list[str], name: str, weight: str, ids: str) -> DataFrame:
    """Criteria that agree in lot, spelling-free name and weight, merged; their evidence ids united.

    Null weights are equal to each other; a null list adds no ids.
    """
    spelt = F.lower(collapse(F.col(name)))
    per_id = rows.select(*keys, spelt.alias("name_key"), F.col(weight), F.posexplode_outer(F.when(F.size(ids) > 0, F.col(ids))).alias("_pos", "_id"))
    # ids are made distinct first, so that repeats of one criterion don't pile up in one list
    ones = per_id.groupBy(*keys, "name_key", weight, "_id").agg(F.count(F.when(F.coalesce("_pos", F.lit(0)) == 0, 1)).alias("_n"))
    return ones.groupBy(*keys, "name_key", weight).agg(F.sum("_n").alias("n_rows"), F.array_sort(F.collect_list("_id")).alias("evidence"))


def scope_problem(labels: DataFrame, key: str, label: str, shared: Column, declared: DataFrame | None = None) -> DataFrame:
    """``key, problem``: the first contradiction between a record's lot labels, null where none.

    ``declared`` holds ``key`` and ``lot``: the lots that the record is known to have.
    multiple_numbers: a label or declared lot names several numbers; shared_but_labelled: the
    shared flag beside labels; mixed: labelled and unlabelled criteria; several_unlabelled:
    more than one declared lot, but unlabelled criteria.
    """
    sides = labels.select(key, lot_key(F.col(label)).alias("_k"), shared.alias("_shared"), F.lit(True).alias("_own"))
    if declared is not None:
        sides = sides.unionByName(declared.select(key, lot_key(F.col("lot")).alias("_k"), F.lit(False).alias("_shared"), F.lit(False).alias("_own")))
    numbers = F.size(F.regexp_extract_all("_k", F.lit(r"\p{Nd}+"), F.lit(0)))
    named, own = F.col("_k") != "all", F.col("_own")
    once = sides.groupBy(key, "_k", "_own").agg(F.max("_shared").alias("_shared"))  # labels first, so that no group holds all rows of a record
    agg = once.groupBy(key).agg(
        F.max((numbers > 1).cast("int")).alias("_several"), F.max(F.col("_shared").cast("int")).alias("_shared"), F.count(F.when(own & named, 1)).alias("_named"),
        F.count(F.when(own & ~named, 1)).alias("_unnamed"), F.count(F.when(~own & named, 1)).alias("_declared"), F.count(F.when(own, 1)).alias("_n"),
    )
    shared_flag = F.coalesce(F.col("_shared"), F.lit(0)) == 1
    problem = (
        F.when(F.col("_several") == 1, "multiple_numbers")
        .when(shared_flag & (F.col("_named") > 0), "shared_but_labelled")
        .when((F.col("_named") > 0) & (F.col("_unnamed") > 0), "mixed")
        .when(~shared_flag & (F.col("_unnamed") > 0) & (F.col("_declared") > 1), "several_unlabelled")
    )
    return agg.where("_n > 0").select(key, problem.alias("problem"))
