"""Runs, attempts, logs and reviews: latest states, changes, diffs, summaries and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; further columns break ties by value."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*")


def first_last_change(df: DataFrame, keys: list[str], order: list[str], good: Column) -> DataFrame:
    """``keys, first_ok, last_ok, change``: improved, worsened, unchanged, or not_compared without rows to compare."""
    mark = F.struct(*order, good.cast("int").alias("ok"))
    agg = df.where(good.isNotNull()).groupBy(*keys).agg(F.min(mark)["ok"].alias("first_ok"), F.max(mark)["ok"].alias("last_ok"))
    d = F.col("last_ok") - F.col("first_ok")
    return agg.withColumn("change", F.when(d > 0, "improved").when(d < 0, "worsened").otherwise("unchanged"))


def sessions(df: DataFrame, keys: list[str], time: str, gap_seconds: int) -> DataFrame:
    """``df`` with ``session_no`` from 1: a new one after a gap longer than ``gap_seconds``."""
    tie = [c for c in df.columns if c not in (*keys, time)][:1]
    w = Window.partitionBy(*keys).orderBy(time, *tie)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    new = F.when(seconds - F.lag(seconds).over(w) <= gap_seconds, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_diff(a: DataFrame, b: DataFrame, keys: list[str], fields: Sequence[str]) -> DataFrame:
    """``keys, changed, n_changed``: fields that differ (null-safe) between two runs, for keys in both."""
    left = a.select(*keys, F.struct(*fields).alias("a"))
    right = b.select(*keys, F.struct(*fields).alias("b"))
    listed = F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields])
    both = left.join(right, keys).withColumn("changed", F.filter(listed, lambda x: x.isNotNull()))
    return both.select(*keys, F.array_join("changed", ",").alias("changed"), F.size("changed").cast("long").alias("n_changed"))


def verdict_pivot(df: DataFrame, row: str, column: str, value: Column, columns: Sequence[str]) -> DataFrame:
    """Verdicts side by side, ``-`` for absent; ``agree`` is null where they differ, else true."""
    wide = df.groupBy(row).pivot(column, list(columns)).agg(F.max(value))
    distinct = F.size(F.array_distinct(F.filter(F.array(*[F.col(f"`{c}`") for c in columns]), lambda x: x.isNotNull())))
    shown = [F.coalesce(F.col(f"`{c}`"), F.lit("-")).alias(c) for c in columns]
    return wide.select(row, *shown, F.when(distinct <= 1, F.lit(True)).alias("agree"))


def finite(seconds: Column) -> Column:
    """A time in seconds, null where it is negative, infinite or NaN."""
    return F.when((seconds >= 0) & ~F.isnan(seconds) & (seconds < float("inf")), seconds)


def latency_summary(df: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """Sum, mean and exact median per value of each column in ``by`` and in all: grouping sets."""
    clean = df.withColumn("_s", finite(F.col(seconds)))
    sets = [[c] for c in by] + [[]]
    n, missing = F.count("*").alias("n"), F.count(F.when(F.col("_s").isNull(), 1)).alias("n_missing")
    rated = [F.round(F.sum("_s"), 2).alias("total_s"), F.round(F.avg("_s"), 2).alias("mean_s"), F.round(F.percentile("_s", F.lit(0.5)), 2).alias("median_s")]
    return clean.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(n, missing, *rated)


def kpi_rows(one: DataFrame, measures: Sequence[str]) -> DataFrame:
    """A one-row frame as rows ``measure, value``."""
    args = ", ".join(f"'{m}', cast(`{m}` as double)" for m in measures)
    return one.selectExpr(f"stack({len(measures)}, {args}) as (measure, value)")


def stratified_sample(df: DataFrame, strata: list[str], ident: str, k: int, seed: int = 2026) -> DataFrame:
    """At most k rows per stratum by a seeded hash, with the stratum's size: the same on every run.

    Only the k smallest hashes of each task's rows can win, so a partial top-k runs before the shuffle.
    """
    rank = F.md5(F.concat_ws(":", F.col(ident).cast("string"), F.lit(str(seed))))
    w = Window.partitionBy(*strata).orderBy("_h", ident)
    sizes = df.groupBy(*strata).agg(F.count("*").alias("population"))
    picked = df.withColumn("_h", rank).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k).drop("_h")
    cond = [picked[c].eqNullSafe(sizes[c]) for c in strata]
    return picked.join(sizes, cond).select(*[picked[c] for c in picked.columns], "population")


def running_header(df: DataFrame, partition: list[str], order: list[str], header: Column) -> Column:
    """The header that applies to each following row (forward fill)."""
    return F.last(header, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def decision_source(human: Column, reviewed: Column, complete: Column) -> Column:
    """Six-way provenance of a decision from the ordered list of human action types."""
    last = F.element_at(F.when(F.size(human) > 0, human), -1)
    return (
        F.when(~F.coalesce(reviewed, F.lit(False)), "no_review")
        .when(~F.coalesce(complete, F.lit(False)), "incomplete")
        .when(human.isNull() | (F.size(human) == 0), "automatic")
        .when(last == "edit", "human_amended")
        .when(last == "approve", "human_approved")
        .otherwise("model_after_feedback")
    )


def final_status(budget: Column, error: Column, verdict: Column, main: Column, n_additional: Column, has_classification: Column, n_candidates: Column) -> Column:
    """Status of an extraction, first rule that holds."""
    empty = main.isNull() | (main == "")
    return (
        F.when(budget, "input_budget_exceeded")
        .when(error.isNotNull(), "error")
        .when(verdict == "revise", "unresolved")
        .when(empty & (n_additional > 0), "partial")
        .when(~empty & (verdict == "accept"), "accepted")
        .when(has_classification, "not_reviewed")
        .when(n_candidates == 0, "no_candidates")
        .otherwise("unresolved")
    )


def lot_inventory_problem(division: Column, count: Column, labels: Column, complete: Column) -> Column:
    """The first contradiction of a declared lot inventory, null where it is consistent."""
    clean = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
    n = F.size(clean)
    return (
        F.when(F.exists(clean, lambda x: x == "") | (F.size(F.array_distinct(clean)) < n), "empty_or_duplicate_label")
        .when((division != "divided") & ((n > 0) | count.isNotNull() | F.coalesce(complete, F.lit(False))), "inventory_without_division")
        .when(n > count, "more_labels_than_count")
        .when(complete & (n != count), "complete_but_unequal")
        .when(complete & count.isNull(), "complete_without_count")
    )


def task_plan(df: DataFrame, key: str, labels: str) -> DataFrame:
    """``key, task_no, lot_label, fallback``: a task per label, or one fallback without label."""
    listed = F.filter(F.coalesce(F.col(labels), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    tasks = F.when(F.size(listed) > 0, F.transform(listed, lambda x, i: F.struct((i + 1).alias("task_no"), x.alias("lot_label"), F.lit(False).alias("fallback"))))
    lone = F.array(F.struct(F.lit(1).alias("task_no"), F.lit(None).cast("string").alias("lot_label"), F.lit(True).alias("fallback")))
    return df.select(key, F.explode(F.coalesce(tasks, lone)).alias("t")).select(key, "t.*")


def review_summary(df: DataFrame, by: list[str], applies: Column, status: Column, n_human: Column, n_pauses: Column, overridden: Column, seconds: Column) -> DataFrame:
    """Counts of one review run: candidates, attempted, decided, unresolved, human reviewed, times."""
    attempted = status.isNotNull()
    decided = attempted & applies.isNotNull() & (status == "decided")
    count = lambda c: F.count(F.when(c, 1))
    s = finite(seconds)
    agg = df.groupBy(*by).agg(
        F.count("*").alias("candidates"), count(attempted).alias("attempted"), count(decided).alias("decided"), count(attempted & ~decided).alias("unresolved"),
        count(~attempted).alias("not_attempted"), count(n_human > 0).alias("human_reviewed"), count(decided & applies).alias("applies"), F.sum(n_pauses).alias("pauses"),
        count(overridden).alias("overridden"), F.round(F.sum(s), 1).alias("seconds"), F.round(F.avg(s), 1).alias("seconds_each"),
    )
    return agg.withColumn("complete", F.col("decided") == F.col("candidates"))


def last_call_reply(turns: DataFrame, keys: list[str], order: str, role: str, call_id: str, ok: Column) -> DataFrame:
    """The last call per session with its last reply, if that has the same id and succeeded."""
    calls = turns.where(F.col(role) == "call").groupBy(*keys).agg(F.max(F.struct(order, call_id)).alias("c"))
    replies = turns.where(F.col(role) == "reply").groupBy(*keys, call_id).agg(F.max(F.struct(F.col(order), ok.alias("ok"))).alias("r"))
    both = calls.select(*keys, F.col(f"c.{order}").alias("call_at"), F.col(f"c.{call_id}").alias(call_id)).join(replies, [*keys, call_id], "left")
    return both.select(*keys, call_id, "call_at", F.col(f"r.{order}").alias("reply_at"), F.coalesce(F.col("r.ok") & (F.col(f"r.{order}") > F.col("call_at")), F.lit(False)).alias("valid"))


def fold_session(events: DataFrame, keys: list[str], order: str, action: str, value: str) -> DataFrame:
    """State of each review session after its ordered actions: ``keys, state, verdict, pauses, n_events``.

    Actions: start, pause, propose, approve, edit, reject. A pause waits; approve takes the open
    proposal, edit sets the verdict itself, reject drops the proposal. The last edit wins over
    later proposals. The fold runs inside one row of ordered actions, without Python.
    """
    listed = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, action, value))).alias("e"))

    def step(s: Column, e: Column) -> Column:
        a, v = e[action], e[value]
        state = F.when(a == "pause", "pending").when(a.isin("approve", "edit"), "decided").when(a == "reject", "open").when(a == "start", "open").otherwise(s["state"])
        proposal = F.when(a == "propose", v).when(a == "reject", F.lit(None).cast("string")).otherwise(s["proposal"])
        verdict = F.when(a == "edit", v).when((a == "approve") & ~s["edited"], s["proposal"]).otherwise(s["verdict"])
        return F.struct(state.alias("state"), proposal.alias("proposal"), verdict.alias("verdict"), (s["edited"] | (a == "edit")).alias("edited"), (s["pauses"] + (a == "pause").cast("int")).alias("pauses"))

    none = F.lit(None).cast("string")
    zero = F.struct(F.lit("new").alias("state"), none.alias("proposal"), none.alias("verdict"), F.lit(False).alias("edited"), F.lit(0).alias("pauses"))
    return listed.select(*keys, F.aggregate("e", zero, step).alias("s"), F.size("e").cast("long").alias("n_events")).select(*keys, "s.state", "s.verdict", "s.pauses", "n_events")
