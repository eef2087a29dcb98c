"""Append-only logs as streams: the latest row per key, sessions, and review state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_of(spark: SparkSession, path: str, schema: str, source: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(source).load(path)


def stream_latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row per key so far; run in complete or update mode."""
    rest = [c for c in events.columns if c not in (*keys, *order)]
    return events.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*")


def stream_sessions(events: DataFrame, keys: list[str], time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows with a watermark; later rows are dropped by the engine."""
    return events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_events")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


REVIEW_STATE = "state string, proposal string, verdict string, edited boolean, pauses int, last long"


_FIELDS = ("state", "proposal", "verdict", "edited", "pauses", "last")


def step_review(s: dict, action: str, value: str | None) -> dict:
    """One action on the state of a review session (see operators.runs.fold_session)."""
    s = dict(s)
    if action in ("pause", "start", "reject", "approve", "edit"):
        s["state"] = {"pause": "pending", "start": "open", "reject": "open"}.get(action, "decided")
    if action == "pause":
        s["pauses"] += 1
    elif action == "propose":
        s["proposal"] = value
    elif action == "reject":
        s["proposal"] = None
    elif action == "approve" and not s["edited"]:
        s["verdict"] = s["proposal"]
    elif action == "edit":
        s["verdict"], s["edited"] = value, True
    return s


def stream_reviews(events: DataFrame, key: str, order: str, action: str, value: str, idle_seconds: int = 7 * 24 * 3600) -> DataFrame:
    """``key, state, verdict, pauses`` of each session as its events arrive.

    Events of a session are numbered by ``order``; one that isn't above the last number taken is
    a repeat, or too late, and ignored. So the state of a session is one row of fixed size; it
    leaves after ``idle_seconds`` without events.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = dict(zip(_FIELDS, state.get, strict=True)) if state.exists else dict(zip(_FIELDS, ("new", None, None, False, 0, None), strict=True))
        rows = pd.concat(list(batches)).sort_values(order)
        for at, a, v in zip(rows[order], rows[action], rows[value], strict=True):
            if s["last"] is None or int(at) > s["last"]:
                s = step_review(s, a, v) | {"last": int(at)}
        state.update(tuple(s[f] for f in _FIELDS))
        state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame([{key: keys[0], "state": s["state"], "verdict": s["verdict"], "pauses": s["pauses"]}])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, state string, verdict string, pauses int", REVIEW_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
