"""Where results go: partitioned JSON, CSV with header, append-only logs, guarded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.reports import markdown


def write_records(df: DataFrame, path: str, key: str = "eis_id") -> None:
    """One JSON line per record, partitioned by key bucket, so that a rerun overwrites what it covers."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(256)).cast("int")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(path)


def write_csv(df: DataFrame, path: str, guarded: bool = False) -> None:
    """CSV with a header; a guarded path, such as an annotated sample, is never overwritten."""
    df.write.mode("errorifexists" if guarded else "overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def summary_json(df: DataFrame) -> DataFrame:
    """A one-row frame as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("summary"))


def append_trace(calls: DataFrame, path: str) -> None:
    """One JSON line a model call, in folders by procurement and run; earlier runs stay."""
    calls.write.mode("append").partitionBy("eis_id", "run").json(path)


def write_report(df: DataFrame, folder: str, name: str, labels: dict[str, str] | None = None, note: str = "") -> None:
    """The same small table for spreadsheets (``name.csv``) and for reading (``name.md``)."""
    text = markdown(df, labels) + (f"\n{note}\n" if note else "")
    shown = df.select(*[df[c].alias((labels or {}).get(c, c)) for c in df.columns])
    shown.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    df.sparkSession.createDataFrame([(text,)], "text string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.md")
