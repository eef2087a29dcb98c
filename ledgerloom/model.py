"""The boundary to language models: a protocol, offline clients, and the reflection loop."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut


class ModelClient(Protocol):
    def complete(self, task: str, prompt: str) -> str: ...


class Truncated(Exception):
    """A client raises this where its answer ended at the limit of output."""


def complete_within(client, task: str, prompt: str, limits: tuple[int, ...] = (2500, 4096)) -> str:  # noqa: ANN001
    """An answer within the first limit of output tokens that suffices; Truncated where none does.

    Clients without limits (no ``limit`` argument) are asked once.
    """
    if not hasattr(client, "complete_limited"):
        return client.complete(task, prompt)
    for k, limit in enumerate(limits):
        try:
            return client.complete_limited(task, prompt, limit)
        except Truncated:
            if k == len(limits) - 1:
                raise
    raise ValueError("no limit given")


class RuleClient:
    """A deterministic stand-in: the first code of the prompt; no critique beyond its presence."""

    def complete(self, task: str, prompt: str) -> str:
        codes = re.findall(r"(?<!\d)\d{8}-\d(?!\d)", prompt)
        if task == "critique":
            return "accept" if codes else "revise"
        return codes[0] if codes else ""


class ReplayClient:
    """Recorded answers by task and prompt; what was never recorded is empty."""

    def __init__(self, answers: dict[tuple[str, str], str]) -> None:
        self.answers = answers

    def complete(self, task: str, prompt: str) -> str:
        return self.answers.get((task, prompt), "")


def complete_column(df: DataFrame, client: ModelClient, task: str, prompt: str, out: str) -> DataFrame:
    """``df`` with the model's answers; a failing call gives null."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for p in batch[prompt]:
                try:
                    answers.append(complete_within(client, task, p or ""))
                except Exception:  # noqa: BLE001  a model's failure is a result
                    answers.append(None)
            yield batch.assign(**{out: answers})[[*names, out]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{out}` string")


def reflect(df: DataFrame, client: ModelClient, key: str, text: str, attempts: int = 3) -> DataFrame:
    """``key, answer, verdict, attempts``: classify, criticise, and try again what was sent back.

    Only unfinished keys enter the next round; each round is cut, so lost executors don't
    repeat model calls of earlier rounds.
    """
    open_rows, done = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("prompt")), None
    for n in range(1, attempts + 1):
        judged = complete_column(complete_column(open_rows, client, "classify", "prompt", "answer"), client, "critique", "prompt", "verdict")
        judged = cut(judged.withColumn("attempts", F.lit(n)))
        over = judged if n == attempts else judged.where(F.col("verdict") != "revise")
        done = over if done is None else done.unionByName(over)
        open_rows = judged.where(F.col("verdict").isNull() | (F.col("verdict") == "revise")).select(key, F.concat("prompt", F.lit("\nFeedback: "), F.coalesce("answer", F.lit(""))).alias("prompt"))
    return done.select(key, "answer", "verdict", "attempts")
