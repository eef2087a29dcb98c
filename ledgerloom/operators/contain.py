"""Which texts contain which of a fixed set of needles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def contained(texts: DataFrame, needles: DataFrame, text_id: str, text: str, needle_id: str, needle: str, block: int = 50_000) -> DataFrame:
    """``text_id, needle_id`` for every needle that occurs in a text, each pair once per text row.

    The needles are the fixed side: they stream to the driver in blocks of ``block``, each block
    becomes one automaton, and every text is read once per block. Null and empty needles match
    nothing, null texts match nothing.
    """
    kinds = f"{text_id} {texts.schema[text_id].dataType.simpleString()}, {needle_id} {needles.schema[needle_id].dataType.simpleString()}"
    rows = texts.select(text_id, text).where(f"`{text}` IS NOT NULL")
    listed = needles.select(needle_id, needle).where(f"`{needle}` <> ''")
    found, part = None, []

    def match(part: list[tuple]) -> DataFrame:
        shared = texts.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            ids: dict[str, list] = {}
            for i, n in shared.value:
                ids.setdefault(n, []).append(i)
            machine = ahocorasick.Automaton()
            for n, own in ids.items():
                machine.add_word(n, own)
            machine.make_automaton()
            for batch in batches:
                out = []
                for t, s in zip(batch[text_id], batch[text], strict=True):
                    out += [(t, i) for i in dict.fromkeys(i for _, own in machine.iter(s) for i in own)]
                yield pd.DataFrame(out, columns=[text_id, needle_id])

        return rows.mapInPandas(run, kinds)

    for r in listed.toLocalIterator(prefetchPartitions=True):
        part.append((r[0], r[1]))
        if len(part) == block:
            found, part = match(part) if found is None else found.unionByName(match(part)), []
    if part:
        found = match(part) if found is None else found.unionByName(match(part))
    return texts.sparkSession.createDataFrame([], kinds) if found is None else found
