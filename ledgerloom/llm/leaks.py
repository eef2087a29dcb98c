"""Test passages inside a corpus: which documents hold at least so many consecutive words of which item.

The test items, normalised to words, form a generalised suffix automaton. The corpus streams
past it word by word; the automaton tracks the longest match ending at each word, and where
that reaches the limit the items of the state (lifted to the shortest suffix that is still long
enough) have leaked. The items are the fixed side: they are cut into blocks of bounded size,
and every block meets all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

PER_PASS = 4  # automata that one pass over the corpus holds in memory
_WORDS = re.compile(r"[^\W_]+")
_RAW = re.compile(r"[^\W_](?:[^\W_]|[\u0300-\u036f])*")  # a word as written, with its combining accents
_MARKS = re.compile("[̀-ͯ]+")


def normal_words(text: str) -> list[str]:
    """Runs of letters and digits in lower case, without accents."""
    folded = text.casefold()
    if not folded.isascii():
        folded = _MARKS.sub("", unicodedata.normalize("NFD", folded))
    return _WORDS.findall(folded)


class SuffixAutomaton:
    """All word sequences of all items. ``goto[s]`` maps a word id to a state; state 0 is empty."""

    def __init__(self, items: Sequence[tuple[int, list[str]]]) -> None:
        self.ids: dict[str, int] = {}
        self.goto: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        self._ends = ends
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                ends[last].add(item)
        for s in sorted(range(1, len(self.goto)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]

    def _new(self, goto: dict[int, int], link: int, length: int) -> int:
        self.goto.append(goto)
        self.link.append(link)
        self.length.append(length)
        self._ends.append(set())
        return len(self.goto) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._new(dict(self.goto[q]), self.link[q], self.length[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.goto[p].get(c) == q:
            self.goto[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.goto[last]:
            q = self.goto[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._new({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.goto[p]:
            self.goto[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.goto[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def compile(self, least: int) -> Matcher:
        """The automaton for matches of at least ``least`` words; its states carry their items."""
        lifted: list[int] = [0] * len(self.goto)
        for s in sorted(range(len(self.goto)), key=lambda s: self.length[s]):
            if self.length[s] >= least:
                up = self.link[s]
                lifted[s] = s if self.length[up] < least else lifted[up]
        items = {s: tuple(sorted(self._ends[s])) for s in set(lifted) - {0}}
        return Matcher(self.ids, self.goto, self.link, self.length, lifted, items, least)


class Matcher:
    def __init__(self, ids, goto, link, length, lifted, items, least) -> None:  # noqa: ANN001, PLR0913
        self.ids, self.goto, self.link, self.length = ids, goto, link, length
        self.lifted, self.items, self.least = lifted, items, least

    def states(self, words: Sequence[str]) -> dict[int, int]:
        """Lifted states that the words reach, with the longest match that reached each."""
        goto, link, length, lifted, ids, least = self.goto, self.link, self.length, self.lifted, self.ids, self.least
        state, n = 0, 0
        found: dict[int, int] = {}
        for c in map(ids.get, words):
            if c is None:
                state = n = 0
                continue
            nxt = goto[state].get(c)
            while nxt is None and state:
                state = link[state]
                n = length[state]
                nxt = goto[state].get(c)
            if nxt is None:
                n = 0
                continue
            state = nxt
            n += 1
            if n >= least:
                at = state
                while length[link[at]] >= n:  # the match may be shorter than the state
                    at = link[at]
                at = lifted[at]
                if found.get(at, 0) < n:
                    found[at] = n
        return found

    def leaks(self, text: str) -> dict[int, int]:
        """``item -> longest match in words`` for the items that leaked into a text."""
        out: dict[int, int] = {}
        for s, n in self.states(normal_words(text)).items():
            for item in self.items[s]:
                if out.get(item, 0) < n:
                    out[item] = n
        return out

    def spans(self, words: Sequence[str]) -> list[tuple[int, int]]:
        """Word spans ``(start, stop)`` of all matches of at least the limit, those that touch or overlap as one."""
        out: list[tuple[int, int]] = []
        goto, link, length = self.goto, self.link, self.length
        state, n = 0, 0
        for i, c in enumerate(map(self.ids.get, words)):
            while state and (c is None or c not in goto[state]):
                state = link[state]
                n = length[state]
            nxt = None if c is None else goto[state].get(c)
            if nxt is None:
                state = n = 0
                continue
            state, n = nxt, n + 1
            if n >= self.least:
                out.append((i - n + 1, i + 1))
        return united(out)


def united(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of at most ``block_chars`` characters (one item at least), streamed."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where(F.col(text).isNotNull())
    for row in rows.toLocalIterator(prefetchPartitions=True):
        if block and size + len(row["t"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"])
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", least: int = 12, block_chars: int = 400_000) -> DataFrame:
    """``doc_id, item_id, n_words``: documents that hold ``least`` or more consecutive words of an item.

    ``n_words`` is the longest such run. Items shorter than ``least`` words can't leak. Null and
    empty texts match nothing. An item's words match only inside that item, never across two.
    Documents with the same id are each looked at, so pairs may repeat with them. The automaton
    of a block is sent to every executor; ``block_chars`` bounds its size.
    """
    spark = documents.sparkSession
    kinds = f"{doc_id} {documents.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}, n_words int"
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    found: DataFrame | None = None
    for block in blocks(items, item_id, item_text, block_chars):
        matcher = SuffixAutomaton([(i, normal_words(t)) for i, t in block]).compile(least)
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            leaks = shared.value.leaks
            for batch in batches:
                out = [(d, i, n) for d, t in zip(batch["id"], batch["text"], strict=True) for i, n in leaks(t).items()]
                yield pd.DataFrame(out, columns=[doc_id, item_id, "n_words"])

        part = rows.mapInPandas(run, kinds)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], kinds) if found is None else found


def remove_leaks(documents: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "item_text", least: int = 12, most_coverage: float = 0.5, block_chars: int = 400_000) -> DataFrame:
    """Documents without leaked spans, plus ``leaked_share``; mostly leaked documents leave whole.

    The spans of all blocks of items are marked on the words as written and united; only then
    the text is cut and its coverage judged, so the result doesn't depend on how the items are
    cut into blocks. A span of at least ``least`` words is cut out with the punctuation inside
    and after it; a document of whose words more than ``most_coverage`` leaked is dropped. Null
    texts stay null, texts without words as they are. A pass holds at most PER_PASS automata;
    beyond that the marks are written between passes.
    """
    spark = documents.sparkSession
    if {"leaked_share", "_cut", "_spans"} & set(documents.columns):
        raise ValueError("the column names leaked_share, _cut and _spans are taken")
    out = documents.withColumn("_spans", F.array().cast(_SPANS))
    for k, block in enumerate(blocks(items, item_id, item_text, block_chars)):
        if k and k % PER_PASS == 0:
            out = cut(out)
        shared = spark.sparkContext.broadcast(SuffixAutomaton([(i, normal_words(t)) for i, t in block]).compile(least))
        out = out.withColumn("_spans", F.concat("_spans", _marker(shared)(F.col(text))))
    out = out.withColumn("_cut", F.when(F.size("_spans") > 0, _cut_out(F.when(F.size("_spans") > 0, F.col(text)), F.col("_spans"))))
    out = out.withColumn(text, F.when(F.size("_spans") > 0, F.col("_cut.text")).otherwise(F.col(text))).withColumn("leaked_share", F.coalesce("_cut.share", F.lit(0.0)))
    return out.where(F.col("leaked_share") <= most_coverage).drop("_spans", "_cut")


_SPANS = "array<struct<start:int,stop:int>>"


def _marker(shared):  # noqa: ANN001, ANN202
    @F.pandas_udf(_SPANS)
    def mark(texts: pd.Series) -> pd.Series:
        matcher = shared.value
        return texts.map(lambda t: [] if t is None else [{"start": a, "stop": b} for a, b in matcher.spans(normal_words(t))])

    return mark


def _cut_out(text, spans):  # noqa: ANN001, ANN202
    @F.pandas_udf("text string, share double")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [(None, 0.0) if t is None else without(t, [(x["start"], x["stop"]) for x in s]) for t, s in zip(texts, spans, strict=True)]
        return pd.DataFrame(rows, columns=["text", "share"])

    return cut_out(text, spans)


def without(text: str, spans: Sequence[tuple[int, int]]) -> tuple[str, float]:
    """``(text without the words of the spans, their share)``; a raw word that folds to several leaves only if all of them do."""
    leaked: set[int] = {i for a, b in united(spans) for i in range(a, b)}
    pieces, done, k, open_cut = [], 0, 0, False
    for m in _RAW.finditer(text):
        n = len(normal_words(m[0]))
        if not n:
            continue
        gone = all(i in leaked for i in range(k, k + n))
        k += n
        if gone and not open_cut:
            pieces.append(text[done : m.start()])
            open_cut = True
        elif not gone and open_cut:
            done, open_cut = m.start(), False
    if not open_cut:
        pieces.append(text[done:])
    return "".join(pieces), len(leaked) / k if k else 0.0
