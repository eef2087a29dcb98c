"""Documents into containers of one token capacity, with little space left.

Sizes are whole numbers up to the capacity, so the packing itself is planned on the histogram of
sizes, whose length the capacity bounds. The plan moves runs of equal documents into runs of
equal bins: documents above a third of the capacity are matched, at most two to a bin, each
large one with the largest partner that still fits; smaller ones go, largest first, into the
tightest gap they fit (best fit), and open new bins when none is left. Then every document finds
its bin by its rank within its size, which is counted in parallel.

Only a document that alone exceeds the capacity is split: into full containers and a rest that
is packed like any other.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

TOKENIZERS = "/opt/tokenizers"
#: fixed value: the split pattern that belongs to the byte-level vocabularies, from the tokenizers' own module
PATTERN_NAME = "PATTERN"


def token_counter(path: str):  # noqa: ANN201
    """A function from texts to token counts, by the kind of the vocabulary file at ``path``."""
    if path.endswith(".tiktoken"):
        import runpy

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = runpy.run_path(path.rsplit("/", 1)[0] + "/__init__.py")[PATTERN_NAME]
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(coder.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(list(texts), num_threads=1)]
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(path)
    bpe.encode_special_tokens = True
    return lambda texts: [len(x) for x in bpe.encode_batch(list(texts), add_special_tokens=False)]


def count_tokens(documents: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens``; a null text has no tokens, like an empty one."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(tokenizer)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            # a few texts at a time: the encoded lists of very long texts are large
            sizes = [n for i in range(0, len(texts), 64) for n in count(texts[i : i + 64])]
            yield pd.DataFrame({"id": batch["id"], "n_tokens": np.array(sizes, dtype="int64")})

    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, n_tokens long").withColumnRenamed("id", doc_id)


class _Bins:
    """Open bins by free space, as runs of consecutive bin numbers."""

    def __init__(self) -> None:
        self.spaces: list[int] = []
        self.runs: dict[int, deque[tuple[int, int]]] = defaultdict(deque)

    def put(self, space: int, first: int, n: int) -> None:
        if space <= 0:
            return
        if not self.runs[space]:
            insort(self.spaces, space)
        self.runs[space].append((first, n))

    def take(self, size: int, n: int) -> tuple[int, int, int] | None:
        """Up to n bins with the least space that fits: ``(space, first, count)``."""
        at = bisect_left(self.spaces, size)
        if at == len(self.spaces):
            return None
        space = self.spaces[at]
        first, count = self.runs[space].popleft()
        if count > n:
            self.runs[space].appendleft((first + n, count - n))
        elif not self.runs[space]:
            del self.spaces[at]
        return space, first, min(count, n)


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """``(moves, bins)``: a move ``(size, rank, bin, n)`` sends ranks rank.. of a size to bins bin.., one each.

    Sizes lie between 1 and the capacity. The work depends on the number of different sizes
    and of runs, not on the number of documents.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    moves: list[tuple[int, int, int, int]] = []
    bins, n_bins = _Bins(), 0

    def move(size: int, first: int, n: int) -> None:
        moves.append((size, rank[size], first, n))
        rank[size] += n
        left[size] -= n

    third = capacity / 3
    large = sorted(s for s in left if s > third)
    # greedy matching: the largest item with the largest partner that fits
    for size in reversed(large):
        while left[size]:
            at = bisect_left(large, capacity - size + 1) - 1
            while at >= 0 and not left[large[at]]:
                at -= 1
            partner = large[at] if at >= 0 else 0
            if partner and partner != size:
                n = min(left[size], left[partner])
            elif partner:
                n = left[size] // 2
            else:
                n = 0
            if n == 0:  # alone
                n = left[size]
                move(size, n_bins, n)
                bins.put(capacity - size, n_bins, n)
            else:
                move(size, n_bins, n)
                move(partner, n_bins, n)
                bins.put(capacity - size - partner, n_bins, n)
            n_bins += n
    for size in sorted((s for s in left if s <= third), reverse=True):
        while left[size]:
            found = bins.take(size, left[size])
            if found:
                space, first, n = found
                move(size, first, n)
                bins.put(space - size, first, n)
            else:  # new bins, each with as many of this size as fit
                each = capacity // size
                full, rest = divmod(left[size], each)
                for _ in range(each if full else 0):
                    move(size, n_bins, full)
                if full:
                    bins.put(capacity - each * size, n_bins, full)
                n_bins += full
                for k in range(rest):
                    move(size, n_bins, 1)
                if rest:
                    bins.put(capacity - rest * size, n_bins, 1)
                    n_bins += 1
    return moves, n_bins


def pack_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", salts: int | None = None) -> DataFrame:
    """``doc_id, part_no, n_tokens, container_no``: a container for each document or part of one.

    Part 1 is the whole document unless it exceeds the capacity. Documents without tokens have
    no part and no container (part_no 0, container_no null), so every row comes out. Rows with
    the same id are packed each for itself.

    Ranks are counted by size and salt, so a size that most documents share is spread over
    ``salts`` tasks (the shuffle partitions of the session unless given).
    """
    spark = documents.sparkSession
    salts = salts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sized = count_tokens(documents, doc_id, text, tokenizer)
    whole = F.floor(F.col("n_tokens") / capacity)
    rest = F.col("n_tokens") - whole * capacity
    lone = F.when(F.col("n_tokens") == 0, F.array(F.struct(F.lit(0).alias("part_no"), F.lit(0).cast("long").alias("size"))))
    full = F.transform(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), lambda i: F.struct(i.cast("int").alias("part_no"), F.lit(capacity).cast("long").alias("size")))
    full = F.slice(full, F.lit(1), whole.cast("int"))
    tail = F.when(rest > 0, F.array(F.struct((whole + 1).cast("int").alias("part_no"), rest.cast("long").alias("size")))).otherwise(F.array())
    parts = sized.select(doc_id, F.explode(F.coalesce(lone, F.concat(full, tail))).alias("p")).select(doc_id, "p.*")
    parts = cut(parts.withColumn("salt", F.pmod(F.xxhash64(doc_id, "part_no"), F.lit(salts)).cast("int")))
    # at most capacity x salts rows, added up in the engine; the driver gets one row a size
    counts = parts.where("size > 0").groupBy("size", "salt").agg(F.count("*").alias("n"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    moves, _ = plan_bins(histogram, capacity)
    table = np.array(sorted(moves), dtype="int64").reshape(-1, 4)
    plan = spark.sparkContext.broadcast(table)
    ranked = parts.where("size > 0").selectExpr(
        f"`{doc_id}`", "part_no", "size", "salt", f"row_number() OVER (PARTITION BY size, salt ORDER BY `{doc_id}`, part_no) - 1 AS own_rank"
    )
    before = counts.selectExpr("size", "salt", "sum(n) OVER (PARTITION BY size ORDER BY salt) - n AS before")
    ranked = ranked.join(before, ["size", "salt"]).select(doc_id, "part_no", "size", (F.col("own_rank") + F.col("before")).alias("rank"))
    kind = documents.schema[doc_id].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = plan.value
        starts = {}
        for s in np.unique(rows[:, 0]):
            own = rows[rows[:, 0] == s]
            starts[int(s)] = own
        for batch in batches:
            where = np.empty(len(batch), dtype="int64")
            sizes, ranks = batch["size"].to_numpy(), batch["rank"].to_numpy()
            for s in np.unique(sizes):
                own, here = starts[int(s)], sizes == s
                at = np.searchsorted(own[:, 1], ranks[here], side="right") - 1
                where[here] = own[at, 2] + ranks[here] - own[at, 1]
            yield pd.DataFrame({"id": batch["id"], "part_no": batch["part_no"], "n_tokens": sizes, "container_no": where})

    placed = ranked.withColumnRenamed(doc_id, "id").mapInPandas(place, f"id {kind}, part_no int, n_tokens long, container_no long")
    empty = parts.where("size = 0").select(F.col(doc_id).alias("id"), "part_no", F.col("size").alias("n_tokens"), F.lit(None).cast("long").alias("container_no"))
    return placed.unionByName(empty).withColumnRenamed("id", doc_id)
