"""Reading level of documents, spread from graded examples over a graph of documents and words.

Documents and words are the two sides of a weighted graph; graded documents are clamped, and a
harmonic iteration alternates until levels rest: a word takes the mean level of its documents, a
document the mean level of its words. Besides its words a document is joined to feature nodes
(binned sentence length, word length, share of long words, commas), which let levels pass between
texts that share few words. Words are told apart by their spelling, so each language gets its
own word nodes.

Every word that occurs twice is a node; one that stands once joins nothing. Words that make up at
least 1 / SHARE of all words are frequent: at most SHARE, at every size of the corpus, so their
levels fit arrays that go to the driver and to all executors, and their edges stay where they are, a
compact table scanned once per iteration. The levels of all other words, however many, stay in
tables: documents send them their levels, grouped by word, and they answer, grouped by document.
Both kinds follow the same formulas.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

SHARE = 2_000_000  # a frequent word makes up at least one in so many words
BINS = 256  # bins of a feature; what lies beyond falls into the last one
FEATURES = ("sentence", "word", "long", "comma")
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?…]+(?=\s|$)|\n\s*\n")


def _key(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def text_nodes(text: str) -> tuple[dict[str, float], dict[str, float]]:
    """Words with damped frequencies, and feature nodes with weights, of one text."""
    words = _WORD.findall(text.lower())
    counts = Counter(words)
    # damped: a long text must not drown its rare words
    nodes = {w: 1.0 if n == 1 else 1.0 + math.log(n) for w, n in counts.items()}
    if not words:
        return {}, {}
    sentences = max(1, len(_END.findall(text)))
    long_share = sum(n for w, n in counts.items() if len(w) > 8) / len(words)
    features = {
        "sentence": math.log2(1 + len(words) / sentences) * 4,
        "word": sum(len(w) * n for w, n in counts.items()) / len(words) * 4,
        "long": long_share * 20,
        "comma": text.count(",") / sentences * 4,
    }
    return nodes, features


def word_nodes(documents: DataFrame, text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the frequent words, at most SHARE; every text is counted."""
    return _frequent(documents, text)[0]


def _frequent(documents: DataFrame, text: str) -> tuple[np.ndarray, bool]:
    """Hashes of the frequent words, and whether there are others that occur twice."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for t in batch["text"]:
                found.update(_WORD.findall(t.lower()))
            yield pd.DataFrame({"word": np.fromiter(map(_key, found), dtype="int64", count=len(found)), "n": np.fromiter(found.values(), dtype="int64", count=len(found))})

    rows = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    counted = cut(rows.mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    least = max(2, total / SHARE)
    rest = least > 2 and not counted.where((F.col("n") >= 2) & (F.col("n") < least)).isEmpty()
    return np.sort(counted.where(F.col("n") >= least).select("word").toPandas()["word"].to_numpy(dtype="int64")), rest


def document_nodes(documents: DataFrame, doc_id: str, text: str, known: np.ndarray, rest: bool = False) -> DataFrame:
    """``id, nodes, weights``: the edges of each document, one row a document; null texts have none.

    Words that aren't known have no edges there; feature nodes come after the words and have negative
    weights. With ``rest`` also ``others, other_weights``: hashes and weights of the words not known.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        cache: dict[str, int] = {}
        for batch in batches:
            at, weight, others, other_weights = [], [], [], []
            for t in batch["text"]:
                words, features = text_nodes(t) if t else ({}, {})
                new = [w for w in words if w not in cache]
                if new:
                    if len(cache) > 500_000:
                        cache.clear()
                        new = list(words)
                    keys = np.fromiter(map(_key, new), dtype="int64", count=len(new))
                    place = np.searchsorted(known, keys)
                    hit = np.zeros(len(new), dtype=bool) if not len(known) else known[np.minimum(place, len(known) - 1)] == keys
                    cache.update(zip(new, np.where(hit, place, -1).tolist(), strict=True))
                own: dict[int, float] = {n: x for w, x in words.items() if (n := cache[w]) >= 0}
                for k, name in enumerate(FEATURES if features else ()):  # two neighbouring bins share a value's weight
                    x = min(features[name], BINS - 2)
                    low = math.floor(x)
                    base = len(known) + k * BINS + low
                    own[base], own[base + 1] = -(1 - (x - low)), -(x - low)
                at.append(np.fromiter(own.keys(), dtype="int32", count=len(own)))
                weight.append(np.fromiter(own.values(), dtype="float32", count=len(own)))
                if rest:
                    left = {w: x for w, x in words.items() if cache[w] < 0}
                    others.append(np.fromiter(map(_key, left), dtype="int64", count=len(left)))
                    other_weights.append(np.fromiter(left.values(), dtype="float32", count=len(left)))
            yield pd.DataFrame({"id": batch["id"], "nodes": at, "weights": weight} | ({"others": others, "other_weights": other_weights} if rest else {}))

    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, nodes array<int>, weights array<float>" + (", others array<long>, other_weights array<float>" if rest else ""))


def mean_grades(labels: DataFrame, doc_id: str, grade: str) -> DataFrame:
    """One grade per document: the mean over its raters; null grades and ids count for nothing."""
    rows = labels.where(F.col(grade).isNotNull() & F.col(doc_id).isNotNull())
    return rows.groupBy(F.col(doc_id).alias("id")).agg(F.avg(F.col(grade).cast("double")).alias("grade"))


def _sums(edges: DataFrame, step, nodes: int, width: int, told: bool = False) -> tuple[np.ndarray, DataFrame | None]:  # noqa: ANN001
    """Column sums over all documents of what ``step`` adds to a table of nodes x width.

    With ``told`` also ``row, level, weight``: what ``step`` returns for each document.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((nodes, width))
        for batch in batches:
            level, weight = step(batch, total)
            if told:
                yield pd.DataFrame({"node": np.int32(-1), "row": batch["row"], "level": level, "weight": weight} | {f"s{i}": 0.0 for i in range(width)})
        at = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"node": at.astype("int32")} | ({"row": -1, "level": 0.0, "weight": 0.0} if told else {}) | {f"s{i}": total[at, i] for i in range(width)})

    schema = "node int, " + ("row long, level double, weight double, " if told else "") + ", ".join(f"s{i} double" for i in range(width))
    added = edges.mapInPandas(run, schema)
    added = cut(added) if told else added
    sums = added.where("node >= 0").groupBy("node").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).toPandas()
    out = np.zeros((nodes, width))
    out[sums["node"].to_numpy(dtype=int)] = sums[[f"s{i}" for i in range(width)]].to_numpy()
    return out, added.where("node < 0").select("row", "level", "weight") if told else None


def _other_words(graph: DataFrame, n_docs: int) -> DataFrame:
    """``row, words``: the words of each document that are neither frequent nor stand once, with their weights."""
    edges = graph.select("row", F.explode(F.arrays_zip("others", "other_weights")).alias("e")).select("row", F.col("e.others").alias("key"), F.col("e.other_weights").cast("double").alias("w"))
    # a weight is above 1 if the word occurs twice in its document
    words = edges.groupBy("key").agg(F.collect_list(F.struct("row", "w")).alias("docs"), F.max("w").alias("most")).where((F.size("docs") > 1) | (F.col("most") > 1))
    idf = F.log(F.lit(n_docs + 1.0) / (F.size("docs") + 1)) + 0.1
    flat = words.select("key", idf.alias("idf"), F.explode("docs").alias("d"))
    return flat.groupBy(F.col("d.row").alias("row")).agg(F.collect_list(F.struct("key", (F.col("d.w") * F.col("idf")).alias("w"))).alias("words"))


def _other_levels(told: DataFrame, edges: DataFrame, mean: float) -> DataFrame:
    """``key, s0, s2, level, spread, docs``: levels of the words in tables, as ``_State`` has them of the others."""
    e = told.join(edges.select("row", "grade", "words"), "row").select("row", "level", "weight", "grade", F.explode("words").alias("e"))
    x, level = F.col("e.w") * F.col("weight"), F.col("level")
    own = F.collect_list(F.struct("row", F.col("e.w").alias("w"), "grade")).alias("docs")
    words = e.groupBy(F.col("e.key").alias("key")).agg(F.sum(x * level).alias("s0"), F.sum(x * level * level).alias("s1"), F.sum(x).alias("s2"), own)
    seen = F.col("s2") > 0
    words = words.withColumn("level", F.when(seen, F.col("s0") / F.col("s2")).otherwise(F.lit(mean)))
    spread = F.greatest(F.when(seen, F.col("s1") / F.col("s2") - F.col("level") ** 2).otherwise(F.lit(1.0)), F.lit(0.0))
    return cut(words.select("key", "s0", "s2", "level", spread.alias("spread"), "docs"))


def _trust(den: Column, clamp: float) -> Column:
    return F.when(den > 1e-9, den / (den + clamp)).otherwise(F.lit(0.0)) / (0.05 + F.col("spread"))


def _other_answers(words: DataFrame, mean: float, clamp: float, own: bool = False) -> DataFrame:
    """``row, num, den, all``: what the words in tables add to each document's level, as in ``_State.levels``."""
    d = words.select("s0", "s2", "level", "spread", F.explode("docs").alias("d")).select("*", "d.*")
    level, trust = F.col("level"), _trust(F.col("s2"), clamp)
    if own:
        graded = F.col("grade").isNotNull()
        den = F.greatest(F.col("s2") - F.col("w") * clamp, F.lit(0.0))
        level = F.when(graded, F.when(den > 1e-9, (F.col("s0") - F.col("w") * clamp * F.col("grade")) / den).otherwise(F.lit(mean))).otherwise(level)
        trust = F.when(graded, _trust(den, clamp)).otherwise(trust)
    w = F.col("w")
    return d.groupBy("row").agg(F.sum(w * trust * level).alias("num"), F.sum(w * trust).alias("den"), F.sum(w).alias("all"))


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = batch["nodes"].map(len).to_numpy()
    if not sizes.sum():
        return np.zeros(0, dtype=int), np.zeros(0), np.zeros(0, dtype=int)
    owner = np.repeat(np.arange(len(batch)), sizes)
    return np.concatenate(batch["nodes"].to_numpy()).astype(int), np.concatenate(batch["weights"].to_numpy()).astype(float), owner


def _weigh(nodes: np.ndarray, raw: np.ndarray, idf: np.ndarray, feature_weight: float) -> np.ndarray:
    return np.where(raw < 0, -raw * feature_weight, raw * idf[nodes])


class _State:
    """Levels of all nodes: the mean of their documents, and how far they are trusted."""

    def __init__(self, idf: np.ndarray, sums: np.ndarray | None, mean: float, clamp: float) -> None:
        self.idf, self.mean, self.clamp = idf, mean, clamp
        self.other_top = 0.0  # most trust of a word in tables
        self.sums = np.zeros((len(idf), 3)) if sums is None else sums
        den = self.sums[:, 2]
        seen = den > 0
        self.words = np.where(seen, self.sums[:, 0] / np.where(seen, den, 1), mean)
        # a word whose documents agree says more
        self.spread = np.maximum(np.where(seen, self.sums[:, 1] / np.where(seen, den, 1) - self.words**2, 1.0), 0.0)
        self.trust = self.trusted(den, self.spread)

    def trusted(self, den: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Little evidence is drawn to nothing."""
        return np.where(den > 1e-9, den / (den + self.clamp), 0.0) / (0.05 + spread)

    def levels(self, batch: pd.DataFrame, feature_weight: float, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Levels of a batch's documents from their words, and how far known words back them (0 to 1).

        With ``own`` a graded document's own grade is first taken out of its words again.
        """
        nodes, raw, owner = _flat(batch)
        w = _weigh(nodes, raw, self.idf, feature_weight)
        words, trust = self.words[nodes], self.trust[nodes]
        if own:
            grade = batch["grade"].to_numpy(dtype=float)[owner]
            known = ~np.isnan(grade)
            part = np.where(known, w * self.clamp, 0.0)
            den = np.maximum(self.sums[nodes, 2] - part, 0.0)
            num = self.sums[nodes, 0] - part * np.where(known, grade, 0.0)
            words = np.where(known, np.where(den > 1e-9, num / np.where(den > 1e-9, den, 1), self.mean), words)
            trust = np.where(known, self.trusted(den, self.spread[nodes]), trust)
        num, den, all_w = (np.bincount(owner, x, len(batch)) for x in (w * trust * words, w * trust, w))
        if "num" in batch:  # answers of the words in tables
            num, den, all_w = (x + batch[k].fillna(0.0).to_numpy(dtype=float) for x, k in ((num, "num"), (den, "den"), (all_w, "all")))
        return np.where(den > 0, num / np.where(den > 0, den, 1), self.mean), den / np.where(all_w > 0, all_w, 1) / max(float(self.trust.max(initial=0.0)), self.other_top, 1e-12)


def reading_levels(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", grade: str = "grade", tolerance: float = 0.02, most_rounds: int = 20, clamp: float = 50.0, feature_weight: float = 20.0) -> DataFrame:
    """``doc_id, level, level_band, support, graded`` for every document.

    ``level`` is continuous on the scale of the grades, ``level_band`` its nearest whole grade,
    ``support`` the share of the document's edges that lead to words with evidence, ``graded``
    whether it carries a grade (then ``level`` is that grade: clamped). Documents without words
    have a null level and no support. Without any label all levels are null. Documents with the
    same id are each graded. ``clamp`` is the weight of a graded document against an ungraded
    one in a word's mean. Rounds go on until trusted nodes move by less than ``tolerance`` grades
    on average, ``most_rounds`` at most.
    """
    grades = mean_grades(labels, label_id, grade)
    known, rest = _frequent(documents, text)
    nodes = len(known) + len(FEATURES) * BINS
    edges = cut(document_nodes(documents, doc_id, text, known, rest).join(grades, "id", "left").withColumn("row", F.monotonically_increasing_id()))
    base = edges.agg(F.count("*").alias("n"), F.avg("grade").alias("mean"), F.min("grade").alias("low"), F.max("grade").alias("high")).first()
    kind = documents.schema[doc_id].dataType.simpleString()
    if base["mean"] is None:
        none = edges.select("id", F.lit(None).cast("double").alias("level"), F.lit(None).cast("int").alias("level_band"), F.lit(0.0).alias("support"), F.lit(False).alias("graded"))
        return none.withColumnRenamed("id", doc_id)
    spark = documents.sparkSession

    def frequency(batch: pd.DataFrame, total: np.ndarray) -> tuple[None, None]:
        at, _, _ = _flat(batch)
        np.add.at(total[:, 0], at, 1.0)
        return None, None

    df = _sums(edges.select("nodes", "weights"), frequency, nodes, 1)[0][:, 0]
    state = _State(np.log((base["n"] + 1) / (df + 1)) + 0.1, None, float(base["mean"]), clamp)
    columns = ["id", "nodes", "weights", "grade", "row"]
    if rest:  # rounds join what is small to documents that lie by row, so their edges move only once
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        edges = edges.select(*columns).repartition(partitions, "row").join(_other_words(edges, base["n"]).repartition(partitions, "row"), "row", "left")
        edges = edges.persist(StorageLevel.DISK_ONLY)
    scanned, others = edges.select(*columns), None
    for k in range(most_rounds):
        sent = spark.sparkContext.broadcast(state)

        def spread(batch: pd.DataFrame, total: np.ndarray, first: bool = k == 0, sent=sent) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
            state = sent.value
            at, raw, owner = _flat(batch)
            own = batch["grade"].to_numpy(dtype=float)
            clamped = ~np.isnan(own)
            if first:  # only graded documents have a level yet
                level, weight = np.where(clamped, own, 0.0), clamped * clamp
            else:
                guess, support = state.levels(batch, feature_weight)
                level, weight = np.where(clamped, own, guess), np.where(clamped, clamp, support)
            w = _weigh(at, raw, state.idf, feature_weight) * weight[owner]
            for i in range(3):  # weights, weighted levels and squares
                total[:, i] += np.bincount(at, w * level[owner] ** (1, 2, 0)[i], nodes)
            return level, weight

        sums, told = _sums(scanned, spread, nodes, 3, rest)
        new = _State(state.idf, sums, state.mean, clamp)
        moved, trusted = float((np.abs(new.words - state.words) * new.trust).sum()), float(new.trust.sum())
        if rest:
            before, others = others, _other_levels(told, edges, state.mean)
            pairs = others.withColumn("old", F.lit(state.mean)) if before is None else others.join(before.select("key", F.col("level").alias("old")), "key")
            trust = _trust(F.col("s2"), clamp)
            t = pairs.agg(F.max(trust).alias("top"), F.sum(trust).alias("trusted"), F.sum(trust * F.abs(F.col("level") - F.col("old"))).alias("moved")).first()
            moved, trusted, new.other_top = moved + t["moved"], trusted + t["trusted"], t["top"]
            scanned = edges.select(*columns).join(_other_answers(others, state.mean, clamp), "row", "left")
        state = new
        if k and moved <= tolerance * trusted:
            break
    if others is not None:
        scanned = edges.select(*columns).join(_other_answers(others, state.mean, clamp, own=True), "row", "left")
    # the mean of means is narrow: graded documents, judged without their own grade, tell how far to stretch it
    final = spark.sparkContext.broadcast(state)

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            level, support = final.value.levels(batch, feature_weight, own=True)
            empty = batch["nodes"].map(len).to_numpy() == 0
            yield pd.DataFrame({"id": batch["id"], "raw": np.where(empty, np.nan, level), "support": support, "grade": batch["grade"]})

    guessed = scanned.mapInPandas(guess, f"id {kind}, raw double, support double, grade double").withColumn("raw", F.nanvl("raw", F.lit(None).cast("double")))
    if rest:
        guessed = cut(guessed)
        edges.unpersist()
    fit = guessed.where(F.col("grade").isNotNull() & F.col("raw").isNotNull()).agg(F.avg("raw").alias("x"), F.avg("grade").alias("y"), F.stddev_pop("raw").alias("sx"), F.stddev_pop("grade").alias("sy"), F.corr("raw", "grade").alias("r")).first()
    stretch = fit["sy"] / fit["sx"] * max(fit["r"] or 0.0, 0.0) if fit["sx"] else 1.0
    x0, y0 = (fit["x"], fit["y"]) if fit["x"] is not None else (state.mean, state.mean)
    stretched = F.greatest(F.lit(base["low"]), F.least(F.lit(base["high"]), F.lit(y0) + (F.col("raw") - F.lit(x0)) * F.lit(stretch)))
    level: Column = F.coalesce(F.when(F.col("raw").isNotNull(), F.col("grade")), F.when(F.col("raw").isNotNull(), stretched))
    return guessed.select(F.col("id").alias(doc_id), level.alias("level"), F.round(level).cast("int").alias("level_band"), "support", F.col("grade").isNotNull().alias("graded"))


def level_profile(levels: DataFrame, documents: DataFrame, doc_id: str = "doc_id", by: str = "lang") -> DataFrame:
    """How many documents of each group fall into each band, with their mean level."""
    return levels.join(documents.select(doc_id, by), doc_id).groupBy(by, "level_band").agg(F.count("*").alias("n_docs"), F.round(F.avg("level"), 6).alias("mean_level"))
