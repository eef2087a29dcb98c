"""Agreement of extracted and true values: tallies, precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_tally(pred: Column, gold: Column) -> Column:
    """Struct ``tp, fp, fn`` of one value against one; null is absent."""
    same = pred.eqNullSafe(gold)
    tp = F.when(pred.isNotNull() & gold.isNotNull() & same, 1).otherwise(0)
    fp = F.when(pred.isNotNull() & ~same, 1).otherwise(0)
    fn = F.when(gold.isNotNull() & ~same, 1).otherwise(0)
    return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Columns precision, recall and f1, all zero-safe."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def multiset_tally(rows: DataFrame, keys: list[str], value: Column, is_pred: Column) -> DataFrame:
    """``keys, tp, fp, fn`` of two bags of values: per value the smaller count matches.

    One aggregate over both sides at once; a value that fills a third of the rows combines early.
    """
    n_pred, n_gold = F.count(F.when(is_pred, 1)), F.count(F.when(~is_pred, 1))
    per = rows.groupBy(*keys, value.alias("_value")).agg(n_pred.alias("p"), n_gold.alias("g"))
    both = F.sum(F.least("p", "g"))
    return per.groupBy(*keys).agg(both.alias("tp"), (F.sum("p") - both).alias("fp"), (F.sum("g") - both).alias("fn"))


def set_f1(a: Column, b: Column) -> Column:
    """2 |a and b| / (|a| + |b|) of two lists taken as sets; 0 when both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return ratio(2 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y))


def tolerance_match(pred: Column, gold: Column, tolerance: float) -> Column:
    """How many values of two sorted arrays can be paired one to one within a tolerance.

    Greedy from the smallest, which is optimal on a line. Both arrays hold exact numbers
    (integers or decimals) in ascending order; null arrays match nothing.
    """

    def step(state: Column, g: Column) -> Column:
        first = F.greatest(state["i"], F.size(F.filter(pred, lambda y: y < g - F.lit(tolerance))))
        y = F.get(pred, first)
        hit = F.coalesce(F.abs(y - g) <= F.lit(tolerance), F.lit(False))
        return F.struct(F.when(hit, first + 1).otherwise(first).alias("i"), (state["n"] + hit.cast("int")).alias("n"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"))
    return F.when(pred.isNull() | gold.isNull(), F.lit(0)).otherwise(F.aggregate(gold, zero, step)["n"])


def pooled(tallies: DataFrame, by: list[str]) -> DataFrame:
    """Micro averages: tallies added up by group, then rated."""
    s = tallies.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return s.select(*by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def averaged(tallies: DataFrame, by: list[str]) -> DataFrame:
    """Macro averages over the rows of ``tallies``; no rows give null measures."""
    rated = tallies.select(*by, *prf(F.col("tp"), F.col("fp"), F.col("fn")))
    return rated.groupBy(*by).agg(F.count("*").alias("records"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
