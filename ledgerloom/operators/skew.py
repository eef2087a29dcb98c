"""Joins that no single key can overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.001


def hot_join(large: DataFrame, small: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join on ``key``, which is unique in ``small``; ``weight`` says how many rows of ``large`` have it.

    Hot keys are joined by broadcast: as weights add up to at most ``total``, there are at most
    1 / HOT_SHARE of them. All other keys are joined by shuffle, each with less than HOT_SHARE
    of the rows. Null keys match nothing; a left join keeps them. ``small`` should be cheap to
    read twice.
    """
    floor = max(1.0, total * HOT_SHARE)
    hot = small.where(F.col(weight) >= floor).drop(weight)
    rest = small.where(F.col(weight) < floor).drop(weight)
    if hot.isEmpty():
        return large.join(rest.hint("merge"), key, how)
    cold = large.join(F.broadcast(hot.select(key)), key, "left_anti")
    return large.join(F.broadcast(hot), key).unionByName(cold.join(rest.hint("merge"), key, how))


def skew_rank(df: DataFrame, keys: list[str], order: str, buckets: int = 64) -> DataFrame:
    """``df`` plus ``rank`` (from 1, by ``order`` within ``keys``) and ``group_size``; no group meets one task.

    ``order`` is a number without nulls, unique within its group. Its range is cut at global
    quantiles into buckets that all groups share; a rank is the rows of lower buckets plus the
    rank inside the own one.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.001)))
    bucket = sum(((F.col(order) > c).cast("int") for c in cuts), F.lit(0)) if cuts else F.lit(0)
    placed = df.withColumn("_bucket", bucket)
    names = ", ".join(f"`{k}`" for k in keys)
    sizes = placed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.selectExpr("*", f"sum(_n) OVER (PARTITION BY {names} ORDER BY _bucket) - _n AS _before", f"sum(_n) OVER (PARTITION BY {names}) AS group_size")
    ranked = placed.selectExpr("*", f"row_number() OVER (PARTITION BY {names}, _bucket ORDER BY `{order}`) AS _own")
    same = [ranked[k].eqNullSafe(sizes[k]) for k in keys] + [ranked["_bucket"] == sizes["_bucket"]]
    joined = ranked.join(sizes, same)
    return joined.select(*[ranked[c] for c in df.columns], (F.col("_own") + F.col("_before")).alias("rank"), "group_size")
