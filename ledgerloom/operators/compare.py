"""Differences between two copies of one table, row by row and field by field.

Both sides are reduced to key and canonical fields, tagged, united and grouped once by key;
each group keeps one struct per side, and generated higher-order SQL compares the structs.
One shuffle; the aggregate combines before it, so a key that holds a third of all rows sends
one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: blanks, dashes and signs that differ in kind only
BLANKS = r"[\s\u0085  ᠎ -‍    ⁠　﻿]"
DASHES = "[‐‑‒–—―−﹘﹣－­]"


def canonical_code(c: Column) -> Column:
    """A code without blanks and with one kind of dash; null where nothing is left."""
    x = F.regexp_replace(F.regexp_replace(c, BLANKS, ""), DASHES, "-")
    return F.when(x != "", x)


def canonical_numbers(c: Column) -> Column:
    """The numbers of a text as a sorted list with repeats; null where it holds none.

    A comma between two digits is a decimal mark; every other character separates. Leading and
    trailing zeros don't count.
    """
    found = F.regexp_extract_all(c, F.lit(r"(?<![0-9])[-−]?[0-9]+(?:[.,][0-9]+)?"), F.lit(0))

    def one(x: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(x, ",", "."), "−", "-")
        whole = F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1")
        return F.regexp_replace(F.regexp_replace(whole, r"\.$", ""), r"^(-?)0+(?=[0-9])", "$1")

    values = F.array_sort(F.transform(found, one))
    return F.when(F.size(values) > 0, F.array_join(values, " "))


def compare_copies(main: DataFrame, copy: DataFrame, keys: Sequence[str], fields: dict[str, object], several: bool = False) -> DataFrame:
    """``keys, finding, main_value, copy_value``: what differs between two copies.

    ``fields`` maps a column name to the function that gives its canonical form (null and blank
    must both give null). ``finding`` is ``row_missing_in_main``, ``row_missing_in_copy`` or a
    field name; a missing row yields no field findings. Null keys match each other. Exact
    repeats of a row change nothing; of a key's different rows on one side the one with the
    greatest canonical struct stands for it, so the result doesn't depend on order; with
    ``several`` such keys also have a finding ``several_rows_in_main`` or ``several_rows_in_copy``
    of their own, with the least struct as value. Empty sides are allowed, further columns of
    either side are ignored.
    """
    for name in (*keys, *fields):
        if name in ("side", "finding", "main_value", "copy_value"):
            raise ValueError(f"column name {name} is taken")

    def side(df: DataFrame, tag: str) -> DataFrame:
        content = F.struct(*[make(F.col(f"`{n}`")).alias(n) for n, make in fields.items()])
        return df.select(*[F.col(f"`{k}`") for k in keys], F.lit(tag).alias("side"), content.alias("content"))

    both = side(main, "m").unionByName(side(copy, "c"))
    pair = both.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == t, F.col("content"))).alias(t) for t in "mc"], *[F.min(F.when(F.col("side") == t, F.col("content"))).alias(f"{t}_least") for t in "mc" if several])
    listed = ", ".join(f"struct('{n}' AS finding, m.`{n}` AS main_value, c.`{n}` AS copy_value)" for n in fields)
    missing = "array(struct('{}' AS finding, CAST(NULL AS string) AS main_value, CAST(NULL AS string) AS copy_value))"
    found = F.expr(
        f"CASE WHEN m IS NULL THEN {missing.format('row_missing_in_main')} WHEN c IS NULL THEN {missing.format('row_missing_in_copy')} "
        f"ELSE filter(array({listed}), d -> NOT (d.main_value <=> d.copy_value)) END"
    )
    if several:
        more = [F.when(F.col(f"{t}_least") != F.col(t), F.struct(F.lit(f"several_rows_in_{name}").alias("finding"), *[(F.to_json(f"{t}_least") if u == t else F.lit(None).cast("string")).alias(v) for u, v in (("m", "main_value"), ("c", "copy_value"))])) for t, name in (("m", "main"), ("c", "copy"))]
        found = F.concat(found, F.filter(F.array(*more), lambda d: d.isNotNull()))
    return pair.select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")
