"""Records that are equal but for their writing, collapsed into one with a count of copies.

Byte-identical rows are collapsed first, so only distinct raw texts are parsed and
canonicalised; these are grouped again on the full canonical text and their counts summed. Both
groupings combine before their shuffle: a record that holds a third of all rows sends one row a
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import hot_join
from ledgerloom.session import cut

EVIDENCE_FIELDS = ("phase", "name", "text")


def letters_and_digits(c: Column) -> Column:
    """Lower case, without everything that is no letter, combining accent or digit; '' for null."""
    return F.coalesce(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", ""), F.lit(""))


def canonical_record(raw: Column, fields: tuple[str, ...] = EVIDENCE_FIELDS) -> Column:
    """One canonical text of a JSON record: the fields in fixed order, reduced to letters and digits.

    Absent and null fields are empty. A text that is no JSON object is reduced as a whole and
    is never equal to a parsed one.
    """
    schema = ", ".join(f"`{f}` string" for f in (*fields, "_bad"))
    parsed = F.from_json(raw, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})

    def write(p: Column) -> Column:
        whole = F.concat_ws("\u0001", *[letters_and_digits(p[f]) for f in fields])
        return F.when(p.isNull() | p["_bad"].isNotNull(), F.concat(F.lit("\u0002"), letters_and_digits(raw))).otherwise(whole)

    return F.transform(F.array(parsed), write)[0]


def collapse_raw(df: DataFrame, record_id: str, raw: str) -> DataFrame:
    """Distinct raw texts: ``raw, raw_key, raw_first, raw_copies``. Null texts are no records."""
    rows = df.select(F.col(f"`{record_id}`").alias("id"), F.col(f"`{raw}`").alias("raw")).where(F.col("raw").isNotNull())
    found = rows.groupBy("raw").agg(F.min("id").alias("raw_first"), F.count("*").alias("raw_copies"))
    return found.withColumn("raw_key", F.unhex(F.md5("raw")))


def collapse_records(df: DataFrame, record_id: str, raw: str, fields: tuple[str, ...] = EVIDENCE_FIELDS) -> DataFrame:
    """``canonical, first_id, copies``: every record once, with its number of copies.

    ``first_id`` is the smallest id among the copies. Empty texts are records without content
    and copies of each other; an empty table gives none; further columns don't matter.
    """
    raws = collapse_raw(df, record_id, raw).withColumn("canonical", canonical_record(F.col("raw"), fields))
    return raws.groupBy("canonical").agg(F.min("raw_first").alias("first_id"), F.sum("raw_copies").alias("copies"))


def copy_members(df: DataFrame, record_id: str, raw: str, fields: tuple[str, ...] = EVIDENCE_FIELDS) -> DataFrame:
    """``first_id, id``: each record that has an earlier copy, with the smallest id of its copies.

    Ids are taken as unique; a repeated id with equal content counts as one record. Grouping is
    on whole texts; the two joins that lead back from groups to rows carry 16-byte digests and
    ids only, leave out whatever has no copy, and send hot keys by a broadcast of bounded size.
    """
    raws = collapse_raw(df, record_id, raw).select("raw_key", "raw_first", "raw_copies", canonical_record(F.col("raw"), fields).alias("canonical"))
    raws = cut(raws)
    size = raws.agg(F.count("*").alias("raws"), F.coalesce(F.sum("raw_copies"), F.lit(0)).alias("rows")).first()
    groups = raws.groupBy("canonical").agg(F.min("raw_first").alias("first_id"), F.count("*").alias("n_raws"), F.sum("raw_copies").alias("copies"))
    groups = cut(groups.where("copies > 1").select(F.unhex(F.md5("canonical")).alias("group_key"), "first_id", "n_raws"))
    keyed = raws.select(F.unhex(F.md5("canonical")).alias("group_key"), "raw_key", "raw_first", "raw_copies")
    mapped = cut(hot_join(keyed, groups, "group_key", "n_raws", size["raws"]).drop("group_key"))
    heads = mapped.where("raw_first > first_id").select("first_id", F.col("raw_first").alias("id"))
    several = mapped.where("raw_copies > 1").select("raw_key", "first_id", "raw_first", "raw_copies")
    rows = df.select(F.col(f"`{record_id}`").alias("id"), F.unhex(F.md5(F.col(f"`{raw}`"))).alias("raw_key")).where(F.col("raw_key").isNotNull())
    further = hot_join(rows, several, "raw_key", "raw_copies", size["rows"]).where("id > raw_first")
    return heads.unionByName(further.select("first_id", "id"))
