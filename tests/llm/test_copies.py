import json
import random

from pyspark.sql import functions as F

from ledgerloom.llm.copies import canonical_record, collapse_records, copy_members


def key(raw):
    try:
        j = json.loads(raw)
        if not isinstance(j, dict):
            raise ValueError
    except ValueError:
        return ("?", "".join(c for c in raw.lower() if c.isalnum()))
    return tuple("".join(c for c in (j.get(f) or "").lower() if c.isalnum()) for f in ("phase", "name", "text"))


def test_against_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(600):
        rec = {"phase": rng.choice(["award", "Award", "AWARD "]), "name": rng.choice(["ISO 1", "iso-1", "ISO 2"]), "text": rng.choice(["Ābols ir, labs.", "ābols IR labs", "abols ir labs", "x" * 5])}
        items = list(rec.items())
        rng.shuffle(items)
        rows.append((i, json.dumps(dict(items), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])), i, "x"))
    rows += [(1000 + i, '{"phase":"a"}', 0, "hot") for i in range(400)]
    rows += [(2000, None, 0, ""), (2001, None, 0, ""), (2002, "", 0, ""), (2003, "not json!", 0, ""), (2004, "NOT JSON", 0, ""), (2005, "{" + "y" * 100_000, 0, ""), (2006, '{"phase":null,"name":"","text":"-"}', 0, ""), (2007, "{}", 0, ""), (2008, "[1]", 0, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "evidence_id long, evidence string, id long, raw string")
    first, pairs, sizes = {}, set(), {}
    for i, raw, *_ in sorted(rows, key=lambda r: r[0]):
        if raw is None:
            continue
        k = key(raw)
        sizes[k] = sizes.get(k, 0) + 1
        if k in first:
            pairs.add((first[k], i))
        else:
            first[k] = i
    assert {tuple(r) for r in copy_members(df, "evidence_id", "evidence").select("first_id", "id").collect()} == pairs
    assert {(r["first_id"], r["copies"]) for r in collapse_records(df, "evidence_id", "evidence").collect()} == {(first[k], n) for k, n in sizes.items()}
    assert copy_members(df.limit(0), "evidence_id", "evidence").count() == 0 and collapse_records(df.limit(0), "evidence_id", "evidence").count() == 0


def test_field_borders(spark):
    df = spark.createDataFrame([('{"phase":"ab","name":"c"}',), ('{"phase":"a","name":"bc"}',)], "e string")
    assert df.select(canonical_record(F.col("e"))).distinct().count() == 2
