from pyspark.sql import functions as F

from ledgerloom.operators.compare import canonical_code, canonical_numbers, compare_copies

FIELDS = {"code": canonical_code, "weights": canonical_numbers}
SCHEMA = "k string, r int, code string, weights string, m string, c string"


def test_canonical(spark):
    df = spark.createDataFrame([(" 12345678 – 9\n", "30,50; 7 %|30.5"), ("12345678-9", "7/30.5 30,5"), (None, None), ("  ", " "), ("\u00a0", "x" * 50_000)], "a string, b string")
    out = df.select(canonical_code(F.col("a")), canonical_numbers(F.col("b"))).collect()
    assert out[0] == out[1] and out[2] == out[3] == out[4] == (None, None)
    assert spark.createDataFrame([("007,10 0 0.0 100",)], "b string").select(canonical_numbers(F.col("b"))).first()[0] == "0 0 100 7.1"


def test_findings(spark, rows):
    main = spark.createDataFrame([("a", 1, "1-1", "1;2", "x", "y"), ("a", 1, "1-1", "1;2", "z", "y"), ("b", 1, None, "5", "", ""), ("d", 1, "7-7", "1 1", "", ""), (None, None, "1", "1", "", "")], SCHEMA)
    copy = spark.createDataFrame([("a", 1, "1 – 1", "2|1", "x", "y"), ("c", 1, "x", "", "", ""), ("d", 1, "7-8", "1", "", ""), (None, None, "1", "1", "", "")], SCHEMA)
    got = rows(compare_copies(main, copy, ["k", "r"], FIELDS), "k", "finding")
    assert got == [("b", "row_missing_in_copy"), ("c", "row_missing_in_main"), ("d", "code"), ("d", "weights")]
    double = main.unionByName(spark.createDataFrame([("b", 1, None, "6", "", "")], SCHEMA))
    assert ("b", "several_rows_in_main") in rows(compare_copies(double, copy, ["k", "r"], FIELDS, several=True), "k", "finding") and rows(compare_copies(main, copy, ["k", "r"], FIELDS, several=True), "k", "finding") == got
    empty = main.limit(0)
    assert compare_copies(empty, empty, ["k", "r"], FIELDS).count() == 0
    assert {r["finding"] for r in compare_copies(empty, copy, ["k", "r"], FIELDS).collect()} == {"row_missing_in_main"}


def test_one_exchange(spark):
    df = spark.createDataFrame([("a", 1, "1-1", "1;2", "x", "y")], SCHEMA)
    plan = compare_copies(df, df, ["k", "r"], FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
