import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import reconcile, runs, scoring, spans
from ledgerloom.operators.contain import contained
from ledgerloom.operators.skew import hot_join, skew_rank
from ledgerloom.plans.reference import line_context_passages


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def one(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_text_functions(spark):
    assert one(col(spark, ["ĀžŪ", None, ""]), T.fold(F.col("x"))) == ["azu", None, ""]
    assert one(col(spark, [" a \n b ", None]), T.collapse(F.col("x"))) == ["a b", None]
    assert one(col(spark, ["12345678-9", "12345678‑9", "1234567-9", "", None, "x12345678-9"]), T.is_code(F.col("x"))) == [True, True, False, False, False, False]
    assert one(col(spark, ["a 12345678-9 b 123456789-1 12345678–0"]), T.codes_in(F.col("x"))) == [["12345678-9", "12345678–0"]]
    assert one(col(spark, [None, "", "null", "Lot 02", " 3.", "4. daļa", "A2", "Lot 1 and 2"]), T.lot_key(F.col("x"))) == ["all", "all", "all", "2", "3", "4", "a2", "lot 1 and 2"]
    prose = {"iepirkuma 2. daļā": "2", "lots 3": "3", "2. daļai": "2", "nr. 5": "nr. 5", "part 7": "part 7", "daļa A2": "daļa a2", "007": "7", "lot_3": "lot_3", "1. un 2. daļa": "1. un 2. daļa", "3..": "3", "NULL": "all", "lot 0": "0"}
    assert one(col(spark, list(prose)), T.lot_key(F.col("x"))) == list(prose.values())
    assert one(col(spark, ["0,5;1,5;2.5", "50 out of 100", "x", None]), T.whole_weights(F.col("x"))) == [[0, 2, 2], [50], [], []]
    assert one(col(spark, ["a漢字b", None]), T.strip_cjk(F.col("x"))) == ["a b", None]
    assert one(col(spark, ["https://x/Procurement/123", "https://x/Other/1", None]), T.url_number(F.col("x"))) == ["123", None, None]
    assert [len(x) for x in one(col(spark, ["n" * 500, "short"]), T.elide(F.col("x")))] == [240, 5]


@pytest.mark.parametrize(("text", "weights"), [(None, []), ("30,5", [30.5]), ("50 points out of 100", [50.0]), ("150 out of 100", []), ("-10", []), ("30; 70 | 5", [30.0, 70.0, 5.0]), ("30 %", [30.0]), ("about 30", []), ("", []), ("− 5", []), ("50 point out  of 100", [50.0]), ("50 out of 100 points", []), ("+5 | 7,25%", [5.0, 7.25]), ("30;;", []), ("5 out of 0", []), ("1e3", []), ("30 % / 70 %", [30.0, 70.0])])
def test_parse_weights(spark, text, weights):
    assert one(col(spark, [text]), T.parse_weights(F.col("x"))) == [weights]


def test_clean_codes_and_sample(spark):
    df = spark.createDataFrame([("1", ["12345678-9", "bad", "12345678-9"]), ("12345678-9", ["12345678-9", "22345678-9"]), (None, None)], "m string, a array<string>")
    assert [tuple(r[0]) for r in df.select(T.clean_codes(F.col("m"), F.col("a"))).collect()] == [("", ["12345678-9"]), ("12345678-9", ["22345678-9"]), ("", [])]
    seven = spark.createDataFrame([(list(range(7)),)], "x array<int>")
    assert one(seven, T.even_sample(F.col("x"), 4)) == [[0, 2, 4, 6]]
    assert one(seven, T.even_sample(F.col("x"), 1)) == [[0]] and one(seven, T.even_sample(F.col("x"), 0)) == [[]] and one(seven, T.even_sample(F.col("x"), 9)) == [list(range(7))]


def test_spans_round_trip(spark):
    text = "x 12345678-9ā 22222222-2 12345678-9"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "none")], "id int, t string")
    got = spans.spans_of(df, ["id"], "t", "[0-9]{8}-[0-9]").collect()
    assert [(r["hit"], text[r["start"] : r["stop"]]) for r in got] == [(h, h) for h in ("12345678-9", "22222222-2", "12345678-9")]
    cand = spans.pattern_candidates(df, ["id"], ["id"], "t", "[0-9]{8}-[0-9]", 2).collect()
    assert [(r["code"], r["n_hits"], r["first_context"]) for r in sorted(cand, key=lambda r: r["rank"])] == [("12345678-9", 2, "x 12345678-9ā "), ("22222222-2", 1, "ā 22222222-2 1")]


def test_sections_chunks_windows(spark, rows):
    df = spark.createDataFrame([(1, "intro\n1. A\nx\n\n2. B\ny"), (2, None)], "id int, t string")
    s = rows(spans.sections(df, ["id"], "t", r"^[0-9]+\. "), "section", "heading", "n_lines", "n_chars")
    assert s == [(0, None, 1, 5), (1, "1. A", 3, 5), (2, "2. B", 2, 5)]
    top = spark.createDataFrame([(1, "1. A\nx"), (2, ""), (3, "no heading\n")], "id int, t string")
    assert rows(spans.sections(top, ["id"], "t", r"^[0-9]+\. "), "id", "section", "n_lines") == [(1, 1, 2), (2, 0, 1), (3, 0, 2)]
    assert rows(spans.labelled_hits(df, ["id"], "t", "[xy]", r"^[0-9]+\. "), "line_no", "phase") == [(2, "1. A"), (5, "2. B")]
    sizes = spark.createDataFrame([(1, "\n".join("a" * n for n in [3, 3, 9, 1, 20])), (2, ""), (3, None)], "id int, t string")
    assert rows(spans.line_chunks(sizes, ["id"], "t", 10)) == [(1, 1, 0, 1), (1, 2, 2, 2), (1, 3, 3, 3), (1, 4, 4, 4), (2, 1, 0, 0)]
    units = spark.createDataFrame([(1, i, "a" * n) for i, n in enumerate([3, 3, 9, 1, 20])], "id int, i int, t string")
    assert [r[2] for r in rows(spans.greedy_chunks(units, ["id"], "i", "t", 10))] == [1, 1, 2, 3, 4]
    packed = spans.budget_pack(units.withColumn("n", F.length("t")), ["id"], ["i"], "n", 8)
    assert [r[2] for r in rows(packed)] == [True, True, False, True, False]
    lines = spark.createDataFrame([(1, "\n".join(["a", "hit", "b", "c", "d", "e", "hit"]))], "id int, t string")
    w = rows(spans.line_windows(lines, ["id"], "t", "hit", 1, 1), "first_line", "last_line", "passage")
    assert w == [(0, 2, "a\nhit\nb"), (5, 6, "e\nhit")]
    assert spans.line_windows(lines, ["id"], "t", "hit", 1, 1, longest=3).count() == 0


def test_long_passages_stay(spark, rows, tmp_path):
    near = "\n".join(["a", "b", "CPV x", *(f"line {i}" for i in range(60))])
    long = "\n".join(["CPV"] + ["y" * 500] * 30)
    spark.createDataFrame([(1, "e", near), (2, "e", long), (3, "e", None)], "doc_id long, eis_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(line_context_passages(spark, str(tmp_path)), "doc_id", "passage_no", "first_line", "last_line", "oversized")
    assert got == [(1, 1, 1, 42, False), (2, 1, 0, 30, True)]


def test_overlap_anti(spark, rows):
    df = spark.createDataFrame([(1, "12345678-9 77 x12"), (2, None), (3, "")], "id int, t string")
    assert rows(spans.overlap_anti(df, ["id"], "t", "[0-9]{2,}", "[0-9]{8}-[0-9]")) == [(1, "12", 15, 17), (1, "77", 11, 13)]


def test_positions_of_many_hits(spark):
    text = "ab " * 3000 + "ab"
    got = spark.createDataFrame([(text,)], "t string").select(spans.find_spans(F.col("t"), "b").alias("s")).first()["s"]
    assert [x["start"] for x in got] == [i for i, c in enumerate(text) if c == "b"]


def test_stems_that_share_a_beginning(spark, rows):
    df = spark.createDataFrame([(1, "Price list, priced; list"), (2, None), (3, "x")], "id int, t string")
    assert rows(spans.folded_hits(df, ["id"], "t", {"p": "price", "pl": "price list", "l": "list"})) == [(1, "l", 2), (1, "p", 2), (1, "pl", 1)]


def test_scoring(spark, rows):
    pairs = spark.createDataFrame([("A", "A"), ("B", "A"), (None, "A"), ("A", None), (None, None)], "p string, g string")
    assert [tuple(r[0]) for r in pairs.select(scoring.scalar_tally(F.col("p"), F.col("g"))).collect()] == [(1, 0, 0), (0, 1, 1), (0, 0, 1), (0, 1, 0), (0, 0, 0)]
    bag = spark.createDataFrame([(1, v, s) for s, vs in ((True, [30, 30, 40]), (False, [30, 40, 40])) for v in vs], "k int, v int, s boolean")
    tally = scoring.multiset_tally(bag, ["k"], F.col("v"), F.col("s"))
    assert rows(tally) == [(1, 2, 1, 1)]
    assert scoring.pooled(tally, ["k"]).first()["precision"] == pytest.approx(2 / 3)
    zero = spark.createDataFrame([(0, 0, 0)], "tp int, fp int, fn int")
    assert tuple(zero.select(*scoring.prf(F.col("tp"), F.col("fp"), F.col("fn"))).first()) == (0.0, 0.0, 0.0)
    assert scoring.averaged(tally.limit(0), []).first()["macro_f1"] is None


def test_tolerance_match_is_optimal(spark):
    rng, cases = random.Random(4), []
    for _ in range(200):
        cases.append((sorted(rng.randrange(40) for _ in range(rng.randrange(7))), sorted(rng.randrange(40) for _ in range(rng.randrange(7)))))
    df = spark.createDataFrame(cases, "p array<int>, g array<int>")

    def best(p, g):
        n, i = 0, 0
        for y in g:
            while i < len(p) and p[i] < y - 2:
                i += 1
            if i < len(p) and abs(p[i] - y) <= 2:
                n, i = n + 1, i + 1
        return n

    assert [r[0] for r in df.select(scoring.tolerance_match(F.col("p"), F.col("g"), 2)).collect()] == [best(*c) for c in cases]


def test_lot_status(spark):
    data = [("ok", 60.0, "points"), ("ok", 40.0, "points"), ("off", 30.0, "points"), ("off", 40.0, "points"), ("gap", 100.0, "points"), ("gap", None, "points"), ("sole", None, "unknown"), ("half", 50.0, "points"), ("thirds", 33.33, "points"), ("thirds", 33.33, "points"), ("thirds", 33.33, "points"), ("frac", 0.4, "fraction"), ("frac", 0.6, "fraction"), ("what", 5.0, "unknown"), ("what", 95.0, "unknown")]
    df = spark.createDataFrame(data, "k string, w double, s string")
    got = {r["k"]: (r["status"], r["total"]) for r in reconcile.lot_status(df, ["k"], "w", F.col("s"), F.lit(False)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"ok": "reconciled", "off": "total_mismatch", "gap": "missing_weights", "sole": "reconciled", "half": "total_mismatch", "thirds": "reconciled", "frac": "reconciled", "what": "unknown_scale"}
    assert got["sole"][1] == Decimal(100)
    assert {r["status"] for r in reconcile.lot_status(df, ["k"], "w", F.col("s"), F.lit(True)).collect()} == {"unresolved"}


def test_reference_and_record_status(spark):
    df = spark.createDataFrame([([],), ([None],), ([1.0],), ([33.33] * 3,), ([99.5],), ([99.49],), (None,)], "x array<double>")
    assert one(df, reconcile.reference_status(F.col("x"))) == ["missing", "incomplete", "total_mismatch", "available", "available", "total_mismatch", "missing"]


def test_merge_and_scope(spark, rows):
    df = spark.createDataFrame([("1", " Cena ", 5.0, ["a", "b"]), ("1", "cena", 5.0, ["b", "c"]), ("1", "cena", None, None), ("1", "x", 5.0, [])], "lot string, name string, w double, ids array<string>")
    got = {(r["name_key"], r["w"]): (r["n_rows"], r["evidence"]) for r in reconcile.merge_exact(df, ["lot"], "name", "w", "ids").collect()}
    assert got == {("cena", 5.0): (2, ["a", "b", "c"]), ("cena", None): (1, []), ("x", 5.0): (1, [])}
    s = spark.createDataFrame([(1, "1 and 2"), (2, "1"), (2, None), (3, None), (3, "null"), (4, "1"), (4, "2")], "k int, lot string")
    declared = spark.createDataFrame([(3, "Lot 1"), (3, "2"), (4, "1-3"), (5, "9")], "k int, lot string")
    assert rows(reconcile.scope_problem(s, "k", "lot", F.lit(False))) == [(1, "multiple_numbers"), (2, "mixed"), (3, None), (4, None)]
    assert rows(reconcile.scope_problem(s, "k", "lot", F.lit(False), declared)) == [(1, "multiple_numbers"), (2, "mixed"), (3, "several_unlabelled"), (4, "multiple_numbers")]
    assert rows(reconcile.scope_problem(s, "k", "lot", F.lit(True), declared)) == [(1, "multiple_numbers"), (2, "shared_but_labelled"), (3, None), (4, "multiple_numbers")]


def test_runs(spark, rows):
    v = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 2, True), ("c", 1, None)], "k string, n int, ok boolean")
    assert rows(runs.first_last_change(v, ["k"], ["n"], F.col("ok")), "k", "change") == [("a", "worsened"), ("b", "improved")]
    a = spark.createDataFrame([(1, "x", None), (2, "x", "y")], "k int, f string, g string")
    b = spark.createDataFrame([(1, "x", None), (2, "z", None)], "k int, f string, g string")
    assert rows(runs.run_diff(a, b, ["k"], ["f", "g"])) == [(1, "", 0), (2, "f,g", 2)]
    p = spark.createDataFrame([("s", "m1", "yes"), ("s", "m2", "no"), ("t", "m1", "yes")], "r string, c string, v string")
    assert rows(runs.verdict_pivot(p, "r", "c", F.col("v"), ["m1", "m2"])) == [("s", "yes", "no", None), ("t", "yes", "-", True)]
    t = spark.createDataFrame([("p", ["2", "4"]), ("q", []), ("r", None)], "k string, labels array<string>")
    assert rows(runs.task_plan(t, "k", "labels")) == [("p", 1, "2", False), ("p", 2, "4", False), ("q", 1, None, True), ("r", 1, None, True)]
    inv = spark.createDataFrame([("divided", 2, ["1", " 1"], None), ("no", None, ["1"], None), ("divided", 1, ["1", "2"], None), ("divided", 3, ["1"], True), ("divided", None, ["1"], True), ("divided", 2, ["1", "2"], True)], "d string, n int, l array<string>, c boolean")
    assert one(inv, runs.lot_inventory_problem(F.col("d"), F.col("n"), F.col("l"), F.col("c"))) == ["empty_or_duplicate_label", "inventory_without_division", "more_labels_than_count", "complete_but_unequal", "complete_without_count", None]


def fold(actions):
    s = {"state": "new", "proposal": None, "verdict": None, "edited": False, "pauses": 0}
    from ledgerloom.streaming.state import step_review

    for a, v in actions:
        s = step_review(s, a, v)
    return s["state"], s["verdict"], s["pauses"]


def test_review_fold_matches_brute_force(spark):
    rng = random.Random(3)
    events, expect = [], {}
    for k in range(40):
        acts = [(rng.choice(["start", "pause", "propose", "approve", "edit", "reject"]), str(rng.randrange(9))) for _ in range(rng.randrange(1, 12))]
        events += [(k, i, a, v) for i, (a, v) in enumerate(acts)]
        expect[k] = fold(acts)
    rng.shuffle(events)
    got = runs.fold_session(spark.createDataFrame(events, "k int, i int, a string, v string"), ["k"], "i", "a", "v")
    assert {r["k"]: (r["state"], r["verdict"], r["pauses"]) for r in got.collect()} == expect


def test_skew_tools(spark, rows):
    big = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(3000)] + [(None, -1)], "k string, i long")
    ranked = skew_rank(big, ["k"], "i", buckets=7).toPandas()
    want = big.toPandas().assign(r=lambda d: d.groupby("k", dropna=False)["i"].rank().astype(int))
    assert dict(zip(ranked["i"], ranked["rank"], strict=True)) == dict(zip(want["i"], want["r"], strict=True))
    small = big.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("w"), F.min("i").alias("m"))
    assert hot_join(big, small, "k", "w", 3001).count() == 3000
    assert hot_join(big, small, "k", "w", 3001, "left").count() == 3001
    assert hot_join(big, small.limit(0), "k", "w", 3001).count() == 0


def test_contained(spark, rows):
    t = spark.createDataFrame([(1, "abcabc"), (2, None), (3, "")], "id long, t string")
    n = spark.createDataFrame([(1, "bc"), (2, "ca"), (3, "x"), (4, ""), (5, None), (6, "bc")], "nid long, n string")
    assert rows(contained(t, n, "id", "t", "nid", "n", block=2)) == [(1, 1), (1, 2), (1, 6)]
    assert contained(t, n.limit(0), "id", "t", "nid", "n").count() == 0
