import random

from ledgerloom.llm.leaks import SuffixAutomaton, find_leaks, normal_words, remove_leaks, without


def brute(words, items, least):
    out = {}
    for i, w in items:
        best = 0
        for a in range(len(words)):
            for b in range(len(w)):
                n = 0
                while a + n < len(words) and b + n < len(w) and words[a + n] == w[b + n]:
                    n += 1
                best = max(best, n)
        if best >= least:
            out[i] = best
    return out


def test_automaton_against_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        items = [(i, [rng.choice("abc") for _ in range(rng.randrange(12))]) for i in range(4)]
        least = rng.randrange(1, 5)
        m = SuffixAutomaton(items).compile(least)
        words = [rng.choice("abcd") for _ in range(30)]
        found = {}
        for s, n in m.states(words).items():
            for i in m.items[s]:
                found[i] = max(found.get(i, 0), n)
        want = brute(words, items, least)
        assert set(found) == set(want)
        spans = m.spans(words)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
        inside = [False] * 30
        for _, w in items:
            for a in range(30):
                for b in range(len(w)):
                    n = 0
                    while a + n < 30 and b + n < len(w) and words[a + n] == w[b + n]:
                        n += 1
                    if n >= least:
                        inside[a : a + n] = [True] * n
        assert [any(a <= i < b for a, b in spans) for i in range(30)] == inside


def test_words():
    assert normal_words("Ābols, STRASSE ß_x  12.5") == ["abols", "strasse", "ss", "x", "12", "5"]


def test_find_and_remove(spark, rows):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame(
        [(1, f"start {item.upper()} end"), (2, " ".join(f"w{i}" for i in range(11))), (3, None), (4, ""), (5, "W0, w1; w2. w3 w4 w5 w6 w7 w8 w9 w10 w11! rest " + "z " * 20_000), (5, "other")], "doc_id long, text string"
    )
    items = spark.createDataFrame([(10, item), (11, item + " more"), (12, None), (13, "short")], "item_id long, item_text string")
    assert rows(find_leaks(docs, items)) == [(1, 10, 20), (1, 11, 20), (5, 10, 12), (5, 11, 12)]
    assert rows(find_leaks(docs, items, block_chars=10)) == rows(find_leaks(docs, items))
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0
    clean = {(r["doc_id"], (r["text"] or "")[:12]) for r in remove_leaks(docs, items).collect()}
    assert (1, "start ") not in clean and all(d != 1 for d, _ in clean) and (5, "rest z z z z") in clean and (3, "") in clean


def test_removal_does_not_depend_on_the_blocks(spark, rows):
    """Items that overlap in a text are cut out whole, and coverage is judged once, however the items are cut into blocks."""
    words = [f"w{i}" for i in range(22)]
    one, two = " ".join(words[:14]), " ".join(words[8:])
    docs = [(1, "Sākums: " + " ".join(words) + ". Beigas " + "x " * 40), (2, " ".join(words) + " y z"), (3, "A\u0304bols " + one.upper() + "; rest " + "x " * 40), (4, None), (5, "...")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_text", docs_clash())
    items = spark.createDataFrame([(1, one), (2, two), *((k, f"other item {k} " * 6) for k in range(3, 9))], "item_id long, item_text string")
    results = [rows(remove_leaks(docs, items, block_chars=n)) for n in (400_000, 60, 1)]
    assert results[0] == results[1] == results[2]
    kept = {r[0]: (r[1], round(r[3], 4)) for r in results[0]}
    assert kept[1] == ("Sākums: Beigas " + "x " * 40, round(22 / 64, 4)) and 2 not in kept
    assert kept[3] == ("A\u0304bols rest " + "x " * 40, round(14 / 56, 4)) and kept[4] == (None, 0.0) and kept[5] == ("...", 0.0)


def test_without():
    assert without("a, b. C d!", [(1, 3)]) == ("a, d!", 0.5) and without("a b", [(0, 2)]) == ("", 1.0) and without("", []) == ("", 0.0)


def docs_clash():
    from pyspark.sql import functions as F

    return F.lit("clash")
