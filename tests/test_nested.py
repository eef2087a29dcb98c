import json
import random

import pytest

from ledgerloom.operators.nested import PROCUREMENT, STEP, Levels, criterion_positions, group_paths, json_events, path_tables, procurement_tables, read_triples, triples
from ledgerloom.plans.problems import queries


@pytest.mark.parametrize("bad", ["", "{", '{"a":1,}', "[1,]", "nul", '{"a" 1}', "1 2", '{"a":NaN}', "[1", '"a', "01", '{"a":"\n"}', "[1 2]"])
def test_invalid_json(bad):
    with pytest.raises(ValueError):
        list(json_events(bad))


def _random(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 5)
    if kind == 5:
        return [_random(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 6:
        return {rng.choice("abcd") + str(i): _random(rng, depth + 1) for i in range(rng.randrange(4))}
    return [None, True, rng.randrange(100), 'x"\\ā\n', 1.5][kind]


def test_events_rebuild_the_value():
    rng = random.Random(1)
    for _ in range(300):
        value = _random(rng)
        stack, root = [], []
        for kind, step, v in json_events(json.dumps(value, indent=rng.choice([None, 1]))):
            if kind == "close":
                stack.pop()
                continue
            new = v if kind == "leaf" else {} if v == "object" else []
            if stack and isinstance(stack[-1], dict):
                stack[-1][step] = new
            elif stack:
                stack[-1].append(new)
            else:
                root.append(new)
            if kind == "open":
                stack.append(new)
        text = lambda x: {k: text(y) for k, y in x.items()} if isinstance(x, dict) else [text(y) for y in x] if isinstance(x, list) else None if x is None else str(x).lower() if isinstance(x, bool) else x if isinstance(x, str) else str(x)
        assert root[0] == text(value)


def short(text, levels=Levels()):
    return [(".".join(p), o, k, v) for p, o, k, v, _ in triples(text, levels) if k != "entry"]


def test_deep_nesting_and_triples():
    assert sum(1 for _ in json_events("[" * 50_000 + "]" * 50_000)) == 100_000
    assert short('{"a":[{"b":1},{"b":[2,3]}]}') == [("a", (0,), "list", None), ("a.b", (1, 1), "value", "1"), ("a.b", (2, 0), "list", None), ("a.b", (2, 1), "value", "2"), ("a.b", (2, 2), "value", "3")]
    assert short('{"a":["x",""," ",null,"y"],"b":null,"c":""}') == [("a", (0,), "list", None), ("a", (1,), "value", "x"), ("a", (0,), "value", ""), ("a", (0,), "value", " "), ("a", (2,), "value", "y"), ("c", (0,), "value", "")]
    with pytest.raises(ValueError):
        list(triples('{"a":1'))


def test_groups_come_from_the_paths():
    j = lambda *keys: STEP.join(keys)
    seen = [("", "entry"), (j("a", "b"), "list"), (j("a", "b", "c"), "value"), (j("a", "d"), "value"), (j("x", "lots", "t", "u"), "value")]
    groups = {p.replace(STEP, "."): (g.keys, g.places, g.column) for p, g in group_paths(seen, Levels(("lots",))).items()}
    assert groups == {"": ((), (), ""), "a.b": (("b",), (1,), ""), "a.b.c": (("b",), (1,), "c"), "a.d": ((), (), "a.d"), "x.lots.t.u": (("lots",), (1,), "t.u")}


def positions(spark, bodies):
    df = spark.createDataFrame([(i, json.dumps(b) if not isinstance(b, str) else b) for i, b in enumerate(bodies)], "record_id long, body string")
    out = {i: [] for i in range(len(bodies))}
    for r in criterion_positions(df).collect():
        out[r["record_id"]].append(tuple(r)[1:])
    return {i: sorted(v) for i, v in out.items()}


def test_wrappings(spark):
    lots = [{"criterion": {"winnerCriterionName": "A", "subCriterion": [{"x": 1}, {"x": 2}]}}, {}, {"criterion": []}]
    want = [(1, 1, 0), (1, 1, 1), (1, 1, 2), (2, 0, 0), (3, 0, 0)]
    forms = [{"lots": lots}, {"tenderingProcess": {"lots": {"lot": lots}}}, {"lots": json.dumps(lots)}, {"lots": json.dumps({"lot": lots})}, {"lots": [lots[0], None, [lots[1]], lots[2]]}, {"lots": lots[:1], "tenderingProcess": {"lots": lots[1:]}}]
    got = positions(spark, [*forms, {"lots": None}, {"lots": []}, {}, "[]", "5", "{", "", {"lots": {}}, {"lots": ["x", " "]}, {"lots": {"lot": {"criterion": {}}}}, {"lots": {"criterion": {"subCriterion": {"subCriterion": [{}, {}]}}}}])
    assert all(got[i] == want for i in range(len(forms)))
    assert [got[i] for i in range(6, 17)] == [[(0, 0, 0)]] * 5 + [[], [], [(1, 0, 0)], [(1, 0, 0)], [(1, 1, 0)], [(1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 1, 3)]]


def test_tables(spark, rows):
    bodies = [(1, '{"cpvType":"c","lots":[{"title":"t","criterion":[{"winnerCriterionName":"n","subCriterion":{"winnerCriterionName":"s"}}]},{}]}', "k"), (2, "{", "k"), (3, None, "k"), (4, "", "k"), (5, "{}", "k"), (5, "{}", "k")]
    df = spark.createDataFrame(bodies, "record_id long, body string, key string")
    t = procurement_tables(df)
    assert rows(t["records"], "record_id", "cpvType", "n_children") == [(1, "c", 2), (5, None, 0), (5, None, 0)]
    assert rows(t["lots"], "record_id", "lot_no", "title") == [(1, 1, "t"), (1, 2, None)]
    assert rows(t["sub_criteria"], "lot_no", "criterion_no", "sub_no", "winnerCriterionName") == [(1, 1, 1, "s")]
    assert rows(criterion_positions(df)) == [(1, 1, 1, 0), (1, 1, 1, 1), (1, 2, 0, 0), (5, 0, 0, 0), (5, 0, 0, 0)]
    assert all(t.count() == 0 for t in procurement_tables(df.limit(0)).values()) and criterion_positions(df.limit(0)).count() == 0


def test_tables_of_all_paths(spark, rows, tmp_path):
    bodies = [
        (1, '{"cpvType":"c","additionalCpvType":["a","","b"],"tenderingProcess":{"buyer":{"title":"T","address":{"town":"W"}}},"lots":[{"title":"t","Title":"u","x":[{"p":1,"q":2},{"q":3}],"note":"[1]"}]}'),
        (2, '{"additionalCpvType":"z","lots":[{}]}'), (3, '{"additionalCpvType":null}'), (4, "{"), (5, '{"lots":"[{\\"title\\":\\"in a string\\",\\"x\\":{\\"p\\":4}}]"}'),
    ]
    spark.createDataFrame(bodies, "record_id long, body string").write.parquet(f"{tmp_path}/reference_records.parquet")
    q = queries()
    assert rows(q["p4_additional_codes"](spark, str(tmp_path)), "record_id", "item_no", "value") == [(1, 1, "a"), (1, 2, "b"), (2, 1, "z")]
    assert rows(q["p4_records"](spark, str(tmp_path)), "record_id", "cpv_type", "buyer_title", "buyer_town", "buyer_zone") == [(1, "c", "T", "W", None), (2, None, None, None, None), (3, None, None, None, None), (5, None, None, None, None)]
    assert rows(q["p4_sub_criteria"](spark, str(tmp_path))) == []
    df = spark.createDataFrame(bodies, "record_id long, body string")
    t = path_tables(read_triples(df, "record_id", "body", PROCUREMENT), "record_id", PROCUREMENT)
    assert sorted(t) == ["additionalCpvType", "lots", "lots_x", "record"]
    assert rows(t["lots"], "record_id", "lots_no", "Title", "note", "title_2", "n_children") == [(1, 1, "u", "[1]", "t", 2), (2, 1, None, None, None, 0), (5, 1, None, None, "in a string", 1)]
    assert rows(t["lots_x"], "record_id", "lots_no", "x_no", "p", "q") == [(1, 1, 1, "1", "2"), (1, 1, 2, None, "3"), (5, 1, 1, "4", None)]
