import random

import pytest

from ledgerloom.operators.packed import GRAMMARS, Grammar, Lattice, Spelling, atoms, json_list, pieces_of, split_cell, unpack_values

NAMES, WEIGHTS, CODES = GRAMMARS["criteria_names_extracted"], GRAMMARS["weights_truth"], GRAMMARS["additional_cpv_extracted"]
CASES = [
    ('"Cena; EUR" | Kvalitāte/vienība, km ;;"A ""B"""', NAMES, ["Cena; EUR", "Kvalitāte/vienība, km", 'A "B"']),
    ('"A, x","B", "C"', NAMES, ["A, x", "B", "C"]), ("A, B", NAMES, ["A, B"]), ("a\r\nb\tc", NAMES, ["a", "b", "c"]), ('["A", null, " ", "B \\"x\\""]', NAMES, ["A", 'B "x"']), ('5" pipe; 6" pipe', NAMES, ['5" pipe', '6" pipe']),
    ("32,5, 32,5 ;7 %|8%", WEIGHTS, ["32,5", "32,5", "7 %", "8%"]), ("48 51 1", WEIGHTS, ["48", "51", "1"]), ('"17","83"', WEIGHTS, ["17", "83"]), ("10/90", WEIGHTS, ["10", "90"]), ('"7 %" 8 % 9', WEIGHTS, ["7 %", "8 %", "9"]),
    ("45094000-4  64042000–2/1", CODES, ["45094000-4", "64042000–2", "1"]), ("", NAMES, []), (" ; | ", NAMES, []), ('"open; a', NAMES, ['"open', "a"]), ("[not json", NAMES, ["[not json"]), ("[1, 2", WEIGHTS, ["[1", "2"]),
]


@pytest.mark.parametrize(("cell", "grammar", "values"), CASES)
def test_split_cell(cell, grammar, values):
    assert split_cell(cell, grammar) == values


def test_json_list():
    assert json_list("[1, 2.5]") == ["1", "2.5"] and json_list("[1") is None and json_list("x") is None and json_list("[]") == []


def test_long_cells_take_linear_time():
    assert len(split_cell("a;" * 200_000, NAMES)) == 200_000
    assert len(split_cell('"a;' * 50_000, NAMES)) > 1
    assert len(split_cell(" ".join(["7"] * 20_000), WEIGHTS)) == 20_000


def unpacked(spark, cells, grammar, rounds=2):
    df = spark.createDataFrame(list(enumerate(cells)), "id long, v string")
    out = {i: [] for i in range(len(cells))}
    for r in sorted(unpack_values(df, "id", {"v": grammar}, rounds).collect(), key=lambda r: r["value_pos"]):
        out[r["id"]].append(r["value_text"])
    return out


def test_learned_split_keeps_what_the_column_writes_as_one(spark):
    """A blank is open: the column's own values show which ones belong together."""
    g = Grammar(hard=";", soft=" ", comma="never")
    rng = random.Random(2)
    cells = [";".join(rng.choice(["red", "blue", "green"]) for _ in range(3)) for _ in range(200)] + ["red blue", "green red blue"]
    out = unpacked(spark, cells, g)
    assert out[200] == ["red", "blue"] and out[201] == ["green", "red", "blue"]


def test_rows_need_the_learned_model(spark):
    """Neither splitting at every blank nor at none reads this column; EM does, and round by round it learns names it was never shown."""
    g = Grammar(hard=";", soft=" ", comma="never")
    rng = random.Random(5)
    known = ["Boston", "Riga", "Las Vegas", "San Jose"]
    cells = ["; ".join(f'"{rng.choice(known)}"' for _ in range(3)) for _ in range(100)]
    truth = {}
    for _ in range(120):
        picked = [rng.choice([*known, "New York"]) for _ in range(rng.randint(1, 4))]
        truth[len(cells)] = picked
        cells.append(" ".join(picked))
    out = unpacked(spark, cells, g)
    assert all(out[i] == v for i, v in truth.items())
    none = unpacked(spark, cells, g, rounds=0)
    assert sum(none[i] == v for i, v in truth.items()) < 60 and any(atoms(cells[i], g) != v for i, v in truth.items())


def test_values_of_any_length(spark):
    """No limit on the atoms of a value: one of nine words is read as one."""
    long = "Act on the award of contracts for public works"
    g = Grammar(hard=";", soft=" ", comma="never")
    cells = [f'"{long}"', '"Cena"'] * 30 + [f"Cena {long} Cena"]
    assert unpacked(spark, cells, g)[60] == ["Cena", long, "Cena"]


def test_forward_backward_covers_every_atom():
    g = Grammar(hard=";", soft=" ", comma="never")
    parts = atoms("a b c", g)
    lattice = Lattice(parts, {"a b": 50.0, "a": 20.0, "b": 20.0, "c": 30.0}, 120.0, 2, Spelling())
    assert parts == ["a", " b", " c"] and lattice.best() == ["a b", "c"]
    assert abs(sum(e * size for _, size, e in lattice.expected(0.0)) - 3) < 1e-6


def test_spelled_values_may_be_longer_than_all_known_ones():
    spelling = Spelling({("a", " "): 900.0, (" ", "a"): 900.0, ("a", "$"): 10.0, ("^", "a"): 10.0, ("a", "a"): 5000.0})
    parts = atoms("x y z", Grammar(hard=";", soft=" ", comma="never"))
    assert Lattice(parts, {}, 0.0, 1, spelling).best() == ["x y z"]


@pytest.mark.parametrize("grammar", [NAMES, WEIGHTS, CODES], ids=["names", "weights", "codes"])
def test_the_two_readers_agree(spark, grammar):
    """Cells without quotes are cut by the JVM, others walked; both give the same pieces."""
    from pyspark.sql import functions as F

    from ledgerloom.operators.packed import _plain_pieces

    rng = random.Random(3)
    cells = ["".join(rng.choice("ab17 ,;/|%\n\t.  -–") for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select("c", _plain_pieces(F.col("c"), grammar).alias("p")).collect()
    for r in got:
        assert [(p["text"], p["open"]) for p in r["p"]] == pieces_of(r["c"], grammar), repr(r["c"])


def test_unpack(spark, rows):
    df = spark.createDataFrame([(1, "1;2", "3", 'A;"B"', "x"), (1, "1;2", "3", 'A;"B"', "x"), (2, None, "", " ", "x"), (3, None, None, None, None)], "row_no long, additional_cpv_extracted string, weights_truth string, criteria_names_extracted string, cell string")
    out = rows(unpack_values(df, "row_no").distinct())
    assert out == [(1, "additional_cpv_extracted", 1, "1"), (1, "additional_cpv_extracted", 2, "2"), (1, "criteria_names_extracted", 1, "A"), (1, "criteria_names_extracted", 2, "B"), (1, "weights_truth", 1, "3")]
    assert unpack_values(df, "row_no").count() == 10 and unpack_values(df.limit(0), "row_no").count() == 0
