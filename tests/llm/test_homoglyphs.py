import unicodedata

import pytest

from ledgerloom.llm.homoglyphs import LETTER, TABLE, Reading, check, compile_table, regular_items, regular_text


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("Рamatоjoties uz", "Pamatojoties uz"), ("Комиссия проверяет", "Комиссия проверяет"), ("ｄａｌīｂａｉ．", "dalībai."), ("8042000О-6", "80420000-6"), ("1５３９1000－8", "15391000-8"), ("2248​1000‒0", "22481000-0"),
        ("no rīta un", "no rīta un"), ("apdrοš‌ināšanas", "apdrošināšanas"), (unicodedata.normalize("NFD", "līgumā"), "līgumā"), ("10³ m² ½ °C „x” – y", "10³ m² ½ °C „x” – y"), ("plain", "plain"), ("", ""),
        ("8042000O-6", "8042000O-6"), ("Pабота", "Работа"), ("Сеnа ­", "Cena "), ("\U0001d400bc", "Abc"),
    ],
)
def test_regular_text(text, plain):
    assert regular_text(text) == plain
    assert regular_text(plain) == plain  # nothing is left to do


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("l\u012b\u200bg\u0443m\u0101", "līgymā"), ("\u0430\u0304bols", "ābols"), ("\u0430\u200b\u0304bols", "ābols"), ("\u212aelvin", "Kelvin"), ("pro\u0261ramma", "programma"), ("n\u0585liktava", "noliktava"), ("m\u0451rs", "mërs"), ("\u0421\u0430\u0304", "Cā"),
        ("1234\u200b5678\u2011\u200b9", "12345678-9"), ("12345678–9-5", "12345678-9-5"), ("x12345678–9", "x12345678–9"), ("_12345678–9", "_12345678–9"), ("12345678–9a", "12345678–9a"), ("ОООООООО-О", "ОООООООО-О"), ("1–2", "1–2"), ("cenas‑kvalitātes", "cenas‑kvalitātes"),
        ("Москва\u0301", "Москва\u0301"), ("\u0435\u0301", "é"), ("ёлка", "ёлка"), ("日本語か\u3099", "日本語か\u3099"), ("a\u0304\u0323", "ạ\u0304"), ("\u200b", ""), ("ＡＢＣ－１２", "ABC-12"), ("Οκτώβριος", "Οκτώβριος"),
    ],
)
def test_clusters(text, plain):
    assert regular_text(text) == plain and regular_text(plain) == plain


def test_table_has_no_conflicts():
    assert TABLE["А"].forms["LATIN"] == "A" and TABLE["Ａ"].forms == {"LATIN": "A"} | {k: v for k, v in TABLE["A"].forms.items() if k != "LATIN"} and TABLE["а\u0304"].forms["LATIN"] == "ā"
    assert compile_table() == TABLE
    for bad in ({"x\u0304": Reading(LETTER, "LATIN", {"LATIN": "y"}), "x": Reading(LETTER, "LATIN", {"LATIN": "x"})}, {"ж": Reading(LETTER, "CYRILLIC", {"LATIN": "з"}), "з": Reading(LETTER, "CYRILLIC", {"CYRILLIC": "з"})}):
        with pytest.raises(ValueError):
            check(bad)


def test_every_entry_is_settled_in_one_pass():
    for source, r in TABLE.items():
        for around in ("ab{}c", "{}", "1 {} 2", "ж{}ж", "ω{}ω"):
            once = regular_text(around.format(source))
            assert regular_text(once) == once, (source, around)


def test_items(spark, rows):
    schema = "state_id long, documents_text string, candidates array<struct<code:string,hits:int>>, text string, id int"
    df = spark.createDataFrame([(1, "a\n\nbо b", [("1234567О-1", 1), (None, 1), ("12345678-1", 2)], "t", 1), (2, None, None, None, None), (3, "", [], "", 0)], schema)
    got = rows(regular_items(df).where("changed"), "state_id", "field_name", "item_no", "plain_text")
    assert got == [(1, "candidates", 1, "12345670-1"), (1, "documents_text", 3, "bo b")]
    assert regular_items(df).count() == 6 and regular_items(df.limit(0)).count() == 0
    assert regular_text("а" + "x" * 300_000)[:1] == "a"
