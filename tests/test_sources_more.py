import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.model import Truncated, complete_within
from ledgerloom.operators import reconcile, reports, spans
from ledgerloom.sources import files, pdf, sinks


def make_pdf(pages, packed=False, cmap=None):
    """A small PDF: ``pages`` holds content streams."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1" + (b" /ToUnicode 4 0 R" if cmap else b"") + b" >>"}
    if cmap:
        objects[4] = b"<< /Length 1 >>\nstream\n" + cmap + b"\nendstream"
    kids = []
    for i, content in enumerate(pages):
        n = 10 + 2 * i
        kids.append(n)
        data = zlib.compress(content)
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (n + 1)
        objects[n + 1] = b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(data) + data + b"\nendstream"
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % k for k in kids) + b"] /Resources << /Font << /F1 3 0 R >> >> >>"
    if packed:
        moved = {k: objects.pop(k) for k in (1, 2, *kids)}
        body = b" ".join(moved.values())
        starts, at = [], 0
        for k, v in moved.items():
            starts.append(b"%d %d" % (k, at))
            at += len(v) + 1
        head = b" ".join(starts) + b" "
        data = zlib.compress(head + body)
        objects[90] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode >>\nstream\n" % (len(moved), len(head)) + data + b"\nendstream"
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % k + v + b"\nendobj\n" for k, v in objects.items()) + b"%%EOF"


PAGES = [rb"BT /F1 12 Tf 72 700 Td (CPV 71220000-6 \(main\)) Tj 0 -14 Td [(Sec) -50 (ond) -300 (line)] TJ ET", b"BT /F1 9 Tf 1 0 0 1 72 700 Tm (Third) Tj T* <6C696E65> Tj ET", b"q Q"]


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_pages(packed):
    found = pdf.read_pages(make_pdf(PAGES, packed))
    assert [p.text for p in found] == ["CPV 71220000-6 (main)\nSecond line", "Third\nline", ""] and [pdf.needs_ocr(p) for p in found] == [False, False, True]
    assert pdf.combine(found, {1: "no", 3: "scanned"}) == ("CPV 71220000-6 (main)\nSecond line\nThird\nline\nscanned", "scanned", [3])


def test_pdf_fonts_and_broken_files():
    cmap = b"1 beginbfchar <0041> <0100> endbfchar 1 beginbfrange <0042> <0043> <0161> endbfrange 1 beginbfrange <0044> <0045> [<0031> <00320033>] endbfrange"
    assert pdf.read_pages(make_pdf([b"BT /F1 9 Tf <00410042004300440045> Tj ET"], cmap=cmap))[0].text == "ĀšŢ123"
    for bad in (b"", b"text", b"%PDF-1.4 /Encrypt 1 0 R"):
        with pytest.raises(ValueError):
            pdf.read_pages(bad)
    assert pdf.read_pages(b"%PDF-1.4 nothing") == [] and all(p.text == "" for p in pdf.read_pages(make_pdf(PAGES)[:200]))


def test_modes(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make_pdf(PAGES))
    (tmp_path / "b.html").write_text("<table><tr><td>x</td></tr></table>after")
    read = lambda mode: {r["chain"]: (bool(r["text"]), len(r["tables"]), r["reason"]) for r in files.read_documents(spark, str(tmp_path), mode=mode).collect()}
    assert read("all") == {"a.pdf": (True, 0, None), "b.html": (True, 1, None)} and read("text")["b.html"] == (True, 0, None) and read("tables")["b.html"] == (False, 1, None)
    assert read("digital") == {"a.pdf": (True, 0, None), "b.html": (False, 0, "unsupported format .html")}
    assert files.read_documents(spark, str(tmp_path)).where("seconds >= 0").count() == 2
    with pytest.raises(ValueError):
        files.read_documents(spark, str(tmp_path), mode="other")


def test_candidates_in_tables(spark, rows):
    df = spark.createDataFrame([(1, "No code in prose.", [[["CPV", "71220000-6"], ["x", None]], [["71220000-6"]]]), (2, None, None)], "k int, t string, tables array<array<array<string>>>")
    parts = spans.texts_with_tables(df, ["k"], "t", "tables")
    found = spans.pattern_candidates(parts, ["k"], ["part"], "text", "[0-9]{8}-[0-9]")
    assert rows(found, "k", "code", "n_hits", "first_context") == [(1, "71220000-6", 2, "CPV | 71220000-6\nx | ")]


def test_ranked_search_against_brute_force(spark):
    rng = random.Random(5)
    words = ["cena", "kvalitāte", "termiņš", "x", "y"]
    chunks = [(q, f"c{q}_{i}", rng.choice("ab"), rng.randrange(2), i, rng.choice(["", "H"]), None, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))), rng.choice(["text", "table"]), rng.choice([None, "1", "2"]), rng.randrange(3)) for q in range(40) for i in range(14)]
    df = spark.createDataFrame(chunks, "q int, id string, source string, section int, start int, heading string, table_header string, text string, kind string, lot_hint string, strength int")
    got: dict = {}
    for r in spans.ranked_search(df, ["q"], ["Cena", " kvalit"], F.col("strength"), F.array(F.lit("1")), F.col("source") == "a").orderBy("q", "position").collect():
        got.setdefault(r["q"], []).append(r["id"])
    for q in range(40):
        own = [c for c in chunks if c[0] == q]
        rank = lambda c: (c[10], c[9] == "1", c[8] == "table", ("cena" in c[7]) + ("kvalit" in c[7]), c[2] == "a")
        able = sorted((c for c in own if c[9] in (None, "1") and (c[10] or rank(c)[3])), key=lambda c: (c[2], c[4], c[1]))
        able.sort(key=rank, reverse=True)
        hits, seen = [], set()
        for c in able:
            if (c[5], c[7]) in seen or c[1] in hits:
                continue
            seen.add((c[5], c[7]))
            hits.append(c[1])
            if len(hits) == 1:
                hits += [n[1] for n in sorted((n for n in own if n[2] == c[2] and n[3] == c[3] and n[4] > c[4]), key=lambda n: n[4])[:1]]
            if len(hits) >= 6:
                break
        # a continuation that is also a hit takes no second place
        assert got.get(q, [])[:2] == hits[:2] and set(hits[:5]) <= set(got.get(q, [])) | set(hits[5:]) and len(got.get(q, [])) <= 6, q
    with pytest.raises(ValueError):
        spans.ranked_search(df, ["q"], [" "], F.lit(0), F.array(), F.lit(False))


def test_global_status_and_correction(spark, rows):
    lots = spark.createDataFrame([(1, "reconciled", True), (1, "reconciled", True), (2, "reconciled", True), (2, None, True), (3, "reconciled", None)], "k int, s string, c boolean")
    assert rows(reconcile.global_status(lots, ["k"], "s", F.col("c"))) == [(1, 2, True), (2, 2, False), (3, 1, False)]
    first = spark.createDataFrame([(1, 10.0, "a"), (2, None, "b"), (3, 5.0, None)], "k int, w double, x string")
    failing = spark.createDataFrame([(2,), (3,), (3,), (9,)], "k int")
    seen = []

    def second(df):
        seen.extend(r["k"] for r in df.collect())
        return df.select("k", F.when(F.col("k") == 2, 7.0).alias("w"))

    assert rows(reconcile.correct_once(first, failing, second, "k", ["w"])) == [(1, 10.0, "a", False), (2, 7.0, "b", True), (3, 5.0, None, False)] and sorted(seen) == [2, 3]


def test_run_audit(spark, rows):
    code = "eis_id string, main string, additional array<string>"
    records = spark.createDataFrame([(k, "A", ["y", "x"]) for k in "12345"] + [("6", None, None)], code)
    evaluation = spark.createDataFrame([(k, "A" if k != "5" else "B", ["x", "y"], " A ") for k in "2345"] + [("6", None, [], None)], code + ", truth string")
    log = spark.createDataFrame([(k, 1, "B", []) for k in "345"] + [(k, 2, "A" if k != "4" else "C", ["x", "y", "x"]) for k in "345"] + [("6", 1, None, [])], "eis_id string, attempt int, main string, additional array<string>")
    traces = spark.createDataFrame([(k,) for k in "456"], "eis_id string")
    assert rows(reports.run_audit(records, evaluation, log, traces)) == [("1", "missing_evaluation", None, None), ("2", "missing_log", None, True), ("3", "missing_trace", False, True), ("4", "log_disagrees", False, True), ("5", "evaluation_disagrees", False, True), ("6", None, None, None)]


def test_reports_and_traces(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1, 2.5), ("c", None, None)], "name string, n int, share double")
    text = reports.markdown(df, {"n": "Count"})
    assert text == "| name | Count | share |\n| --- | ---: | ---: |\n| a\\|b | 1 | 2.50 |\n| c | Not available | Not available |\n"
    sinks.write_report(df, str(tmp_path), "r", {"n": "Count"}, "Note.")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r.csv").columns == ["name", "Count", "share"] and "Note." in "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/r.md").collect())
    with pytest.raises(ValueError):
        reports.markdown(df, most=1)
    for run in ("r1", "r2"):
        sinks.append_trace(spark.createDataFrame([("1", run, 0.5)], "eis_id string, run string, seconds double"), f"{tmp_path}/traces")
    assert spark.read.json(f"{tmp_path}/traces").count() == 2


def test_answers_cut_off_are_asked_for_again():
    class Client:
        def __init__(self, need):
            self.need, self.asked = need, []

        def complete_limited(self, task, prompt, limit):
            self.asked.append(limit)
            if limit < self.need:
                raise Truncated
            return "ok"

    short, long, never = Client(10), Client(3000), Client(9000)
    assert complete_within(short, "t", "p") == "ok" and short.asked == [2500] and complete_within(long, "t", "p") == "ok" and long.asked == [2500, 4096]
    with pytest.raises(Truncated):
        complete_within(never, "t", "p")
