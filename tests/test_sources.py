import io
import json
import zipfile

import pytest

from ledgerloom.model import ReplayClient, RuleClient, reflect
from ledgerloom.sources import files, records, sinks
from ledgerloom.streaming.state import stream_latest, stream_of, stream_reviews


def zipped(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return b.getvalue()


DOCX = zipped({"word/document.xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t> a </w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = zipped({"xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si></sst>', "xl/worksheets/sheet1.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2" t="inlineStr"><is><t> </t></is></c></row></sheetData></worksheet>'})


def test_archives():
    inner = zipped({"b.txt": "B", "META-INF/x.xml": "no", "mimetype": "no"})
    data = zipped({"a.txt": "A", "in.edoc": inner, "../evil.txt": "x", "bad.zip": "not a zip"})
    got = {chain: (content, reason) for chain, content, reason in files.leaves("top.zip", data)}
    assert got["top.zip/a.txt"] == (b"A", None) and got["top.zip/in.edoc/b.txt"] == (b"B", None)
    assert got["top.zip/evil.txt"][1] and got["top.zip/bad.zip"] == (b"not a zip", "broken container") and len(got) == 4
    deep = b"x"
    for i in range(8):
        deep = zipped({f"{i}.zip" if i else "x.txt": deep})
    assert [r for *_, r in files.leaves("d.zip", deep)] == ["nested too deeply"]
    assert next(files.leaves("x.7z", b"?"))[2]


def test_readers():
    assert files.read_docx(DOCX) == ("Hello", [[["a", ""]]])
    assert files.read_xlsx(XLSX) == ("name\t5", [[["name", "", "5"]]])
    assert files.read_plain(b"\xef\xbb\xbfa\xffb")[0] == "ab"


def test_html_grid():
    source = "<table><tr><td rowspan=2 colspan=2>A &amp; B</td><td>x</td></tr><tr><td>y</td></tr><tr><td rowspan=0>z<td colspan=bad>q</tr><tr></tr></table><script>no</script><p>text</p>"
    assert files.html_tables(source) == [[["A & B", "", "x"], ["", "", "y"], ["z", "q", ""], ["", "", ""]]]
    assert "text" in files.html_text(source) and "no" not in files.html_text(source).split()
    wide = "<table><tr><td>a</td><td rowspan=2>b</td><td>c</td></tr><tr><td colspan=2>d</td><td>e</td></tr></table>"
    assert files.html_tables(wide) == [[["a", "b", "c", "", ""], ["", "", "d", "", "e"]]]  # d needs two free columns
    assert files.html_tables("") == [] and files.html_text("") == ""


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped({"x.docx": DOCX, "y.bin": b"1"}))
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    got = {r["chain"]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.zip/x.docx"]["text"] == "Hello" and got["a.zip/x.docx"]["tables"] == [[["a", ""]]]
    assert got["a.zip/y.bin"]["reason"].startswith("unsupported") and "BadZipFile" in got["b.xlsx"]["reason"]


def test_records(spark, tmp_path):
    truth = [{"tenderingProcess": {"documentsURL": "https://x/Procurement/7"}, "lots": [{"criterion": [{"winnerCriterionName": "n", "winnerCriterionNumber": "5"}]}, {"criterion": []}]}, {"lots": []}]
    (tmp_path / "t.json").write_text(json.dumps(truth))
    t = records.read_truth(spark, str(tmp_path / "t.json"))
    assert sorted((r["eis_id"] or "", r["lot_no"], r["name"]) for r in records.flatten_truth(t).collect()) == [("", None, None), ("7", 0, "n"), ("7", 1, None)]
    (tmp_path / "t2.json").write_text(json.dumps([truth[0], truth[0]]))
    with pytest.raises(records.DuplicateKey):
        records.read_truth(spark, str(tmp_path / "t2.json"))
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "42.json").write_text('{"attempts": 1}')
    r = records.read_extractions(spark, str(tmp_path / "e")).first()
    assert (r["eis_id"], r["status"]) == ("42", "legacy_unlabelled")
    (tmp_path / "v.csv").write_text("﻿eis_id,a\n1,x\n")
    assert records.read_evaluation(spark, str(tmp_path / "v.csv")).first()["eis_id"] == "1"


def test_run_log(spark):
    lines = ["noise", "=== 12 ===", "attempt 1: main=12345678-9 additional=[22345678-9, 32345678-9]", "please revise", "attempt 2: main= additional=[]", "=== 13 ===", "attempt 1: main=12345678-9 additional=[]"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "source string, line_no int, value string")
    got = sorted(tuple(r)[1:] for r in records.parse_run_log(df).collect())
    assert got == [("12", 1, "12345678-9", "22345678-9,32345678-9", 1), ("12", 2, None, "", 1), ("13", 1, "12345678-9", "", 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 2)], "eis_id string, n int")
    sinks.write_records(df, str(tmp_path / "r"))
    sinks.write_csv(df, str(tmp_path / "c"), guarded=True)
    with pytest.raises(Exception, match="exists"):
        sinks.write_csv(df, str(tmp_path / "c"), guarded=True)
    sinks.append_log(df, str(tmp_path / "l"))
    sinks.append_log(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2 and spark.read.json(str(tmp_path / "r")).count() == 1
    assert json.loads(sinks.summary_json(df).first()[0]) == {"eis_id": "1", "n": 2}


def test_streams(spark, tmp_path):
    src = tmp_path / "s"
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "k string, i long, v string").write.json(str(src))
    s = stream_of(spark, str(src), "k string, i long, v string")
    q = stream_latest(s, ["k"], ["i"]).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("latest").collect()) == [("a", 3, "z"), ("b", 1, "q")]
    ev = tmp_path / "ev"
    spark.createDataFrame([("s", 1, "propose", "p"), ("s", 2, "pause", None), ("s", 3, "approve", None), ("s", 3, "approve", None)], "k string, i long, a string, v string").write.json(str(ev))
    q = stream_reviews(stream_of(spark, str(ev), "k string, i long, a string, v string"), "k", "i", "a", "v").writeStream.format("memory").queryName("reviews").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("reviews").collect()][-1] == ("s", "decided", "p", 1)


def test_reflection(spark):
    df = spark.createDataFrame([(1, "code 12345678-9"), (2, "nothing"), (3, None)], "k int, t string")
    got = {r["k"]: (r["answer"], r["verdict"], r["attempts"]) for r in reflect(df, RuleClient(), "k", "t").collect()}
    assert got == {1: ("12345678-9", "accept", 1), 2: ("", "revise", 3), 3: ("", "revise", 3)}
    assert ReplayClient({("a", "b"): "c"}).complete("a", "b") == "c"
