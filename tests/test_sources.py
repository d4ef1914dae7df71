import json
import zipfile

import pytest
from pyspark.sql import functions as F

from emoloom import sources, streaming


def workbook(path, rows, sheet="UBMEC"):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = sorted({x for r in rows for x in r if isinstance(x, str)})

    def cell(k, n, x):
        at = f"{chr(65 + k)}{n}"
        return "" if x is None else f'<c r="{at}" t="s"><v>{shared.index(x)}</v></c>' if isinstance(x, str) else f'<c r="{at}"><v>{x}</v></c>'

    body = "".join(f'<row r="{n}">{"".join(cell(k, n, x) for k, x in enumerate(r))}</row>' for n, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["text", "classes", "n"], ["ভালো", "joy", 3], [None, "fear", None], ["x", None, 4]])
    got = sources.excel(spark, str(tmp_path / "a.xlsx"), "UBMEC").collect()
    assert [tuple(r) for r in got] == [("ভালো", "joy", "3"), (None, "fear", None), ("x", None, "4")]
    typed = sources.excel(spark, str(tmp_path / "a.xlsx"), schema=spark.createDataFrame([], "n long, text string").schema).collect()
    assert [tuple(r) for r in typed] == [(3, "ভালো"), (None, None), (4, "x")]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"one, ""two""\nthree"\n2,\n', encoding="utf-8")
    rows = sources.csv_inferred(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert rows[0].text == 'one, "two"\nthree' and rows[1].text is None
    sources.csv_with_bom(spark.createDataFrame([(1, "ক")], "i int, t string"), str(tmp_path / "b"))
    part = next((tmp_path / "b").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# head\n\nনয়\nনা তো\n", encoding="utf-8")
    assert sources.word_list(spark, str(tmp_path / "w.txt")) == ["নয়", "না তো"]
    assert sources.word_list(spark, str(tmp_path / "w.txt"), normalise=True)[0] == "\u09a8\u09df"
    (tmp_path / "p.txt").write_text("# head\nভালো pos\nমন খারাপ NEG\nodd other\nalone\n", encoding="utf-8")
    assert {tuple(r) for r in sources.polarity_lexicon(spark, str(tmp_path / "p.txt")).collect()} == {("ভালো", "pos"), ("মন খারাপ", "neg")}


def test_probe_and_reports(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("ক".encode())
    (tmp_path / "l.txt").write_bytes(b"\xe9t\xe9")
    got = {(r.path.rsplit("/", 1)[1], r.encoding): r.readable for r in sources.encoding_probe(spark, str(tmp_path / "*.txt")).collect()}
    assert got["u.txt", "utf-8"] and not got["l.txt", "utf-8"] and got["l.txt", "latin-1"]
    df = spark.createDataFrame([(1, "a|b")], "i int, t string")
    sources.json_report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"i": 1, "t": "a|b"}] and sources.json_config(str(tmp_path / "r.json"))
    assert sources.markdown_table(df, "T") == "## T\n\n| i | t |\n|---|---|\n| 1 | a\\|b |\n"


def test_resume(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([(1,), (2,)], "k int")

    path = str(tmp_path / "t")
    assert sources.once(spark, path, make).count() == 2 and sources.once(spark, path, make).count() == 2 and len(calls) == 1
    assert sources.once(spark, path, lambda: spark.createDataFrame([(2,), (3,)], "k int"), "k").count() == 3


def test_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "খুব ভালো !!!! http://x.y"), (2, None), (3, "")], "i int, text string")
    df.write.parquet(str(tmp_path / "in"))
    streaming.written(streaming.scored(streaming.files(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, streaming.scored(df).select(*got.columns).collect()))
    assert got.where(F.col("i") == 1).first().sent_pos == 1.0


def test_unknown_sheet(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["x"]])
    with pytest.raises(Exception, match="no sheet"):
        sources.excel(spark, str(tmp_path / "a.xlsx"), "other").collect()
