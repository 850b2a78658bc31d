import io
import zipfile

import pytest
from pyspark.sql import functions as F

from evidentia.operators.phrases import variants
from evidentia.operators.series import table_roles
from evidentia.plans.reports import file_events, format_report, hide_names, mail_body, mail_link, report_lines, rewrite_folder, sizing_claims, total_claims
from evidentia.sources.files import cells_of, extract, parse_delimited, quarantine, read_files, rtf_text


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


XLSX = zipped({
    "xl/sharedStrings.xml": "<sst><si><t>Shards</t></si><si><r><t>Node </t></r><r><t>cores</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
                                '<row r="2"><c r="A2"><v>3</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    "xl/media/i.png": "img",
})
DOCX = zipped({"word/header1.xml": "<w:p><w:t>Head</w:t></w:p>", "word/document.xml": "<w:p><w:r><w:t>Body &amp; more</w:t></w:r></w:p>"})
PPTX = zipped({f"ppt/slides/slide{n}.xml": f"<a:p><a:t>Slide {n}</a:t></a:p>" for n in (10, 2)})
FILES = {
    "a.csv": b'metric,value\nshards,3\n"quo""ted","x,y"\n', "b.tsv": b"t\tv\n2026-01-01\t5\n2026-01-02\t6\n", "c.json": b'{"a": 1}', "d.html": b"<html><p>Hi&nbsp;there</p></html>",
    "e.txt": b"plain words", "f.eml": b"From: A <a@b.c>\nTo: d@e.f\nSubject: Cores\n\nWe have 8 cores.", "g.xlsx": XLSX, "h.docx": DOCX, "i.pptx": PPTX, "j.pdf": b"%PDF-1.4", "k.png": b"\x89PNG\r\n\x1a\n",
    "l.bin": b"\x00\x01\x02", "m.zip": b"PK\x03\x04broken", "n.doc": b"\xd0\xcf\x11\xe0rest", "o.jpg": b"\xff\xd8\xff\xe0", "p.xml": b"<note>n</note>", "q.rtf": b"{\\rtf1 hello}", "empty": b"",
}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    for name, data in FILES.items():
        (top / name).write_bytes(data)
    files = read_files(spark, str(top))
    return files, extract(files).cache()


def test_every_file_is_reported(parts):
    files, found = parts
    rows = {}
    for r in found.collect():
        rows.setdefault(r.name.rsplit("/", 1)[1], []).append(r)
    assert set(rows) == set(FILES)
    assert rows["c.json"][0].text == '{"a": 1}' and rows["d.html"][0].text == "Hi there" and rows["p.xml"][0].text == "n"
    assert rows["a.csv"][0].rows == [["shards", "3"], ['quo"ted', "x,y"]]
    mail = {r.kind: r for r in rows["f.eml"]}
    assert mail["text"].text.strip() == "We have 8 cores." and mail["keyvalue"].pairs["subject"] == "Cores"
    sheet = next(r for r in rows["g.xlsx"] if r.kind == "table")
    assert sheet.headers == ["Shards", "Node cores"] and sheet.rows == [["3", "", "x"]]
    assert next(r for r in rows["g.xlsx"] if r.kind == "image").bytes == b"img"
    assert [r.text for r in rows["h.docx"]] == ["Body & more", "Head"]
    assert [r.text for r in rows["i.pptx"]] == ["Slide 2", "Slide 10"]
    assert rows["q.rtf"][0].text == "hello"
    for name in ("j.pdf", "l.bin", "m.zip", "n.doc"):
        assert rows[name][0].error and rows[name][0].kind is None
    assert rows["k.png"][0].kind == rows["o.jpg"][0].kind == "image"


def test_cells_and_roles(parts):
    cells = cells_of(parts[1])
    roles = {r.source.rsplit("/", 1)[1]: r.role for r in table_roles(cells).collect()}
    assert roles == {"a.csv": "data-table", "b.tsv": "metric-time-series", "g.xlsx#sheet1": "data-table"}


def test_quarantine(parts):
    flags = {r.name.rsplit("/", 1)[1]: r.flag for r in quarantine(parts[0]).collect()}
    assert flags["k.png"] == flags["o.jpg"] == "image" and flags["l.bin"] == "binary" and flags["n.doc"] == "not UTF-8" and flags["a.csv"] is None


def test_parse_delimited():
    assert parse_delimited('a,b\n"x,1","y""z"\n', ",") == [["a", "b"], ["x,1", 'y"z']]
    assert parse_delimited("a\tb\r\n1\t2", "\t") == [["a", "b"], ["1", "2"]]
    assert parse_delimited("a,b\n\n1\n", ",") == [["a", "b"], [""], ["1"]]
    assert parse_delimited('a"b,c"d,e', ",") == [["ab,cd", "e"]] and parse_delimited("", ",") == []
    assert parse_delimited('"open\nend', ",") == [["open\nend"]] and parse_delimited("a,\n", ",") == [["a", ""]]


def test_rtf():
    text = rtf_text(r"{\rtf1{\fonttbl{\f0 Arial;}}{\*\themedata 00ff}A\'e9\u8364 ? b\par {\b bold}\tab x \{y\}}")
    assert text == "Aé€ b\nbold x y"


def test_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Acme met Acme Blue")
    (tmp_path / "in/b.png").write_bytes(b"x")
    entries = spark.createDataFrame([("Acme", "EV_ORG_01"), ("Acme Blue", "EV_ORG_02")], "phrase string, slug string")
    (tmp_path / "in/deep").mkdir()
    (tmp_path / "in/deep/e.txt").write_text("é none")
    (tmp_path / "in/deep/f.bin").write_bytes(b"\0\1\2")
    done = rewrite_folder(spark, str(tmp_path / "in"), entries, str(tmp_path / "out"))
    assert {r.name: (r.flag, r.n_replaced) for r in done.collect()} == {"a.txt": (None, 2), "b.png": ("image", 0), "deep/e.txt": (None, 0), "deep/f.bin": ("binary", 0)}
    assert (tmp_path / "out/texts/a.txt").read_text() == "EV_ORG_01 met EV_ORG_02" and (tmp_path / "out/texts/deep/e.txt").read_text() == "é none"
    assert (tmp_path / "out/flagged/b.png").read_bytes() == b"x"
    report = format_report(done).first().report
    assert report == "Files:\n  binary: 1 file(s), 0 replacement(s)\n  image: 1 file(s), 0 replacement(s)\n  rewritten: 2 file(s), 2 replacement(s)\n  left as it is: b.png (image)\n  left as it is: deep/f.bin (binary)"
    back = rewrite_folder(spark, str(tmp_path / "out/texts"), entries, str(tmp_path / "back"), reverse=True)
    assert back.count() == 2 and (tmp_path / "back/texts/a.txt").read_text() == "Acme met Acme Blue"
    (tmp_path / "in/c.txt").write_text("EV_ORG_02 is here")
    with pytest.raises(ValueError, match="EV_ORG_02"):
        rewrite_folder(spark, str(tmp_path / "in"), entries, str(tmp_path / "out2"))


def test_events_and_mail(spark, parts):
    events = file_events(parts[1], F.lit("2026-01-01T00:00:00"), F.lit("PDF"))
    assert {r.category for r in events.collect()} == {"unsupported_format", "malformed_file"}
    hidden = hide_names(events.withColumn("message", F.concat("message", F.lit(" in "), F.col("context")["file"]))).collect()
    assert all("file-" in r.message and r.context["file"] not in r.message + r.title for r in hidden)
    assert report_lines(events).count() == events.count()
    body = mail_body(events, "Hello\n", "\nBye", 60).first().body
    assert body.startswith("Hello\n  - ") and body.endswith("\nBye") and len(body) <= 60
    link = spark.range(1).select(mail_link(F.lit("a@b.c"), F.lit("x y"), F.lit("z&")).alias("l")).first().l
    assert link.startswith("mailto:a@b.c?subject=x") and "z%26" in link


def test_variants(spark):
    rows = spark.createDataFrame([(0, "josé  NÚÑEZ", "s1"), (1, "JOSÉ NÚÑEZ", "s2")], "ord int, phrase string, slug string")
    got = {r.phrase: r.slug for r in variants(rows).collect()}
    assert got["José Núñez"] == "s1" and got["josé núñez"] == "s1" and got["JOSÉ NÚÑEZ"] == "s1" and "jose\u0301 nu\u0301n\u0303ez" in got


def test_sizing_claims(spark):
    from evidentia.plans import costs, sizing
    from tests.test_goldens import CASE, COSTS, INPUTS

    inputs = spark.createDataFrame([CASE], INPUTS)
    got = {r.id: r.value for r in sizing_claims(inputs, sizing.scenarios(sizing.consumed(inputs))).collect()}
    assert got["in-primary"] == "18/45%" and got["base-conservative"] == "22" and len(got) == 8
    parts = [(1, "license", "baseline", 1.0, 449500.0, 1.0), (1, "proposedPrimary", "proposed", 0.0, 80926.0, 0.0), (1, "warmDrAdd", "proposed", 0.0, 132723.0, 0.0), (1, "migration", "once", 0.0, 17277.0, 0.0)]
    df = spark.createDataFrame(parts, "case int, " + COSTS)
    told = total_claims(costs.annual_saving(df, ["case"]), costs.payback(costs.five_years(df, ["case"]), ["case"]), ["case"]).where("posture = 'warm'").first()
    assert (told.saving, told.net, told.payback) == ("52%", "$712K", "year 2")


def test_cells_as_they_are_shown(spark, tmp_path):
    """Entities, truth values, dates by style, errors and results of formulas."""
    sheet = ('<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t xml:space="preserve">x &lt; y</t></is></c></row>'
             '<row r="2"><c r="A2" t="b"><v>1</v></c><c r="B2" t="b"><v>0</v></c><c r="C2" s="1"><v>45292.5</v></c><c r="D2" s="2"><v>45292</v></c></row>'
             '<row r="3"><c r="A3" t="e"><v>#DIV/0!</v></c><c r="B3" t="str"><f>A1</f><v>a &amp; b</v></c><c r="C3" s="0"><v>3.0</v></c><c r="D3"><f>1/3</f><v>0.33333333333333331</v></c></row></sheetData></worksheet>')
    styles = '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="165"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    data = {"xl/sharedStrings.xml": "<sst><si><t>A &amp;amp; B &#233;</t></si></sst>", "xl/styles.xml": styles, "xl/worksheets/sheet1.xml": sheet}
    (tmp_path / "a.xlsx").write_bytes(zipped(data))
    got = extract(read_files(spark, str(tmp_path))).first()
    assert got.headers == ["A &amp; B é", "x < y"]
    assert got.rows == [["true", "false", "2024-01-01T12:00:00.000Z", "2024-01-01T00:00:00.000Z"], ["#DIV/0!", "a & b", "3", "0.3333333333333333"]]


def test_names_in_tables_are_found(parts):
    from evidentia.operators.phrases import corpus

    texts = {r.name.rsplit("/", 1)[1]: r.text for r in corpus(parts[1]).where("part = '' or part is null or part = 'headers'").collect()}
    assert texts["a.csv"] == 'metric | value\nshards | 3\nquo"ted | x,y' and texts["c.json"] == '{"a": 1}' and "Cores" in texts["f.eml"]


def test_containers_and_readers(spark):
    from evidentia.sources.files import container_type, image_mime, read_mail, read_office

    assert [container_type(n) for n in (["xl/a"], ["word/x"], ["ppt/y"], ["z"])] == ["xlsx", "docx", "pptx", "ooxml"]
    doc = zipped({"word/document.xml": "<w:p><w:t>x</w:t></w:p>", "word/comments.xml": '<w:comment w:author="A &amp; B"/><w:comment w:author="C"/>', "word/media/a.JPG": "p", "word/media/b.png": ""})
    found = list(read_office("d", doc))
    assert [p["text"] for p in found if p["kind"] == "text"] == ["comment authors: A & B; C"]
    assert [(p["type"], p["bytes"]) for p in found if p["kind"] == "image"] == [("jpeg", b"p")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z, z.open("xl/workbook.xml", "w", force_zip64=True) as f:
        f.write(b"x")
    entry = zipfile.ZipFile(out).infolist()[0]
    entry.extra = b"\x07\x00\x01\x00z\x01\x00\x08\x00" + bytes(8)
    from evidentia.sources.files import _has_long_sizes

    assert _has_long_sizes(entry.extra) and not _has_long_sizes(b"\x07\x00\x02\x00\x01\x00")
    pairs = [p for p in read_mail("m", b'From: "Ann Lee" <ann@x.org>\nTo: b@x.org, Cy <c@x.org>\nSubject: s\n\nhi') if p["kind"] == "keyvalue"][0]["pairs"]
    assert pairs == {"subject": "s", "from": "Ann Lee <ann@x.org>", "to": "b@x.org; Cy <c@x.org>"}
    kinds = spark.createDataFrame([("png",), ("pdf",)], "t string").select(image_mime(F.col("t")).alias("m")).collect()
    assert [r.m for r in kinds] == ["image/png", None]
    files = spark.createDataFrame([("a.pdf", 8, b"%PDF-1.4"), ("b.doc", 8, b"\xd0\xcf\x11\xe0" + "WordDocument".encode("utf-16-le"))], "name string, length long, content binary")
    errors = {r.name: r.error for r in extract(files).collect()}
    assert errors["a.pdf"].endswith("its pictures") and errors["b.doc"].endswith(".docx")
    own = extract(files, {"pdf": lambda name, content: iter([{"type": "pdf", "kind": "text", "part": "", "text": "read"}])})
    assert own.where("name = 'a.pdf'").first().text == "read"


def test_a_type_is_worked_out_once_for_the_readers_and_once_for_the_rest(spark):
    from evidentia.sources.files import HTML_START

    files = spark.createDataFrame([("a", b"a,b\n1,2\n"), ("b", b"<p>x</p>"), ("c", b"\x01" * 3 + b"x" * 57), ("d", b"\x01" * 4 + b"x" * 57)], "name string, content binary")
    got = extract(files)
    assert {r.name: (r.type, r.kind) for r in got.collect()} == {"a": ("csv", "table"), "b": ("html", "text"), "c": ("text", "text"), "d": ("unknown", None)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count(HTML_START) == 2
