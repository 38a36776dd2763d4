"""Parsers, archives, the command line and the stream, on files built here."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from foliospark import cli, providers
from foliospark.errors import IntelligenceError, ParseError, UnsupportedFormatError
from foliospark.functions import text
from foliospark.operators.index import StoredIndex
from foliospark.plans import pipeline
from foliospark.plans.questions import evaluate
from foliospark.sources import archive, delimited, docx, evalcases, html, markdown, pdf, xlsx
from foliospark.sources.registry import Parser, ParserRegistry, raw_sections, read_files
from foliospark.streaming.reindex import reindex

MD = "intro text\n\n# Annual Report\nfirst\n## Revenue\nsome text\n```\n# not a heading\n```\n## Costs  \nlast\n"


def test_markdown(spark):
    title, kind, sections = markdown.parse("/x/myNotes_2.md", MD.encode())
    assert (title, kind) == ("Annual Report", "md")
    assert [(s["title"], s["level"]) for s in sections] == [("My Notes 2", 1), ("Annual Report", 1), ("Revenue", 2), ("Costs", 2)]
    assert sections[2]["text"] == "some text\n```\n# not a heading\n```"
    assert markdown.parse("a-b.md", b"")[2] == [{"title": "a-b", "level": 1, "text": ""}]
    assert markdown.parse("a-b.md", b"## x\nplain")[0] == "a-b"
    texts = {"myNotes": MD, "b-b": "", "plain_text": "just text\r\nmore", "fences": "~~~\n# x\n~~~\n# y", "two": "\n\n# one\n# two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string").withColumn("fallback", F.col("doc_id"))
    docs = docs.withColumn("preamble", text.title_case(F.replace(text.doc_slug(F.concat("doc_id", F.lit(".md"))), F.lit("-"), F.lit(" "))))
    got = {}
    for r in markdown.sections(docs).orderBy("doc_id", "sec_idx").collect():
        got.setdefault(r.doc_id, []).append({"title": r.title, "level": r.level, "text": r.text})
    for name, body in texts.items():
        assert got[name] == markdown.parse(f"{name}.md", body.encode())[2]


def test_delimited():
    content = 'Name,Amount,Note\n"a ""b""","1,200",x\nshort\none,2,3,4\n,,\n'
    _, kind, [section] = delimited.parse("/d/sales_data.csv", content.encode())
    table = section["tables"][0]
    assert kind == "csv" and table["headers"] == ["Name", "Amount", "Note"]
    assert table["rows"] == [['a "b"', "1,200", "x"], ["short", "", ""], ["one", "2", "3"]]
    assert section["text"] == 'File: sales_data\nColumns: Name, Amount, Note\nData:\na "b" | 1,200 | x\nshort |  | \none | 2 | 3' and section["title"] == "Sales Data"
    assert delimited.detect('a;b;"x,y,z,w"\n') == ";" and delimited.detect("plain") == ","
    assert delimited.records('a,"b\nc"\r\nd\re', ",") == [["a", "b\nc"], ["d"], ["e"]] and delimited.records("", ",") == [[""]]
    assert delimited.records('x"y,z"w,"', ",") == [["xy,zw", ""]]
    assert delimited.decode("é".encode("latin-1")) == "é" and delimited.decode(b"\xef\xbb\xbfx") == "x"
    assert delimited.parse("t.tsv", b"a\tb,c\n1\t2")[2][0]["tables"][0]["headers"] == ["a", "b,c"]
    for bad in (b"", b"\n , \n"):
        with pytest.raises(ParseError):
            delimited.parse("x.csv", bad)


PAGE = """<html><head><title> The page </title></head><body><h1>Top</h1><p>one<p>two <b>bold</b></p>text<h2>Table</h2>
<table><caption>Cap</caption><tr><th>Region</th><th>Q</th><th>V</th></tr><tr><td rowspan=2>North</td><td>1</td><td>5</td></tr><tr><td>2</td><td>6</td></tr><tr><td colspan="x"></td></tr></table>
<div><h3>Inner</h3>inside</div>after</body></html>"""


def test_html():
    title, _, sections = html.parse("x.html", PAGE.encode())
    assert title == "The page" and [(s["title"], s["level"], s["text"]) for s in sections] == [("Top", 1, "one two bold text"), ("Table", 2, "Inner" + "inside after"), ("Inner", 3, "inside")]
    assert sections[1]["tables"] == [{"table_id": "tbl_001", "caption": "Cap", "headers": ["Region", "Q", "V"], "rows": [["North", "1", "5"], ["North", "2", "6"]]}]
    assert html.parse("my-page.htm", b"<p>only")[0::2] == ("My Page", [{"title": "Document", "level": 1, "text": "only"}])
    assert html.parse("x.html", b"")[2] == [] and html.parse("x.html", b"<h1>H</h1>")[0] == "H"
    assert html.grid([x for x in html.tree("<table><tr><td colspan=2 rowspan=2>a<td>b<tr><td>c</table>").walk() if x.tag == "tr"]) == [["a", "a", "b"], ["a", "a", "c"]]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx_bytes(body, core=""):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if core:
            z.writestr("docProps/core.xml", f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{core}</dc:title></c>')
    return b.getvalue()


def par(text, style="", bold=False):
    s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{s}<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}<w:t>{text}</w:t></w:r></w:p>"


def test_docx():
    cell = lambda t, p="": f"<w:tc><w:tcPr>{p}</w:tcPr>{par(t)}</w:tc>"
    table = "<w:tbl>" + f"<w:tr>{cell('R')}{cell('Q')}{cell('V')}</w:tr>" + "<w:tr>" + cell("North", '<w:vMerge w:val="restart"/>') + cell("1") + cell("2") + "</w:tr>" + "<w:tr>" + cell("", "<w:vMerge/>") + cell("both", '<w:gridSpan w:val="2"/>') + "</w:tr>" + f"<w:tr>{cell('S')}</w:tr></w:tbl>"
    body = par("before") + par("Main", "Heading1") + par("body text.") + par("item", "ListParagraph") + par("Sub", "heading 2") + table + par("ALL CAPS") + par("bold one", bold=True) + par("Lead in:") + par("end.")
    title, kind, s = docx.parse("/x/a_b.docx", docx_bytes(body))
    assert (title, kind) == ("Main", "docx")
    assert [(x["title"], x["level"]) for x in s] == [("Introduction", 1), ("Main", 1), ("Sub", 2), ("ALL CAPS", 1), ("bold one", 1), ("Lead in", 1)]
    assert s[1]["text"] == "body text.\n\n- item" and s[5]["text"] == "end."
    assert s[2]["tables"] == [{"table_id": "tbl_001", "caption": None, "headers": ["R", "Q", "V"], "rows": [["North", "1", "2"], ["North", "both", "both"], ["S", "", ""]]}]
    assert docx.parse("a_b.docx", docx_bytes(par("x"), "Core"))[0] == "Core" and docx.parse("a_b.docx", docx_bytes(par("x y.")))[0] == "A B"
    for bad in (b"", b"no zip"):
        with pytest.raises(ParseError):
            docx.parse("x.docx", bad)


def xlsx_bytes(sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        names = "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Shared</t></si><si><r><t>Ri</t></r><r><t>ch</t></r></si></sst>")
        for i, (_, rows) in enumerate(sheets):
            data = "".join("<row>" + "".join(c for c in row) + "</row>" for row in rows)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{data}</sheetData></worksheet>")
    return b.getvalue()


def test_xlsx():
    text = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    num = lambda ref, v: f'<c r="{ref}"><v>{v}</v></c>'
    sales = [[text("A1", "Sales sheet")], [text("A2", "Region"), '<c r="C2" t="s"><v>0</v></c>'], [num("A3", "1"), num("C3", "2")], [], [text("A5", "Name"), text("B5", "Note")], [text("A6", "x"), '<c r="B6" t="b"><v>1</v></c>']]
    _, kind, s = xlsx.parse("/a/book_1.xlsx", xlsx_bytes([("Sales", sales), ("Empty", []), ("Notes", [['<c r="A1" t="s"><v>1</v></c>'], [num("A2", "45000")]])]))
    assert kind == "xlsx" and [x["title"] for x in s] == ["Sales", "Notes"]
    assert [(t["table_id"], t["headers"], t["rows"]) for t in s[0]["tables"]] == [("tbl_001", ["Region", "", "Shared"], [["1", "", "2"]]), ("tbl_002", ["Name", "Note"], [["x", "True"]])]
    assert s[1]["tables"][0]["headers"] == ["Rich"] and s[1]["text"] == "Sheet: Notes\nColumns: Rich\nData:\n45000"
    assert xlsx.column("AB12") == 27 and xlsx.column(None) == 0 and xlsx.is_number("1,200") and not xlsx.is_number("1_0")
    for path, bad in (("x.xls", b"x"), ("x.xlsx", b""), ("x.xlsx", b"z"), ("x.xlsx", xlsx_bytes([("E", [])]))):
        with pytest.raises(ParseError):
            xlsx.parse(path, bad)


def pdf_bytes(lines, deflate=True):
    content = "BT " + " ".join(f"/F{1 + bold} {size} Tf 1 0 0 1 72 {y} Tm ({text}) Tj" for y, size, bold, text in lines) + " ET"
    raw = zlib.compress(content.encode()) if deflate else content.encode()
    head = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> /Contents 4 0 R >> endobj\n"
    fonts = b"5 0 obj << /Type /Font /BaseFont /Helvetica >> endobj\n6 0 obj << /Type /Font /BaseFont /Helvetica-Bold >> endobj\n"
    return head + b"4 0 obj << /Length %d %s>> stream\n" % (len(raw), b"/Filter /FlateDecode " if deflate else b"") + raw + b"\nendstream endobj\n" + fonts


def test_pdf(spark):
    lines = [(700, 24, 1, "Title"), (660, 16, 1, "Part"), (640, 11, 0, "body \\(one\\)"), (625, 11, 0, "body two"), (600, 13, 1, "Sub"), (580, 11, 0, "x"), (560, 11, 0, "y"), (540, 11, 0, "z"), (520, 11.8, 1, "bold small"), (500, 11, 0, "w")]
    for deflate in (True, False):
        title, kind, s = pdf.parse("a.pdf", pdf_bytes(lines, deflate))
        assert (title, kind) == ("Title", "pdf")
        assert [(x["title"], x["level"]) for x in s] == [("Title", 1), ("Part", 2), ("Sub", 3), ("bold small", 1)] and s[1]["text"] == "body (one)\nbody two"
    letters = [("d", 1, float(x), y, c, 10.0, f) for x, y, c, f in ((0, 100.0, "a", "Bold"), (5, 98.0, "b", "x"), (2, 96.5, "c", "x"), (9, 102.0, "d", "x"))]
    got = pdf.lines(spark.createDataFrame(letters, "doc_id string, page int, x double, y double, text string, size double, font string")).orderBy("line_idx").collect()
    assert [r.text for r in got] == ["ad", "cb"] and not got[0].bold  # the anchor is the first letter's baseline
    rows = [("d", i, t, float(z), bool(b)) for i, (_, z, b, t) in enumerate(lines)]
    native = pdf.sections(spark.createDataFrame(rows, "doc_id string, line_idx int, text string, size double, bold boolean")).orderBy("sec_idx").collect()
    assert [(r.title, r.level) for r in native] == [("Title", 1), ("Part", 2), ("Sub", 3), ("bold small", 1)]
    with pytest.raises(ParseError):
        pdf.parse("x.pdf", b"none")


def test_registry(spark, tmp_path):
    registry = ParserRegistry()
    assert registry.get("A.MD").name == "markdown" and not registry.supports("x.pptx")
    with pytest.raises(UnsupportedFormatError, match="pptx"):
        registry.get("x.pptx")
    registry.register(Parser("mine", (".md",), lambda p, c: ("T", "mine", [])), 99)
    assert registry.get("x.md").name == "markdown"
    registry.register(Parser("mine", (".md",), lambda p, c: ("T", "mine", [])), -5)
    assert registry.get("x.md").name == "mine"
    registry.unregister("mine")
    (tmp_path / "in").mkdir()
    for name, content in (("One.md", MD), ("two.csv", "a,b\n1,2"), ("three.html", PAGE), ("bad.csv", "\n,\n"), ("odd.bin", "x")):
        (tmp_path / "in" / name).write_text(content)
    parsed = registry.parse_files(read_files(spark, f"{tmp_path}/in"))
    by = {r.path.rsplit("/", 1)[1]: r for r in parsed.collect()}
    assert by["One.md"].doc_id == "one" and by["two.csv"].sections[0].tables[0].rows == [["1", "2"]]
    assert "no rows" in by["bad.csv"].error and "bin" in by["odd.bin"].error and by["three.html"].error is None
    assert raw_sections(parsed).filter("doc_id = 'one'").count() == 4


def test_archives_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Uptime.md").write_text("# Dienst Größe\nService uptime: 99.9%\n## Support\nThe support desk answers all requests within one day.\n")
    assert cli.main(["convert", f"{tmp_path}/in", f"{tmp_path}/out"], spark) == 0
    with zipfile.ZipFile(tmp_path / "out" / "uptime.udf") as z:
        manifest, catalogue, content = (json.loads(z.read(p)) for p in archive.PARTS)
        assert "Größe" in z.read("manifest.json").decode() and "embeddings.bin" not in z.namelist()
    assert set(manifest) == set("udf_version doc_id title source_format created_at embedding_model embedding_dims quantization section_count intelligence embedding_format owner department tags access_roles version last_updated producer".split())
    assert set(catalogue) == set("doc_id title source language summary insights owner department tags access_roles version last_updated key_numbers section_index embedding_model embedding_dims quantization".split())
    assert (manifest["udf_version"], manifest["section_count"], manifest["quantization"], manifest["access_roles"], catalogue["source"]) == ("1.0", 2, "float16", ["*"], "Uptime.md")
    assert catalogue["key_numbers"] == [{"label": "Service uptime", "value": "99.9%", "unit": "%", "section": "§1"}] and catalogue["section_index"][0]["parent_id"] is None
    assert list(content["sections"]) == ["§1", "§1.1"] and content["sections"]["§1"]["tables"] == []
    capsys.readouterr()
    assert cli.main(["info", f"{tmp_path}/out"], spark) == 0
    assert "2 sections, 1 key numbers" in capsys.readouterr().out
    for where in ("in", "out"):
        assert cli.main(["query", f"{tmp_path}/{where}", "what is the service uptime?", "--no-llm"], spark) == 0
        out = capsys.readouterr().out
        assert "99.9%" in out and "Layer 0" in out
        assert cli.main(["query", f"{tmp_path}/{where}", "when does the support desk answer requests", "--no-llm"], spark) == 0
        assert "Layer 1" in capsys.readouterr().out


def test_archive_rejects_and_vectors(spark):
    def zipped(**parts):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for k, v in parts.items():
                z.writestr(f"{k}.json", v)
        return b.getvalue()

    other = zipped(manifest='{"udf_version": "9.9", "doc_id": "d"}', catalogue="{}", content="{}")
    known = zipped(manifest='{"udf_version": "1.0", "doc_id": "d", "unknown": 1}', catalogue='{"section_index": [{"id": "§1", "title": "T", "level": 1}, {"id": "§2", "title": "U", "level": 1, "summary": ""}]}', content='{"sections": {"§1": {"title": "T", "level": 1, "text": "x"}}}')
    files = spark.createDataFrame([("a", zipped(catalogue="{}", content="{}")), ("b", other), ("c", b"junk"), ("d", known)], "path string, content binary")
    got = archive.unpack(files)
    errors = {r.path: r.error for r in got.collect()}
    assert "manifest" in errors["a"] and "9.9" in errors["b"] and errors["c"] and errors["d"] is None
    rows = archive.sections_of(got).orderBy("sec_idx").collect()
    assert [(r.id, r.text, r.summary, r.children, r.token_count) for r in rows] == [("§1", "x", None, [], 0), ("§2", "", None, [], 0)]
    docs = spark.createDataFrame([("d", "T", "s.md", "md", None, [], None, "now")], "doc_id string, title string, source string, format string, summary string, insights array<string>, meta struct<owner:string,department:string,tags:array<string>,access_roles:array<string>,version:string,last_updated:string>, created_at string")
    sections = rows and archive.sections_of(got)
    numbers = spark.createDataFrame([], "doc_id string, kn_idx int, label string, value string, unit string, section string")
    blocks = spark.createDataFrame([("d", 1, b"BB", "m", 2, "int8"), ("d", 0, b"AA", "m", 2, "int8")], "doc_id string, sec_idx int, bytes binary, model string, dims int, quantization string")
    packed = archive.pack(archive.parts(docs, sections, numbers, embeddings=blocks))
    back = archive.unpack(packed.select(F.lit("p").alias("path"), F.col("archive").alias("content"))).first()
    assert bytes(back.embeddings) == b"AABB" and back.manifest.embedding_dims == 2 and back.catalogue.quantization == "int8"


def test_eval_cases(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"Format": "md", "file": "a.md", "questions": [{"q": "x?", "truth": "y"}, {"q": "z?", "truth": "w"}]}]))
    got = evalcases.read_cases(spark, f"{tmp_path}/c.json").orderBy("nth").collect()
    assert [tuple(r) for r in got] == [("md", "a.md", 0, "x?", "y"), ("md", "a.md", 1, "z?", "w")]


def test_evaluation(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Plan2024.md").write_text("# Plan\nService uptime: 99.9%\n## Team\nThe team moved to the harbour office in spring.\n")
    (tmp_path / "c.json").write_text(json.dumps([{"format": "md", "file": "x/Plan2024.md", "questions": [{"q": "what is the service uptime?", "truth": "Service uptime: 99.9%"}, {"q": "where did the team moved office", "truth": "the harbour office"}, {"q": "weather?", "truth": "rain on 12 days"}]}]))
    parsed, sections, numbers = pipeline.ingest(spark, f"{tmp_path}/in")
    documents = parsed.select("doc_id", "title", F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("insights"))
    sections = sections.withColumn("summary", F.lit(None).cast("string")).cache()
    cases = evalcases.read_cases(spark, f"{tmp_path}/c.json")
    scores, report = evaluate(cases, documents, sections, numbers)
    assert [(r.layer_used, r.score) for r in scores.orderBy("nth").collect()] == [(0, 10), (1, 10), (-1, 0)]
    assert {(r.phase, r.file): r.n for r in report.collect()} == {("md", "x/Plan2024.md"): 3, ("md", None): 3, (None, None): 3}
    graded, _ = evaluate(cases, documents, sections, numbers, lambda p: "a reply", lambda p: f"SCORE: {len(p) % 3}\nREASONING: x")
    assert all(r.score in (0, 1, 2) and r.reason == "x" for r in graded.collect()) and graded.filter("layer_used >= 2").count() == 1


def test_connectors():
    sent = []
    chat = providers.ChatCompletions("http://h/v1/", "m", "k", send=lambda u, b, h: sent.append((u, b, h)) or {"choices": [{"message": {"content": "hi"}}]})
    assert chat("p") == "hi" and sent[0][0] == "http://h/v1/chat/completions" and sent[0][2]["Authorization"] == "Bearer k" and sent[0][1]["max_tokens"] == 1500
    assert providers.Messages("http://h", "m", "k", send=lambda u, b, h: {"content": [{"text": "a"}, {"text": "b"}]})("p") == "ab"
    with pytest.raises(IntelligenceError):
        providers.ChatCompletions("http://h", "m", send=lambda u, b, h: {})("p")
    waits, left = [], [2]

    def flaky(prompt):
        if left[0]:
            left[0] -= 1
            e = IntelligenceError("busy")
            e.transient = True
            raise e
        return "ok"

    assert providers.Retrying(flaky, sleep=waits.append)("p") == "ok" and waits == [1.0, 2.0]
    assert providers.from_settings() is None or True


def test_stream_reindexes_what_changed(spark, tmp_path):
    schema = "doc_id string, sec_idx int, id string, title string, text string"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: reindex(spark, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/index", f"{tmp_path}/cp", stem=None).awaitTermination()
    put(1, [("a", 0, "§1", "t", "one two"), ("b", 0, "§1", "t", "three")])
    run()
    stored = StoredIndex(spark, f"file://{tmp_path}/index", stem=None)
    asked = spark.createDataFrame([(w,) for w in "t one two three four".split()], "term string")
    terms = lambda d: {r.term for r in stored.tokens(asked).filter(F.col("doc_id") == d).collect()}
    assert terms("a") == {"t", "one", "two"} and terms("b") == {"t", "three"}
    put(2, [("a", 0, "§1", "t", "four"), ("b", 0, "§1", "t", "three")])
    run()
    assert terms("a") == {"t", "four"} and terms("b") == {"t", "three"}
    assert {r.doc_id: r.segment for r in stored.registry().collect()} == {"a": 1, "b": 0}
