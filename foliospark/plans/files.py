"""Queries over parsers: files are written from rows of the driver's tables, as bytes, and read by the registered parsers."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.plans import corpus
from foliospark.sources import html
from foliospark.sources.registry import ParserRegistry, raw_sections


def _parsed(files: DataFrame) -> DataFrame:
    return ParserRegistry().parse_files(files)


def _tables(files: DataFrame) -> DataFrame:
    """(doc_id, sec_idx, title, level, text, tables): tables one after the other, rows by / and cells by |."""
    cells = lambda r: F.array_join(r, "|")
    one = lambda t: F.concat(t["table_id"], F.lit("="), F.coalesce(t["caption"], F.lit("")), F.lit("="), cells(t["headers"]), F.lit("/"), F.array_join(F.transform(t["rows"], cells), "/"))
    return raw_sections(_parsed(files)).select("doc_id", "sec_idx", "title", "level", "text", F.array_join(F.transform("tables", one), " & ").alias("tables"))


def _text(key: str, *pieces: str) -> F.Column:
    """Content of a file as one expression: pieces are SQL."""
    return F.expr("concat(" + ", ".join(pieces) + ")").cast("binary").alias("content")


# Each part is one file: by its key it is delimited by commas, semicolons or tabs, with quotes, a short, a long and an empty row.
CSV_MARK = "CASE p_partkey % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END"


def delimited_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.table(spark, sf_dir, "part")
    path = F.expr("concat('/in/part_list', p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '.tsv' ELSE '.csv' END)").alias("path")
    q = "chr(34)"
    content = _text(
        "p_partkey", "'Name'", CSV_MARK, "'Size'", CSV_MARK, "'Note '", CSV_MARK, "chr(13)", "chr(10)", q, "p_name", CSV_MARK, "' '", q, q, "p_brand", q, q, q, CSV_MARK, "CAST(p_size AS string)", CSV_MARK, "'x'", "chr(10)",
        "'short'", "chr(13)", "chr(10)", "p_type", CSV_MARK, "'2'", CSV_MARK, "'3'", CSV_MARK, "'4'", "chr(10)", "' '", CSV_MARK, CSV_MARK, "chr(10)", q, "'two'", "chr(10)", "'lines'", q, CSV_MARK, CSV_MARK, "CAST(p_partkey AS string)",
    )
    return _tables(p.select(path, content))


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part: text before, between and in siblings of headings, and a table with spans both ways."""
    p = corpus.table(spark, sf_dir, "part")
    down, across = "CAST(p_partkey % 3 + 1 AS string)", "CAST(p_partkey % 2 + 1 AS string)"
    content = _text(
        "p_partkey", "'<html><head><title> '", "p_name", "' </title></head><body><p>lead</p><h1>'", "p_name", "'</h1><p>one <b>'", "p_brand", "'</b><p>two</p>tail &amp; end<h2> Table </h2>'", "'<div>before</div><table>'",
        "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('<caption> ', p_type, '</caption>') END", "'<tr><th>A</th><th>B</th><th>C</th></tr><tr><td rowspan='", down, "'>'", "p_brand", "'</td><td colspan='", across, "'>'", "CAST(p_size AS string)", "'</td></tr><tr><td>x<td>y</tr><tr><td>z</td></tr></table>'",
        "'<table><tr><td></td></tr></table><section><h4>Inner</h4>in</section>after</body></html>'",
    )
    return _tables(p.select(F.expr("concat('/www/p', p_partkey, '.htm')").alias("path"), content))


def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of raw pages, as the HTML parser reads them."""
    pages = corpus.table(spark, sf_dir, "pages").select("page_id", "html")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "title": [html.page_title(html.tree(page or ""), "") for page in pdf["html"]]})

    return pages.mapInPandas(run, "page_id bigint, title string")


_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _word_file(r) -> bytes:
    par = lambda t, style="", bold="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:rPr>{bold}</w:rPr><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t, kind="": f"<w:tc><w:tcPr>{kind}</w:tcPr>{par(t)}</w:tc>"
    row = lambda *cells: f"<w:tr>{''.join(cells)}</w:tr>"
    table = "<w:tbl>" + row(cell("Part"), cell("Size"), cell("Kind")) + row(cell(r.p_name, '<w:vMerge w:val="restart"/>'), cell(str(r.p_size)), cell(r.p_type))
    table += row(cell("", "<w:vMerge/>"), cell(r.p_brand, '<w:gridSpan w:val="2"/>')) + row(cell("end")) + "</w:tbl>"
    lead = par("lead in") if r.p_partkey % 2 else ""
    body = lead + par(r.p_name, "Heading1") + par("body of it.") + par("item", "ListBullet") + par(r.p_brand, "heading 2") + table + par("IN CAPITALS") + par("plain text.") + par("Note:") + par("bold words", bold="<w:b/>")
    return _zip({"word/document.xml": f"<w:document {_WORD}><w:body>{body}</w:body></w:document>"})


def _sheet_file(r) -> bytes:
    text = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    num = lambda ref, v: f'<c r="{ref}"><v>{v}</v></c>'
    first = ["".join(x) for x in ([text("A1", "Stock")], [text("A2", "Name"), text("C2", "Size")], [text("A3", r.p_name), num("C3", r.p_size)], [num("A4", r.p_partkey), num("B4", 7)], [text("A6", "Brand"), '<c r="B6" t="s"><v>0</v></c>'], [text("A7", r.p_brand), '<c r="B7" t="b"><v>1</v></c>'])]
    second = [text("A1", r.p_type)] if r.p_partkey % 2 else []
    sheet = lambda rows: f"<worksheet {_SHEET}><sheetData>{''.join(f'<row>{x}</row>' for x in rows)}</sheetData></worksheet>"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return _zip({
        "xl/workbook.xml": f'<workbook {_SHEET} xmlns:r="{rel}"><sheets><sheet name="Parts" r:id="a"/><sheet name="Types" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {_SHEET}><si><r><t>In </t></r><r><t>stock</t></r></si></sst>", "xl/worksheets/s1.xml": sheet(first), "xl/worksheets/s2.xml": sheet(second),
    })


def _office(spark: SparkSession, sf_dir: str, make, path: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(path.format(r.p_partkey), make(r)) for r in pdf.itertuples()], columns=["path", "content"])

    return corpus.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").mapInPandas(run, "path string, content binary")


def docx_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(_office(spark, sf_dir, _word_file, "/docs/Report_{}.docx"))


def xlsx_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(_office(spark, sf_dir, _sheet_file, "/docs/Book_{}.xlsx"))


def parser_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file name gets: the parser's format, or the error; broken and unknown files don't stop the others."""
    p = corpus.table(spark, sf_dir, "part")
    kinds = ["md", "MARKDOWN", "csv", "html", "docx", "xls", "xlsx", "pdf", "txt", ""]
    name = F.concat(F.lit("/in/f"), F.col("p_partkey"), F.element_at(F.array(*[F.lit(f".{k}" if k else "") for k in kinds]), (F.col("p_partkey") % len(kinds) + 1).cast("int")))
    out = _parsed(p.select(name.alias("path"), F.concat(F.lit("a,b\n1,"), "p_name").cast("binary").alias("content")))
    return out.select("path", "doc_id", "title", "format", F.size("sections").alias("n_sections"), F.col("error").isNotNull().alias("failed"))


QUERIES = {f.__name__: f for f in (delimited_sections, html_tables, html_title, docx_sections, xlsx_tables, parser_registry)}

_P = "q AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_type AS t, p_size AS s FROM part)"
_ROWS = "CAST({i} AS INTEGER) AS sec_idx, {title} AS title, CAST({level} AS INTEGER) AS level, {text} AS text, {tables} AS tables"
_NL = "chr(10)"


def _section(doc: str, i: str, title: str, level: int, text: str, tables: str = "''", where: str = "true") -> str:
    return f"SELECT {doc} AS doc_id, " + _ROWS.format(i=i, title=title, level=level, text=text, tables=tables) + f" FROM q WHERE {where}"


def unescaped(c: str) -> str:
    """The pages' character references, which may lack their semicolon."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("#39", "''"), ("amp", "&")):
        c = f"regexp_replace({c}, '&{name};?', '{char}', 'g')"
    return c


_TITLE = "trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))"
_NAME = "(n || CASE k % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END || ' \"' || b || '\"')"
_GRID = """CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN b || '|' || s || '|/x|y|/z||' WHEN k % 3 = 0 THEN b || '|' || s || '|' || s || '/x|y|/z||'
  WHEN k % 3 = 1 AND k % 2 = 0 THEN b || '|' || s || '|/' || b || '|x|y/z||' WHEN k % 3 = 1 THEN b || '|' || s || '|' || s || '/' || b || '|x|y/z||'
  WHEN k % 2 = 0 THEN b || '|' || s || '|/' || b || '|x|y/' || b || '|z|' ELSE b || '|' || s || '|' || s || '/' || b || '|x|y/' || b || '|z|' END"""

ORACLES = {
    "delimited_sections": f"WITH {_P} " + _section(
        "'part-list-' || k", "0", "'Part List' || k", 1,
        f"'File: part_list' || k || {_NL} || 'Columns: Name, Size, Note' || {_NL} || 'Data:' || {_NL} || {_NAME} || ' | ' || s || ' | x' || {_NL} || 'short |  | ' || {_NL} || t || ' | 2 | 3' || {_NL} || 'two' || {_NL} || 'lines |  | ' || k",
        f"'tbl_001==Name|Size|Note/' || {_NAME} || '|' || s || '|x/short||/' || t || '|2|3/two' || {_NL} || 'lines||' || k",
    ),
    "html_tables": f"WITH {_P} " + " UNION ALL ".join([
        _section("'p-' || k", "0", "trim(n)", 1, "'one ' || b || ' two tail & end'"),
        _section("'p-' || k", "1", "'Table'", 2, "'before Innerin after'", f"'tbl_001=' || CASE WHEN k % 4 = 0 THEN '' ELSE t END || '=A|B|C/' || {_GRID}"),
        _section("'p-' || k", "2", "'Inner'", 4, "'in'"),
    ]),
    "html_title": f"""SELECT page_id, trim({unescaped(f"CASE WHEN {_TITLE} <> '' THEN {_TITLE} ELSE trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) END")}) AS title FROM pages""",
    "docx_sections": f"WITH {_P} " + " UNION ALL ".join([
        _section("'report-' || k", "0", "'Introduction'", 1, "'lead in'", where="k % 2 = 1"),
        _section("'report-' || k", "k % 2", "n", 1, f"'body of it.' || {_NL} || {_NL} || '- item'"),
        _section("'report-' || k", "k % 2 + 1", "b", 2, "''", "'tbl_001==Part|Size|Kind/' || n || '|' || s || '|' || t || '/' || n || '|' || b || '|' || b || '/end||'"),
        _section("'report-' || k", "k % 2 + 2", "'IN CAPITALS'", 1, "'plain text.'"), _section("'report-' || k", "k % 2 + 3", "'Note'", 1, "''"), _section("'report-' || k", "k % 2 + 4", "'bold words'", 1, "''"),
    ]),
    "xlsx_tables": f"WITH {_P} " + " UNION ALL ".join([
        _section(
            "'book-' || k", "0", "'Parts'", 1,
            f"'Sheet: Parts' || {_NL} || 'Columns: Name, , Size' || {_NL} || 'Data:' || {_NL} || n || ' |  | ' || s || {_NL} || k || ' | 7 | ' || {_NL} || 'Sheet: Parts' || {_NL} || 'Columns: Brand, In stock' || {_NL} || 'Data:' || {_NL} || b || ' | True'",
            "'tbl_001==Name||Size/' || n || '||' || s || '/' || k || '|7| & tbl_002==Brand|In stock/' || b || '|True'",
        ),
        _section("'book-' || k", "1", "'Types'", 1, f"'Sheet: Types' || {_NL} || 'Columns: ' || t", "'tbl_003==' || t || '/'", "k % 2 = 1"),
    ]),
    "parser_registry": """WITH q AS (SELECT p_partkey AS k, ['md', 'MARKDOWN', 'csv', 'html', 'docx', 'xls', 'xlsx', 'pdf', 'txt', ''][p_partkey % 10 + 1] AS x FROM part)
SELECT '/in/f' || k || CASE WHEN x = '' THEN '' ELSE '.' || x END AS path, 'f-' || k AS doc_id, CASE k % 10 WHEN 0 THEN 'f' || k WHEN 1 THEN 'f' || k WHEN 2 THEN 'F' || k WHEN 3 THEN 'F' || k END AS title, CASE k % 10 WHEN 0 THEN 'md' WHEN 1 THEN 'md' WHEN 2 THEN 'csv' WHEN 3 THEN 'html' END AS format,
CAST(CASE WHEN k % 10 < 4 THEN 1 END AS INTEGER) AS n_sections, k % 10 > 3 AS failed FROM q""",
}
