"""Excel files: one section per sheet, stacked tables told apart."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from foliospark.errors import ParseError
from foliospark.sources import names
from foliospark.sources.delimited import fit, headers_of, summary

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def column(reference: str | None) -> int:
    """0-based column of a cell reference."""
    n = 0
    for c in re.match(r"[A-Za-z]*", reference or "")[0].upper():
        n = n * 26 + ord(c) - 64
    return max(n - 1, 0)


def _value(cell, shared: list[str]) -> str:
    raw, kind = cell.findtext(f"{NS}v") or "", cell.get("t")
    if kind == "s":
        return shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
    if kind == "inlineStr":
        plain = cell.findtext(f"{NS}is/{NS}t")
        return plain if plain is not None else "".join(x.text or "" for x in cell.iter(f"{NS}t")).strip()
    return ("True" if raw == "1" else "False") if kind == "b" else raw


def sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) in workbook order; rows are as wide as the widest, rows that aren't there aren't made up."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        there = set(z.namelist())
        shared = [] if "xl/sharedStrings.xml" not in there else ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
        out = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{NS}sheet"):
            target = targets.get(sheet.get(REL))
            if target is None:
                out.append((sheet.get("name", "Sheet"), []))
                continue
            data = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).find(f"{NS}sheetData")
            rows = [{column(c.get("r")): _value(c, shared) for c in row.findall(f"{NS}c")} for row in ([] if data is None else data.findall(f"{NS}row"))]
            width = max((max(r, default=0) for r in rows), default=-1) + 1
            out.append((sheet.get("name", "Sheet"), [[r.get(c, "") for c in range(width)] for r in rows]))
        return out


def is_number(cell: str) -> bool:
    s = cell.strip().replace(",", "")
    try:
        return bool(s) and "_" not in s and float(s) is not None
    except ValueError:
        return False


def _filled(row: list[str]) -> list[str]:
    return [c.strip() for c in row if c.strip()]


def looks_like_header(row: list[str]) -> bool:
    cells = _filled(row)
    return len(cells) >= 2 and sum(not is_number(c) for c in cells) >= len(cells) * 0.5 and sum(map(len, cells)) / len(cells) <= 50


def mostly_numbers(row: list[str]) -> bool:
    cells = _filled(row)
    return bool(cells) and sum(map(is_number, cells)) >= len(cells) * 0.5


def split_tables(rows: list[list[str]]) -> list[tuple[list[str], list[list[str]]]]:
    """(header, data) of stacked tables: a header-like row after a numeric one starts the next."""
    first = next((i for i, r in enumerate(rows) if len(_filled(r)) >= 2), 0)
    out: list[tuple[list[str], list[list[str]]]] = []
    numeric = False
    for row in rows[first:]:
        if not out or numeric and out[-1][1] and looks_like_header(row):
            out.append((row, []))
            numeric = False
        else:
            out[-1][1].append(row)
            numeric = mostly_numbers(row)
    return out


def parse(path: str, content: bytes) -> tuple[str, str, list[dict]]:
    if path.lower().endswith(".xls"):
        raise ParseError(f"{path}: the old binary format isn't supported; save it as .xlsx")
    if not content:
        raise ParseError(f"{path} is empty")
    try:
        found = sheets(content)
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise ParseError(f"can't open {path}: {e}") from e
    out, nth = [], 0
    for name, every in found:
        tables = []
        for header, data in split_tables([r for r in every if _filled(r)]):
            nth += 1
            if headers := headers_of(header):
                tables.append({"table_id": f"tbl_{nth:03d}", "caption": None, "headers": headers, "rows": fit(data, len(headers))})
        if tables:
            out.append({"title": name, "level": 1, "text": "\n".join(summary([f"Sheet: {name}"], t) for t in tables), "tables": tables})
    if not out:
        raise ParseError(f"{path} has no sheet with data")
    return names.filename_title(names.stem(path)), "xlsx", out
