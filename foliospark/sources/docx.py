"""Word files: headings by style or look, lists, tables with merged cells."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from foliospark.errors import ParseError
from foliospark.sources import names

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TITLE = "{http://purl.org/dc/elements/1.1/}title"


def _text(node) -> str:
    return "".join(x.text or "" for x in node.iter(f"{NS}t"))


def _val(node, path: str) -> str | None:
    found = node.find("/".join(f"{NS}{p}" for p in path.split("/")))
    return None if found is None else found.get(f"{NS}val", "")


def heading_level(style: str) -> int | None:
    low = style.strip().lower()
    if low in ("title", "subtitle"):
        return 1 if low == "title" else 2
    m = re.fullmatch(r"heading\s*([1-6])", low)
    return int(m[1]) if m else None


def looks_like_heading(paragraph, text: str) -> bool:
    """At most 100 characters, and all capitals, mostly bold, or a lead-in with a colon."""
    if not text or len(text) > 100:
        return False
    if text == text.upper() and any(c.isalpha() for c in text):
        return True
    total = bold = 0
    for run in paragraph.findall(f"{NS}r"):
        n = len(_text(run))
        total += n
        mark = run.find(f"{NS}rPr/{NS}b")
        bold += n * (mark is not None and mark.get(f"{NS}val", "true").lower() not in ("0", "false", "off"))
    return bool(total) and bold / total > 0.5 or text.endswith(":") and not re.search(r"[.?!]", text[:-1])


def grid(table) -> list[list[str]]:
    """Horizontal spans repeated; continued cells copy the one above at the column reached; padded to the widest row."""
    out: list[list[str]] = []
    for row in table.findall(f"{NS}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{NS}tc"):
            across = _val(cell, "tcPr/gridSpan")
            merge = _val(cell, "tcPr/vMerge")
            if merge is not None and merge != "restart" and out:
                value = out[-1][len(cells)] if len(cells) < len(out[-1]) else ""
            else:
                value = _text(cell).strip()
            cells += [value] * (max(1, int(across)) if across and across.isdigit() else 1)
        out.append(cells)
    width = max(map(len, out), default=0)
    return [r + [""] * (width - len(r)) for r in out]


def parse(path: str, content: bytes) -> tuple[str, str, list[dict]]:
    if not content:
        raise ParseError(f"{path} is empty")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ET.fromstring(z.read("word/document.xml")).find(f"{NS}body")
            core = ET.fromstring(z.read("docProps/core.xml")).findtext(TITLE) if "docProps/core.xml" in z.namelist() else None
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise ParseError(f"can't open {path}: {e}") from e
    if body is None:
        raise ParseError(f"{path} has no body")
    out: list[dict] = []

    def start(title: str, level: int) -> None:
        out.append({"title": title, "level": level, "text": "", "tables": []})

    nth, title = 0, None
    for node in body:
        if node.tag == f"{NS}tbl":
            nth += 1
            if cells := grid(node):
                if not out:
                    start("Tables", 1)
                out[-1]["tables"].append({"table_id": f"tbl_{nth:03d}", "caption": None, "headers": cells[0], "rows": cells[1:]})
        elif node.tag == f"{NS}p":
            style, text = _val(node, "pPr/pStyle") or "", _text(node).strip()
            if not text:
                continue
            if title is None and style.lower() in ("title", "heading1"):
                title = text
            level = heading_level(style)
            if level is not None:
                start(text, level)
            elif looks_like_heading(node, text):
                start(text.rstrip(":").strip(), 1)
            else:
                if not out:
                    start("Introduction", 1)
                out[-1]["text"] += f"- {text}\n" if "list" in style.lower() else f"{text}\n\n"
    for s in out:
        s["text"] = s["text"].strip()
    return (core or "").strip() or title or names.filename_title(names.stem(path)), "docx", out
