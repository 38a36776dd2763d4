"""CSV and TSV files as one section with one table."""

from __future__ import annotations

from foliospark.errors import ParseError
from foliospark.sources import names

#: In order of preference.
DELIMITERS = (",", "\t", ";", "|")


def decode(content: bytes) -> str:
    """UTF-8, with or without a mark; Latin-1 if it isn't that."""
    if content.startswith(b"\xef\xbb\xbf"):
        return content[3:].decode("utf-8", "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def detect(text: str) -> str:
    """The delimiter that stands most often outside quotes in the first line; the earlier of equals."""
    first = text[:8192].split("\n", 1)[0]
    outside = "".join(first.split('"')[::2])
    return max(DELIMITERS, key=lambda d: (outside.count(d), -DELIMITERS.index(d)))


def records(text: str, delimiter: str) -> list[list[str]]:
    """RFC 4180 rows: quotes may open inside a field, doubled quotes escape, CR, LF and CRLF end rows, the last row always counts."""
    rows: list[list[str]] = []
    row: list[str] = []
    cell: list[str] = []
    quoted, i, n = False, 0, len(text)
    while i < n:
        # runs without special characters are taken whole
        j = i
        stops = '"' if quoted else f'"\r\n{delimiter}'
        while j < n and text[j] not in stops:
            j += 1
        cell.append(text[i:j])
        if j == n:
            break
        c, i = text[j], j + 1
        if quoted:
            if text[i : i + 1] == '"':
                cell.append('"')
                i += 1
            else:
                quoted = False
        elif c == '"':
            quoted = True
        else:
            row.append("".join(cell))
            cell = []
            if c != delimiter:
                rows.append(row)
                row = []
                i += c == "\r" and text[i : i + 1] == "\n"
    row.append("".join(cell))
    rows.append(row)
    return rows


def fit(rows: list[list[str]], width: int) -> list[list[str]]:
    return [(r + [""] * (width - len(r)))[:width] for r in rows]


def headers_of(row: list[str]) -> list[str]:
    """Trimmed, without empty ones at the end."""
    out = [h.strip() for h in row]
    while out and not out[-1]:
        out.pop()
    return out


def summary(lead: list[str], table: dict) -> str:
    parts = [*lead, f"Columns: {', '.join(table['headers'])}"]
    if table["rows"]:
        parts.append("Data:\n" + "\n".join(" | ".join(r) for r in table["rows"]))
    return "\n".join(parts)


def parse(path: str, content: bytes) -> tuple[str, str, list[dict]]:
    if not content:
        raise ParseError(f"{path} is empty")
    kind = path.rsplit(".", 1)[-1].lower()
    text = decode(content)
    rows = [r for r in records(text, "\t" if kind == "tsv" else detect(text)) if any(c.strip() for c in r)]
    if not rows:
        raise ParseError(f"{path} has no rows")
    headers = headers_of(rows[0])
    if not headers:
        raise ParseError(f"{path} has no headers")
    table = {"table_id": "tbl_001", "caption": None, "headers": headers, "rows": fit(rows[1:], len(headers))}
    stem = names.stem(path)
    title = names.filename_title(stem)
    return title, kind, [{"title": title, "level": 1, "text": summary([f"File: {stem}"], table), "tables": [table]}]
