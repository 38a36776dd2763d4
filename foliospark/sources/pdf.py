"""PDF files: letters to lines, and headings by font size.

Lines and headings are the operator; letters come from a reader. The one here reads pages whose text uses simple fonts
(one byte a character) in plain or deflated content streams; `parse` takes any other reader as an argument.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.errors import ParseError
from foliospark.sources import names

# Baseline tolerance in points, and sizes over the median that make a heading.
TOLERANCE, HEADING, BOLD_HEADING, BOLD_CHARS = 3.0, 1.15, 1.05, 100

Letter = tuple[int, float, float, str, float, str]  # page, x, baseline, text, size, font


def upper_median(values: list[float]) -> float:
    return sorted(values)[len(values) // 2]


def lines_of(letters: list[tuple[float, float, str, float, str]]) -> list[tuple[str, float, bool]]:
    """(text, size, bold) of one page's letters (x, baseline, text, size, font), from the top.

    A letter more than TOLERANCE from the baseline of a line's first letter starts the next line.
    """
    groups: list[list] = []
    anchor = None
    for letter in sorted(letters, key=lambda l: -l[1]):
        if anchor is None or abs(letter[1] - anchor) > TOLERANCE:
            groups.append([])
            anchor = letter[1]
        groups[-1].append(letter)
    out = []
    for group in groups:
        group.sort(key=lambda l: l[0])
        text = "".join(l[2] for l in group).strip()
        if text:
            bold = sum("bold" in (l[4] or "").lower() for l in group)
            out.append((text, round(upper_median([l[3] for l in group]), 1), bold * 2 > len(group)))
    return out


def lines(letters: DataFrame) -> DataFrame:
    """(doc_id, page, line_idx, text, size, bold) from (doc_id, page, x, y, text, size, font), page by page."""
    kind = letters.schema["doc_id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = lines_of(list(pdf[["x", "y", "text", "size", "font"]].itertuples(index=False, name=None)))
        out = pd.DataFrame(rows, columns=["text", "size", "bold"])
        out.insert(0, "doc_id", pdf["doc_id"].iloc[0])
        out.insert(1, "page", pdf["page"].iloc[0])
        out.insert(2, "line_idx", range(len(out)))
        return out

    return letters.groupBy("doc_id", "page").applyInPandas(one, f"doc_id {kind}, page int, line_idx int, text string, size double, bold boolean")


def sections(pdf_lines: DataFrame) -> DataFrame:
    """(doc_id, sec_idx, title, level, text) from (doc_id, line_idx, text, size, bold), with windows.

    Headings are lines from HEADING times the median size, or bold ones a little smaller; their level is the rank of
    their size among heading sizes, 6 at most, and 1 for bold ones below. The median is the upper one.
    """
    whole = W.partitionBy("doc_id")
    place = F.row_number().over(whole.orderBy("size")) - 1
    rows = pdf_lines.withColumn("p_", place).withColumn("n_", F.count("*").over(whole))
    rows = rows.withColumn("median", F.max(F.when(F.col("p_") == F.floor(F.col("n_") / 2), F.col("size"))).over(whole))
    large = F.col("size") >= F.col("median") * HEADING
    bold = F.col("bold") & (F.col("size") >= F.col("median") * BOLD_HEADING) & (F.length("text") < BOLD_CHARS)
    rows = rows.filter(F.col("text") != "").withColumn("head", large | bold)
    rank = F.dense_rank().over(whole.orderBy(F.when(large, F.col("size")).desc_nulls_last()))
    rows = rows.withColumn("level", F.when(large, F.least(rank, F.lit(6))).otherwise(1))
    rows = rows.withColumn("sec", F.sum(F.col("head").cast("int")).over(whole.orderBy("line_idx").rowsBetween(W.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_idx", "text")))), lambda x: x["text"]), "\n")
    out = rows.groupBy("doc_id", "sec").agg(F.max(F.when(F.col("head"), F.col("text"))).alias("title"), F.max(F.when(F.col("head"), F.col("level"))).alias("level"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("text"))
    out = out.withColumn("sec_idx", F.row_number().over(whole.orderBy("sec")) - 1)
    return out.select("doc_id", "sec_idx", F.coalesce("title", F.lit("Introduction")).alias("title"), F.coalesce("level", F.lit(1)).alias("level"), "text")


def headings(found: list[tuple[str, float, bool]]) -> list[dict]:
    """The same for one file's lines."""
    if not found:
        return []
    median = upper_median([s for _, s, _ in found])
    sizes = sorted({s for _, s, _ in found if s >= median * HEADING}, reverse=True)
    out: list[dict] = []
    for text, size, bold in found:
        if size >= median * HEADING or bold and size >= median * BOLD_HEADING and len(text) < BOLD_CHARS:
            out.append({"title": text, "level": min(sizes.index(size) + 1, 6) if size in sizes else 1, "text": ""})
            continue
        if not out:
            out.append({"title": "Introduction", "level": 1, "text": ""})
        out[-1]["text"] += text + "\n"
    return [{**s, "text": s["text"].strip()} for s in out]


def read_letters(content: bytes) -> list[Letter]:
    """Letters of a file with simple fonts."""
    objects: dict[int, bytes] = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content, re.DOTALL)}
    refs = lambda raw: [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", raw)]

    def stream(n: int) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", objects.get(n, b""), re.DOTALL)
        if not m:
            return b""
        head = objects[n][: m.start()]
        if b"/FlateDecode" not in head:
            return m[1]
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error as e:
            raise ParseError(f"broken stream: {e}") from e

    fonts = {n: f[1].decode("latin-1") for n, raw in objects.items() if (f := re.search(rb"/BaseFont\s*/([^\s/<>\[\]()]+)", raw))}
    out: list[Letter] = []
    pages = [n for n, raw in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", raw)]
    for page, n in enumerate(pages):
        raw = objects[n]
        named = raw + b" ".join(objects.get(i, b"") for i in refs((re.search(rb"/Resources\s+\d+\s+\d+\s+R", raw) or [b""])[0]))
        named += b" ".join(objects.get(i, b"") for i in refs((re.search(rb"/Font\s+\d+\s+\d+\s+R", named) or [b""])[0]))
        names_ = {m[1].decode("latin-1"): fonts.get(int(m[2]), "") for m in re.finditer(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", named)}
        where = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", raw)
        out += _show(page, b"\n".join(stream(i) for i in refs(where[1])) if where else b"", names_)
    return out


_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        h = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode()).decode("cp1252", "replace")
    plain = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else _ESCAPES.get(m[1], b"" if m[1].strip() == b"" else m[1]), token[1:-1], flags=re.DOTALL)
    return plain.decode("cp1252", "replace")


def _show(page: int, content: bytes, fonts: dict[str, str]) -> list[Letter]:
    """Follows the text operators of a content stream. Widths are taken as half an em: only the order of letters matters."""
    out: list[Letter] = []
    stack: list[bytes] = []
    font, size, leading = "", 0.0, 0.0
    line, at, scale = (0.0, 0.0), [0.0, 0.0], 1.0
    base: list[tuple[float, float]] = []
    cm = (0.0, 0.0)

    def write(token: bytes) -> None:
        for c in _string(token):
            out.append((page, cm[0] + at[0], cm[1] + at[1], c, size * scale, font))
            at[0] += size * scale * 0.5

    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/" or t[:1].isdigit() or t[:1] in b"+-.":
            stack.append(t)
            continue
        number = lambda k: float(stack[-k])
        try:
            if t == b"Tf":
                font, size = fonts.get(stack[-2][1:].decode("latin-1"), ""), number(1)
            elif t == b"BT":
                line, at, scale = (0.0, 0.0), [0.0, 0.0], 1.0
            elif t in (b"Td", b"TD"):
                leading = -number(1) if t == b"TD" else leading
                line = (line[0] + number(2) * scale, line[1] + number(1) * scale)
                at = list(line)
            elif t == b"Tm":
                line, scale = (number(2), number(1)), abs(number(3)) or 1.0
                at = list(line)
            elif t == b"TL":
                leading = number(1)
            elif t in (b"T*", b"'", b'"'):
                line = (line[0], line[1] - leading * scale)
                at = list(line)
                if t != b"T*":
                    write(stack[-1])
            elif t == b"Tj":
                write(stack[-1])
            elif t == b"TJ":
                start = len(stack) - 1 - stack[::-1].index(b"[")
                for part in stack[start + 1 : -1]:
                    if part[:1] in b"(<":
                        write(part)
                    else:
                        at[0] -= float(part) / 1000 * size * scale
            elif t == b"cm":
                cm = (cm[0] + number(2), cm[1] + number(1))
            elif t == b"q":
                base.append(cm)
            elif t == b"Q" and base:
                cm = base.pop()
        except (IndexError, ValueError) as e:
            raise ParseError(f"broken operator {t!r}") from e
        stack = []
    return out


def parse(path: str, content: bytes, letters: Callable[[bytes], list[Letter]] = read_letters) -> tuple[str, str, list[dict]]:
    if not content.startswith(b"%PDF"):
        raise ParseError(f"{path} is no PDF file")
    found: list[tuple[str, float, bool]] = []
    by_page: dict[int, list] = {}
    for page, *letter in letters(content):
        by_page.setdefault(page, []).append(tuple(letter))
    for page in sorted(by_page):
        found += lines_of(by_page[page])
    title = max(found, key=lambda l: l[1])[0] if found else names.filename_title(names.stem(path))
    return title, "pdf", headings(found)
