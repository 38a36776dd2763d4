"""Parsers by file name, and parsing whole folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.errors import ParseError, UnsupportedFormatError
from foliospark.schema import PARSED
from foliospark.sources import delimited, docx, html, markdown, pdf, xlsx

#: What a parser makes of a file: (title, format, sections), from (path, content).
Parse = Callable[[str, bytes], tuple[str, str, list[dict]]]


@dataclass
class Parser:
    """A format: its file name endings and the function for a file's content."""

    name: str
    endings: tuple[str, ...]
    parse: Parse

    def supports(self, path: str) -> bool:
        return path.lower().endswith(self.endings)


def default_parsers() -> list[Parser]:
    return [
        Parser("markdown", (".md", ".markdown"), markdown.parse), Parser("delimited", (".csv", ".tsv"), delimited.parse), Parser("html", (".html", ".htm"), html.parse),
        Parser("docx", (".docx",), docx.parse), Parser("xlsx", (".xlsx", ".xls"), xlsx.parse), Parser("pdf", (".pdf",), pdf.parse),
    ]


@dataclass
class ParserRegistry:
    """Parsers in order; the first that supports a path is used."""

    parsers: list[Parser] = field(default_factory=default_parsers)

    def register(self, parser: Parser, position: int = 0) -> None:
        self.parsers.insert(max(0, min(position, len(self.parsers))), parser)

    def unregister(self, name: str) -> None:
        self.parsers = [p for p in self.parsers if p.name != name]

    def supports(self, path: str) -> bool:
        return any(p.supports(path) for p in self.parsers)

    def get(self, path: str) -> Parser:
        for p in self.parsers:
            if p.supports(path):
                return p
        ending = path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
        raise UnsupportedFormatError(f"no parser for '.{ending}' ({path})")

    def parse_files(self, files: DataFrame) -> DataFrame:
        """One row per file of (path, content), as schema.PARSED; what goes wrong with a file is in its error column."""
        parsers = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf_ in batches:
                yield pd.DataFrame([parsers.parse_one(p, c) for p, c in zip(pdf_["path"], pdf_["content"])], columns=["path", "title", "format", "sections", "error"])

        from foliospark.functions import text

        schema = ", ".join(c for c in _top_level(PARSED) if c.split()[0] not in ("doc_id", "source"))
        out = files.select("path", "content").mapInPandas(run, schema)
        return out.select("path", text.doc_slug(F.col("path")).alias("doc_id"), "title", F.col("path").alias("source"), "format", "sections", "error")

    def parse_one(self, path: str, content: bytes) -> tuple:
        try:
            title, kind, sections = self.get(path).parse(path, bytes(content))
            return path, title, kind, [{"tables": [], **s} for s in sections], None
        except (ParseError, UnsupportedFormatError) as e:
            return path, None, None, None, str(e)


def _top_level(ddl: str) -> list[str]:
    """The fields of a DDL string, cut at its outer commas."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[last:i].strip())
            last = i + 1
    return [*out, ddl[last:].strip()]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files in a folder or glob, by any store that Spark reads. Its scan leaves out empty files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def raw_sections(parsed: DataFrame) -> DataFrame:
    """(doc_id, sec_idx, title, level, text, tables, images), one row for each section of the files that could be parsed."""
    rows = parsed.filter("error IS NULL").select("doc_id", F.posexplode("sections").alias("sec_idx", "s"))
    none = F.array().cast("array<struct<image_id:string,alt:string,asset_path:string>>")
    return rows.select("doc_id", "sec_idx", "s.title", "s.level", "s.text", F.coalesce("s.tables", F.array()).alias("tables"), none.alias("images"))
