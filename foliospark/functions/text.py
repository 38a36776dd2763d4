"""Text expressions: tokens, counts, titles, slugs. Everything here is a built-in Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import words

LINE_END = r"\r\n|[\r\n\f\x{85}\x{2028}\x{2029}]"

# Where names are cut into words, and what separates them, in slugs and titles.
SLUG_BOUNDARIES = ("([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])")
SLUG_SEPARATORS, TITLE_SEPARATORS = r"[\s_-]+", "[-_]+"


def strings(items: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in items])


def lines(text: Column) -> Column:
    """Lines by any line ending; null and empty text have none."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, LINE_END, -1))


def word_count(text: Column) -> Column:
    """White-space separated words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def token_count(text: Column) -> Column:
    """Words times 1.3, cut to a whole number."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("int")


def title_case(text: Column) -> Column:
    """Each word with a capital first letter; words all in capitals stay as they are."""
    one = lambda w: F.when((F.upper(w) == w) & (F.length(w) > 1), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(F.transform(F.split(text, " ", -1), one), " ")


def filename_title(stem: Column) -> Column:
    return title_case(F.regexp_replace(stem, TITLE_SEPARATORS, " "))


def stem(path: Column) -> Column:
    """File name without folders and last extension."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def doc_slug(path: Column) -> Column:
    """Hyphens at case and digit boundaries and for separators; lower case."""
    s = stem(path)
    for boundary in SLUG_BOUNDARIES:
        s = F.regexp_replace(s, boundary, "$1-$2")
    return F.regexp_replace(F.lower(F.regexp_replace(s, SLUG_SEPARATORS, "-")), "^-+|-+$", "")


def source_label(source: Column, keep_full: bool = False) -> Column:
    """The base name of a path; URLs, and names that are nothing but separators, as they are."""
    if keep_full:
        return source
    base = F.regexp_extract(F.regexp_replace(F.regexp_replace(source, r"\\", "/"), "/+$", ""), "([^/]*)$", 1)
    return F.when(source.contains("://") | (base == ""), source).otherwise(base)


def retrieval_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and hyphens over one character long."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9-]", " ")
    return F.filter(F.split(clean, " +"), lambda w: F.length(w) > 1)


def query_units(question: Column) -> Column:
    """What a question searches for: its keywords, else all tokens, else the whole question."""
    full = retrieval_tokens(question)
    keywords = F.filter(full, lambda w: (F.length(w) > 2) & ~F.array_contains(strings(words.RETRIEVAL_STOP), w))
    return F.when(F.size(keywords) > 0, keywords).when(F.size(full) > 0, full).otherwise(F.array(F.coalesce(question, F.lit(""))))


def index_tokens(text: Column) -> Column:
    """Tokens of the index: ASCII letters in lower case, digits and all characters beyond ASCII."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda w: w != "")


def alnum_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def content_tokens(question: Column) -> Column:
    """Distinct tokens of a question over two characters long that carry content."""
    keep = lambda w: (F.length(w) > 2) & ~F.array_contains(strings(words.QUESTION_FILLERS), w)
    return F.array_distinct(F.filter(alnum_tokens(question), keep))


def singular_tokens(text: Column) -> Column:
    """Tokens without a plural s, as labels and questions are matched."""
    return F.transform(alnum_tokens(text), lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def contains_any(text: Column, markers: list[str]) -> Column:
    return F.exists(strings(markers), lambda m: F.contains(text, m))
