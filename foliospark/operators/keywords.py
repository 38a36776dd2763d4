"""Keywords of sections, within the row: sorting replaces counting by shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import text, words


def keywords(title: Column, body: Column, k: int = 8) -> Column:
    """Up to k words: the title's in order, then the body's by count plus a tenth of the length, ties by first place."""
    stop = text.strings(words.KEYWORD_STOP)
    tokens = lambda c: F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9][a-z0-9-]{2,})"), 1), lambda w: ~F.array_contains(stop, w))
    ordered = lambda c: F.array_sort(F.transform(tokens(c), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    first = lambda s: F.filter(F.transform(s, lambda x, j: F.struct(x["w"].alias("w"), x["i"].alias("i"), j.alias("j"))), lambda x: (x["j"] == 0) | (F.get(s, x["j"] - 1)["w"] != x["w"]))
    count = lambda s, f, n: F.coalesce(F.get(f, n + 1)["j"], F.size(s)) - f[n]["j"]
    score = lambda s, f: F.transform(f, lambda x, n: F.struct((-(count(s, f, n).cast("double") + F.lit(0.1) * F.length(x["w"]).cast("double"))).alias("o"), x["i"].alias("i"), x["w"].alias("w")))
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    ranked = bind(ordered(body), lambda s: bind(first(s), lambda f: F.transform(F.array_sort(score(s, f)), lambda x: x["w"])))
    return F.slice(F.array_distinct(F.concat(tokens(title), ranked)), 1, k)
