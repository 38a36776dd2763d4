"""Names from paths, for parsers that run on executors; the same rules as functions.text has for columns."""

from __future__ import annotations

import re

from foliospark.functions.text import SLUG_BOUNDARIES, SLUG_SEPARATORS, TITLE_SEPARATORS


def stem(path: str) -> str:
    name = re.split(r"[/\\]", path)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def title_case(text: str) -> str:
    return " ".join(w if len(w) > 1 and w == w.upper() else w[:1].upper() + w[1:].lower() for w in text.split(" "))


def filename_title(name: str) -> str:
    return title_case(re.sub(TITLE_SEPARATORS, " ", name))


def slug(path: str) -> str:
    s = stem(path)
    for boundary in SLUG_BOUNDARIES:
        s = re.sub(boundary, r"\1-\2", s)
    return re.sub(SLUG_SEPARATORS, "-", s).lower().strip("-")
