"""WordPiece ids for text and for pairs of texts, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

MAX_CHARS = 200


class WordPiece:
    """Greedy longest match; words over 200 characters or without a match are unknown."""

    def __init__(self, vocabulary: list[str]):
        self.ids = {w.strip(): i for i, w in enumerate(vocabulary)}
        self.cls, self.sep, self.pad, self.unk = (self.ids.get(t, 0) for t in ("[CLS]", "[SEP]", "[PAD]", "[UNK]"))

    def words(self, text: str | None) -> list[str]:
        """Lower-case runs of letters and digits; any other character but white space is a word of its own."""
        out: list[str] = []
        joined = False
        for c in (text or "").lower():
            if c.isalnum():
                if joined:
                    out[-1] += c
                else:
                    out.append(c)
                joined = True
            else:
                joined = False
                if not c.isspace():
                    out.append(c)
        return out

    def pieces(self, word: str) -> list[int]:
        if len(word) > MAX_CHARS:
            return [self.unk]
        found, at = [], 0
        while at < len(word):
            mark = "##" if at else ""
            end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in self.ids), None)
            if end is None:
                return [self.unk]
            found.append(self.ids[mark + word[at:end]])
            at = end
        return found

    def _all(self, text: str | None) -> list[int]:
        return [i for w in self.words(text) for i in self.pieces(w)]

    def encode(self, text: str | None, most: int) -> list[int]:
        return [self.cls, *self._all(text)[: max(0, most - 2)], self.sep][:most]

    def encode_pair(self, query: str | None, passage: str | None, most: int) -> tuple[list[int], list[int]]:
        """Ids and segments; both separators always fit."""
        first = [self.cls, *self._all(query)[: max(0, most - 3)], self.sep]
        second = [*self._all(passage)[: max(0, most - 1 - len(first))], self.sep]
        return first + second, [0] * len(first) + [1] * len(second)


def encode_udf(vocabulary: list[str], most: int):
    tokenizer = WordPiece(vocabulary)

    @F.pandas_udf("array<bigint>")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda t: tokenizer.encode(t, most))

    return encode
