"""Embedding and reranking seams: Arrow-batched functions around any model.

An embedder is a callable list[str] -> array of shape (n, d); a scorer is (list[str], list[str]) -> n scores. The ONNX
ones load a local model file in each worker once; no model is fetched.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.errors import EmbedError
from foliospark.functions import vectors
from foliospark.functions.wordpiece import WordPiece

BATCH, MAX_TOKENS = 32, 256
PAIR_BATCH, PAIR_TOKENS = 16, 320


def embed_sections(sections: DataFrame, embed: Callable, batch: int = BATCH) -> DataFrame:
    """(doc_id, sec_idx, vec): vectors of "title text", of length one."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out = []
            for at in range(0, len(s), batch):
                got = embed(list(s[at : at + batch]))
                if len(got) != len(s[at : at + batch]):
                    raise EmbedError("the model returned another number of vectors than of texts")
                out.extend(list(map(float, v)) for v in got)
            yield pd.Series(out, index=s.index)

    joined = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    return sections.select("doc_id", "sec_idx", run(joined).alias("raw")).select("doc_id", "sec_idx", vectors.normalized(F.col("raw")).alias("vec"))


def model_files(folder: str, name: str = "model") -> tuple[str, str]:
    """Where a folder's model and vocabulary are expected; nothing is fetched."""
    return os.path.join(folder, f"{name}.onnx"), os.path.join(folder, f"{name}.vocab.txt")


def model_present(folder: str, name: str = "model") -> bool:
    return all(map(os.path.isfile, model_files(folder, name)))


@functools.lru_cache(maxsize=4)
def _session(model: str, vocabulary: str):
    import onnxruntime

    with open(vocabulary, encoding="utf-8") as f:
        return onnxruntime.InferenceSession(model), WordPiece(f.read().splitlines())


def _padded(rows: list[list[int]], fill: int):
    import numpy as np

    out = np.full((len(rows), max(map(len, rows))), fill, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _run(session, ids, types, mask):
    feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": types}
    wanted = {i.name for i in session.get_inputs()}
    return session.run(None, {k: v for k, v in feeds.items() if k in wanted})[0]


def onnx_embedder(model: str, vocabulary: str) -> Callable:
    """Mean of the token vectors under the attention mask, from model and vocabulary files that every executor has."""

    def embed(texts: list[str]):
        import numpy as np

        session, tokenizer = _session(model, vocabulary)
        rows = [tokenizer.encode(t, MAX_TOKENS) for t in texts]
        ids = _padded(rows, tokenizer.pad)
        mask = _padded([[1] * len(r) for r in rows], 0)
        hidden = _run(session, ids, np.zeros_like(ids), mask)
        return (hidden * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)

    return embed


def onnx_scorer(model: str, vocabulary: str) -> Callable:
    """A cross-encoder's logit for each question and passage, as search.rerank takes it."""

    def score(questions: pd.Series, passages: pd.Series) -> pd.Series:
        session, tokenizer = _session(model, vocabulary)
        out: list[float] = []
        for at in range(0, len(questions), PAIR_BATCH):
            pairs = [tokenizer.encode_pair(q, p, PAIR_TOKENS) for q, p in zip(questions[at : at + PAIR_BATCH], passages[at : at + PAIR_BATCH])]
            ids, types = _padded([i for i, _ in pairs], tokenizer.pad), _padded([t for _, t in pairs], 0)
            mask = _padded([[1] * len(i) for i, _ in pairs], 0)
            out.extend(_run(session, ids, types, mask).reshape(len(pairs), -1)[:, 0].tolist())
        return pd.Series(out, index=questions.index)

    return score
