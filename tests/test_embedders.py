"""Embedding in batches with a stand-in model."""

import pytest

from foliospark import embedders


def test_sections_are_embedded_in_batches(spark):
    words = ["alpha", "beta"]
    df = spark.createDataFrame([("d", i, "alpha" if i % 2 else None, "beta " * (i % 3)) for i in range(10)], "doc_id string, sec_idx int, title string, text string")

    def embed(texts):
        assert len(texts) <= 3
        return [[float(t.count(w)) for w in words] for t in texts]

    got = {r.sec_idx: list(r.vec) for r in embedders.embed_sections(df, embed, batch=3).collect()}
    assert got[0] == [0.0, 0.0] and got[1] == pytest.approx([2**-0.5, 2**-0.5]) and got[2] == [0.0, 1.0] and got[3] == [1.0, 0.0]
