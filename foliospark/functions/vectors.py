"""Vector expressions: similarity, normalisation, quantisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.errors import QuantizationError

MODES = ("float32", "float16", "int8", "binary")


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length, in double."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the shorter length; 0 if either norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(x, y) / norms)


def normalized(v: Column) -> Column:
    """Length one; vectors of a length up to 1e-12 stay as they are."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm <= 1e-12, v).otherwise(F.transform(v, lambda x: (x / norm).cast("float")))


def int8(v: Column) -> Column:
    """Components times 127 over the largest, in float32 arithmetic, cut toward zero."""
    most = F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(0.0).cast("float"))
    scale = (F.lit(127.0).cast("double") / (most + F.lit(1e-8).cast("float")).cast("double")).cast("float")
    cut = lambda x: F.least(F.greatest(x * scale, F.lit(-127.0).cast("float")), F.lit(127.0).cast("float")).cast("int")
    return F.transform(v, cut)


def from_int8(v: Column) -> Column:
    """Components over 127; the scale isn't restored."""
    return F.transform(v, lambda x: (x.cast("double") / F.lit(127.0)).cast("float"))


def binary_bits(v: Column) -> Column:
    """One bit for each component, 1 if positive, most significant first; zeros fill the last byte. As hex digits."""
    bits = F.array_join(F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    n = F.ceil(F.size(v) / 8).cast("int")
    padded = F.rpad(bits, n * 8, F.lit("0"))
    byte = lambda i: F.lpad(F.conv(F.substr(padded, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")
    return F.when(F.size(v) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), byte), ""))


def stride(dims: Column, mode: str) -> Column:
    """Bytes of a vector."""
    if mode not in MODES:
        raise QuantizationError(f"unknown mode {mode}; there are {', '.join(MODES)}")
    return F.ceil(dims / 8).cast("int") if mode == "binary" else dims * {"float32": 4, "float16": 2, "int8": 1}[mode]


def quantizer(mode: str):
    """array<float> -> bytes, as an Arrow-batched function, for the modes that need bytes."""
    import numpy as np

    if mode not in MODES:
        raise QuantizationError(f"unknown mode {mode}; there are {', '.join(MODES)}")

    def rows(x):
        """Codes of vectors of one length, a row each."""
        if mode == "float32":
            return x.astype("<f4")
        if mode == "float16":
            return x.astype("<f2")
        if mode == "binary":
            return np.packbits(x > 0, axis=1)
        scale = np.float32(127) / (np.abs(x).max(axis=1, initial=np.float32(0), keepdims=True) + np.float32(1e-8))
        return np.clip(x * scale, np.float32(-127), np.float32(127)).astype(np.int8)

    @F.pandas_udf("binary")
    def quantize(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        sizes = s.map(lambda v: -1 if v is None else len(v))
        for n in sizes[sizes >= 0].unique():  # vectors of one length are one array
            own = s[sizes == n]
            codes = rows(np.array(own.tolist(), np.float32).reshape(len(own), n))
            out[own.index] = pd.Series([c.tobytes() for c in codes], index=own.index, dtype=object)
        return out

    return quantize


def dequantizer(mode: str, dims: int):
    """bytes -> array<float>."""
    import numpy as np

    if mode not in MODES:
        raise QuantizationError(f"unknown mode {mode}; there are {', '.join(MODES)}")

    def one(b):
        if b is None:
            return None
        if mode in ("float32", "float16"):
            return np.frombuffer(b, "<f4" if mode == "float32" else "<f2").astype(np.float32)
        if mode == "int8":
            return np.frombuffer(b, np.int8).astype(np.float32) / np.float32(127)
        return np.unpackbits(np.frombuffer(b, np.uint8))[:dims].astype(np.float32) * 2 - 1

    @F.pandas_udf("array<float>")
    def dequantize(s: pd.Series) -> pd.Series:
        return s.map(one)

    return dequantize
