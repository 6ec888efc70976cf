"""Vector columns: length, unit form, cosine, and the packed byte form.

Sums run element by element in DOUBLE, so equal vectors give equal numbers
wherever their rows happen to be processed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Dot product in DOUBLE of two arrays of the same size."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def unit(v: Column, length: Column) -> Column:
    """The vector scaled to length one, as ARRAY<DOUBLE>."""
    return F.transform(v, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity in DOUBLE; pass lengths that are already known."""
    return dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def vector_problem(v: Column) -> Column:
    """Why a vector cannot be indexed or searched with, or NULL."""
    length = norm(v)
    return (
        F.when(v.isNull(), F.lit("vector is null"))
        .when(F.size(v) == 0, F.lit("vector is empty"))
        .when(length == 0, F.lit("vector is zero"))
        # NULL, NaN and infinite values all show in the length.
        .when(~F.coalesce(length < float("inf"), F.lit(False)), F.lit("vector is not finite"))
    )


def blob_problem(blob: Column, dim: Column) -> Column:
    """Why a packed vector does not fit its declared dimension, or NULL."""
    size = F.octet_length(blob)
    return (
        F.when(blob.isNull(), F.lit("vector is null"))
        .when(size % 4 != 0, F.lit("byte length is not a multiple of 4"))
        .when(size != dim * 4, F.lit("byte length does not match dim"))
    )


@F.arrow_udf(T.BinaryType())
def pack(vectors: pa.Array) -> pa.Array:
    """Little-endian float32 bytes of each vector: the batch's values as they are, with offsets in bytes."""
    sizes = pc.list_value_length(vectors).fill_null(0).to_numpy()
    offsets = np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int32)
    values = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False), "<f4")
    valid = vectors.is_valid().buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(vectors), [valid, pa.py_buffer(offsets), pa.py_buffer(values)])


@F.arrow_udf(T.ArrayType(T.FloatType()))
def unpack(blobs: pa.Array) -> pa.Array:
    """The vector behind each byte string; a stray byte length is an error."""
    sizes = pc.binary_length(blobs).fill_null(0).to_numpy()
    if (sizes % 4).any():
        raise ValueError("byte length is not a multiple of 4")
    offsets = np.concatenate([[0], np.cumsum(sizes) // 4]).astype(np.int32)
    # Without nulls, the bytes of a batch lie one after the other.
    own = blobs.drop_null().cast(pa.binary())
    ends = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1] if len(own) else [0, 0]
    data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    values = pa.array(data.view("<f4"), pa.float32())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=blobs.is_null())
