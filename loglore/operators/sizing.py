"""Broadcasts only behind a check of what would be sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglore.functions.text import id_folder

BROADCAST_BYTES = 64 * 1024 * 1024
_ROW_OVERHEAD = 32


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a narrow table, from its row count and its string lengths."""
    width = F.lit(_ROW_OVERHEAD)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"measure only flat tables, not {field.name}")
        else:
            width = width + 16
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def restrict(big: DataFrame, keys_of: DataFrame, keys: list[str], small: bool, folders: int = 0) -> DataFrame:
    """Rows of `big` whose key is in `keys_of`.

    With `small` set (checked by the caller) the keys travel and `big` stays in
    place; otherwise both sides are shuffled on the key. Where `big` lies in
    `sha_prefix` folders of `folders` digits, small keys have only their own
    folders read.
    """
    wanted = keys_of.select(*keys)
    if not small:
        return big.join(wanted, keys, "left_semi")
    if folders:
        # A comparison, though true of every id, tells the optimizer that pruning folders pays.
        wanted = wanted.withColumn("sha_prefix", id_folder(F.col("sha"), folders)).filter(F.col("sha_prefix") >= "")
        keys = [*keys, "sha_prefix"]
    return big.join(F.broadcast(wanted), keys, "left_semi")


def exclude(new: DataFrame, existing: DataFrame, keys: list[str], small: bool, folders: int = 0) -> DataFrame:
    """Rows of `new` whose key is not in `existing`; `folders` as for `restrict`.

    For a small `new`, the existing keys are first cut down to those that can
    match, in place, so a large table is never shuffled for a small addition.
    What remains is a part of the keys of `new`, and as small.
    """
    known = existing.select(*keys)
    if small:
        stored = existing.select(*keys, "sha_prefix") if folders else known
        known = F.broadcast(restrict(stored, new, keys, True, folders).select(*keys).distinct())
    return new.join(known, keys, "left_anti")
