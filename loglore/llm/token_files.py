"""Token ids as binary files: a shared zstandard dictionary, one frame per document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglore.llm.common import slices, texts_of
from loglore.llm.encoding import encoder

END_ID = 2
#: The dictionary is trained on about so many documents, with so many characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 2_000, 4_000
DICTIONARY_BYTES = 64 * 1024
#: A shard is closed when its frames reach so many bytes.
SHARD_BYTES = 1024 * 1024
#: One shard a row group and page, so that no task writes or reads a whole file's shards at once.
_LAID_OUT = {
    "parquet.block.size": SHARD_BYTES,
    "parquet.block.size.row.check.min": 1,
    "parquet.page.size.row.check.min": 1,
}

_SHARD = (
    "part int, seq int, start_in_part long, n_ids long, width int, dict_hash string, "
    "first_doc long, last_doc long, doc_ids array<long>, n_tokens array<int>, offsets array<long>, data binary"
)


def train_dictionary(docs: DataFrame, content: str, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary for serialized id arrays, from a bounded sample of documents.

    The sample is SAMPLE_DOCS documents by a hash of their whole row, a run of SAMPLE_CHARS
    characters from anywhere in each; it shapes the ratio of compression only, never the ids. Too
    little to train on gives a raw dictionary of the sampled bytes, and an empty table none.
    """
    import zstandard

    total = docs.count()
    if not total:
        return b""
    at = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1)
    picked = (
        docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(total)) < SAMPLE_DOCS)
        .select(F.substring(F.col("text"), (at + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
        .limit(2 * SAMPLE_DOCS)
    )
    arrays = sorted(a for a in encoder(content).encode([r.text or "" for r in picked.collect()]) if a)
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:size]


def write_token_files(docs: DataFrame, path: str, content: str, end_id: int = END_ID) -> None:
    """Write the ids of every whole text, `end_id` after each, under `path`.

    `shards/` holds rows of about SHARD_BYTES: zstandard frames, one per document, one after the
    other in `data`, the place of each in `offsets`, its document in `doc_ids`, and the hash of the
    dictionary they need. `dictionary/` holds that dictionary. Documents stand in ascending doc_id,
    nulls first; rows of one doc_id by a hash of their text. A null text counts as empty and has
    the end id alone. Other columns are not looked at.

    Documents are dealt by ranges of doc_id, with hash and running number behind it, so that even
    one doc_id with a third of all rows spreads. The running number repeats as long as `docs` reads
    a table; equal rows may change places, which changes no result.
    """
    import zstandard

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, content)
    named = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(named, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content)
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        end = np.array([end_id], enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        seq = start = n_ids = size = 0
        ids: list[int | None] = []
        counts: list[int] = []
        offsets: list[int] = []
        frames: list[bytes] = []

        def shard() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = {
                "part": part, "seq": seq, "start_in_part": start, "n_ids": n_ids, "width": enc.width,
                "dict_hash": named, "first_doc": min(known, default=None), "last_doc": max(known, default=None),
                "doc_ids": ids, "n_tokens": counts, "offsets": offsets, "data": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=_arrow_shard())

        for some in slices(batches):
            arrays = enc.encode(texts_of(some.column("text")))
            for doc_id, array in zip(some.column("doc_id").to_pylist(), arrays, strict=True):
                frame = press.compress(array + end)
                ids.append(doc_id)
                counts.append(len(array) // enc.width + 1)
                offsets.append(size)
                frames.append(frame)
                size += len(frame)
                n_ids += counts[-1]
                if size >= SHARD_BYTES:
                    yield shard()
                    seq, start = seq + 1, start + n_ids
                    n_ids = size = 0
                    ids, counts, offsets, frames = [], [], [], []
        if ids:
            yield shard()
        # The worker stays while the JVM works on.
        pa.default_memory_pool().release_unused()

    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_row")]
    ordered = docs.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys)
    (
        ordered.sortWithinPartitions(*keys)
        .drop("_row")
        .mapInArrow(pack, _SHARD)
        .write.mode("overwrite")
        .options(**_LAID_OUT)
        .parquet(f"{path}/shards")
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    `start` counts the ids of all documents before it. Parts are as many as the writing tasks were;
    only their totals, a row each, meet in one task.
    """
    shards = spark.read.parquet(f"{path}/shards")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    found = _documents(shards, _dictionary(spark, path), with_ids=False)
    return found.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (array of int) of the named documents: only shards that may hold them are read."""
    shards = spark.read.parquet(f"{path}/shards")
    held = F.lit(False)
    for i in doc_ids:
        held = held | ((F.col("first_doc") <= i) & (F.col("last_doc") >= i))
    return _documents(shards.where(held), _dictionary(spark, path), with_ids=True, only=set(doc_ids)).select(
        "doc_id", "ids"
    )


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row.dict_hash, bytes(row.dictionary)


def _documents(shards: DataFrame, held: tuple[str, bytes], with_ids: bool, only: set[int] | None = None) -> DataFrame:
    """One row per document; `start` counts from the first id of its part."""
    import zstandard

    named, dictionary = held
    fields = [("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else [("ids_crc32", pa.int64())]
    schema = pa.schema(fields)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for one in slices(batches, 1):
            row = one.to_pylist()[0]
            if row["dict_hash"] != named:
                raise ValueError(f"shard {row['part']}/{row['seq']} needs another dictionary: {row['dict_hash']}")
            out, start = [], row["start_in_part"]
            ends = [*row["offsets"][1:], len(row["data"])]
            for doc_id, n, begin, end in zip(row["doc_ids"], row["n_tokens"], row["offsets"], ends, strict=True):
                if only is None or doc_id in only:
                    ids = np.frombuffer(inflate.decompress(row["data"][begin:end]), f"<u{row['width']}").astype("<u4")
                    last = ids.astype(np.int32).tolist() if with_ids else zlib.crc32(ids.tobytes())
                    out.append((row["part"], doc_id, start, len(ids), last))
                start += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
                if out
                else [pa.array([], f.type) for f in schema],
                schema=schema,
            )
        pa.default_memory_pool().release_unused()

    kind = "ids array<int>" if with_ids else "ids_crc32 long"
    return shards.select(
        "part", "seq", "start_in_part", "width", "dict_hash", "doc_ids", "n_tokens", "offsets", "data"
    ).mapInArrow(unpack, f"part int, doc_id long, start long, n_tokens long, {kind}")


def _arrow_shard() -> pa.Schema:
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    kinds = [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.int32(), pa.string()] + [pa.int64()] * 2
    names = [x.split()[0] for x in _SHARD.split(", ")]
    return pa.schema(list(zip(names, [*kinds, longs, ints, longs, pa.binary()], strict=True)))
