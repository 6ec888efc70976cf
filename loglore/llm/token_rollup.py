"""Token totals kept by signed deltas: inserts, deletes and revised counts in idempotent batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglore.llm.common import WORD, slices, texts_of
from loglore.llm.encoding import counter
from loglore.operators.sizing import fits_broadcast, restrict
from loglore.session import materialise

_KEY = ["doc_key", "tokenizer_version"]
_CELL = ["source", "lang", "tokenizer_version"]
_LEDGER = "doc_key string, tokenizer_version string, source string, lang string, docs long, tokens long"
#: Larger keys of a batch are not broadcast; the ledger's rows are dealt by key after the join in any case.
_KEYS_BYTES = 8 * 1024 * 1024
_IN_WORD = WORD.removesuffix("+")
# The first letter or digit of a word that has one, with the rest of the word behind it; or what stands before.
_SPELT = r"[^\p{L}\p{N}]++|([\p{L}\p{N}])" + _IN_WORD + "*+"


def word_count(text: Column) -> Column:
    """Words of a text, null for a null one.

    One character is left of each word, so a text's words never stand in memory as strings.
    """
    return F.length(F.regexp_replace(text, rf"({_IN_WORD}){_IN_WORD}*+|[\x20\x09-\x0D]++", "$1"))


def spelt_word_count(text: Column) -> Column:
    """Words with a letter or digit (\\p{L}, \\p{N}), counted likewise."""
    return F.length(F.regexp_replace(text, _SPELT, "$1"))


def count_tokens(docs: DataFrame, content: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens of every whole text; a null text has none."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_tokens", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = counter(content)
        for some in slices(batches):
            counts = enc.count(texts_of(some.column("text")))
            kept = [some.column(c).cast(schema.field(c).type) for c in ("doc_id", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts)], schema=schema)
        # The worker stays while the JVM works on.
        pa.default_memory_pool().release_unused()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text").mapInArrow(
        run, "doc_id long, source string, lang string, n_tokens long"
    )
    return counted.withColumn("tokenizer_version", F.lit(version))


class TokenRollup:
    """Totals by source, language and tokenizer version under one path.

    `ledger/batch=<id>` holds the signed rows of a batch, one or two per changed document;
    `deltas/batch=<id>` their sums by cell; `commits/batch=<id>` says that both are whole. Totals
    are the sums of the deltas of committed batches. A batch that is committed is not applied
    again, and one that broke off is written anew over what it left, so each counts once however
    often it is sent. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def upsert(self, batch: str, counts: DataFrame) -> bool:
        """Insert counts, or revise those of known documents; False if the batch was committed before.

        `counts` has doc_id, source, lang, tokenizer_version and n_tokens, others are not looked at.
        A document has one count per tokenizer version, and a null doc_id counts as one document.
        Of rows that repeat a document in a batch the greatest (n_tokens, source, lang) holds; a null
        n_tokens counts as 0. Null source, lang and version are cells of their own.
        """
        value = F.struct(F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"), "source", "lang")
        new = counts.groupBy(*_keys()).agg(F.max(value).alias("v"))
        return self._apply(
            batch,
            new.select(
                *_KEY, F.col("v.source").alias("source"), F.col("v.lang").alias("lang"),
                F.lit(1).cast("long").alias("docs"), F.col("v.n").alias("tokens"),
            ),
        )

    def delete(self, batch: str, documents: DataFrame) -> bool:
        """Take documents (doc_id, tokenizer_version) out; unknown ones change nothing."""
        gone = documents.select(*_keys()).distinct()
        none = F.lit(None).cast("string")
        zero = F.lit(0).cast("long")
        return self._apply(
            batch,
            gone.select(*_KEY, none.alias("source"), none.alias("lang"), zero.alias("docs"), zero.alias("tokens")),
        )

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; cells without documents are left out."""
        return (
            self._committed("deltas")
            .groupBy(*_CELL)
            .agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
            .where("n_docs <> 0 OR n_tokens <> 0")
        )

    def _apply(self, batch: str, new: DataFrame) -> bool:
        if self._batches().where(F.col("batch") == batch).head(1):
            return False
        # Counted once: the batch feeds the look-up of what is known and the new rows.
        new = materialise(new, "rollup-batch")
        ledger = self._committed("ledger")
        keys = new.select(*_KEY)
        known = restrict(ledger.drop("batch"), keys, _KEY, small=fits_broadcast(keys, _KEYS_BYTES))
        # What the committed batches say of a document sums to one row per cell, or to nothing.
        before = (
            known.groupBy(*_KEY, "source", "lang")
            .agg((-F.sum("docs")).alias("docs"), (-F.sum("tokens")).alias("tokens"))
            .where("docs <> 0")
        )
        signed = new.where("docs <> 0").unionByName(before)
        signed.select("doc_key", "tokenizer_version", "source", "lang", "docs", "tokens").write.mode(
            "overwrite"
        ).parquet(f"{self.path}/ledger/batch={batch}")
        rows = self.spark.read.schema(_LEDGER).parquet(f"{self.path}/ledger/batch={batch}")
        sums = rows.groupBy(*_CELL).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        self.spark.range(1).select(F.lit(batch).alias("batch")).write.mode("overwrite").parquet(
            f"{self.path}/commits/{batch}"
        )
        return True

    def _batches(self) -> DataFrame:
        try:
            return self.spark.read.schema("batch string").parquet(f"{self.path}/commits/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "batch string")

    def _committed(self, name: str) -> DataFrame:
        schema = _LEDGER if name == "ledger" else _LEDGER.removeprefix("doc_key string, ")
        batches = [r.batch for r in self._batches().collect()]
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/batch={b}" for b in batches])


def _keys() -> list:
    return [
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key"),
        F.coalesce("tokenizer_version", F.lit("")).alias("tokenizer_version"),
    ]
