"""The operators' queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglore.llm.chunked_bpe import encode_documents
from loglore.llm.common import table, tokenizer_json
from loglore.llm.conversations import damaged, findings, repair
from loglore.llm.decontaminate import contaminated
from loglore.llm.lattice_lm import scores
from loglore.llm.line_dedup import drop_boilerplate
from loglore.llm.mixing import mix
from loglore.llm.neardup import near_duplicates
from loglore.llm.quality import quality
from loglore.llm.resampling import resample
from loglore.llm.secrets import secrets
from loglore.llm.token_files import read_token_files, write_token_files
from loglore.llm.token_rollup import TokenRollup, count_tokens, spelt_word_count, word_count
from loglore.llm.url_filter import url_verdicts
from loglore.operators.sizing import fits_broadcast
from loglore.session import work_path

#: Doubles are compared with SQL to so many places.
PLACES = 6


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_json())
    return read_token_files(spark, path)


def op2_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), tokenizer_json())


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    for c in ("chars_apart", "words_apart"):
        found = found.withColumn(c, F.round(c, PLACES))
    return found


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches, one of them sent twice.

    All documents are inserted with their BPE counts and with their counts of words; then all
    later copies of a text are deleted, for both versions; then the words are counted anew, those
    without a letter or digit left out.
    """
    docs = table(spark, sf_dir, "documents")
    rollup = TokenRollup(spark, work_path(spark, "token-rollup"))
    text = F.coalesce("text", F.lit(""))
    known = docs.select("doc_id", "source", "lang", F.lit("words").alias("tokenizer_version"), text.alias("text"))
    plain = known.withColumn("n_tokens", word_count(F.col("text"))).drop("text")
    revised = known.withColumn("n_tokens", spelt_word_count(F.col("text"))).drop("text")

    hashes = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    first = hashes.groupBy("h").agg(F.min("doc_id").alias("first"))
    copies = hashes.join(first, "h").where("doc_id <> first").select("doc_id")
    versions = F.array(F.lit("byte_bpe_50k"), F.lit("words"))
    gone = copies.select("doc_id", F.explode(versions).alias("tokenizer_version"))

    rollup.upsert("1-bpe", count_tokens(docs, tokenizer_json(), "byte_bpe_50k"))
    rollup.upsert("2-words", plain)
    rollup.delete("3-copies", gone)
    if rollup.upsert("2-words", plain):
        raise RuntimeError("a committed batch was applied twice")
    rollup.upsert("4-revised", revised.join(copies, "doc_id", "left_anti"))
    return rollup.totals()


def op8_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages")).withColumn("score", F.round("score", PLACES))


def op9_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_boilerplate(table(spark, sf_dir, "documents"), counts=True)
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def op10_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_json())


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, targets, _ = mix(table(spark, sf_dir, "documents"), F.array("source"))
    few = F.broadcast(targets) if fits_broadcast(targets) else targets
    joined = mixed.withColumn("_own", F.col("sources")[0]).join(few, F.col("_own").eqNullSafe(F.col("source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return findings(repair(damaged(given)), given)


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files, op2_lattice_scores, op3_divergence_rules, op4_near_duplicates, op5_benchmark_passages,
        op6_secret_owners, op7_token_rollup, op8_url_ratio, op9_site_lines, op10_chunked_bpe,
        op11_source_mix, op12_conversation_repair, op13_target_resampling,
    )
}
