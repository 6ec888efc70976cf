"""One query per group of operators, over the given tables.

Each takes (spark, sf_dir) and returns a DataFrame; `oracles.ORACLES` holds the
same question as SQL under the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglore.functions.embedders import HASHED_MODEL, Embedder, Reply, hashed_words
from loglore.functions.text import first_line, is_commit_id
from loglore.functions.vectors import cosine, norm, pack, unit, unpack
from loglore.operators.clean import (
    check_commits,
    commit_order,
    drop_merges,
    empty_to_null,
    first_per_key,
    flatten,
    good_commits,
    null_to_empty,
    reject_whole_batches,
    rejected_commits,
)
from loglore.operators.embed import attach_vectors, embed, embedding_rows
from loglore.operators.index import index_docs, index_rejects, mark_synced, sync_index, sync_status, unsynced
from loglore.operators.lookup import find_commits, hit_list, lookup, request_list, result_pages, with_commits
from loglore.operators.number import with_batch_no
from loglore.operators.report import reject_report
from loglore.operators.runs import STAGES
from loglore.operators.search import MAX_LOCAL_K, best_per_commit, count_documents, search
from loglore.operators.tables import TableSet, cascade_delete, check_embeddings, check_packed
from loglore.plans.fixture import (
    FIXTURE_MODEL,
    benchmark_vectors,
    fixture_embeddings,
    raw_from_conversations,
    raw_from_documents,
    sha_of,
    spoilt_sha,
    table,
)
from loglore.plans.indexing import arrival_order, index_commits
from loglore.plans.searching import search_text
from loglore.schema import DEFAULT_MODEL, EMBEDDING_KEY, RAW_COMMIT, SOURCE_DIFF_SUMMARY, SOURCE_MESSAGE
from loglore.session import materialise, subfolders, work_path
from loglore.sources.commits import read_commit_stream, read_commits, read_log_dump, union_exports, write_log_dump
from loglore.streaming.index_stream import index_stream

Query = Callable[[SparkSession, str], DataFrame]

OTHER_MODEL = "other-64"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_from_documents(table(spark, sf_dir, "documents"))


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_from_documents(table(spark, sf_dir, "documents"), spoilt_sha())


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return good_commits(check_commits(_raw(spark, sf_dir)))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that carry a label."""
    return table(spark, sf_dir, "labels").select(sha_of(F.col("doc_id")).alias("sha")).distinct()


def _tables(spark: SparkSession, label: str) -> TableSet:
    # Nothing is looked up by id in these tables, so they need no folders.
    return TableSet(spark, work_path(spark, label), prefix_length=0)


def _benchmark_hits(spark: SparkSession, sf_dir: str, k: int = 10, local_k: int = MAX_LOCAL_K) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    queries = benchmark_vectors(table(spark, sf_dir, "benchmark"), vectors)
    return search(queries, index_docs(fixture_embeddings(vectors)), k, local_k)


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("author_date", "committer_date")})


def flatten_drop_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "export")
    _raw(spark, sf_dir).write.json(path)
    return _dates_as_text(flatten(drop_merges(read_commits(spark, path))).drop("date_out_of_range"))


def parse_log_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "dump")
    write_log_dump(_raw(spark, sf_dir), path)
    return _dates_as_text(flatten(drop_merges(read_log_dump(spark, path))).drop("date_out_of_range"))


def union_overlapping_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _raw(spark, sf_dir)
    later = F.col("committer").withField("epoch", F.col("committer.epoch") + 10)
    mirror = docs.withColumn("repo", F.concat(F.lit("a-mirror/"), "repo")).withColumn("committer", later)
    turns = raw_from_conversations(table(spark, sf_dir, "conversations"))
    commits = good_commits(check_commits(union_exports(docs, mirror, turns)))
    return first_per_key(commits, ["sha"], commit_order())


def utc_dates_and_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = empty_to_null(flatten(_raw(spark, sf_dir)))
    return flat.select("sha", "author_email", "author_date", "committer_email", "committer_date")


def read_back_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = null_to_empty(empty_to_null(flatten(_raw(spark, sf_dir))))
    return _dates_as_text(stored.select("sha", "author_email", "author_date", "committer_email", "committer_date"))


def commit_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", spoilt_sha().alias("sha"))
    return documents.withColumn("is_valid", is_commit_id("sha"))


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw commits with bad ids, and with names and messages missing by language."""
    documents = table(spark, sf_dir, "documents")
    raw = raw_from_documents(
        documents.withColumn("text", F.when(F.col("lang") != "fr", F.col("text"))), spoilt_sha()
    )
    nameless = F.col("author").withField("name", F.when(F.col("author.name") != "dev3", F.col("author.name")))
    return raw.withColumn("author", nameless)


def report_of_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_report(rejected_commits(check_commits(_reported(spark, sf_dir))))


def report_of_rejects_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    # Few bad ids, so that some batches are spoilt and others are not.
    some = F.when(F.length("text") % 211 == 0, F.lit("")).otherwise(sha_of(F.col("doc_id")))
    checked = check_commits(raw_from_documents(documents, some))
    batched = with_batch_no(checked, [*arrival_order(), F.md5("message")])
    strict = reject_whole_batches(batched, ["repo", "batch_no"])
    return reject_report(rejected_commits(strict))


def hashed_word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark, sf_dir)
    rows = embedding_rows(
        embed(commits, hashed_words, HASHED_MODEL, concurrency=spark.sparkContext.defaultParallelism)
    )
    return (
        rows.select("sha", "source", "model", "dim", F.posexplode("vector").alias("bucket", "weight"))
        .filter(F.col("weight") > 0)
        .withColumn("bucket", F.col("bucket").cast("long"))
        .withColumn("weight", F.round(F.col("weight").cast("double"), 4))
    )


def picky_embedder(model: str) -> Embedder:
    """Refuses a call with a text of some lengths, and drops a vector for others."""

    def call(texts: list[str]) -> Reply:
        if any(len(t) % 97 == 0 for t in texts):
            raise RuntimeError("text refused")
        lost = any(len(t) % 89 == 1 for t in texts)
        return Reply([[0.1, 0.2]] * (len(texts) - lost), model)

    return call


def failing_embedder(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = with_batch_no(_commits(spark, sf_dir), [F.col("sha")])
    answered = embed(batched, picky_embedder, "picky", batch=["repo", "batch_no"])
    return answered.select(
        "repo", "batch_no", "sha", F.size("vector").alias("dim"), "model", F.col("error").alias("detail")
    )


def join_external_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = fixture_embeddings(_vectors(spark, sf_dir)).select(F.col("sha").alias("id"), "vector", "model")
    enriched, unknown = attach_vectors(_commits(spark, sf_dir), results)
    return enriched.select("sha", "repo", "dim", F.lit("stored").alias("outcome")).unionByName(
        unknown.select(
            "sha",
            F.lit(None).cast("string").alias("repo"),
            F.lit(None).cast("int").alias("dim"),
            F.col("reason").alias("outcome"),
        )
    )


def append_commits_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark, sf_dir)
    early = commits.join(_labelled(spark, sf_dir), "sha", "left_semi")
    tables = _tables(spark, "append-commits")
    tables.append_commits(early.withColumn("repo", F.concat(F.lit("early/"), "repo")))
    tables.append_commits(commits.unionByName(commits))
    tables.append_commits(commits)
    return tables.commits().select("sha", "repo", "author_email", "committer_date", "message")


def append_embeddings_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture_embeddings(_vectors(spark, sf_dir))
    early = rows.join(_labelled(spark, sf_dir), "sha", "left_semi")
    tables = _tables(spark, "append-embeddings")
    tables.append_embeddings(early.withColumn("vector", F.reverse("vector")))
    tables.append_embeddings(rows.unionByName(rows))
    tables.append_embeddings(rows.withColumn("model", F.lit(OTHER_MODEL)))
    return tables.embeddings().select(
        "sha", "source", "model", "dim", F.round(F.col("vector")[0].cast("double"), 6).alias("first_value")
    )


def integrity_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    declared = F.when(F.col("label") == 3, F.lit(32)).otherwise(F.size("embedding"))
    rows = fixture_embeddings(vectors).join(
        vectors.select(sha_of(F.col("vec_id")).alias("sha"), declared.alias("declared")), "sha"
    )
    rows = rows.withColumn("dim", F.col("declared")).drop("declared")
    valid, rejects = check_embeddings(rows, _commits(spark, sf_dir))
    return valid.select("sha", F.lit("stored").alias("outcome")).unionByName(
        rejects.select("sha", F.col("reason").alias("outcome"))
    )


def cascade_to_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1)
    gone = toxic.select(sha_of(F.col("doc_id")).alias("sha"))
    left = cascade_delete(fixture_embeddings(_vectors(spark, sf_dir)), gone)
    return left.select("sha", "source", "model", "dim")


def _partly_synced(spark: SparkSession, sf_dir: str) -> TableSet:
    tables = _tables(spark, "sync")
    tables.append_embeddings(fixture_embeddings(_vectors(spark, sf_dir)))
    labelled = _labelled(spark, sf_dir)
    tag = [F.lit(FIXTURE_MODEL).alias("model"), F.lit(SOURCE_MESSAGE).alias("source")]
    mark_synced(tables, labelled.select("sha", *tag))
    mark_synced(tables, labelled.select("sha", *tag))
    return tables


def list_unsynced(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _partly_synced(spark, sf_dir)
    rows = unsynced(tables.embeddings(), tables.sync_log())
    return rows.select("sha", "source", "model", "dim")


def repair_unsynced(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _partly_synced(spark, sf_dir)
    sync_index(tables)
    sync_index(tables)
    docs = tables.index_docs().select("sha", "source", "model", F.lit(True).alias("_doc"))
    status = sync_status(tables.sync_log())
    return (
        tables.embeddings()
        .select(*EMBEDDING_KEY)
        .join(docs, EMBEDDING_KEY, "left")
        .join(status, EMBEDDING_KEY, "left")
        .select(
            *EMBEDDING_KEY,
            F.col("_doc").isNotNull().alias("in_index"),
            F.col("synced_at").isNotNull().alias("is_synced"),
        )
    )


def build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    broken = (
        F.when(F.col("label") == 5, F.transform("embedding", lambda x: x * F.lit(0).cast("float")))
        .when(F.col("label") == 6, F.array().cast("array<float>"))
        .otherwise(F.col("embedding"))
    )
    tables = _tables(spark, "index")
    tables.append_embeddings(fixture_embeddings(vectors.withColumn("embedding", broken)))
    sync_index(tables)
    docs = tables.index_docs().join(sync_status(tables.sync_log()), EMBEDDING_KEY, "left")
    built = docs.select(
        "doc_id",
        F.col("dim").cast("int").alias("dim"),
        F.round(unit(F.col("vector"), F.col("norm"))[0], 4).alias("first_unit"),
        F.round(norm(unit(F.col("vector"), F.col("norm"))), 6).alias("unit_length"),
        F.when(F.col("synced_at").isNotNull(), F.lit("synced")).alias("outcome"),
    )
    rejected = index_rejects(tables.embeddings()).select(
        F.col("detail").alias("doc_id"),
        F.lit(None).cast("int").alias("dim"),
        F.lit(None).cast("double").alias("first_unit"),
        F.lit(None).cast("double").alias("unit_length"),
        F.col("reason").alias("outcome"),
    )
    return built.unionByName(rejected)


def look_up_request_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every turn asks for three commits; ids repeat within and between lists, and merges are unknown.
    ids = F.array(*[sha_of(F.col(c)) for c in ("conv_id", "turn", "conv_id")])
    lists = table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids"))
    found = lookup(_commits(spark, sf_dir), request_list(lists), ("conv_id", "turn", "pos"))
    return found.select("conv_id", "turn", "pos", "sha", "repo", first_line("message").alias("subject"))


def hits_with_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = materialise(_benchmark_hits(spark, sf_dir), "hits")
    found = hit_list(with_commits(hits, _commits(spark, sf_dir)))
    return found.select(
        "query_id", "rank", "line_no", "sha", "repo", F.round("similarity", 4).alias("similarity"), "author_name"
    )


def page_of_every_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # With one hit each, the queries whose nearest commit was a merge are left with none.
    hits = materialise(_benchmark_hits(spark, sf_dir, k=1), "hits")
    listed = hit_list(with_commits(hits, _commits(spark, sf_dir)))
    queries = benchmark_vectors(table(spark, sf_dir, "benchmark"), _vectors(spark, sf_dir))
    return result_pages(queries, listed).select("query_id", "sha", "display")


def top_k_for_many_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _benchmark_hits(spark, sf_dir)
    return hits.select("query_id", "rank", "sha", "source", F.round("similarity", 4).alias("similarity"))


def top_k_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    index = index_docs(fixture_embeddings(vectors))
    # One query: with k above the count, every document is a hit.
    queries = vectors.agg(F.max_by("embedding", "vec_id").alias("vector")).select(
        F.lit("last").alias("query_id"), "vector", F.lit(FIXTURE_MODEL).alias("model")
    )
    counted = count_documents(index).select(
        F.lit("documents").alias("k_case"),
        F.col("model").alias("query_id"),
        F.col("n_docs").alias("n_hits"),
        F.lit(None).cast("long").alias("first_rank"),
        F.lit(None).cast("long").alias("last_rank"),
    )
    for name, k in (("above count", 1_000_000), ("zero", 0), ("negative", -3)):
        hits = search(queries, index, k)
        per_query = hits.groupBy("query_id").agg(
            F.count("*").alias("n_hits"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank")
        )
        counted = counted.unionByName(per_query.select(F.lit(name).alias("k_case"), "*"))
    return counted


def top_k_by_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A k beyond what tasks rank themselves, for all benchmark queries."""
    hits = _benchmark_hits(spark, sf_dir, k=50, local_k=20)
    return hits.select("query_id", "rank", "sha", "source", F.round("similarity", 4).alias("similarity"))


def _crowded(vectors: DataFrame) -> DataFrame:
    """Vectors that all point nearly the same way."""
    near = F.transform("embedding", lambda x: (F.lit(1.0) + F.lit(0.02) * x.cast("double")).cast("float"))
    return vectors.withColumn("embedding", near)


def top_k_of_close_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A k beyond what tasks rank themselves, where all similarities are above 0.99 and each comes twice."""
    vectors = _crowded(_vectors(spark, sf_dir))
    rows = fixture_embeddings(vectors).unionByName(fixture_embeddings(vectors, SOURCE_DIFF_SUMMARY))
    queries = benchmark_vectors(table(spark, sf_dir, "benchmark"), vectors)
    hits = search(queries, index_docs(rows), k=50, local_k=20)
    return hits.select("query_id", "rank", "sha", "source", F.round("similarity", 6).alias("similarity"))


def best_hit_per_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    # The second embedding of a commit is the vector numbered one higher.
    second = vectors.withColumn("vec_id", F.col("vec_id") - 1).filter(F.col("vec_id") >= 0)
    rows = fixture_embeddings(vectors).unionByName(fixture_embeddings(second, SOURCE_DIFF_SUMMARY))
    queries = benchmark_vectors(table(spark, sf_dir, "benchmark"), vectors)
    best = best_per_commit(search(queries, index_docs(rows)))
    return best.withColumn("similarity", F.round("similarity", 4))


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark, sf_dir)
    cores = spark.sparkContext.defaultParallelism
    answered = embed(commits.select("sha", "message"), hashed_words, HASHED_MODEL, concurrency=cores)
    index = index_docs(embedding_rows(answered))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    found = search_text(queries, index, commits, hashed_words, HASHED_MODEL)
    return found.select("query_id", "rank", "sha", "display")


def pack_and_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = fixture_embeddings(_vectors(spark, sf_dir)).withColumn("blob", pack("vector"))
    label = _vectors(spark, sf_dir).select(sha_of(F.col("vec_id")).alias("sha"), "label")
    # Two labels stand for damaged exports: one byte short, and one whole value short.
    lost = F.when(F.col("label") == 7, 1).when(F.col("label") == 8, 4).otherwise(0)
    damaged = packed.join(label, "sha").withColumn(
        "blob", F.substring(F.col("blob"), F.lit(1), F.octet_length("blob") - lost)
    )
    checked = check_packed(damaged, "blob")
    sound = checked.filter(F.col("reason").isNull()).withColumn("read", unpack("blob"))
    return sound.select(
        "sha",
        F.octet_length("blob").cast("long").alias("n_bytes"),
        (F.col("read") == F.col("vector")).alias("is_same"),
        F.round(F.col("read")[0].cast("double"), 6).alias("first_value"),
        F.round(cosine(F.col("read"), F.col("vector")), 6).alias("similarity"),
        "reason",
    ).unionByName(
        checked.filter(F.col("reason").isNotNull()).select(
            "sha",
            F.octet_length("blob").cast("long").alias("n_bytes"),
            F.lit(None).cast("boolean").alias("is_same"),
            F.lit(None).cast("double").alias("first_value"),
            F.lit(None).cast("double").alias("similarity"),
            "reason",
        )
    )


def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "documents").schema
    # A glob lets the stream take the table as one file or as a folder of files.
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    tables = _tables(spark, "stream")
    running = index_stream(
        raw_from_documents(arriving, spoilt_sha()),
        tables,
        hashed_words,
        work_path(spark, "stream-checkpoint"),
        HASHED_MODEL,
    )
    running.awaitTermination()
    return _stored(tables)


def _stored(tables: TableSet) -> DataFrame:
    """Everything stored of each commit, side by side."""
    commits = tables.commits().select(
        "sha", "repo", "author_email", "committer_date", F.length("message").alias("n_chars")
    )
    vectors = tables.embeddings().select("sha", "source", "model", "dim")
    docs = tables.index_docs().select("sha", "source", "model", "doc_id")
    marked = sync_status(tables.sync_log())
    return (
        commits.join(vectors, "sha", "left")
        .join(docs, EMBEDDING_KEY, "left")
        .join(marked, EMBEDDING_KEY, "left")
        .withColumn("is_synced", F.col("synced_at").isNotNull())
        .withColumn("n_chars", F.col("n_chars").cast("long"))
        .drop("synced_at")
    )


def index_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _spoilt(spark, sf_dir)
    turns = raw_from_conversations(table(spark, sf_dir, "conversations"))
    tables = _tables(spark, "again")
    steps = [("first", raw), ("same again", raw), ("empty", raw.limit(0)), ("more", raw.unionByName(turns))]
    counts = []
    for name, feed in steps:
        index_commits(feed, tables, hashed_words, HASHED_MODEL, run=name.replace(" ", "-"))
        for what, rows in (
            ("commits", tables.commits()),
            ("embeddings", tables.embeddings()),
            ("index_docs", tables.index_docs()),
            ("sync_log", tables.sync_log()),
            ("rejects", tables.rejects()),
        ):
            counts.append((name, what, rows.count()))
    return spark.createDataFrame(counts, "after string, stored string, n_rows bigint")


def _ledger(tables: TableSet) -> DataFrame:
    """The runs with their counts, and what still waits."""
    return tables.runs().select("run", "state", *STAGES, "error").unionByName(
        tables.pending().select(
            F.concat(F.lit("waiting "), "sha").alias("run"),
            F.concat(F.lit("tries "), "tries").alias("state"),
            *[F.lit(None).cast("long").alias(c) for c in STAGES],
            "error",
        )
    )


def dead_embedder(model: str) -> Embedder:
    def call(texts: list[str]) -> Reply:
        raise ConnectionError("no embedder")

    return call


def embedder_of_short_texts(model: str) -> Embedder:
    """Refuses texts of some lengths, and answers the others as the built-in one."""
    answer = hashed_words()

    def call(texts: list[str]) -> Reply:
        if any(len(t) % 97 == 0 for t in texts):
            raise RuntimeError("text refused")
        return answer(texts)

    return call


def failed_then_taken_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that fail, then some that work, on runs that bring in nothing new: the queue is worked off."""
    raw = _raw(spark, sf_dir)
    tables = _tables(spark, "taken-up")
    index_commits(raw, tables, dead_embedder, HASHED_MODEL, run="1-dead")
    index_commits(raw.limit(0), tables, embedder_of_short_texts, HASHED_MODEL, run="2-some")
    return _ledger(tables)


def queue_worked_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables after all commits were taken up again, the last of them by a stream without new files."""
    raw = _raw(spark, sf_dir)
    tables = _tables(spark, "worked-off")
    index_commits(raw, tables, dead_embedder, HASHED_MODEL, run="1-dead")
    index_commits(raw.limit(0), tables, embedder_of_short_texts, HASHED_MODEL, run="2-some")
    arriving = work_path(spark, "worked-off-files")
    _spoilt(spark, sf_dir).filter(F.col("sha") == "").write.json(arriving)
    feed = read_commit_stream(spark, arriving)
    checkpoint = work_path(spark, "worked-off-checkpoint")
    index_stream(feed, tables, hashed_words, checkpoint, HASHED_MODEL).awaitTermination()
    return _stored(tables).join(tables.pending().select("sha", "tries"), "sha", "left")


class _FullDisk(TableSet):
    """Tables whose index cannot be written."""

    def append_index_docs(self, docs: DataFrame) -> int:
        raise OSError("no space left")


def failing_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose store fails is in the ledger, and the next one finishes its work from its notes."""
    raw = _spoilt(spark, sf_dir)
    tables = _tables(spark, "failing-store")
    try:
        index_commits(raw, _FullDisk(spark, tables.base, 0), hashed_words, HASHED_MODEL, run="1-full-disk")
    except OSError:
        pass
    index_commits(raw.limit(0), tables, hashed_words, HASHED_MODEL, run="2-repair")
    index_commits(raw, tables, hashed_words, HASHED_MODEL, run="3-again")
    index_docs_now = tables.index_docs().join(sync_status(tables.sync_log()), EMBEDDING_KEY, "left_semi")
    indexed = index_docs_now.groupBy(F.lit("index").alias("run"), F.lit("marked").alias("state")).agg(
        *[F.count("*").alias(c) if c == "indexed" else F.lit(None).cast("long").alias(c) for c in STAGES],
        F.lit(None).cast("string").alias("error"),
    )
    return _ledger(tables).unionByName(indexed)


def alias_asked_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked by no name, the embedder answers under its own: the second run embeds what is new alone."""
    raw = _raw(spark, sf_dir)
    tables = _tables(spark, "alias")
    index_commits(raw, tables, hashed_words, run="1-default")
    turns = raw_from_conversations(table(spark, sf_dir, "conversations"))
    index_commits(raw.unionByName(turns), tables, hashed_words, run="2-again")
    index_commits(raw, tables, hashed_words, DEFAULT_MODEL, run="3-by-name")
    return _ledger(tables)


def stream_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports that arrive one by one; each micro-batch is a run of the ledger."""
    arriving = work_path(spark, "arriving")
    raw = _spoilt(spark, sf_dir)
    tables = _tables(spark, "stream-of-files")
    checkpoint = work_path(spark, "stream-of-files-checkpoint")
    # An export per remainder, of as many files as tasks wrote; the stream goes on where it stopped.
    for part in range(3):
        known = set(subfolders(spark, arriving))
        raw.filter(F.pmod(F.crc32("body"), F.lit(3)) == part).write.mode("append").json(arriving)
        n_files = len([f for f in set(subfolders(spark, arriving)) - known if f.startswith("part-")])
        feed = read_commit_stream(spark, arriving, files_per_trigger=n_files)
        index_stream(feed, tables, hashed_words, checkpoint, HASHED_MODEL).awaitTermination()
    indexed = tables.index_docs().select("sha", F.posexplode("vector").alias("bucket", "weight"))
    weights = indexed.filter(F.col("weight") > 0).select(
        "sha", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("weight").cast("double"), 4).alias("weight")
    )
    ledger = tables.runs().agg(F.count("*").alias("bucket"), F.sum("read").cast("double").alias("weight"))
    return weights.unionByName(ledger.withColumn("sha", F.lit("runs")))


def appends_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three appends into the usual folders, written anew as one version; the labelled ids are found in it."""
    commits, labelled = _commits(spark, sf_dir), _labelled(spark, sf_dir)
    turns = good_commits(check_commits(raw_from_conversations(table(spark, sf_dir, "conversations"))))
    tables = TableSet(spark, work_path(spark, "compacted"))
    early = commits.join(labelled, "sha", "left_semi").withColumn("repo", F.concat(F.lit("early/"), "repo"))
    for part in (early, commits, turns):
        tables.append_commits(part)
    n_files = F.count_distinct("_metadata.file_path").alias("n")
    before = tables.commits().agg(n_files).first()["n"]
    tables.compact("commits")
    after = tables.commits().agg(n_files).first()["n"]
    tables.append_commits(commits)  # all of it is stored
    tables.drop_versions("commits")
    found = find_commits(tables.commits(), labelled, prefix_length=tables.prefix_length)
    stored = tables.commits().select(
        "sha",
        "repo",
        "committer_date",
        F.length("message").cast("long").alias("n_chars"),
        F.lit(after < before).alias("fewer_files"),
    )
    asked = found.select("sha", F.lit(True).alias("asked"))
    return stored.join(asked, "sha", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def malformed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export in which roots are cut off and commits without an author's address have times that are none."""
    line = F.to_json(F.struct(*RAW_COMMIT.names))
    no_address = F.coalesce("author.email", F.lit("")) == ""
    damaged = (
        F.when(F.size("parents") == 0, F.left(line, F.length(line) - 2))
        .when((F.size("parents") == 1) & no_address, F.regexp_replace(line, r'"epoch":(-?\d+)', r'"epoch":"at $1"'))
        .otherwise(line)
    )
    path = work_path(spark, "damaged")
    _raw(spark, sf_dir).select("repo", damaged.alias("value")).write.partitionBy("repo").text(path)
    tables = _tables(spark, "quarantine")
    outcome = index_commits(
        read_commits(spark, path, tolerant=True), tables, hashed_words, HASHED_MODEL, run="quarantine"
    )
    rejected = tables.rejects().select(
        F.regexp_extract("detail", "/repo=([^/]*)/", 1).alias("repo"), "reason", F.lit(outcome.error).alias("error")
    )
    kept = tables.commits().join(tables.index_docs().select("sha"), "sha")
    return rejected.groupBy("repo", "reason", "error").agg(F.count("*").alias("n_rows")).unionByName(
        kept.groupBy("repo", F.lit("indexed").alias("reason"), F.lit(outcome.error).alias("error")).agg(
            F.count("*").alias("n_rows")
        )
    )


def nearest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: for every benchmark query vector, its nearest commits as a list."""
    hits = materialise(_benchmark_hits(spark, sf_dir), "hits")
    return hit_list(find_commits(_commits(spark, sf_dir), hits)).select(
        "query_id", "line_no", "sha", F.round("similarity", 4).alias("similarity"), "display"
    )


QUERIES: dict[str, Query] = {
    "b01_flatten_drop_merges": flatten_drop_merges,
    "b02_parse_log_dump": parse_log_dump,
    "b03_union_overlapping_exports": union_overlapping_exports,
    "b04_utc_dates_and_nulls": utc_dates_and_nulls,
    "b05_read_back_form": read_back_form,
    "b06_commit_id_check": commit_id_check,
    "b07_report_of_rejects": report_of_rejects,
    "b07_report_of_rejects_strict": report_of_rejects_strict,
    "b08_hashed_word_vectors": hashed_word_vectors,
    "b09_failing_embedder": failing_embedder,
    "b09_join_external_vectors": join_external_vectors,
    "b10_append_commits_once": append_commits_once,
    "b11_append_embeddings_once": append_embeddings_once,
    "b12_integrity_of_embeddings": integrity_of_embeddings,
    "b12_cascade_to_embeddings": cascade_to_embeddings,
    "b13_list_unsynced": list_unsynced,
    "b13_repair_unsynced": repair_unsynced,
    "b14_build_index": build_index,
    "b15_look_up_request_list": look_up_request_list,
    "b16_hits_with_commits": hits_with_commits,
    "b16_page_of_every_query": page_of_every_query,
    "b17_top_k_for_many_queries": top_k_for_many_queries,
    "b18_top_k_by_floor": top_k_by_floor,
    "b18_top_k_edges": top_k_edges,
    "b18_top_k_of_close_vectors": top_k_of_close_vectors,
    "b19_best_hit_per_commit": best_hit_per_commit,
    "b20_text_search": text_search,
    "b21_pack_and_unpack": pack_and_unpack,
    "b22_stream_documents": stream_documents,
    "b22_stream_of_files": stream_of_files,
    "b23_index_again": index_again,
    "b24_failed_then_taken_up": failed_then_taken_up,
    "b24_queue_worked_off": queue_worked_off,
    "b25_failing_store": failing_store,
    "b26_alias_asked_twice": alias_asked_twice,
    "b27_appends_compacted": appends_compacted,
    "b28_malformed_records": malformed_records,
    "nearest_commits": nearest_commits,
}
