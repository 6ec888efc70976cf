"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

from loglore.operators.runs import STAGES

# The commits of the documents table, merges included, dates as stored.
_RAW = """
raw AS (
  SELECT doc_id, lang, source AS repo, sha256(CAST(doc_id AS VARCHAR)) AS sha,
         CASE WHEN doc_id % 7 = 0 THEN 2 WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS n_parents,
         'dev' || (doc_id % 17) AS author_name,
         CASE WHEN doc_id % 5 <> 0 THEN 'dev' || (doc_id % 17) || '@example.com' END AS author_email,
         CASE WHEN doc_id % 13 <> 0
              THEN make_timestamp((1704067200 + doc_id * 3600) * 1000000) END AS author_date,
         'dev' || ((doc_id + 1) % 17) AS committer_name,
         CASE WHEN (doc_id + 1) % 5 <> 0 THEN 'dev' || ((doc_id + 1) % 17) || '@example.com' END AS committer_email,
         CASE WHEN (doc_id + 1) % 13 <> 0
              THEN make_timestamp((1704067260 + (doc_id + 1) * 3600) * 1000000) END AS committer_date,
         text AS message
  FROM documents
),
commits AS (SELECT * FROM raw WHERE n_parents <= 1)"""

_SPOILT = """
spoilt AS (
  SELECT doc_id, CASE doc_id % 10
           WHEN 0 THEN upper(sha256(CAST(doc_id AS VARCHAR)))
           WHEN 1 THEN substr(sha256(CAST(doc_id AS VARCHAR)), 1, 38)
           WHEN 2 THEN 'z' || substr(sha256(CAST(doc_id AS VARCHAR)), 2)
           WHEN 3 THEN ''
           WHEN 4 THEN sha256(CAST(doc_id AS VARCHAR)) || chr(10)
           ELSE sha256(CAST(doc_id AS VARCHAR)) END AS sha
  FROM documents
),
judged AS (
  SELECT doc_id, sha, regexp_full_match(sha, '[0-9a-f]{40}|[0-9a-f]{64}') AS is_valid FROM spoilt
)"""

_TURNS = """
turns AS (
  SELECT 'conversations' AS repo, sha256('conv-' || conv_id || '-' || turn) AS sha, role AS author_name,
         CAST(NULL AS VARCHAR) AS author_email,
         make_timestamp((1704067200 + conv_id * 60 + turn) * 1000000) AS author_date,
         role AS committer_name, CAST(NULL AS VARCHAR) AS committer_email,
         make_timestamp((1704067200 + conv_id * 60 + turn) * 1000000) AS committer_date,
         text AS message
  FROM conversations
)"""

_VECTORS = """
vectors AS (
  SELECT vec_id, sha256(CAST(vec_id AS VARCHAR)) AS sha, embedding, label,
         CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings
),
labelled AS (SELECT DISTINCT sha256(CAST(doc_id AS VARCHAR)) AS sha FROM labels)"""

_HITS = """
hits AS (
  SELECT query_id, rank, sha, 'message' AS source, similarity FROM (
    SELECT CAST(b.item_id AS VARCHAR) AS query_id, d.sha, list_cosine_similarity(q.v, d.v) AS similarity,
           row_number() OVER (PARTITION BY b.item_id ORDER BY list_cosine_similarity(q.v, d.v) DESC, d.sha) AS rank
    FROM benchmark b JOIN vectors q ON q.vec_id = b.item_id CROSS JOIN vectors d
  ) WHERE rank <= 10
)"""

_HIT_LINE = """printf('%d. %s  (similarity: %.4f)' || chr(10) || '   %s',
              {rank}, substr({sha}, 1, 7), {similarity}, split_part({message}, chr(10), 1))"""

# Vectors of hashed words for the texts of a table `texts(id, text)`.
_HASHED = """
words AS (
  SELECT id, CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) % 64 AS bucket
  FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM texts) WHERE w <> ''
),
counted AS (SELECT id, bucket, CAST(count(*) AS DOUBLE) AS n FROM words GROUP BY id, bucket),
lengths AS (SELECT id, sqrt(sum(n * n)) AS length FROM counted GROUP BY id)"""

# Texts that the embedder of short texts refuses.
_REFUSED = "length(message) % 97 = 0"

_NO_COUNTS = ", ".join(f"NULL::BIGINT AS {c}" for c in STAGES)


def _run(name: str, state: str, error: str, **counts: str) -> str:
    """One row of the ledger; counts that are not given are zero."""
    numbers = ", ".join(f"CAST({counts.get(c, '0')} AS BIGINT) AS {c}" for c in STAGES)
    return f"SELECT '{name}' AS run, '{state}' AS state, {numbers}, {error} AS error FROM sizes"


def _rows(reason: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN '{reason} (' || {n} || ' rows)' END"


_FLAT = """
  SELECT repo, sha, author_name, coalesce(author_email, '') AS author_email,
         coalesce(CAST(author_date AS VARCHAR), '0001-01-01 00:00:00') AS author_date,
         committer_name, coalesce(committer_email, '') AS committer_email,
         CAST(committer_date AS VARCHAR) AS committer_date, message
  FROM commits"""

ORACLES: dict[str, str] = {
    "b01_flatten_drop_merges": f"WITH {_RAW} {_FLAT}",
    "b02_parse_log_dump": f"WITH {_RAW} {_FLAT}",
    "b03_union_overlapping_exports": f"""
WITH {_RAW}, {_TURNS},
feed AS (
  SELECT repo, sha, author_name, author_email, author_date, committer_name, committer_email, committer_date, message
  FROM commits
  UNION ALL
  SELECT 'a-mirror/' || repo, sha, author_name, author_email, author_date, committer_name, committer_email,
         committer_date + INTERVAL 10 SECOND, message
  FROM commits
  UNION ALL
  SELECT repo, sha, author_name, author_email, author_date, committer_name, committer_email, committer_date, message
  FROM turns
)
SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (PARTITION BY sha ORDER BY committer_date NULLS LAST, repo) AS place FROM feed
) WHERE place = 1""",
    "b04_utc_dates_and_nulls": f"""
WITH {_RAW} SELECT sha, author_email, author_date, committer_email, committer_date FROM raw""",
    "b05_read_back_form": f"""
WITH {_RAW}
SELECT sha, coalesce(author_email, '') AS author_email,
       coalesce(CAST(author_date AS VARCHAR), '0001-01-01 00:00:00') AS author_date,
       coalesce(committer_email, '') AS committer_email,
       coalesce(CAST(committer_date AS VARCHAR), '0001-01-01 00:00:00') AS committer_date
FROM raw""",
    "b06_commit_id_check": f"WITH {_SPOILT} SELECT doc_id, sha, is_valid FROM judged",
    "b07_report_of_rejects": f"""
WITH {_RAW}, {_SPOILT},
reasons AS (
  SELECT CASE WHEN NOT is_valid THEN 'invalid commit id'
              WHEN author_name = 'dev3' THEN 'author_name is null'
              WHEN lang = 'fr' THEN 'message is null' END AS reason
  FROM commits JOIN judged USING (doc_id)
)
SELECT 'clean' AS stage, reason, count(*) AS n_rows FROM reasons WHERE reason IS NOT NULL GROUP BY reason""",
    "b07_report_of_rejects_strict": f"""
WITH {_RAW},
marked AS (
  SELECT repo, CASE WHEN length(message) % 211 = 0 THEN '' ELSE sha END AS sha, committer_date, message FROM commits
),
batched AS (
  SELECT repo, sha, (row_number() OVER (
           PARTITION BY repo ORDER BY committer_date NULLS LAST, sha, md5(message)) - 1) // 50 AS batch_no
  FROM marked
),
reasons AS (
  SELECT CASE WHEN sha = '' THEN 'invalid commit id'
              WHEN bool_or(sha = '') OVER (PARTITION BY repo, batch_no)
              THEN 'batch holds an invalid commit' END AS reason
  FROM batched
)
SELECT 'clean' AS stage, reason, count(*) AS n_rows FROM reasons WHERE reason IS NOT NULL GROUP BY reason""",
    "b08_hashed_word_vectors": f"""
WITH {_RAW}, texts AS (SELECT sha AS id, message AS text FROM commits), {_HASHED}
SELECT id AS sha, 'message' AS source, 'hashed-words-64' AS model, 64 AS dim, bucket,
       round(CAST(CAST(n / length AS FLOAT) AS DOUBLE), 4) AS weight
FROM counted JOIN lengths USING (id)""",
    "b09_failing_embedder": f"""
WITH {_RAW},
batched AS (
  SELECT repo, sha, message, (row_number() OVER (PARTITION BY repo ORDER BY sha) - 1) // 50 AS batch_no FROM commits
),
calls AS (
  SELECT repo, batch_no, sha,
         bool_or(length(message) % 97 = 0) OVER (PARTITION BY repo, batch_no) AS refused,
         bool_or(length(message) % 89 = 1) OVER (PARTITION BY repo, batch_no) AS lost,
         count(*) OVER (PARTITION BY repo, batch_no) AS n
  FROM batched
)
SELECT repo, batch_no, sha,
       CASE WHEN NOT refused AND NOT lost THEN 2 END AS dim,
       CASE WHEN NOT refused AND NOT lost THEN 'picky' END AS model,
       CASE WHEN refused THEN 'RuntimeError: text refused'
            WHEN lost THEN 'ValueError: reply has ' || (n - 1) || ' vectors for ' || n || ' texts' END AS detail
FROM calls""",
    "b09_join_external_vectors": f"""
WITH {_RAW}, {_VECTORS}
SELECT v.sha, c.repo, CASE WHEN c.sha IS NOT NULL THEN CAST(len(v.embedding) AS INTEGER) END AS dim,
       CASE WHEN c.sha IS NULL THEN 'unknown commit id' ELSE 'stored' END AS outcome
FROM vectors v LEFT JOIN commits c ON c.sha = v.sha""",
    "b10_append_commits_once": f"""
WITH {_RAW}, {_VECTORS}
SELECT c.sha, CASE WHEN l.sha IS NULL THEN c.repo ELSE 'early/' || c.repo END AS repo,
       author_email, committer_date, message
FROM commits c LEFT JOIN labelled l ON l.sha = c.sha""",
    "b11_append_embeddings_once": f"""
WITH {_VECTORS}
SELECT v.sha, 'message' AS source, 'fixture-64' AS model, CAST(len(embedding) AS INTEGER) AS dim,
       round(CASE WHEN l.sha IS NULL THEN v.v[1] ELSE v.v[len(v.v)] END, 6) AS first_value
FROM vectors v LEFT JOIN labelled l ON l.sha = v.sha
UNION ALL
SELECT sha, 'message', 'other-64', CAST(len(embedding) AS INTEGER), round(v[1], 6) FROM vectors""",
    "b12_integrity_of_embeddings": f"""
WITH {_RAW}, {_VECTORS}
SELECT v.sha, CASE WHEN label = 3 THEN 'vector size does not match dim'
                   WHEN c.sha IS NULL THEN 'no such commit' ELSE 'stored' END AS outcome
FROM vectors v LEFT JOIN commits c ON c.sha = v.sha""",
    "b12_cascade_to_embeddings": f"""
WITH {_VECTORS}
SELECT sha, 'message' AS source, 'fixture-64' AS model, CAST(len(embedding) AS INTEGER) AS dim
FROM vectors WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "b13_list_unsynced": f"""
WITH {_VECTORS}
SELECT sha, 'message' AS source, 'fixture-64' AS model, CAST(len(embedding) AS INTEGER) AS dim
FROM vectors WHERE sha NOT IN (SELECT sha FROM labelled)""",
    "b13_repair_unsynced": f"""
WITH {_VECTORS}
SELECT sha, 'fixture-64' AS model, 'message' AS source,
       sha NOT IN (SELECT sha FROM labelled) AS in_index, TRUE AS is_synced
FROM vectors""",
    "b14_build_index": f"""
WITH {_VECTORS}
SELECT sha || '|fixture-64|message' AS doc_id,
       CASE WHEN label NOT IN (5, 6) THEN CAST(len(embedding) AS INTEGER) END AS dim,
       CASE WHEN label NOT IN (5, 6)
            THEN round(v[1] / sqrt(list_inner_product(v, v)), 4) + 0.0 END AS first_unit,
       CASE WHEN label NOT IN (5, 6) THEN 1.0 END::DOUBLE AS unit_length,
       CASE label WHEN 5 THEN 'vector is zero' WHEN 6 THEN 'vector is empty' ELSE 'synced' END AS outcome
FROM vectors""",
    "b15_look_up_request_list": f"""
WITH {_RAW}
SELECT conv_id, turn, pos, sha, repo, split_part(message, chr(10), 1) AS subject
FROM (SELECT conv_id, turn, 0 AS pos, conv_id AS wanted FROM conversations
      UNION ALL SELECT conv_id, turn, 1, turn FROM conversations
      UNION ALL SELECT conv_id, turn, 2, conv_id FROM conversations)
JOIN commits ON doc_id = wanted""",
    "b16_hits_with_commits": f"""
WITH {_RAW}, {_VECTORS}, {_HITS}
SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS line_no, h.sha, repo,
       round(similarity, 4) AS similarity, author_name
FROM hits h JOIN commits c ON c.sha = h.sha""",
    "b16_page_of_every_query": f"""
WITH {_RAW}, {_VECTORS}, {_HITS},
first AS (
  SELECT query_id, h.sha, similarity, message FROM hits h JOIN commits c ON c.sha = h.sha WHERE rank = 1
)
SELECT query_id, sha,
       CASE WHEN sha IS NULL THEN 'No matching commits found.'
            ELSE {_HIT_LINE.format(rank="CAST(1 AS BIGINT)", sha="sha", similarity="similarity", message="message")}
       END AS display
FROM (SELECT CAST(item_id AS VARCHAR) AS query_id FROM benchmark JOIN vectors ON vec_id = item_id)
LEFT JOIN first USING (query_id)""",
    "b17_top_k_for_many_queries": f"""
WITH {_VECTORS}, {_HITS}
SELECT query_id, rank, sha, source, round(similarity, 4) AS similarity FROM hits""",
    "b18_top_k_by_floor": f"""
WITH {_VECTORS},
ranked AS (
  SELECT CAST(b.item_id AS VARCHAR) AS query_id, d.sha, list_cosine_similarity(q.v, d.v) AS similarity,
         row_number() OVER (PARTITION BY b.item_id
                            ORDER BY list_cosine_similarity(q.v, d.v) DESC, d.sha) AS rank
  FROM benchmark b JOIN vectors q ON q.vec_id = b.item_id CROSS JOIN vectors d
)
SELECT query_id, rank, sha, 'message' AS source, round(similarity, 4) AS similarity FROM ranked WHERE rank <= 50""",
    "b18_top_k_edges": f"""
WITH {_VECTORS}
SELECT 'documents' AS k_case, 'fixture-64' AS query_id, count(*) AS n_hits,
       CAST(NULL AS BIGINT) AS first_rank, CAST(NULL AS BIGINT) AS last_rank
FROM vectors
UNION ALL
SELECT 'above count', 'last', count(*), 1, count(*) FROM vectors""",
    "b18_top_k_of_close_vectors": f"""
WITH {_VECTORS},
near AS (
  SELECT vec_id, sha, list_transform(v, lambda x: CAST(CAST(1.0 + 0.02 * x AS FLOAT) AS DOUBLE)) AS v FROM vectors
),
docs AS (SELECT sha, s AS source, v FROM near, unnest(['message', 'diff_summary']) AS t(s)),
ranked AS (
  SELECT CAST(b.item_id AS VARCHAR) AS query_id, d.sha, d.source, list_cosine_similarity(q.v, d.v) AS similarity,
         row_number() OVER (PARTITION BY b.item_id
                            ORDER BY list_cosine_similarity(q.v, d.v) DESC, d.sha, d.source) AS rank
  FROM benchmark b JOIN near q ON q.vec_id = b.item_id CROSS JOIN docs d
)
SELECT query_id, rank, sha, source, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 50""",
    "b19_best_hit_per_commit": f"""
WITH {_VECTORS},
docs AS (
  SELECT sha, 'message' AS source, v FROM vectors
  UNION ALL
  SELECT sha256(CAST(vec_id - 1 AS VARCHAR)), 'diff_summary', v FROM vectors WHERE vec_id > 0
),
ranked AS (
  SELECT CAST(b.item_id AS VARCHAR) AS query_id, d.sha, list_cosine_similarity(q.v, d.v) AS similarity,
         row_number() OVER (PARTITION BY b.item_id
                            ORDER BY list_cosine_similarity(q.v, d.v) DESC, d.sha, d.source) AS rank
  FROM benchmark b JOIN vectors q ON q.vec_id = b.item_id CROSS JOIN docs d
)
SELECT query_id, sha, round(max(similarity), 4) AS similarity, count(*) AS n_embeddings
FROM ranked WHERE rank <= 10 GROUP BY query_id, sha""",
    "b20_text_search": f"""
WITH {_RAW},
texts AS (
  SELECT 'c' || sha AS id, message AS text FROM commits
  UNION ALL SELECT 'q' || item_id, text FROM benchmark
), {_HASHED},
dense AS (
  SELECT l.id, list(CAST(CAST(coalesce(n, 0) / length AS FLOAT) AS DOUBLE) ORDER BY b.bucket) AS v
  FROM lengths l CROSS JOIN range(64) AS b(bucket) LEFT JOIN counted c ON c.id = l.id AND c.bucket = b.bucket
  GROUP BY l.id
),
ranked AS (
  SELECT substr(q.id, 2) AS query_id, substr(d.id, 2) AS sha, list_cosine_similarity(q.v, d.v) AS similarity,
         row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, d.v) DESC, d.id) AS rank
  FROM dense q CROSS JOIN dense d WHERE q.id LIKE 'q%' AND d.id LIKE 'c%'
)
SELECT query_id, rank, sha, {_HIT_LINE.format(rank="rank", sha="sha", similarity="similarity", message="message")}
       AS display
FROM ranked JOIN commits USING (sha) WHERE rank <= 10""",
    "b21_pack_and_unpack": f"""
WITH {_VECTORS}
SELECT sha, len(embedding) * 4 - CASE label WHEN 7 THEN 1 WHEN 8 THEN 4 ELSE 0 END AS n_bytes,
       CASE WHEN label NOT IN (7, 8) THEN TRUE END AS is_same,
       CASE WHEN label NOT IN (7, 8) THEN round(v[1], 6) END AS first_value,
       CASE WHEN label NOT IN (7, 8) THEN 1.0 END::DOUBLE AS similarity,
       CASE label WHEN 7 THEN 'byte length is not a multiple of 4'
                  WHEN 8 THEN 'byte length does not match dim' END AS reason
FROM vectors""",
    "b22_stream_documents": f"""
WITH {_RAW}, {_SPOILT}
SELECT c.sha, repo, author_email, committer_date, CAST(length(message) AS BIGINT) AS n_chars,
       'message' AS source, 'hashed-words-64' AS model, 64 AS dim,
       c.sha || '|hashed-words-64|message' AS doc_id, TRUE AS is_synced
FROM commits c JOIN judged j USING (doc_id) WHERE j.is_valid""",
    "b23_index_again": f"""
WITH {_RAW}, {_SPOILT}, {_TURNS},
sizes AS (
  SELECT count(*) FILTER (is_valid) AS good, count(*) FILTER (NOT is_valid) AS bad,
         (SELECT count(DISTINCT sha) FROM turns) AS more
  FROM commits JOIN judged USING (doc_id)
),
steps AS (
  SELECT 'first' AS after, good, bad FROM sizes
  UNION ALL SELECT 'same again', good, bad * 2 FROM sizes
  UNION ALL SELECT 'empty', good, bad * 2 FROM sizes
  UNION ALL SELECT 'more', good + more, bad * 3 FROM sizes
)
SELECT after, unnest(['commits', 'embeddings', 'index_docs', 'sync_log', 'rejects']) AS stored,
       unnest([good, good, good, good, bad]) AS n_rows
FROM steps""",
    "b22_stream_of_files": f"""
WITH {_RAW}, {_SPOILT},
texts AS (SELECT c.sha AS id, message AS text FROM commits c JOIN judged j USING (doc_id) WHERE j.is_valid), {_HASHED}
SELECT id AS sha, bucket, round(CAST(CAST(n / length AS FLOAT) AS DOUBLE), 4) AS weight
FROM counted JOIN lengths USING (id)
UNION ALL SELECT 'runs', 3, CAST(count(*) AS DOUBLE) FROM raw""",
    "b24_failed_then_taken_up": f"""
WITH {_RAW},
sizes AS (
  SELECT (SELECT count(*) FROM raw) AS seen, count(*) AS n, count(*) FILTER ({_REFUSED}) AS bad FROM commits
)
{_run("1-dead", "done", _rows("embed: ConnectionError: no embedder", "n"), read="seen", asked="n", failed="n")}
UNION ALL
{_run("2-some", "done", _rows("embed: RuntimeError: text refused", "bad"), asked="n", claimed="n", failed="bad",
      commits="n - bad", embeddings="n - bad", indexed="n - bad")}
UNION ALL
SELECT 'waiting ' || sha, 'tries 2', {_NO_COUNTS}, 'RuntimeError: text refused' FROM commits WHERE {_REFUSED}""",
    "b24_queue_worked_off": f"""
WITH {_RAW}
SELECT sha, repo, author_email, committer_date, CAST(length(message) AS BIGINT) AS n_chars,
       'message' AS source, 'hashed-words-64' AS model, 64 AS dim,
       sha || '|hashed-words-64|message' AS doc_id, TRUE AS is_synced, CAST(NULL AS INTEGER) AS tries
FROM commits""",
    "b25_failing_store": f"""
WITH {_RAW}, {_SPOILT},
sizes AS (
  SELECT (SELECT count(*) FROM raw) AS seen, count(*) FILTER (is_valid) AS n, count(*) FILTER (NOT is_valid) AS bad
  FROM commits JOIN judged USING (doc_id)
)
{_run("1-full-disk", "failed", "'store: OSError: no space left'", read="seen", rejected="bad", asked="n",
      commits="n", embeddings="n")}
UNION ALL
{_run("2-repair", "done", "NULL")}
UNION ALL
{_run("3-again", "done", _rows("clean: invalid commit id", "bad"), read="seen", rejected="bad")}
UNION ALL
SELECT 'index', 'marked', {_NO_COUNTS.replace("NULL::BIGINT AS indexed", "n AS indexed")}, NULL FROM sizes""",
    "b26_alias_asked_twice": f"""
WITH {_RAW}, {_TURNS},
sizes AS (
  SELECT (SELECT count(*) FROM raw) AS seen, (SELECT count(*) FROM commits) AS n, count(*) AS more,
         count(DISTINCT sha) AS new FROM turns
)
{_run("1-default", "done", "NULL", read="seen", asked="n", commits="n", embeddings="n", indexed="n")}
UNION ALL
{_run("2-again", "done", "NULL", read="seen + more", asked="new", commits="new", embeddings="new", indexed="new")}
UNION ALL
{_run("3-by-name", "done", "NULL", read="seen")}""",
    "b27_appends_compacted": f"""
WITH {_RAW}, {_VECTORS}, {_TURNS},
stored AS (
  SELECT c.sha, CASE WHEN l.sha IS NULL THEN c.repo ELSE 'early/' || c.repo END AS repo, committer_date, message
  FROM commits c LEFT JOIN labelled l ON l.sha = c.sha
  UNION ALL
  SELECT sha, repo, committer_date, message FROM turns
)
SELECT s.sha, repo, committer_date, CAST(length(message) AS BIGINT) AS n_chars,
       l.sha IS NOT NULL AS asked, TRUE AS fewer_files
FROM stored s LEFT JOIN labelled l ON l.sha = s.sha""",
    "b28_malformed_records": f"""
WITH {_RAW},
judged AS (SELECT repo, n_parents = 0 OR author_email IS NULL AS damaged FROM commits),
total AS (SELECT 'clean: malformed record (' || count(*) FILTER (damaged) || ' rows)' AS error FROM judged)
SELECT repo, CASE WHEN damaged THEN 'malformed record' ELSE 'indexed' END AS reason, error, count(*) AS n_rows
FROM judged, total GROUP BY ALL""",
    "nearest_commits": f"""
WITH {_RAW}, {_VECTORS}, {_HITS},
listed AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS line_no, h.sha, similarity, message
  FROM hits h JOIN commits c ON c.sha = h.sha
)
SELECT query_id, line_no, sha, round(similarity, 4) AS similarity,
       {_HIT_LINE.format(rank="line_no", sha="sha", similarity="similarity", message="message")} AS display
FROM listed""",
}
