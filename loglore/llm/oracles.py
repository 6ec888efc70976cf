"""DuckDB SQL for the operators that SQL can express; the others are tested by brute force."""

from __future__ import annotations

from loglore.llm.line_dedup import LEAST_PAGES, RATIO
from loglore.llm.quality import (
    CHANCE_CHARS,
    CHANCE_WORDS,
    COMMON_WORDS,
    LEAST_CHARS,
    LEAST_COMMON,
    LEAST_WORDS,
    MOST_CHARS_APART,
    MOST_REPEATED,
    MOST_WORDS_APART,
)
from loglore.llm.secrets import LEAST_ASSIGNED, SHARED_OWNERS
from loglore.llm.url_filter import ORDER, RULES

_WORD = r"[^\x20\x09-\x0D]"


def _distance(own: list[str], reference: list[str]) -> str:
    """Jensen-Shannon distance of two lists of columns, as SQL."""
    total, sums = (" + ".join(x) for x in (own, reference))
    parts = []
    for a, b in zip(own, reference, strict=True):
        p, q = f"({a} / ({total})::DOUBLE)", f"({b} / ({sums})::DOUBLE)"
        for x in (p, q):
            parts.append(f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) / 2 ELSE 0 END")
    return f"CASE WHEN {total} > 0 AND {sums} > 0 THEN sqrt(greatest({' + '.join(parts)}, 0)) END"


def _quality() -> str:
    bins = 1 + max(map(len, COMMON_WORDS.values()))
    counted = []
    for i in range(bins):
        cases = []
        for lang, words in COMMON_WORDS.items():
            if i < len(words):
                w = words[i]
                of = f"len(list_filter(ws, lambda x: x IN ('{w}', '{w.capitalize()}')))"
            else:
                every = ", ".join(f"'{x}', '{x.capitalize()}'" for x in words)
                of = f"len(list_filter(ws, lambda x: x NOT IN ({every})))"
            cases.append(f"WHEN lang = '{lang}' THEN {of}")
        counted.append(f"CASE {' '.join(cases)} END AS w{i}")
    classes = [r"\p{Ll}+", r"\p{Lu}+", r"[\x20\x09-\x0D]+", "[0-9]+", r"""[.,;:!?''"()-]+"""]
    texts = ["t"]
    for kind in classes:
        texts.append(f"regexp_replace({texts[-1]}, '{kind}', '', 'g')")
    chars = [f"length({a}) - length({b}) AS c{i}" for i, (a, b) in enumerate(zip(texts, texts[1:], strict=False))]
    chars.append(f"length({texts[-1]}) AS c{len(classes)}")
    names = [f"c{i}" for i in range(len(classes) + 1)], [f"w{i}" for i in range(bins)]
    sums = ", ".join(f"sum({n}) AS r{n}" for n in [*names[0], *names[1]])
    langs = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws
  FROM documents),
h AS (SELECT *, {", ".join(counted)}, {", ".join(chars)} FROM d),
ref AS (SELECT lang AS rlang, {sums} FROM (SELECT DISTINCT ON (lang, t) * FROM h) GROUP BY lang),
g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n
  FROM (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d))),
rep AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY rid),
m AS (
  SELECT h.doc_id, length(t) AS n_chars, len(ws) AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         CASE WHEN length(t) >= {LEAST_CHARS} THEN {_distance(names[0], [f"r{n}" for n in names[0]])} END AS chars_apart,
         CASE WHEN len(ws) >= {LEAST_COMMON} AND h.lang IN ({langs})
              THEN {_distance(names[1], [f"r{n}" for n in names[1]])} END AS words_apart
  FROM h JOIN ref ON h.lang IS NOT DISTINCT FROM ref.rlang
  LEFT JOIN dup ON dup.rid = h.rid LEFT JOIN rep ON rep.rid = h.rid),
v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       round(chars_apart, 6) AS chars_apart, round(words_apart, 6) AS words_apart,
       NOT base_failed AND coalesce(chars_apart <= {MOST_CHARS_APART} + {CHANCE_CHARS} / sqrt(n_chars), true)
         AND coalesce(words_apart <= {MOST_WORDS_APART} + {CHANCE_WORDS} / sqrt(n_words), true) AS kept
FROM v"""


def _secrets() -> str:
    keys = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in "password passwd secret token".split())
    assign = rf"({keys}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    kinds = [
        (assign, 2, f"length(value) >= {LEAST_ASSIGNED}"),
        ("AKIA[A-Z0-9]+", 0, "length(value) >= 16"),
        ("[0-9a-f]+", 0, "length(value) >= 32"),
        (
            "[A-Za-z0-9+/_=-]{24,}", 0,
            "regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')",
        ),
    ]
    found = "\nUNION ALL\n".join(
        f"""SELECT rid, {rank} AS rank, e - length(whole) AS s, e, value FROM (
  SELECT rid, whole, value, sum(length(gap) + length(whole)) OVER (PARTITION BY rid ORDER BY i)::BIGINT AS e
  FROM (SELECT rid, unnest(range(1, len(whole) + 1)) AS i, unnest(gaps[1:len(whole)]) AS gap, unnest(whole) AS whole,
               unnest(value) AS value
        FROM (SELECT rid, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS whole,
                     regexp_extract_all(t, '{p}', {group}) AS value FROM d)))
WHERE {holds}"""
        for rank, (p, group, holds) in enumerate(kinds)
    )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS owner,
         coalesce(source, chr(0)) || chr(1) || coalesce(lang, chr(0)) AS repository
  FROM documents),
f AS ({found}),
spans AS (
  SELECT * FROM f WHERE rank < 3
  UNION ALL
  SELECT * FROM f AS x WHERE rank = 3
    AND NOT EXISTS (SELECT 1 FROM f AS y WHERE y.rid = x.rid AND y.rank < 3 AND y.s < x.e AND x.s < y.e)),
shares AS (
  SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories
  FROM spans JOIN d USING (rid) GROUP BY value),
judged AS (
  SELECT spans.*, owners, ['assign', 'access', 'hex', 'opaque'][rank + 1] || ':' || s || ':' || e AS written
  FROM spans JOIN shares USING (value) WHERE rank < 3 OR owners = 1 AND repositories = 1),
r AS (
  SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
         count(*) FILTER (rank = 2) AS n_hex, string_agg(written, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
         string_agg(written, ',' ORDER BY s, rank) AS spans, count(*) FILTER (owners < {SHARED_OWNERS}) AS n_live,
         count(*) FILTER (owners >= {SHARED_OWNERS}) AS n_shared
  FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_shared, 0) AS n_shared
FROM d LEFT JOIN r USING (rid)"""


def _urls() -> str:
    rule = verdict = "NULL"
    for r in sorted(RULES, key=lambda r: len(r.host + r.path)):
        fits = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        rule = f"CASE WHEN {fits} THEN '{r.host}{r.path}' ELSE {rule} END"
        verdict = f"CASE WHEN {fits} THEN '{r.verdict}' ELSE {verdict} END"
    tables, last = [], "p0"
    for k in range(ORDER + 1):
        mixed = ", ".join(
            f"CASE WHEN all_{c} > 0 THEN ({c} + kinds_{c} * p_{c}) / (all_{c} + kinds_{c}) ELSE p_{c} END AS p_{c}"
            for c in ("yes", "no")
        )
        tables.append(f"""e{k} AS (
  SELECT right(run, {k + 1}) AS ending, sum(yes) AS yes, sum(no) AS no FROM counts GROUP BY 1),
a{k} AS (
  SELECT left(ending, {k}) AS context, sum(yes) AS all_yes, sum(no) AS all_no,
         count(*) FILTER (yes > 0) AS kinds_yes, count(*) FILTER (no > 0) AS kinds_no FROM e{k} GROUP BY 1),
p{k + 1} AS (
  SELECT run, {mixed} FROM p{k} JOIN e{k} ON ending = right(run, {k + 1}) JOIN a{k} ON context = left(ending, {k}))""")
        last = f"p{k + 1}"
    moments = ", ".join(
        f"sum({c}) AS n_{c}, sum({c} * score) / nullif(sum({c}), 0) AS mean_{c}, "
        f"sqrt(greatest(0, sum({c} * score * score) / nullif(sum({c}), 0) - (sum({c} * score) / nullif(sum({c}), 0)) ** 2)) AS dev_{c}"
        for c in ("yes", "no")
    )
    return rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
n AS (SELECT *, {rule} AS rule, {verdict} AS by_rule, host || path AS line FROM u),
lines AS (
  SELECT line, count(*) FILTER (by_rule = 'allow') AS yes, count(*) FILTER (by_rule = 'block') AS no FROM n GROUP BY line),
runs AS (
  SELECT line, yes, no, substring(repeat(chr(2), {ORDER}) || line || chr(3), i::BIGINT, {ORDER + 1}) AS run
  FROM (SELECT *, unnest(range(1, length(line) + 2)) AS i FROM lines)),
counts AS (SELECT run, sum(yes) AS yes, sum(no) AS no FROM runs GROUP BY run),
p0 AS (
  SELECT run, 1.0::DOUBLE / (SELECT count(DISTINCT right(run, 1)) FROM counts) AS p_yes,
         1.0::DOUBLE / (SELECT count(DISTINCT right(run, 1)) FROM counts) AS p_no FROM counts),
{", ".join(tables)},
scored AS (
  SELECT line, yes, no, avg(ln(p_yes) - ln(p_no)) AS score FROM runs JOIN {last} USING (run) GROUP BY line, yes, no),
moments AS (SELECT {moments} FROM scored),
bound AS (
  SELECT CASE WHEN n_yes > 0 AND n_no > 0 THEN
           CASE WHEN dev_yes + dev_no > 0 THEN (mean_yes * dev_no + mean_no * dev_yes) / (dev_yes + dev_no)
                ELSE (mean_yes + mean_no) / 2 END END AS bound FROM moments)
SELECT page_id, host, path, rule,
       coalesce(by_rule, CASE WHEN score < bound THEN 'block' ELSE 'allow' END) AS verdict, round(score, 6) AS score
FROM n JOIN scored USING (line), bound"""


def _lines() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (
  SELECT rid, source, text, i, line FROM (
    SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS i FROM d WHERE text IS NOT NULL)),
c AS (
  SELECT source, line, count(DISTINCT text) AS pages FROM l WHERE regexp_matches(line, '{_WORD}') GROUP BY 1, 2),
t AS (SELECT source, count(*) AS of_pages FROM (SELECT DISTINCT source, text FROM d) GROUP BY 1),
b AS (
  SELECT c.source, line FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
  WHERE pages >= {LEAST_PAGES} AND pages > {RATIO} * of_pages),
s AS (
  SELECT rid, i, l.line, b.line IS NOT NULL AS dropped
  FROM l LEFT JOIN b ON l.line = b.line AND l.source IS NOT DISTINCT FROM b.source),
r AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS kept
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, kept AS text
FROM d LEFT JOIN r USING (rid)"""


ORACLES: dict[str, str] = {
    "op3_divergence_rules": _quality(),
    "op6_secret_owners": _secrets(),
    "op8_url_ratio": _urls(),
    "op9_site_lines": _lines(),
}
