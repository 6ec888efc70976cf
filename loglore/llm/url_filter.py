"""URL verdicts: rules by host and path, else the ratio of two character language models."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglore.operators.sizing import fits_broadcast
from loglore.session import materialise, staging, work_path


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


#: Fixed values.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: Characters of the longest context.
ORDER = 4
START, END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def ruled(host: str, path: str, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = (F.col(host) == r.host) | F.col(host).endswith("." + r.host)
        fits = fits & F.col(path).startswith(r.path)
        rule = F.when(fits, r.host + r.path).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of `pages` (page_id, url).

    URLs that a rule allows or blocks train one model each of the characters of host and path.
    A character's probability is that in its longest context of ORDER characters, mixed with the
    next shorter one's by how many different characters were seen there (Witten-Bell), down to the
    same for all; a context never seen leaves the shorter one's as it is. `score` is the mean over
    the characters of log(allowed / blocked). The bound lies between the two classes' means, as many
    standard deviations from either. URLs without a rule are allowed from the bound on.

    Without URLs of both classes, all without a rule are allowed. A null URL, or one without ://, has
    empty host and path and is scored as an empty text. Rows that repeat share a score.

    Equal texts are scored once. Counts are taken per run of ORDER + 1 characters, with partial sums;
    shorter contexts are sums of these. The runs' scores go to the texts by broadcast behind a check
    of their size, else by a join that Spark splits where a run is frequent.
    """
    spark = pages.sparkSession
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = ruled("host", "path", rules)
    named = named.select("*", rule.alias("rule"), verdict.alias("by_rule"), F.concat("host", "path").alias("line"))
    with staging(spark) as folder:
        lines = named.groupBy("line").agg(
            F.count_if(F.col("by_rule") == "allow").alias("yes"), F.count_if(F.col("by_rule") == "block").alias("no")
        )
        lines = materialise(lines, "lines", folder)
        padded = F.concat(F.lit(START * ORDER), "line", F.lit(END))
        lines = lines.withColumn("padded", padded)
        at = F.sequence(F.lit(1), F.length("line") + 1)
        runs = F.explode(F.transform(at, lambda i: F.substring(F.col("padded"), i, F.lit(ORDER + 1)))).alias("run")
        counts = lines.select("yes", "no", runs).groupBy("run").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        model = materialise(_ratios(materialise(counts, "counts", folder)), "model", folder)
        small = fits_broadcast(model)

        cut = lines.select("line", "yes", "no", runs).join(F.broadcast(model) if small else model, "run")
        scored = cut.groupBy("line", "yes", "no").agg(F.avg("ratio").alias("score"))
        scored = materialise(scored, "scored", folder)
        bound = _bound(scored)
        by_model = F.lit("allow") if bound is None else F.when(F.col("score") < bound, "block").otherwise("allow")
        result = named.join(scored.select("line", "score"), "line").select(
            "page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score"
        )
        path = work_path(spark, "url-verdicts")
        result.write.parquet(path)
    return spark.read.parquet(path)


def _ratios(counts: DataFrame) -> DataFrame:
    """run, ratio: log of the last character's probability as allowed against as blocked."""
    letters = counts.select(F.right("run", F.lit(1)).alias("x")).distinct().count()
    flat = F.lit(1.0 / max(1, letters))
    runs = counts.select("run", flat.alias("p_yes"), flat.alias("p_no"))
    small = fits_broadcast(counts)
    for k in range(ORDER + 1):
        ends = counts.groupBy(F.right("run", F.lit(k + 1)).alias("end")).agg(
            F.sum("yes").alias("yes"), F.sum("no").alias("no")
        )
        context = F.substring("end", 1, k)
        around = ends.groupBy(context.alias("context")).agg(
            F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"),
            F.count_if(F.col("yes") > 0).alias("kinds_yes"), F.count_if(F.col("no") > 0).alias("kinds_no"),
        )
        ends = ends.withColumn("context", context)
        known = ends.join(F.broadcast(around) if small else around, "context")
        runs = runs.withColumn("end", F.right("run", F.lit(k + 1)))
        runs = runs.join(F.broadcast(known) if small else known, "end").select(
            "run", *[_mixed(c).alias(f"p_{c}") for c in ("yes", "no")]
        )
    return runs.select("run", (F.log("p_yes") - F.log("p_no")).alias("ratio"))


def _mixed(c: str) -> Column:
    total, kinds, shorter = F.col(f"all_{c}"), F.col(f"kinds_{c}"), F.col(f"p_{c}")
    return F.when(total > 0, (F.col(c) + kinds * shorter) / (total + kinds)).otherwise(shorter)


def _bound(scored: DataFrame) -> float | None:
    """Between the classes' means, as many standard deviations from either; null without both classes."""
    row = {}
    for c in ("yes", "no"):
        n = F.sum(c)
        row |= {f"n_{c}": n, f"mean_{c}": F.sum(F.col(c) * F.col("score")) / F.nullif(n, F.lit(0))}
        row[f"square_{c}"] = F.sum(F.col(c) * F.col("score") * F.col("score")) / F.nullif(n, F.lit(0))
    got = scored.agg(*[v.alias(k) for k, v in row.items()]).first()
    if not got.n_yes or not got.n_no:
        return None
    spread = {c: max(0.0, got[f"square_{c}"] - got[f"mean_{c}"] ** 2) ** 0.5 for c in ("yes", "no")}
    both = spread["yes"] + spread["no"]
    if not both:
        return (got.mean_yes + got.mean_no) / 2
    return (got.mean_yes * spread["no"] + got.mean_no * spread["yes"]) / both
