"""Secrets in texts, and how many owners share them: copied examples against live-looking credentials."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglore.session import materialise, staging, work_path

#: The patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGNED = 8
#: Runs that look made by a machine; they count only if the corpus says that one owner has them.
OPAQUE = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
#: A value that so many owners hold is a copied example.
SHARED_OWNERS = 3

#: Spans in one list of results; the next begins a new one, as appending to a list copies it.
LIST = 256

_SPAN = "struct<start:int,rank:int,end:int,value:bigint>"


def secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared of every row of `docs`.

    Spans are kind:start:end in code points. Three patterns give the base spans, which all stay. A
    fourth gives opaque runs: letters of both cases and digits, not inside a base span. The corpus
    decides on each value by the distinct repositories and owners that hold it: with SHARED_OWNERS
    or more it is a copied example, with fewer it is live-looking. Opaque runs become spans only if
    a single owner in a single repository has them. n_live and n_shared count the spans of each sort.

    Documents have no column for repositories: `owner` names the column of owners, `repository`
    those that together name a repository. Nulls in them are an owner, or part of a repository, of
    their own. A null text is empty. Rows that repeat are answered each, and count once per owner
    and repository. A value that a third of all documents hold is summed before it is shuffled; the
    join back to the spans is one that Spark splits where a value is frequent.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("owner"),
        F.concat_ws("\1", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in repository]).alias("repository"),
        text.alias("text"),
    )
    with staging(spark) as folder:
        found = materialise(_spans(named), "spans", folder).withColumn("row", F.monotonically_increasing_id())
        every = found.select(
            "row", "owner", "repository", F.explode(F.concat("base", "more")).alias("span")
        ).select("row", "owner", "repository", "span")
        held = every.select(F.col("span.value").alias("value"), "owner", "repository").distinct()
        shares = held.groupBy("value").agg(
            F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories")
        )
        judged = every.join(shares, F.col("span.value") == F.col("value"))
        opaque = F.col("span.rank") == len(KINDS) - 1
        judged = judged.where(~opaque | ((F.col("owners") == 1) & (F.col("repositories") == 1)))
        live = F.col("owners") < SHARED_OWNERS
        by_row = judged.groupBy("row").agg(
            F.count_if(live).alias("n_live"),
            F.count_if(~live).alias("n_shared"),
            F.collect_list(F.when(opaque, F.col("span"))).alias("added"),
        )
        joined = found.join(by_row, "row", "left")
        added = F.coalesce("added", F.array().cast(f"array<{_SPAN}>"))
        result = joined.select(
            "doc_id",
            *[F.size(F.filter("base", _of_rank(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
            F.sha2(_written("base"), 256).alias("base_sha256"),
            _written(F.array_sort(F.concat("base", added))).alias("spans"),
            F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
            F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
        )
        path = work_path(spark, "secrets")
        result.write.parquet(path)
    return spark.read.parquet(path)


def _spans(docs: DataFrame) -> DataFrame:
    """doc_id, owner, repository, base spans in order, and opaque runs outside of them."""
    none = F.array().cast(f"array<{_SPAN}>")
    # Most texts have no match: one search each tells, and the places are worked out for the others alone.
    docs = docs.select(
        "*",
        F.when(F.col("text").rlike(ASSIGN), _matches("text", ASSIGN, 2)).alias("m0"),
        F.when(F.contains("text", F.lit("AKIA")), _matches("text", ACCESS, 0)).alias("m1"),
        F.when(F.col("text").rlike(HEX), _matches("text", HEX, 0)).alias("m2"),
        F.when(F.col("text").rlike(OPAQUE), _matches("text", OPAQUE, 0)).alias("m3"),
    )
    parts = [_parts(f"m{k}").alias(f"p{k}") for k in range(4)]
    docs = docs.select("doc_id", "owner", "repository", *parts)
    placed = [F.coalesce(_placed(f"p{k}", k), none) for k in range(4)]
    docs = docs.select("doc_id", "owner", "repository", *[p.alias(f"s{k}") for k, p in enumerate(placed)])
    docs = docs.select(
        "doc_id", "owner", "repository",
        F.array_sort(F.concat("s0", "s1", "s2")).alias("base"),
        F.when(F.size("s3") > 0, F.array_sort(F.concat("s0", "s1", "s2", "s3"))).alias("every"),
    )
    return docs.select("doc_id", "owner", "repository", "base", F.coalesce(_outside("every"), none).alias("more"))


def _scan(items: str, first: dict[str, Column], step: Callable[[Column, Column], Column]) -> Column:
    """States of one running `step` over an array column, one state for each LIST items.

    A state has the fields of `first` and `out`, the spans found since the state before. Spans are
    appended to short lists alone, so the work grows with the number of items.
    """
    last = F.greatest(F.size(items) - 1, F.lit(0))
    chunks = F.transform(F.sequence(F.lit(0), (last / LIST).cast("int")), lambda i: F.slice(items, i * LIST + 1, LIST))
    none = F.array().cast(f"array<{_SPAN}>").alias("out")

    def chunk(states: Column, some: Column) -> Column:
        before = F.get(states, F.size(states) - 1)
        start = F.struct(*[F.coalesce(before[name], value).alias(name) for name, value in first.items()], none)
        return F.array_append(states, F.aggregate(some, start, step))

    empty = F.filter(F.array(F.struct(*[v.alias(name) for name, v in first.items()], none)), lambda _: F.lit(False))
    return F.when(F.col(items).isNotNull(), F.aggregate(chunks, empty, chunk))


def _outside(every: str) -> Column:
    """Opaque runs that overlap no base span, from all spans by their start.

    Opaque runs never overlap each other. One is held until the next span: a base span that begins
    inside it takes it out, as does one before it that ends inside or behind it.
    """
    first = {"reach": F.lit(0), "held": F.lit(None).cast(_SPAN)}

    def step(done: Column, x: Column) -> Column:
        held, opaque = done["held"], x["rank"] == len(KINDS) - 1
        inside = ~opaque & (x["start"] < held["end"])
        return F.struct(
            F.when(opaque, done["reach"]).otherwise(F.greatest(done["reach"], x["end"])).alias("reach"),
            F.when(opaque & (done["reach"] <= x["start"]), x).when(opaque | inside, F.lit(None)).otherwise(held).alias("held"),
            F.when(held.isNotNull() & opaque, F.array_append(done["out"], held)).otherwise(done["out"]).alias("out"),
        )

    states = _scan(every, first, step)
    kept = F.flatten(F.transform(states, lambda s: s["out"]))
    final = F.get(states, F.size(states) - 1)["held"]
    return F.filter(F.array_append(kept, final), lambda x: x.isNotNull())


def _matches(text: str, pattern: str, value: int) -> Column:
    """What stands between matches, the matches, and the part of each that is the secret."""
    every = F.lit(pattern)
    return F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, every, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, every, F.lit(value)).alias("value"),
    )


def _parts(found: str) -> Column:
    """Each match with what stands before it."""
    return F.arrays_zip(
        F.slice(F.col(f"{found}.gaps"), 1, F.size(f"{found}.whole")).alias("gap"),
        F.col(f"{found}.whole").alias("whole"),
        F.col(f"{found}.value").alias("value"),
    )


def _placed(parts: str, rank: int) -> Column:
    """Spans of the matches that count: a match starts where the gaps and matches before it end."""

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        span = F.struct(
            begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.xxhash64(x["value"]).alias("value")
        )
        out = F.when(_counts(x, rank), F.array_append(done["out"], span)).otherwise(done["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.flatten(F.transform(_scan(parts, {"at": F.lit(0)}, step), lambda s: s["out"]))


def _of_rank(rank: int) -> Callable[[Column], Column]:
    return lambda x: x["rank"] == rank


def _counts(x: Column, rank: int) -> Column:
    value = x["value"]
    if KINDS[rank] == "assign":
        return F.length(value) >= LEAST_ASSIGNED
    if KINDS[rank] == "opaque":
        return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")
    return F.lit(True)


def _written(spans: Column | str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(
        spans,
        lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string")),
    )
    return F.array_join(one, ",")
