"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded documents."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglore.llm.common import WORD
from loglore.llm.neardup import components
from loglore.operators.number import number_rows
from loglore.operators.sizing import fits_broadcast
from loglore.session import materialise, staging

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds so many words of a hundred there are.
SHARE_PERCENT = 150
#: No document, and so no source, is taken more often.
MOST_TIMES = 2
SEED = 11
#: Documents of each size class (by powers of two), on either side of the last one taken, that may be
#: exchanged to fill what that one left open; and the most steps in which their words are counted.
EXCHANGED, STEPS = 4, 1 << 20


def sized(docs: DataFrame, sources: Column, seed: int = SEED) -> DataFrame:
    """doc_id, the sorted distinct `sources` (an array), size in words, and a number the seed deals."""
    words = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))), F.lit(0))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))).alias("sources"),
        F.when(F.col("text").isNull(), 0).otherwise(words).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("luck"),
    )


def source_targets(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most: int = MOST_TIMES,
) -> DataFrame:
    """source, source_size, target of the sources of `documents` (sources, size).

    Sources in the order of their code points, null last, have the weights, repeating, and share
    `share_percent` of all words. A target stops at `most` times its source's words; what is above is
    shared again by weight. That is a level: each target is the lesser of level x weight and its
    stop. The level rises, by a sum over the sources each time, until no more of them stop. Sources
    stay in a table, however many they are; a document counts in each of its sources.
    """
    spark = documents.sparkSession
    held = documents.select(F.explode("sources").alias("source"), "size")
    found = held.groupBy("source").agg(F.sum("size").alias("source_size"))
    with staging(spark) as folder:
        found = materialise(found, "sources-found", folder)
        numbered = number_rows(found, [], [F.col("source").asc_nulls_last()], "_no", folder)
        turn = ((F.col("_no") - 1) % len(weights)).cast("int")
        weighed = numbered.withColumn("_weight", F.array(*map(F.lit, weights))[turn]).drop("_no")
        weighed = materialise(weighed, "mix-sources")
    stop = F.col("source_size") * most
    share = (documents.agg(F.sum("size")).first()[0] or 0) * share_percent / 100
    level, stopped = 0.0, -1
    while True:
        reached = stop <= F.lit(level) * F.col("_weight")
        row = weighed.agg(
            F.count_if(reached).alias("stopped"),
            F.coalesce(F.sum(F.when(reached, stop)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~reached, F.col("_weight"))), F.lit(0)).alias("weight"),
        ).first()
        if row["stopped"] == stopped or not row["weight"]:
            break
        stopped, level = row["stopped"], (share - row["full"]) / row["weight"]
    target = F.least(F.col("_weight") * level, stop.cast("double")) if row["weight"] else stop.cast("double")
    return weighed.withColumn("target", target).drop("_weight")


def flow(edges: list[tuple[str, int, str, int]], most: int) -> list[tuple[str, str, int]]:
    """(pattern, source, words) of a cheapest largest flow.

    `edges` has (pattern, its words, source, its quota). The first time a pattern's words are used is
    cheapest, each further time dearer. A path that adds flow pays for its first arc alone, the one
    into a pattern; so cheapest paths first means: all that the first use of the words can carry, then
    all that the second adds, and so on. Each such level is a largest flow, found by shortest paths.
    """
    edges = sorted(edges)
    words = {p: n for p, n, _, _ in edges}
    left = {s: n for _, _, s, n in edges}
    near: dict[str, list[str]] = defaultdict(list)
    for p, _, s, _ in edges:
        near[p].append(s)
    sent: dict[tuple[str, str], int] = defaultdict(int)
    users: dict[str, list[str]] = defaultdict(list)  # patterns that send to a source
    for _ in range(most):
        room = dict(words)
        while True:
            # Breadth first from all patterns with room to a source that still wants some.
            came: dict[tuple[str, str], tuple[str, str] | None] = {("p", p): None for p in room if room[p]}
            ready = deque(came)
            end = None
            while ready and end is None:
                kind, at = node = ready.popleft()
                if kind == "s" and left[at]:
                    end = node
                    break
                ahead = (("s", s) for s in near[at]) if kind == "p" else (("p", p) for p in users[at] if sent[p, at])
                for other in ahead:
                    if other not in came:
                        came[other] = node
                        ready.append(other)
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            back = [(b[1], a[1]) for a, b in zip(path, path[1:], strict=False) if a[0] == "s"]
            amount = min([room[path[0][1]], left[end[1]], *(sent[e] for e in back)])
            room[path[0][1]] -= amount
            left[end[1]] -= amount
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "p":
                    if not sent[a[1], b[1]]:
                        users[b[1]].append(a[1])
                    sent[a[1], b[1]] += amount
                else:
                    sent[b[1], a[1]] -= amount
                    if not sent[b[1], a[1]]:
                        users[a[1]].remove(b[1])
    return [(p, s, n) for (p, s), n in sorted(sent.items()) if n]


def routed(documents: DataFrame, targets: DataFrame, most: int = MOST_TIMES) -> DataFrame:
    """pattern, words, source, quota, routed: what each membership pattern gives to each of its sources.

    Patterns are the distinct sets of sources, with the words of all their documents. Those that
    share no source, directly or over others, are settled in tasks of their own; a task holds a row
    per pattern and source of one such group, whatever the number of documents.
    """
    spark = documents.sparkSession
    patterns = documents.groupBy("sources").agg(F.sum("size").alias("words")).where("words > 0")
    patterns = patterns.select(F.to_json("sources", {"ignoreNullFields": "false"}).alias("pattern"), "sources", "words")
    quotas = targets.select(_name("source").alias("_name"), F.round("target").cast("long").alias("quota"))
    each = patterns.withColumn("source", F.explode("sources"))
    edges = each.select("pattern", "words", "source", _name("source").alias("name")).join(
        F.broadcast(quotas) if fits_broadcast(quotas) else quotas, F.col("name") == F.col("_name")
    )
    edges = materialise(edges.drop("_name"), "mix-edges")
    first = Window.partitionBy("pattern")
    links = edges.select(F.min("name").over(first).alias("lead"), F.col("name").alias("rep")).where("lead < rep").distinct()
    if links.isEmpty():
        grouped = edges.withColumn("comp", F.col("name"))
    else:
        with staging(spark) as folder:
            comps = materialise(components(links, "mix", folder), "mix-groups")
        grouped = edges.join(comps, edges["name"] == comps["rep"], "left").drop("rep")
        grouped = grouped.withColumn("comp", F.coalesce("comp", "name"))

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("pattern", "words", "name", "quota")), strict=True))
        found = flow(rows, most)
        return pa.table(
            [pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)]
            if found
            else [pa.array([], k) for k in (pa.string(), pa.string(), pa.int64())],
            names=["_pattern", "_source", "routed"],
        )

    narrow = grouped.select("comp", "pattern", "words", "name", "quota")
    sent = narrow.groupBy("comp").applyInArrow(run, "_pattern string, _source string, routed long")
    on = (F.col("pattern") == F.col("_pattern")) & (F.col("name") == F.col("_source"))
    return materialise(
        edges.join(sent, on, "left").select(
            "pattern", "words", "source", "quota", F.coalesce("routed", F.lit(0).cast("long")).alias("routed")
        ),
        "mix-routes",
    )


def _name(source: str) -> Column:
    return F.to_json(F.array(source), {"ignoreNullFields": "false"})


def select_seeded(documents: DataFrame, routes: DataFrame) -> DataFrame:
    """doc_id, sources, size, copies and taken (words) of every document.

    A pattern's words are used whole as often as they are routed; the rest goes to its documents in
    the order of their seeded numbers, as far as they fit. The words then still open are filled by
    exchanging a few documents: of those nearest to the end, EXCHANGED of each size class that are in
    and as many that are out, those are taken that come closest to what is wanted.

    Documents are dealt by ranges of pattern and number, so a pattern with a third of all rows spans
    a third of the tasks, which share only a sum each. Rows equal in doc_id and text may change
    places, which changes no result.
    """
    spark = documents.sparkSession
    plan = routes.groupBy("pattern").agg(F.first("words").alias("words"), F.sum("routed").alias("routed"))
    plan = plan.select(
        F.col("pattern").alias("_plan"),
        F.floor(F.col("routed") / F.col("words")).alias("whole"),
        (F.col("routed") % F.col("words")).alias("open"),
    )
    with_name = documents.withColumn("pattern", F.to_json("sources", {"ignoreNullFields": "false"}))
    with staging(spark) as folder:
        placed = materialise(_running(with_name), "mix-placed")
        earlier = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = placed.groupBy("pattern", "part").agg(F.sum("size").alias("n"))
        starts = sums.select(
            F.col("pattern").alias("_of"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
        )
        starts = materialise(
            starts.join(plan, F.col("_of") == F.col("_plan"), "left").drop("_plan").fillna(0, ["whole", "open"]), "mix-starts"
        )
    on = (F.col("pattern") == F.col("_of")) & (F.col("part") == F.col("_part"))
    joined = placed.join(F.broadcast(starts) if fits_broadcast(starts) else starts, on).drop("_of", "_part")
    joined = joined.withColumn("more", F.col("start") + F.col("before") + F.col("size") <= F.col("open"))
    fill = materialise(_exchanged(joined), "mix-exchanged")
    own = (F.col("part") == F.col("_at_part")) & (F.col("at") == F.col("_at"))
    chosen = joined.join(F.broadcast(fill) if fits_broadcast(fill) else fill, own, "left")
    copies = F.col("whole") + F.coalesce("_taken", "more").cast("long")
    return chosen.select("doc_id", "sources", "size", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def _running(documents: DataFrame) -> DataFrame:
    """Documents in order, with their part and place, and the words of their pattern `before` them in the part."""
    tie = F.monotonically_increasing_id()
    keys = ["pattern", "luck", "doc_id", "size", "_tie"]
    ordered = documents.withColumn("_tie", tie).repartitionByRange(*keys).sortWithinPartitions(*keys)
    columns = ["doc_id", "sources", "size", "pattern", "luck"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        last, held = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            size = batch.column("size").to_numpy()
            names = batch.column("pattern").dictionary_encode()
            code = names.indices.to_numpy()
            new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            through = np.cumsum(size)
            lead = through - size
            carried = held if names.dictionary[code[0]].as_py() == last else 0
            base = lead[new] - np.r_[carried, np.zeros(len(new) - 1, np.int64)]
            before = lead - np.repeat(base, np.diff(np.r_[new, n]))
            last, held = names.dictionary[code[-1]].as_py(), int(before[-1] + size[-1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(before)],
                names=[*columns, "part", "at", "before"],
            )
            at += n

    kinds = "doc_id long, sources array<string>, size long, pattern string, luck long, part int, at long, before long"
    return ordered.select(*columns).mapInArrow(run, kinds)


def _exchanged(joined: DataFrame) -> DataFrame:
    """The place (_at_part, _at) of documents near each pattern's end, and whether they are _taken."""
    left = joined.groupBy("pattern").agg(
        (F.first("open") - F.coalesce(F.sum(F.when(F.col("more"), F.col("size"))), F.lit(0))).alias("left")
    )
    left = materialise(left.where("left > 0").withColumnRenamed("pattern", "_of"), "mix-open")
    left = F.broadcast(left) if fits_broadcast(left) else left
    near = joined.where("size > 0").join(left, F.col("pattern") == F.col("_of"))
    start = F.col("start") + F.col("before")
    outward = F.when(F.col("more"), -start).otherwise(start)
    nearest = Window.partitionBy("pattern", "more", F.floor(F.log2("size"))).orderBy(outward, "luck", "doc_id", "part", "at")
    few = near.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= EXCHANGED)

    def run(table: pa.Table) -> pa.Table:
        # Equal documents stand side by side in any order: their places say nothing.
        table = table.sort_by([(c, "ascending") for c in ("start", "luck", "doc_id", "part", "at")])
        sizes, more = (table.column(c).to_pylist() for c in ("size", "more"))
        taken = nearest_sum(sizes, more, table.column("left")[0].as_py())
        return pa.table({"_at_part": table.column("part"), "_at": table.column("at"), "_taken": pa.array(taken, pa.bool_())})

    narrow = few.select("pattern", "size", "more", "left", "luck", "doc_id", "part", "at", start.alias("start"))
    return narrow.groupBy("pattern").applyInArrow(run, "_at_part int, _at long, _taken boolean")


def nearest_sum(sizes: list[int], taken: list[bool], left: int) -> list[bool]:
    """Which items to take so that their sizes come nearest to those taken so far and `left`.

    Sums that can be reached are the bits of one integer; where they would be too many, sizes count
    in larger steps. What may stay as it was stays.
    """
    step = 1 + sum(sizes) // STEPS
    units = [round(n / step) for n in sizes]
    wanted = round((left + sum(n for n, t in zip(sizes, taken, strict=True) if t)) / step)
    reached = [1]
    for n in units:
        reached.append(reached[-1] | reached[-1] << n)
    below = (reached[-1] & ((1 << (wanted + 1)) - 1)).bit_length() - 1
    higher = reached[-1] >> (wanted + 1)
    above = wanted + (higher & -higher).bit_length()
    at = below if not higher or wanted - below <= above - wanted else above
    out = []
    for n, was, without in zip(reversed(units), reversed(taken), reversed(reached[:-1]), strict=True):
        can_take, can_leave = at >= n and without >> (at - n) & 1, without >> at & 1
        take = bool(can_take if was else not can_leave)
        out.append(take)
        at -= n if take else 0
    return out[::-1]


def mix(
    docs: DataFrame,
    sources: Column,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most: int = MOST_TIMES,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with their copies, the targets of the sources, and the routes between them.

    `docs` has doc_id and text; `sources`, an array of strings, names the sources that a document is
    in. A null text has no words; a document of no words or no source is not taken; a null source is
    a source, the last one; a null doc_id takes part. Rows are separate documents, also those of one
    doc_id. Targets follow `source_targets`, routes `routed`, documents `select_seeded`. The same
    table gives the same mix again. An empty one gives none. Other columns are not looked at.
    """
    documents = materialise(sized(docs, sources, seed), "mix-documents")
    targets = materialise(source_targets(documents, weights, share_percent, most), "mix-targets")
    routes = routed(documents, targets, most)
    return select_seeded(documents, routes), targets, routes
