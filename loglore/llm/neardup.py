"""Near-duplicate documents: MinHash signatures joined within a Hamming distance by pigeonhole."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglore.llm.common import bytes_of, slices
from loglore.llm.shingles import mix, shingle_sets
from loglore.operators.sizing import fits_broadcast, restrict
from loglore.session import materialise, staging, work_path

#: A signature has SYMBOLS MinHash values of 16 bits each. Two sets of similarity 0.75 differ in 16
#: of them on average, in more than DISTANCE about once in 100,000 pairs.
SYMBOLS, DISTANCE = 64, 31
#: Chunks of a signature. DISTANCE errors over so many chunks leave one with at most ERRORS.
CHUNKS = 16
ERRORS = DISTANCE // CHUNKS
WIDTH = SYMBOLS // CHUNKS
#: Similarity as a share: 75 of 100.
SHARE = 75
#: Shingles of a block: a larger bucket is split into blocks, and each pair of blocks is compared apart.
BLOCK = 200_000

_MULTIPLY = np.random.default_rng(64).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(65).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS values of 16 bits: of each of as many hash functions, the least value's low bits."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        some = shingles[at : at + 4096, None] * _MULTIPLY + _ADD
        np.minimum(least, some.min(axis=0), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, n_shingles, a hash of the whole set, and its signature (null without words)."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("mark", pa.string()), ("n", pa.int64()), ("same", pa.binary()), ("sig", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            sets = shingle_sets(bytes_of(some.column("text")))
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signs = [signature(s).tobytes() if len(s) else None for s in sets]
            columns = [some.column("doc_id"), some.column("mark").cast(pa.string())]
            columns += [pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array(same, pa.binary()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), "text").mapInArrow(
        run, "doc_id long, mark string, n long, same binary, sig binary"
    )


def bucket_keys(classes: DataFrame) -> DataFrame:
    """key, rep: for each chunk, its symbols with each choice of ERRORS symbols left out.

    Two signatures within DISTANCE agree in a chunk but for ERRORS symbols at most, so they share
    a key. A key holds chunk, choice and symbols themselves, so different ones never fall together.
    """
    choices = list(combinations(range(WIDTH), WIDTH - ERRORS))
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 2048):
            signs = _symbols(some.column("sig"))
            keys = np.empty((len(signs), CHUNKS * len(choices)), np.int64)
            for c in range(CHUNKS):
                for k, choice in enumerate(choices):
                    at = c * len(choices) + k
                    key = np.full(len(signs), at, np.int64)
                    for s in choice:
                        key = (key << 16) | signs[:, c * WIDTH + s]
                    keys[:, at] = key
            reps = np.repeat(some.column("rep").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(reps)], schema=schema)

    return classes.select("sig", "rep").mapInArrow(run, "key long, rep long")


def shingle_arrays(docs: DataFrame) -> DataFrame:
    """doc_id and its whole shingle set."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            sets = [s.view(np.int64) for s in shingle_sets(bytes_of(some.column("text")))]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(sets, schema.field(1).type)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text; others ignored).

    Documents are linked if their sets of distinct five-word shingles are similar to 0.75 or more;
    component_id is the smallest doc_id that can be reached, kept tells whether it is one's own.

    1. Rows with one and the same set become a class, led by its smallest doc_id.
    2. Class leaders meet in buckets (`bucket_keys`). Each is held against the leading members of its
       buckets, two rounds with other leaders, the nearest signature first: that ties most groups
       together with one link per member instead of one per pair.
    3. In buckets whose members are still in several components, pairs from two components within
       the signature distance are confirmed on the full sets, block by block (`_across`). Pairs within
       one component change nothing, and pairs that are no links leave no row.

    Shingles that one set alone has bound its similarity to any other (`shareable`). That keeps large
    families of texts that share a core, but are not similar enough, from being confirmed pair by pair.

    The signatures make step 2 and 3 exact within DISTANCE; beyond it, a pair of similarity 0.75 is
    missed about once in 100,000, others less often.

    A text without words, or null, is linked with nothing. A null doc_id can neither lead nor be
    named: such a row has a null component_id and is kept. Rows that repeat a doc_id are judged by
    their own text; with equal texts they share one answer.
    """
    return _judged(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame) -> DataFrame:
    """`near_duplicates` with the hashes of each row's text (mark) and of its set (same)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with staging(spark) as folder:
        drawn = materialise(sketches(docs), "sketches", folder)
        linked = drawn.where("n > 0 AND doc_id IS NOT NULL")
        classes = materialise(linked.groupBy("same", "sig").agg(F.min("doc_id").alias("rep")), "classes", folder)

        keys = bucket_keys(classes)
        # Only buckets with two leaders or more go on.
        heads = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
        shared = materialise(keys.join(heads, "key"), "buckets", folder)

        wanted = shared.select(F.col("rep").alias("doc_id")).distinct()
        wanted = materialise(wanted, "wanted", folder)
        few = fits_broadcast(wanted)
        sets = materialise(shingle_arrays(restrict(docs, wanted, ["doc_id"], few)), "sets", folder)
        signs = materialise(classes.select("rep", "sig").join(shareable(sets), "rep"), "signs", folder)
        # The other set may be as small as what is shared, so the union is `n` at least.
        hopeful = signs.where(F.coalesce(100 * F.col("can") >= SHARE * F.col("n"), F.lit(True)))
        shared = materialise(shared.join(hopeful.select("rep", "n", "can"), "rep"), "hopeful", folder)

        links: DataFrame | None = None
        comps = signs.select("rep", F.col("rep").alias("comp")).limit(0)
        for lead in ("low", "high"):
            open_pairs = _with_comps(shared.select("rep", F.col(lead).alias("lead")).where("rep <> lead").distinct(), comps)
            near = _near(open_pairs.where("rep_comp <> lead_comp").select("rep", "lead"), signs)
            first = near.groupBy("rep").agg(F.min(F.struct("apart", "lead")).alias("x")).select("rep", "x.lead")
            found = materialise(confirmed(first, sets), f"links-{lead}", folder)
            links = found if links is None else links.unionByName(found)
            comps = components(links, f"comps-{lead}", folder)

        # No partner in a bucket is smaller than its smallest set.
        least = shared.groupBy("key").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"))
        rows = shared.join(least, "key").where(_possible("n", "can", "least", "can"))
        rows = rows.join(comps, "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"), "n", "can")
        split = rows.groupBy("key").agg(
            F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.sum(F.coalesce("n", F.lit(1000))).alias("total")
        ).where("c0 < c1")
        blocks = F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks")
        open_rows = rows.join(split.select("key", blocks), "key").join(signs.select("rep", "sig"), "rep")
        open_rows = open_rows.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
        links = links.unionByName(materialise(_across(open_rows), "links-across", folder))
        comps = components(links, "comps", folder)

        answered = drawn.join(classes.select("same", "rep"), "same", "left").join(comps, "rep", "left")
        component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("comp", "rep", "doc_id"))
        result = answered.select(
            "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "mark", "same",
        )
        path = work_path(spark, "near-duplicates")
        result.write.parquet(path)
    return spark.read.parquet(path)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row, all columns, of each group of `docs`; rows without words are in no group and all stay.

    The row has the leader's doc_id and, where that comes with several texts, each of these sets stays
    once. A row without a doc_id stays where no row with one has its set, one row for each set.

    Rows are named by doc_id and the hash of their text, and these names travel, broadcast behind a
    check of their size. Only rows whose name repeats and stays are grouped, one from each input
    partition at most.
    """
    worded = _judged(docs).where("same IS NOT NULL")
    names = worded.groupBy("same", "doc_id", "mark").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    names = materialise(names, "near-duplicate-names")
    # By set: its leader, or none. By set and leader: one text of several with this set.
    leads = names.groupBy("same", "doc_id").agg(F.min("mark").alias("first"))
    named = names.where("doc_id IS NOT NULL").select("same").distinct().withColumn("named", F.lit(True))
    own = (names["same"] == leads["same"]) & names["doc_id"].eqNullSafe(leads["doc_id"])
    judged = names.join(leads, own).select(names["*"], "first").join(named, "same", "left")
    stays = F.col("kept") & (F.col("mark") == F.col("first")) & (F.col("doc_id").isNotNull() | F.col("named").isNull())
    judged = judged.select(F.col("doc_id").alias("_named"), F.col("mark").alias("_mark"), stays.alias("_stays"), "rows")
    judged = materialise(judged.where("NOT _stays OR rows > 1").drop("rows"), "near-duplicate-verdicts")

    marked = docs.select(*[docs[c] for c in docs.columns], F.col("doc_id").cast("long").alias("_id"), _mark().alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("_named")) & (F.col("_text") == F.col("_mark"))
    joined = marked.join(F.broadcast(judged) if fits_broadcast(judged) else judged, same, "left")
    single = joined.where("_stays IS NULL").select(*docs.columns)
    return single.unionByName(joined.where("_stays").dropDuplicates(["_id", "_text"]).select(*docs.columns))


def _mark() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def shareable(sets: DataFrame) -> DataFrame:
    """rep, its set's size n, and `can`: how many of its shingles any other set has too.

    An intersection is no larger than either side's `can`. A doc_id that comes with several texts
    gets nulls, which bound nothing.
    """
    each = sets.select(F.col("doc_id").alias("rep"), F.explode("shingles").alias("shingle"))
    held = each.groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("high"))
    alone = held.where("rep = high").groupBy("rep").agg(F.count("*").cast("int").alias("alone"))
    sizes = sets.groupBy(F.col("doc_id").alias("rep")).agg(
        F.max(F.size("shingles")).alias("n"), F.count("*").alias("texts")
    )
    known = F.when(F.col("texts") == 1, F.col("n"))
    return sizes.join(alone, "rep", "left").select(
        "rep", known.alias("n"), (known - F.coalesce("alone", F.lit(0))).alias("can")
    )


def _possible(n: str, can: str, other_n: str, other_can: str) -> Column:
    """Whether two sets can be similar enough, by their sizes and what each can share."""
    most = F.least(can, other_can)  # nulls bound nothing
    return F.coalesce(100 * most >= SHARE * (F.col(n) + F.col(other_n) - most), F.lit(True))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (rep, lead) whose full sets are similar enough."""
    own = sets.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("a"))
    other = sets.select(F.col("doc_id").alias("lead"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - both
    return pairs.join(own, "rep").join(other, "lead").where(100 * both >= SHARE * union).select("rep", "lead")


def components(links: DataFrame, label: str, folder: str) -> DataFrame:
    """rep, comp for every node of `links` (rep, lead): comp is the smallest node it is tied to.

    Each round takes the least label among a node and its neighbours, then the label of that label,
    until nothing changes; a round is a join and a grouping whose partial sums cut hot nodes down.
    """
    both = links.select("rep", "lead").unionByName(links.select(F.col("lead").alias("rep"), F.col("rep").alias("lead")))
    edges = materialise(both.distinct(), f"{label}-edges", folder)
    labels = edges.groupBy("rep").agg(F.least("rep", F.min("lead")).alias("comp"))
    labels = materialise(labels, f"{label}-0", folder)
    turn = 0
    while True:
        turn += 1
        around = edges.join(labels.select(F.col("rep").alias("lead"), "comp"), "lead").select("rep", "comp")
        nearer = around.unionByName(labels).groupBy("rep").agg(F.min("comp").alias("comp"))
        jump = labels.select(F.col("rep").alias("comp"), F.col("comp").alias("next"))
        new = nearer.join(jump, "comp").select("rep", F.least("comp", "next").alias("comp"))
        new = materialise(new, f"{label}-{turn}", folder)
        was = labels.select("rep", F.col("comp").alias("was"))
        if not new.join(was, "rep").where("comp <> was").head(1):
            return new
        labels = new


def _with_comps(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    for side in ("rep", "lead"):
        named = comps.select(F.col("rep").alias(side), F.col("comp").alias(f"{side}_comp"))
        pairs = pairs.join(named, side, "left").withColumn(f"{side}_comp", F.coalesce(f"{side}_comp", side))
    return pairs


def _near(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Pairs within the signature distance, with that distance."""
    own = signs.select("rep", F.col("sig").alias("a"), "n", "can")
    other = signs.select(F.col("rep").alias("lead"), F.col("sig").alias("b"), F.col("n").alias("m"), F.col("can").alias("may"))
    joined = pairs.join(own, "rep").join(other, "lead").where(_possible("n", "can", "m", "may"))
    return joined.withColumn("apart", _apart("a", "b")).where(F.col("apart") <= DISTANCE).select("rep", "lead", "apart")


def _across(rows: DataFrame) -> DataFrame:
    """Links (rep, lead) between components of one bucket.

    A bucket's rows are dealt to blocks; a group is two blocks of a bucket, or one with itself. In
    it, signatures are compared all at once, and full sets where they are near enough. A pair that
    shares several buckets is taken up in the first alone. Only links leave a group.
    """
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")),
    )
    dealt = rows.withColumn("block", block).select("*", F.explode(pairs).alias("p"))
    dealt = dealt.select("key", "p.x", "p.y", "block", "rep", "comp", "n", "can", "sig", "shingles")
    schema = pa.schema([("rep", pa.int64()), ("lead", pa.int64())])
    choices = list(combinations(range(WIDTH), WIDTH - ERRORS))

    def run(group: pa.Table) -> pa.Table:
        number = group.column("key")[0].as_py() >> (16 * (WIDTH - ERRORS))
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        reps, comps, block = (group.column(c).to_numpy() for c in ("rep", "comp", "block"))
        shingles = group.column("shingles").combine_chunks()
        sets = [shingles[i].values.to_numpy() for i in range(len(reps))]
        signs = _symbols(group.column("sig"))
        sizes = np.array([len(s) for s in sets])
        can = np.where([c.is_valid for c in group.column("can")], group.column("can").fill_null(0).to_numpy(), sizes)
        comps = comps.copy()
        out = []
        right = np.flatnonzero(block == y)
        for i in np.flatnonzero(block == x):
            most = np.minimum(can[i], can[right])
            other = (comps[right] != comps[i]) & (100 * most >= SHARE * (sizes[i] + sizes[right] - most))
            if x == y:
                other &= right > i
            near = right[other]
            same = (signs[near] == signs[i]).reshape(len(near), CHUNKS, WIDTH)
            near_enough = same.sum(axis=(1, 2)) >= SYMBOLS - DISTANCE
            shared = np.stack([same[:, :, list(c)].all(axis=2) for c in choices], axis=2)
            shared = shared.reshape(len(near), CHUNKS * len(choices))
            for j in near[near_enough & (shared.argmax(axis=1) == number)]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if comps[i] != comps[j] and 100 * both >= SHARE * (sizes[i] + sizes[j] - both):
                    out.append((reps[i], reps[j]))
                    comps[comps == comps[j]] = comps[i]
        columns = zip(*out, strict=True) if out else ((), ())
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return dealt.groupBy("key", "x", "y").applyInArrow(run, "rep long, lead long")


def _apart(a: str, b: str) -> Column:
    """Symbols in which two signatures differ, as a native expression on their hexadecimal form."""
    same = F.lit(0)
    for s in range(SYMBOLS):
        at = 2 * s + 1
        same = same + (F.substring(a, at, 2) == F.substring(b, at, 2)).cast("int")
    return F.lit(SYMBOLS) - same


def _symbols(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), SYMBOLS).astype(np.int64)
