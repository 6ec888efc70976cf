"""Quality rules: word counts and repeats, and how far a text's make-up is from its language's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglore.operators.sizing import fits_broadcast
from loglore.session import materialise

#: Frequent function words by language.
COMMON_WORDS = {
    "en": "the of and to in is was that for it with as".split(),
    "de": "der die und in den von zu das mit sich des auf".split(),
    "fr": "de la le et les des en un du une que est".split(),
    "es": "de la que el en y los del se las por un".split(),
}
#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A distribution is judged from so many characters, or words, on.
LEAST_CHARS, LEAST_COMMON = 200, 50
#: Farthest Jensen-Shannon distances that are kept, 0 to 1, of a long text: character classes, common
#: words. A sample of n is by chance about 1 / sqrt(n) away from where it comes from, so a term of
#: this form, in characters or words, is added to the bound.
MOST_CHARS_APART, MOST_WORDS_APART = 0.15, 0.15
CHANCE_CHARS, CHANCE_WORDS = 2.4, 1.7

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
#: Character classes in the order in which they are taken out of a text; the last is what remains.
_CLASSES = (r"\p{Ll}+", r"\p{Lu}+", _SPACE + "+", r"[0-9]+", r"""[.,;:!?'"()-]+""")
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_quality(docs: DataFrame) -> DataFrame:
    """`docs` with one struct column `__ll_quality`: the measures, base_failed, both distances and kept.

    n_words, word_chars (characters in words), n_symbols, n_dup_lines (lines with a word that equal an
    earlier one), n_repeat_words (words in three-word windows that occur twice or more, first
    included). base_failed: too few words, or too many of them repeated.

    chars_apart and words_apart are Jensen-Shannon distances (base 2) of the text's histogram of
    character classes, and of its language's common words and all others, from the reference of the
    language; null below the least length, and for words without a list for the language. kept: base
    rules passed and no distance beyond its bound.

    The reference is the sum of the histograms of the language's distinct texts: copies of a text count
    once, or a group of them could take it over.

    A null text has no words, so it fails. A null language is one of its own. Rows that repeat are
    judged each. The references are one row per language, broadcast behind a check of their size;
    no document is shuffled, only its hash and histograms. Windows are told apart by
    their 64-bit hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(*[docs[c] for c in docs.columns], text.alias("__ll_text"))
    own = _histograms(own)
    reference = _histograms(docs.select(F.col("lang").alias("lang"), text.alias("__ll_text")))
    bins = {"c": ("__ll_chars", len(_CLASSES) + 1), "w": ("__ll_common", _bins())}
    counts = {f"{c}{i}": F.col(h)[i] for c, (h, n) in bins.items() for i in range(n)}
    same = F.sha2("__ll_text", 256).alias("__ll_same")
    reference = reference.select(F.col("lang").alias("__ll_lang"), same, *[c.alias(k) for k, c in counts.items()])
    reference = reference.groupBy("__ll_lang", "__ll_same").agg(*[F.max(k).alias(k) for k in counts])
    sums = [F.sum(k).alias(k) for k in counts]
    reference = materialise(reference.groupBy("__ll_lang").agg(*sums), "quality-references")
    small = fits_broadcast(reference)
    reference = reference.select(
        "__ll_lang",
        F.array(*[f"c{i}" for i in range(len(_CLASSES) + 1)]).alias("__ll_all_chars"),
        F.array(*[f"w{i}" for i in range(_bins())]).alias("__ll_all_common"),
    )
    if small:
        reference = F.broadcast(reference)
    own = own.join(reference, own["lang"].eqNullSafe(reference["__ll_lang"]), "left")

    words, n = F.col("__ll_words"), F.size("__ll_words")
    window = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)),
    )
    own = own.select("*", window.alias("__ll_windows"))
    windows = F.col("__ll_windows")
    numbered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    own = own.select("*", F.when(repeats, numbered).alias("__ll_sorted"))
    ordered, m = F.col("__ll_sorted"), F.size("__ll_sorted") - 1
    three = [F.lit(k) for k in range(3)]
    covered = F.zip_with(
        F.slice(ordered, 1, m),
        F.slice(ordered, 2, m),
        lambda a, b: F.when(
            a["h"] == b["h"], F.array(*[a["i"] + k for k in three], *[b["i"] + k for k in three])
        ).otherwise(F.array().cast("array<int>")),
    )
    repeated = F.when(ordered.isNull(), 0).otherwise(F.size(F.array_distinct(F.flatten(covered))))

    raw = F.col("__ll_text")
    lines = F.filter(F.split(raw, "\n", -1), lambda x: x.rlike(_WORD))
    measures = {
        "n_words": n,
        "word_chars": F.length(F.translate(raw, _BLANKS, "")),
        "n_symbols": F.length(raw) - F.length(F.translate(raw, _SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated,
    }
    measured = F.struct(*[c.cast("long").alias(name) for name, c in measures.items()])
    own = own.select("*", measured.alias("__ll_measured"))
    got = F.col("__ll_measured")
    failed = (got["n_words"] < LEAST_WORDS) | (100 * got["n_repeat_words"] > MOST_REPEATED * got["n_words"])
    chars = _apart("__ll_chars", "__ll_all_chars")
    common = _apart("__ll_common", "__ll_all_common")
    chars = F.when(F.length(raw) >= LEAST_CHARS, chars)
    common = F.when((got["n_words"] >= LEAST_COMMON) & F.col("lang").isin(*COMMON_WORDS), common)
    verdict = F.struct(
        *[got[c].alias(c) for c in _MEASURES],
        failed.alias("base_failed"),
        chars.alias("chars_apart"),
        common.alias("words_apart"),
    )
    own = own.select("*", verdict.alias("__ll_verdict"))
    got = F.col("__ll_verdict")
    most_chars = MOST_CHARS_APART + CHANCE_CHARS / F.sqrt(F.length(raw))
    most_words = MOST_WORDS_APART + CHANCE_WORDS / F.sqrt(got["n_words"])
    near = F.coalesce(got["chars_apart"] <= most_chars, F.lit(True))
    near = near & F.coalesce(got["words_apart"] <= most_words, F.lit(True))
    names = [*_MEASURES, "base_failed", "chars_apart", "words_apart"]
    # Always true, and keeps filters on the verdict above it. Pushed down, the verdict would be put together
    # from the text alone, each step written out as often as later ones name it: a plan without end.
    here = F.monotonically_increasing_id() >= 0
    whole = F.struct(*[got[c].alias(c) for c in names], (~got["base_failed"] & near & here).alias("kept"))
    return own.select(*[docs[c] for c in docs.columns], whole.alias("__ll_quality"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id with all measures, distances and the verdict."""
    return with_quality(docs).select("doc_id", "__ll_quality.*")


def passing(docs: DataFrame) -> DataFrame:
    """`docs`, all columns, without the documents that the rules reject."""
    return with_quality(docs).where("__ll_quality.kept").drop("__ll_quality")


def _bins() -> int:
    return 1 + max(map(len, COMMON_WORDS.values()))


def _histograms(docs: DataFrame) -> DataFrame:
    """`docs` with words, counts of character classes, and counts of common words and all others."""
    trimmed = F.btrim("__ll_text", F.lit(_BLANKS))
    cut = F.split(trimmed, _SPACE + "+", -1)
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(cut)
    docs = docs.select("*", words.alias("__ll_words"), F.length("__ll_text").alias("__ll_n0"))
    left = F.col("__ll_text")
    for k, kind in enumerate(_CLASSES):
        left = F.regexp_replace(left, kind, "")
        docs = docs.select("*", left.alias(f"__ll_t{k}"))
        left = F.col(f"__ll_t{k}")
    lengths = [F.col("__ll_n0"), *[F.length(f"__ll_t{k}") for k in range(len(_CLASSES))]]
    chars = [a - b for a, b in zip(lengths, lengths[1:], strict=False)]
    chars = F.array(*[c.cast("long") for c in [*chars, lengths[-1]]])
    hits = F.lit(None).cast("array<string>")
    for lang, common in COMMON_WORDS.items():
        # More than ten literals become a set, looked up once per word.
        found = F.filter("__ll_words", _within([*common, *[w.capitalize() for w in common]]))
        hits = F.when(F.col("lang") == lang, F.transform(found, F.lower)).otherwise(hits)
    docs = docs.select("*", chars.alias("__ll_chars"), F.coalesce(hits, F.array().cast("array<string>")).alias("__ll_hits"))
    counts = F.lit(None).cast("array<long>")
    for lang, common in COMMON_WORDS.items():
        bins = [F.size(F.filter("__ll_hits", _within([w]))).cast("long") for w in common]
        rest = (F.size("__ll_words") - F.size("__ll_hits")).cast("long")
        counts = F.when(F.col("lang") == lang, F.array(*bins, rest)).otherwise(counts)
    spare = [f"__ll_t{k}" for k in range(len(_CLASSES))]
    return docs.select("*", counts.alias("__ll_common")).drop("__ll_hits", "__ll_n0", *spare)


def _within(words: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(words)


def _apart(counts: str, sums: str) -> Column:
    """Jensen-Shannon distance of a histogram from a reference; null if either is empty."""
    total, reference = _total(counts), _total(sums)

    def both(p: Column, q: Column) -> Column:
        return _share(p, (p + q) / 2) + _share(q, (p + q) / 2)

    terms = F.zip_with(counts, sums, lambda a, b: both(a / total, b / reference))
    apart = F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)
    return F.when((total > 0) & (reference > 0), F.sqrt(F.greatest(apart, F.lit(0.0))))


def _share(part: Column, middle: Column) -> Column:
    return F.when(part > 0, part * F.log2(part / middle) / 2).otherwise(0.0)


def _total(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y)
