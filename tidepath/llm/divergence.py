"""Quality rules: how far a document's characters and common words are from its language."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepath.llm.common import stored

# Words of a reference histogram; all other words share one more cell.
COMMON_WORDS = 16
# A language with fewer words than this is compared with the whole corpus instead.
LEAST_REFERENCE_WORDS = 2_000
# Shorter documents say nothing about a distribution: the rule leaves them alone.
LEAST_WORDS = 50
LEAST_CHARS = 200
# A document is turned down above these Jensen-Shannon distances (0 to 1) plus what
# chance alone brings: a sample of n words over c cells is off by about
# sqrt(c / (8 n ln 2)).
FARTHEST_CHARS = 0.2
FARTHEST_WORDS = 0.2
# Documents below this many words, or with a larger share of repeats, fail outright.
FEWEST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
# Up to so many words a window's place fits beside its hash; longer texts compare all as text.
PLACE_BITS = 24

# Character classes that are counted by pattern. Classes of single
# characters, without ranges, are looked up in a table by the regex engine.
SYMBOLS = "[#*$%&|<>]"
UPPER = "[ABCDEFGHIJKLMNOPQRSTUVWXYZ]"
DIGITS = "[0123456789]"
MARKS = "[.,;:!?'\"()\\-]"
PLAIN = "[^#*$%&|<>ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?'\"()\\-]+"
BREAKS = "[\\t\\n\\x0B\\f\\r]"
CLASSES = 6


def _let(value: Column, use) -> Column:
    """`use(value)` with `value` worked out once, also inside lambda functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _removed(text: Column, pattern: str) -> Column:
    """How many characters match; patterns of single characters that are rare are fast."""
    return (F.length(text) - F.length(F.regexp_replace(text, F.lit(pattern), F.lit("")))).cast("long")


def words_of(text: Column) -> Column:
    """Maximal runs of anything but space and U+0009 to U+000D, as they are."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(BREAKS), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def char_classes(text: Column, marked: Column, inner: Column) -> list[Column]:
    """Counts of a text's upper-case letters, digits, marks, symbols, other characters in
    words, and the bytes that characters beyond ASCII take more than one.

    `marked` is the text without what is in none of the first four classes (`PLAIN`),
    and `inner` how many characters are in words.
    """
    classes = [_removed(marked, pattern) for pattern in (UPPER, DIGITS, MARKS, SYMBOLS)]
    rest = inner - F.length(marked)
    return [*classes, rest.cast("long"), F.octet_length(text).cast("long") - F.length(text)]


def _marked(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(PLAIN), F.lit(""))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of five words that the document holds twice or more.

    Windows with different hashes are different, so most documents end there. In the
    others, hashes are sorted with their places in the low bits (`PLACE_BITS`), which
    leaves the places that may be equal to a neighbour; those are compared as text, and
    each that is repeated covers what the one before it left.
    """
    mask, low = F.lit(-(1 << PLACE_BITS)), F.lit((1 << PLACE_BITS) - 1)

    def hashes(each: Column) -> Column:
        """One for each word; the last four are of what is left, each another number of words."""
        return F.transform(
            each, lambda x, at: F.xxhash64(x, *(F.get(each, at + i) for i in range(1, WINDOW)))
        )

    def beside(ranked: Column, same) -> Column:
        """Those of a sorted array that are the same as the one before or behind."""
        alike = lambda x, y: F.coalesce(same(x, y), F.lit(False))
        return F.filter(
            ranked, lambda x, i: alike(x, F.get(ranked, i - 1)) | alike(x, F.get(ranked, i + 1))
        )

    def candidates(keys: Column) -> Column:
        placed = F.transform(keys, lambda k, i: k.bitwiseAND(mask).bitwiseOR((i + 1).cast("long")))
        same = lambda x, y: x.bitwiseAND(mask) == y.bitwiseAND(mask)
        near = _let(F.sort_array(placed), lambda ranked: beside(ranked, same))
        found = F.transform(near, lambda x: x.bitwiseAND(low).cast("int"))
        last = F.size(keys) - (WINDOW - 1)
        whole = F.filter(found, lambda at: at <= last)
        return F.when(F.size(keys) < (1 << PLACE_BITS), whole).otherwise(F.sequence(F.lit(1), last))

    def places(keys: Column) -> Column:
        texts = F.transform(
            candidates(keys),
            lambda at: F.struct(F.concat_ws(" ", F.slice(words, at, WINDOW)).alias("w"), at.alias("at")),
        )
        twice = _let(F.sort_array(texts), lambda ranked: beside(ranked, lambda x, y: x["w"] == y["w"]))
        return F.sort_array(F.transform(twice, lambda x: x["at"]))

    def covered(keys: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda held, at: F.struct(
            (held["n"] + F.least(F.lit(WINDOW), at - held["last"])).alias("n"), at.alias("last")
        )
        return F.aggregate(places(keys), start, step, lambda held: held["n"])

    none = F.lit(0).cast("long")
    keys = _let(F.transform(words, lambda w: F.xxhash64(w)), hashes)
    counted = _let(
        keys,
        lambda held: F.when(F.size(F.array_distinct(held)) < F.size(held), covered(held)).otherwise(none),
    )
    return F.when(F.size(words) >= WINDOW, counted).otherwise(none)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return _let(lines, lambda held: (F.size(held) - F.size(F.array_distinct(held))).cast("long"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram from reference counts; null if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def term(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def pair(p: Column, q: Column) -> Column:
        return _let((p + q) / 2, lambda m: (term(p, m) + term(q, m)) / 2)

    sums = F.struct(total(counts).alias("own"), total(reference).alias("other"))
    return _let(
        sums,
        lambda s: F.when(
            (s["own"] > 0) & (s["other"] > 0),
            F.sqrt(
                F.greatest(
                    F.lit(0.0),
                    F.aggregate(
                        F.zip_with(counts, reference, lambda a, b: pair(a / s["own"], b / s["other"])),
                        F.lit(0.0),
                        lambda sum_, x: sum_ + x,
                    ),
                )
            ),
        ),
    )


def language_references(docs: DataFrame, common: int = COMMON_WORDS) -> tuple[DataFrame, dict]:
    """Per language `ref_lang, ref_words, ref_counts, ref_chars`, and the same of the whole corpus.

    `ref_words` are its `common` most frequent words (ties by code point), `ref_counts`
    their counts with that of all other words at the end, `ref_chars` the sums of
    `char_classes`. Languages with fewer than
    `LEAST_REFERENCE_WORDS` words have no row. A null language is one like others.
    Words are summed in each task before the shuffle; the whole corpus is one row.
    """
    counted = stored(
        docs.select(F.col("lang").alias("ref_lang"), F.explode(words_of(F.col("text"))).alias("word"))
        .groupBy("ref_lang", "word")
        .agg(F.count(F.lit(1)).alias("n")),
        "reference-words",
    )
    order = Window.partitionBy("ref_lang").orderBy(F.desc("n"), "word")
    top = (
        counted.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= common)
        .groupBy(F.col("ref_lang").alias("top_lang"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    )
    totals = counted.groupBy("ref_lang").agg(F.sum("n").alias("all_words"))

    def shaped(top: Column, total: Column) -> list[Column]:
        kept = F.aggregate(top, F.lit(0).cast("long"), lambda s, x: s + x["n"])
        return [
            F.transform(top, lambda x: x["word"]).alias("ref_words"),
            F.concat(F.transform(top, lambda x: x["n"]), F.array(total - kept)).alias("ref_counts"),
        ]

    by_lang = totals.join(top, F.col("ref_lang").eqNullSafe(F.col("top_lang"))).select(
        "ref_lang", "all_words", *shaped(F.col("top"), F.col("all_words"))
    )
    # Characters come from the counted words, each distinct word once.
    word = F.col("word")
    marked = counted.withColumn("marked", _marked(word))
    each = char_classes(word, F.col("marked"), F.length(word))
    classes = marked.select("ref_lang", *((F.col("n") * c).alias(f"c{i}") for i, c in enumerate(each)))
    chars = stored(
        classes.groupBy(F.col("ref_lang").alias("char_lang")).agg(
            *(F.sum(f"c{i}").alias(f"c{i}") for i in range(CLASSES))
        ),
        "reference-chars",
    )
    sums = chars.select("char_lang", F.array(*(f"c{i}" for i in range(CLASSES))).alias("ref_chars"))
    languages = (
        by_lang.where(F.col("all_words") >= LEAST_REFERENCE_WORDS)
        .join(sums, F.col("ref_lang").eqNullSafe(F.col("char_lang")))
        .select("ref_lang", "ref_words", "ref_counts", "ref_chars")
    )
    whole_words = counted.groupBy("word").agg(F.sum("n").alias("n"))
    most = whole_words.orderBy(F.desc("n"), "word").limit(common).collect()
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sums_all = chars.agg(*(F.coalesce(F.sum(f"c{i}"), F.lit(0)) for i in range(CLASSES))).first()
    corpus = {
        "ref_words": [row.word for row in most],
        "ref_counts": [row.n for row in most] + [total - sum(row.n for row in most)],
        "ref_chars": list(sums_all),
    }
    return stored(languages, "references"), corpus


def quality_measures(docs: DataFrame, carry: Sequence[str] | None = None) -> DataFrame:
    """The rows of `docs` as struct `row`, with their measures and the verdict `kept`.

    `row` has all columns, or those named by `carry`.

    Measures (long): `n_words`, `word_chars` (characters in words), `n_symbols`,
    `n_dup_lines`, `n_repeat_words`. `base_failed`: fewer than ten words, or over 20 %
    of them in repeated windows. `char_distance` and `word_distance` are the
    Jensen-Shannon distances of the document's character classes and of its counts of
    common words from the reference of its language, null where the document or the
    reference is empty. A document is kept unless it fails the base rules, or has at
    least 200 characters and is farther than 0.25 by characters, or has at least 50
    words and is farther than 0.5 by words.

    A null text has no words, so it fails. A null or unknown `lang` is a language like
    others; languages with little text use the reference of the whole corpus. Repeated
    rows, and any columns besides `text` and `lang`, make no difference. An empty table
    gives an empty result. References hold 17 counts for each language; Spark sends
    them to all tasks only where they are below its broadcast threshold.
    """
    references, corpus = language_references(docs)
    row = F.struct("*") if carry is None else F.struct(*carry)
    wide = docs.select(row.alias("row"), F.col("lang").alias("own_lang"), F.coalesce("text", F.lit("")).alias("body"))
    joined = wide.join(references, F.col("own_lang").eqNullSafe(F.col("ref_lang")), "left")
    whole = {
        "ref_words": F.array(*map(F.lit, corpus["ref_words"])).cast("array<string>"),
        "ref_counts": F.array(*map(F.lit, corpus["ref_counts"])).cast("array<bigint>"),
        "ref_chars": F.array(*map(F.lit, corpus["ref_chars"])).cast("array<bigint>"),
    }
    joined = joined.withColumns({name: F.coalesce(name, value) for name, value in whole.items()})
    joined = joined.withColumn("words", words_of(F.col("body")))
    words, body, n = F.col("words"), F.col("body"), F.col("n_words")
    # Worked out on their own first, so that what follows reads columns.
    plain = joined.select(
        "row", "body", "words", "ref_words", "ref_counts", "ref_chars",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
        _marked(body).alias("marked"),
    ).withColumns({f"c{i}": c for i, c in enumerate(char_classes(body, F.col("marked"), F.col("word_chars")))})
    none = F.lit(0).cast("long")
    held = F.array_remove(F.transform(words, lambda w: F.array_position("ref_words", w)), none)
    counts = _let(
        held,
        lambda places: F.concat(
            F.transform(
                "ref_words",
                lambda w, i: (F.size(places) - F.size(F.array_remove(places, (i + 1).cast("long")))).cast("long"),
            ),
            F.array(n - F.size(places)),
        ),
    )
    measured = plain.select(
        "row",
        "n_words",
        "word_chars",
        F.col("c3").alias("n_symbols"),
        repeated_lines(body).alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        distance(F.array(*(f"c{i}" for i in range(CLASSES))), F.col("ref_chars")).alias("char_distance"),
        distance(counts, F.col("ref_counts")).alias("word_distance"),
        (F.size("ref_words") + 1).alias("cells"),
    )
    failed = (n < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * n)
    chance = lambda cells: F.sqrt(cells / (F.lit(8 * math.log(2)) * n))
    far = (F.col("word_chars") >= LEAST_CHARS) & (
        F.col("char_distance") > FARTHEST_CHARS + chance(F.lit(float(CLASSES)))
    )
    far |= (n >= LEAST_WORDS) & (F.col("word_distance") > FARTHEST_WORDS + chance(F.col("cells")))
    return (
        measured.withColumn("base_failed", failed)
        .withColumn("kept", ~(F.col("base_failed") | F.coalesce(far, F.lit(False))))
        .drop("cells")
    )


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with the verdict `kept`, with all their columns."""
    return quality_measures(docs).where("kept").select("row.*")
