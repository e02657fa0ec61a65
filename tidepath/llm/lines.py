"""Repeated and nearly repeated lines across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepath.llm.common import id_order, stored

# Edits between lines that still count as one line, and the shortest line, in
# characters, that goes for this reason; shorter ones must be equal. 1 is for all lines.
EDITS = 1
SHORTEST = 24
# Lines of one bucket are compared in blocks of about so many.
BLOCK = 128
# Segments of fewer characters are in too many lines to find near ones by.
SEGMENT = 4


def _counts(line: Column) -> Column:
    """Lines without anything but white space are kept as they are."""
    return F.length(F.btrim(line, F.lit(" \t\r\f\v"))) > 0


def _once(value: Column) -> Column:
    """A generator that computes `value` once, however often its column is used."""
    return F.explode(F.array(value))


def _apart(lines: Column) -> Column:
    """The lines, blank ones told apart by their number after a line feed."""
    return F.transform(
        lines,
        lambda line, place: F.when(_counts(line), line).otherwise(F.concat(line, F.lit("\n"), place)),
    )


def _identified(docs: DataFrame) -> DataFrame:
    """`at` (the id, null last), `fp` (tells rows with one id apart), `text`; all columns by number."""
    return docs.select(
        id_order(docs, "doc_id").alias("at"),
        F.xxhash64("text").alias("fp"),
        "text",
        *(F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(docs.columns)),
    )


def _lines(rows: DataFrame) -> DataFrame:
    """`at, fp, place, h, g, line`: the different lines of each row, with 128 bits of hash."""
    return (
        rows.select("at", "fp", F.posexplode(F.array_distinct(F.split("text", "\n"))).alias("place", "line"))
        .where(_counts(F.col("line")))
        .select("at", "fp", "place", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "line")
    )


def segment(number: int, length: Column, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and size of a segment, of `edits + 1` nearly equal ones."""
    parts = edits + 1
    size = F.floor(length / parts)
    longer = length - size * parts  # so many last segments have one character more
    short = parts - longer
    start = F.lit(number) * size + F.greatest(F.lit(number) - short, F.lit(0)) + 1
    return start.cast("int"), (size + F.when(F.lit(number) >= short, 1).otherwise(0)).cast("int")


def keys_of(line: Column, edits: int) -> Column:
    """Keys of a line: two lines within `edits` edits share one.

    A line is in the index with its own segments. It looks there for lines that
    are up to `edits` shorter, at the places where a segment of theirs can stand
    in it: a segment with `n` others before it is moved by at most `n` edits, and
    by the difference in length less the edits left for those after it.
    """
    length = F.length(line)
    found = []
    for less in range(edits + 1):
        theirs = length - less
        for number in range(edits + 1):
            start, size = segment(number, theirs, edits)
            low = max(-number, less - (edits - number))
            high = min(number, less + (edits - number))
            for move in range(low, high + 1):
                part = F.substring(line, start + move, size)
                found.append(F.xxhash64(F.lit(number), theirs, part))
    return F.array_distinct(F.array(*found))


def line_keys(lines: DataFrame, edits: int) -> DataFrame:
    """`key, h`: two lines within `edits` edits share a key, some come more than once.

    Lines with segments of at least `SEGMENT` characters have those of `keys_of`. In
    shorter lines a segment says little, and may be empty: they have as keys what is left
    of them without up to `edits` characters, which two near lines have in common. So have
    the lines that are up to `edits` longer, to be found beside them.
    """
    least = SEGMENT * (edits + 1)
    length, short = F.length("line"), F.length("line") < least + edits
    left = lines.select("h", "line", F.col("line").alias("left"))
    for _ in range(edits):
        cuts = F.when(short, F.length("left")).otherwise(0)
        cut = F.concat(
            F.substring("left", F.lit(1), F.col("cut") - 1), F.substring("left", F.col("cut") + 1, F.length("left"))
        )
        left = left.select("*", F.explode(F.sequence(F.lit(0), cuts)).alias("cut")).select(
            "h", "line", F.when(F.col("cut") > 0, cut).otherwise(F.col("left")).alias("left")
        )
    none = F.array().cast("array<long>")
    segments = F.when((length >= least) & (F.col("left") == F.col("line")), keys_of(F.col("line"), edits))
    deletions = F.when(short, F.array(F.xxhash64(F.lit(-1), "left")))
    keys = F.concat(segments.otherwise(none), deletions.otherwise(none))
    return left.select(F.explode(keys).alias("key"), "h")


def near_lines(lines: DataFrame, owners: DataFrame, edits: int, shortest: int) -> DataFrame:
    """`h, g` of the lines within `edits` edits of a line that an earlier document has first.

    These have at least `shortest` characters; the earlier line may have fewer, as many as
    the edits allow. Lines are told apart by hash until their texts are compared. A bucket holds
    the lines with one key. Only buckets with different lines get the texts. They
    are cut into blocks, and each pair of blocks is one row with two lists: so a
    bucket with very many lines is split, and no pair of lines becomes a row.
    """
    long = lines.where(F.length("line") >= shortest - edits)
    keys = line_keys(long, edits)
    shared = (
        keys.groupBy("key")
        .agg(F.min("h").alias("low"), F.max("h").alias("high"))
        .where("low <> high")
        .select("key")
    )
    members = stored(keys.join(shared, "key").distinct(), "line-buckets", tidy=True)
    wanted = owners.select("h", "g", F.col("owner").alias("at")).join(members.select("h").distinct(), "h")
    texts = long.select("h", "g", "at", "line").join(wanted, ["h", "g", "at"]).dropDuplicates(["h", "g"])
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = (
        members.join(sizes, "key")
        .withColumn("block", F.pmod(F.xxhash64("h", F.lit(1)), F.col("blocks")).cast("int"))
        .join(texts, "h")
        .select("key", "block", F.col("blocks"), "h", "g", "at", "line")
    )
    blocks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entry = F.struct("at", "h", "g", "line")
    mine = F.col("block") <= F.col("other")
    groups = blocks.groupBy(
        "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")
    ).agg(
        F.collect_list(F.when(mine, entry)).alias("left"),
        F.collect_list(F.when(~mine | (F.col("block") == F.col("other")), entry)).alias("right"),
    )

    def later(ones: str, others: str) -> Column:
        return F.filter(
            ones,
            lambda one: (F.length(one["line"]) >= shortest)
            & F.exists(
                others,
                lambda other: (other["at"] < one["at"])
                & (F.abs(F.length(other["line"]) - F.length(one["line"])) <= edits)
                & (F.levenshtein(one["line"], other["line"], edits) >= 0),
            ),
        )

    both = F.concat(
        later("left", "right"), F.when(F.col("x") == F.col("y"), F.array()).otherwise(later("right", "left"))
    )
    return groups.select(F.inline(F.transform(both, lambda one: F.struct(one["h"], one["g"])))).distinct()


def dedup_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """`docs` with repeated lines taken out of `text`, and `n_lines`, `n_removed`.

    Lines end at line feeds. A line goes if a document with a smaller id has it,
    or if the first document that has it comes after one with a line within
    `edits` edits of it; that holds for lines of at least `shortest` characters,
    whatever the length of the earlier line, and with `shortest` 1 for all lines.
    Within a document the first of equal lines stays. Lines are judged on the
    input, so a line can go because of one that goes itself; lines of white space
    alone never go. What is left is joined by line feeds again.

    Null texts stay null and empty ones empty, with 0 lines. Ids are numbers, strings or
    any type with an order. A null id counts as the last document (so does the largest
    long), and rows that share an id as one. All columns and rows are kept; columns called
    `n_lines` and `n_removed` are replaced. An empty table gives an empty result.

    A row is rebuilt in time that grows with its lines: a mask has one byte for each of
    its different lines, in which those that go are marked; sets of lines do the rest.
    """
    rows = _identified(docs)
    lines = _lines(rows)
    occurring = lines.select("at", "fp", "place", "h", "g")
    owners = stored(
        occurring.groupBy("h", "g").agg(F.min("at").alias("owner"), F.max("at").alias("newest")),
        "line-owners",
        tidy=True,
    )
    near = stored(near_lines(lines, owners, edits, shortest), "line-near", tidy=True)
    repeated = (
        owners.join(near.withColumn("near", F.lit(True)), ["h", "g"], "left")
        .withColumn("near", F.coalesce("near", F.lit(False)))
        .where(F.col("near") | (F.col("newest") > F.col("owner")))
        .drop("newest")
    )
    gone = (
        occurring.join(repeated, ["h", "g"])
        .where((F.col("at") > F.col("owner")) | F.col("near"))
        .groupBy("at", "fp")
        .agg(F.sort_array(F.collect_set("place")).alias("gone"))
    )
    # One byte a line, up to the last that goes: 1 for those that go.
    gaps = F.transform(
        "gone",
        lambda place, i: F.concat(
            F.repeat(F.lit("0"), place - F.when(i > 0, F.get("gone", i - 1)).otherwise(-1) - 1), F.lit("1")
        ),
    )
    mask = F.array_join(gaps, "").cast("binary")
    joined = rows.join(gone.select("at", "fp", mask.alias("mask")), ["at", "fp"], "left")
    split = joined.select("*", _once(F.split("text", "\n")).alias("lines"))
    split = split.select("*", _once(F.array_distinct("lines")).alias("different"))
    marked = F.filter(
        "different", lambda line, place: F.substring("mask", place + 1, F.lit(1)) == F.lit(b"1")
    )
    whole = F.col("mask").isNull() & (F.size("different") == F.size("lines"))
    none = F.array().cast("array<string>")
    kept = F.when(whole, F.col("lines")).otherwise(
        F.array_except(_apart(F.col("lines")), F.when(F.col("mask").isNull(), none).otherwise(marked))
    )
    left = split.select("*", _once(kept).alias("kept"))
    n_lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size("lines"))
    n_gone = F.when(n_lines > 0, F.size("lines") - F.size("kept")).otherwise(0)
    rebuilt = F.array_join(F.transform("kept", lambda line: F.substring_index(line, "\n", 1)), "\n")
    text = F.when(n_gone == 0, F.col("text")).otherwise(rebuilt)
    columns = [(i, name) for i, name in enumerate(docs.columns) if name not in ("n_lines", "n_removed")]
    return left.select(
        *((text if name == "text" else F.col(f"c{i}")).alias(name) for i, name in columns),
        n_lines.cast("long").alias("n_lines"),
        n_gone.cast("long").alias("n_removed"),
    )
