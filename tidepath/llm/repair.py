"""Cheapest repair of conversations whose turns are missing, repeated, cut or mislabelled."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What each edit of a row costs, and what a cut-off row adds if it stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# Audit letters as digits of three bits, in ASCII order; 0 pads the end.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = "?DIKR"
BITS = 3
# States: nothing yet, after system, after user, after assistant. The empty conversation
# and one that ends with the assistant are whole.
STATES = range(4)
WHOLE = (0, 3)
NEEDED = (2, 2, 3, 2)  # the state that the role a conversation may go on with leads to
NAMES = {2: "user", 3: "assistant"}
# Codes of a row's role by its initial, and of its first fault.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, BLANK, DUPLICATE, CUT = range(4)
# Rows that share one run of fixed-width weights; see `cheapest`.
BLOCK = 256
LONGEST = 2**63 - 1

SPACES = " \t\n\x0b\x0c\r"


def _after(state: int, role: int) -> int | None:
    """The state after a row of this role, or None where the pattern s?(ua)+ has no such row."""
    if role == SYSTEM:
        return 1 if state == 0 else None
    return role + 1 if role != OTHER and NEEDED[state] == role + 1 else None


def _fill(direct: list[int | None], add) -> list[int]:
    """Weights with inserts: up to two rows may be put in before what a state does next."""
    filled = []
    for state in STATES:
        best, at = direct[state], state
        for path in (1, 2):
            at = NEEDED[at]
            if direct[at] is not None:
                weight = direct[at]
                for _ in range(path):
                    weight = add(weight, "I", INSERT)
                best = weight if best is None else min(best, weight)
        filled.append(best)
    return filled


def _weigh(roles: Sequence[int], faults: Sequence[int], ends: list[int | None], width: int) -> list[int]:
    """Weight of the best repair of these rows from each state, given the weights behind them.

    A weight is one integer: its high part is the cost, its low `width` digits are the
    audit letters from the left with zeros behind the last, so the least integer is the
    cheapest repair and among those the first in ASCII order.
    """
    shift = width * BITS
    mask = (1 << shift) - 1

    def add(weight: int, letter: str, cost: int) -> int:
        digits = (DIGITS[letter] << (shift - BITS)) | ((weight & mask) >> BITS)
        return (((weight >> shift) + cost) << shift) | digits

    behind = _fill(ends, add)
    for role, fault in zip(reversed(roles), reversed(faults)):
        extra = TRUNCATED if fault == CUT else 0
        direct: list[int | None] = []
        for state in STATES:
            options = [add(behind[state], "D", DELETE)]
            if fault not in (BLANK, DUPLICATE):
                options.append(add(behind[NEEDED[state]], "R", REROLE + extra))
                kept = _after(state, role)
                if kept is not None:
                    options.append(add(behind[kept], "K", KEEP + extra))
            direct.append(min(options))
        behind = _fill(direct, add)
    return behind


def cheapest(roles: Sequence[int], faults: Sequence[int]) -> tuple[int, str]:
    """Cost and audit of the best repair of one conversation.

    The rows are worked on from the last to the first in blocks, so that weights have a
    fixed width however long the conversation is. A block starts with the costs of the
    states behind it, and no letters: edits that leave one state have different letters,
    or differ in the one after an insert, so letters further on never decide.
    """
    n = len(roles)
    width = 3 * BLOCK + 2
    shift = width * BITS
    costs: list[int | None] = [0 if state in WHOLE else None for state in STATES]
    blocks = []
    for high in range(n, 0, -BLOCK) if n else (0,):
        low = max(0, high - BLOCK)
        ends = [None if c is None else c << shift for c in costs]
        weights = _weigh(roles[low:high], faults[low:high], ends, width)
        blocks.append((low, weights))
        costs = [weight >> shift for weight in weights]
    audit = []
    state = 0
    for low, weights in reversed(blocks):
        at, place, weight = low, shift, weights[state]
        while place:
            place -= BITS
            letter = LETTERS[(weight >> place) & 7]
            if letter == "?":
                break
            audit.append(letter)
            if letter != "I":
                at += 1
            if letter == "K":
                state = _after(state, roles[at - 1])
            elif letter != "D":
                state = NEEDED[state]
    return costs[0], "".join(audit)


def _plain(rows: DataFrame) -> DataFrame:
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    space = F.lit(" ")
    return rows.select(
        "conv_id",
        present.alias("present"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def coded(rows: DataFrame) -> DataFrame:
    """`conv_id, present, turn, role, digest, code, fault`: rows without their texts.

    The rows are dealt out by conversation once; equal ones are numbered there.
    """
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT)
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    again = F.row_number().over(
        Window.partitionBy("conv_id", "present", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    )
    own = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    light = _plain(rows).select(
        "conv_id", "present", "turn", "role", "digest",
        F.coalesce(code, F.lit(OTHER)).alias("code"), own.alias("own"),
    )
    fault = F.when((F.col("own") != BLANK) & (again > 1), DUPLICATE).otherwise(F.col("own"))
    return light.repartition("conv_id").withColumn("fault", fault).drop("own")


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    return rows.sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "digest")


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


class _Conversation:
    """What one task holds of the conversation it reads: two small numbers for each row."""

    def __init__(self) -> None:
        self.roles, self.faults = bytearray(), bytearray()
        self.counts = [0, 0, 0, 0]
        self.illegal = self.distinct = 0
        self.low = self.high = None

    def add(self, turn: int | None, code: int, fault: int) -> None:
        if self.roles and (self.roles[-1], code) not in LEGAL:
            self.illegal += 1
        self.roles.append(code)
        self.faults.append(fault)
        self.counts[fault] += 1
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def result(self) -> tuple:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.distinct
        cost, audit = cheapest(self.roles, self.faults)
        return (min(gaps, LONGEST), *self.counts[1:], self.illegal, cost, audit)


def plan_repairs(rows: DataFrame) -> DataFrame:
    """One row for each `conv_id`: `gaps, blank, duplicate, truncated, illegal, cost, audit`.

    `rows` has `conv_id, turn, role, text`, and may mark rows as not `present`: those
    count only as a mention of their conversation. Rows go by turn (null first), then
    role and digest of the text. The first of a row's faults counts: blank, duplicate
    (role and text of an earlier row), truncated (the last character of a word is not
    one of .!?). `gaps` is the turns missing between the first and the last, `illegal`
    the neighbours whose role initials are not su, ua or au.

    The audit is the edits' initials in order: Keep (costs 0), Rerole to user or
    assistant (3), Delete (4; the only way with blank and duplicate rows), Insert an
    empty user or assistant turn (3). A truncated row that stays adds 3. After them the
    role initials read s?(ua)+ or nothing. Of the cheapest audits it is the least in
    ASCII order.

    Texts are not sent: a row is its order and two codes. A conversation is read by one
    task row by row, which holds two bytes a row and the audit, and its steps grow with
    its rows. A null id is a conversation, a null role or text one space, a null turn
    the first. An empty table gives an empty result; other columns make no difference.
    """
    light = coded(rows)
    out = rows.sparkSession.createDataFrame([], PLAN).schema
    schema = light.select("conv_id").schema
    for field in out:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        now, held = None, None

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*made)) if made else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

        for batch in batches:
            made = []
            names = ("conv_id", "present", "turn", "code", "fault")
            for conv, present, turn, code, fault in zip(*(batch.column(c).to_pylist() for c in names)):
                if held is None or conv != now:
                    if held is not None:
                        made.append((now, *held.result()))
                    now, held = conv, _Conversation()
                if present:
                    held.add(turn, code, fault)
            yield batch_of(made)
        if held is not None:
            yield batch_of([(now, *held.result())])

    return _ordered(light).mapInArrow(run, schema)


def _steps(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one task."""
    marked = _plain(rows).where("present").select(
        "conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text"
    )
    heads = plans.select(
        "conv_id",
        F.lit(0).alias("part"),
        F.lit(None).cast("long").alias("turn"),
        F.lit("").alias("role"),
        F.lit(b"").alias("digest"),
        F.col("audit").alias("text"),
    )
    return _ordered(heads.unionByName(marked).repartition("conv_id"), "part")


class _Edits:
    """Goes along an audit as rows come; gives `edit, role, text` of what is done."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEEDED[self.state]
            yield "I", NAMES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = 1 if role[:1] == "s" else NEEDED[self.state]
        elif letter == "R":
            self.state = NEEDED[self.state]
            role = NAMES[self.state]
        yield letter, role, text


def _walk(batches: Iterator[pa.RecordBatch], begin, edited, end) -> Iterator[list]:
    """Calls `begin(conv)`, `edited(edit, role, text)` and `end(conv)` along the rows of `_steps`."""
    now = edits = None
    names = ("conv_id", "part", "role", "text")
    for batch in batches:
        for conv, part, role, text in zip(*(batch.column(c).to_pylist() for c in names)):
            if part == 0:
                if edits is not None:
                    for edit in edits.inserts():
                        edited(*edit)
                    end(now)
                now, edits = conv, _Edits(text)
                begin(conv)
            else:
                for edit in edits.row(role, text):
                    edited(*edit)
        yield []
    if edits is not None:
        for edit in edits.inserts():
            edited(*edit)
        end(now)
        yield []


def repaired_conversations(rows: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: `conv_id, place, edit, role, text`, one row for each edit.

    `place` counts a conversation's edits from 0; rows whose `edit` is D are those that
    were taken out. `plans` is the result of `plan_repairs` for the same rows. Nulls, ties
    and empty tables are as there.
    """
    plans = plan_repairs(rows) if plans is None else plans
    schema = rows.select("conv_id").schema
    for name, kind in (("place", "long"), ("edit", "string"), ("role", "string"), ("text", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        made: list[tuple] = []
        conv_now, place = None, 0

        def begin(conv) -> None:
            nonlocal conv_now, place
            conv_now, place = conv, 0

        def edited(edit: str, role: str, text: str) -> None:
            nonlocal place
            made.append((conv_now, place, edit, role, text))
            place += 1

        for _ in _walk(batches, begin, edited, lambda conv: None):
            columns = list(zip(*made)) if made else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
            )
            made.clear()

    return _steps(rows, plans).mapInArrow(run, schema)


def repaired_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """`conv_id, sha256`: of the lines `role:text` of each repaired conversation, hashed as
    its rows are read, so that no task holds a conversation's text."""
    schema = rows.select("conv_id").schema.add("sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        made: list[tuple] = []
        hasher, first = hashlib.sha256(), True

        def begin(conv) -> None:
            nonlocal hasher, first
            hasher, first = hashlib.sha256(), True

        def edited(edit: str, role: str, text: str) -> None:
            nonlocal first
            if edit != "D":
                hasher.update(f"{role}:{text}".encode() if first else f"\n{role}:{text}".encode())
                first = False

        for _ in _walk(batches, begin, edited, lambda conv: made.append((conv, hasher.hexdigest()))):
            columns = list(zip(*made)) if made else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
            )
            made.clear()

    return _steps(rows, plans).mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """`conv_id, present, turn, role, text` with planted faults, by crc32 of `conv_id:turn` mod 20.

    0 drops the row (it stays as a mention that is not `present`), 1 empties its text, 2
    takes out its `.!?`, 3 repeats it, 4 sets its role to user. A null is one space.
    """
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), space),
    )
    kind = (F.crc32(key) % 20).alias("kind")
    text = F.coalesce("text", space)
    return rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), kind).select(
        "conv_id",
        (F.col("kind") != 0).alias("present"),
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
