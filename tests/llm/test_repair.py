"""Conversation repair against a search over all edits, and fixed cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict
from itertools import groupby

import pytest

from tidepath.llm import queries, repair
from tidepath.llm.common import read_table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, place long, edit string, present boolean, code int"
WHOLE = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    """Codes of each (role, text) by the words of the rules."""
    seen, out = set(), []
    for role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not words:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif words[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def search(rows):
    """Cheapest cost, audit and roles by best-first search over whole edit sequences."""
    faults = faults_of(rows)
    best = {}
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, at, initials, done = heapq.heappop(queue)
        if at == len(rows) and WHOLE.fullmatch(initials):
            return cost, audit, [f"{r}:{t}" for r, t in done]
        last = initials[-1:] if initials != "" else "0"
        # Same place, state and number of letters: the first one out is the best.
        key = (at, last, len(audit))
        if best.setdefault(key, (cost, audit)) != (cost, audit):
            continue
        if len(audit) > 2 * len(rows) + 2:
            continue
        options = []
        if at < len(rows):
            role, text = rows[at]
            options.append((4, "D", 1, "", ()))
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 if faults[at] == "truncated" else 0
                options.append((extra, "K", 1, role[:1] or "?", ((role, text),)))
                options += [(3 + extra, "R", 1, r[0], ((r, text),)) for r in ("user", "assistant")]
        options += [(3, "I", 0, r[0], ((r, ""),)) for r in ("user", "assistant")]
        for price, letter, step, initial, row in options:
            new = initials + initial
            if initial and not re.fullmatch(r"s?(ua)*u?", new):
                continue
            heapq.heappush(queue, (cost + price, audit + letter, at + step, new, done + row))
    raise AssertionError


def codes_of(rows):
    codes = ["sua".find(role[:1]) if role[:1] else 3 for role, _ in rows]
    kinds = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    return [c if c >= 0 else 3 for c in codes], [kinds[f] for f in faults_of(rows)]


def test_integers_find_the_cheapest_audit():
    random.seed(5)
    for _ in range(400):
        rows = [
            (random.choice(["user", "assistant", "system", "tool", ""]), random.choice(["a.", "b", "", "c!", "d?"]))
            for _ in range(random.randrange(7))
        ]
        cost, audit, _ = search(rows)
        assert repair.cheapest(*codes_of(rows)) == (cost, audit), rows


def test_blocks_change_nothing(monkeypatch):
    random.seed(6)
    cases = [
        ([random.randrange(4) for _ in range(n)], [random.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)])
        for n in (0, 1, 2, 9, 40, 100)
    ]
    whole = [repair.cheapest(*case) for case in cases]
    for size in (1, 2, 7):
        monkeypatch.setattr(repair, "BLOCK", size)
        assert [repair.cheapest(*case) for case in cases] == whole


def expected(table):
    """The contract, from (conv_id, turn, role, text) to a row for each conversation."""
    found = {}
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in groups.items():
        left = []
        for turn, role, text in rows:
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20
            if kind == 1:
                text = ""
            if kind == 2:
                text = re.sub(r"[.!?]", "", text)
            if kind == 4:
                role = "user"
            left += [(turn, role, text)] * (kind != 0) * (1 + (kind == 3))
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = {t for t, _, _ in left if t is not None}
        pairs = [(role, text) for _, role, text in left]
        faults = faults_of(pairs)
        initials = [role[:1] for role, _ in pairs]
        cost, audit, lines = search(pairs)
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_query_is_the_contract_on_given_rows(spark):
    rows = read_table(spark, SMALL, "conversations").collect()
    ours = queries.op12_conversation_repair(spark, SMALL)
    assert ours.columns == ["conv_id", *COLUMNS]
    table = {row.conv_id: tuple(row[c] for c in COLUMNS) for row in ours.collect()}
    assert table == expected([(r.conv_id, r.turn, r.role, r.text) for r in rows])
    assert sum(1 for row in table.values() if row[5]) > 5


ODD = [
    (None, 0, "user", "hi."), (None, 1, "assistant", None), (None, None, None, "no end"),
    (1, 0, "system", "be kind."), (1, 2, "user", "a?"), (1, 2, "user", "a?"), (1, 2, "user", "b?"),
    (1, 9, "assistant", "x" * 200_000 + "."), (1, None, "tool", "t."), (1, None, "tool", "t."),
    (2, None, "", " \n\t"), (3, 5, "user", ""), (4, 3, "assistant", " "), (4, 4, "user", "end. "),
    *((5, t, "user" if t % 2 else "assistant", f"{t % 7}.") for t in range(40)),
]


def test_nulls_ties_repeats_and_clashing_names(spark, tmp_path):
    full = [(*row, 9, "Z", False, 7) for row in ODD * 2]
    folder = str(tmp_path)
    # The table's own columns must not be read as the operator's; `present` is one of its inputs.
    spark.createDataFrame(full, SCHEMA).drop("present").write.parquet(f"{folder}/conversations.parquet")
    ours = queries.op12_conversation_repair(spark, folder)
    table = {row.conv_id: tuple(row[c] for c in COLUMNS) for row in ours.collect()}
    assert table == expected([row for row in ODD * 2])


def test_empty_and_dropped(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    assert queries.op12_conversation_repair(spark, folder).collect() == []
    dropped = next(i for i in range(10**4) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(dropped, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    other = str(tmp_path / "x")
    rows.write.parquet(f"{other}/conversations.parquet")
    (row,) = queries.op12_conversation_repair(spark, other).collect()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_rows_are_what_the_digest_says(spark):
    rows = repair.damaged(read_table(spark, SMALL, "conversations"))
    plans = repair.plan_repairs(rows)
    made = repair.repaired_conversations(rows, plans).orderBy("conv_id", "place").collect()
    audits = {row.conv_id: row.audit for row in plans.collect()}
    digests = {row.conv_id: row.sha256 for row in repair.repaired_digests(rows, plans).collect()}
    seen = set()
    for conv, edits in groupby(made, key=lambda row: row.conv_id):
        edits = list(edits)
        seen.add(conv)
        assert "".join(e.edit for e in edits) == audits[conv]
        kept = [e for e in edits if e.edit != "D"]
        assert WHOLE.fullmatch("".join(e.role[:1] for e in kept))
        text = "\n".join(f"{e.role}:{e.text}" for e in kept)
        assert hashlib.sha256(text.encode()).hexdigest() == digests[conv]
    assert seen == {conv for conv, audit in audits.items() if audit}


@pytest.mark.parametrize("n", [20_000])
def test_a_very_long_conversation_is_linear(n):
    roles = [(i * i) % 4 for i in range(n)]
    cost, audit = repair.cheapest(roles, [0] * n)
    assert sum(letter != "I" for letter in audit) == n and cost > 0
