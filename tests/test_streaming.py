import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from helpers import SMALL, rows_of
from pyspark.serializers import CPickleSerializer

from tidepath.sources import read_tables
from tidepath.sources.tables import SCHEMAS
from tidepath.streaming import (
    append_to_files,
    interval_join,
    keep_latest,
    keep_sessions,
    live_daily,
    read_event_stream,
    session_changes,
    stateful,
    stream_dedupe,
    user_sessions,
)

START = datetime(2024, 1, 1)


class Feed:
    """A folder that receives files of events, and a stream that resumes over it."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.source = str(folder / "in")

    def send(self, *events):
        """Events as (id, hours since the start, user)."""
        rows = [
            (number, START + timedelta(hours=hours), user, "view", 1.0, "{}")
            for number, hours, user in events
        ]
        frame = self.spark.createDataFrame(rows, SCHEMAS["events"])
        frame.coalesce(1).write.mode("append").parquet(self.source)

    def run(self, operator, sink=append_to_files):
        stream = operator(read_event_stream(self.spark, self.source))
        return sink(stream, str(self.folder / "out"), str(self.folder / "state"))


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_daily_counts_with_late_events(feed):
    feed.send((1, 1, 1), (2, 20, 1))
    assert rows_of(feed.run(live_daily)) == []
    # 23:30 of the first day comes after 00:10 of the second: within the hour.
    feed.send((3, 24.2, 1), (4, 23.5, 1))
    assert rows_of(feed.run(live_daily)) == []
    feed.send((5, 26, 1))
    assert rows_of(feed.run(live_daily)) == [("2024-01-01", 3)]
    # Another event of the first day is now past the watermark and not counted.
    feed.send((6, 23, 1), (7, 49.5, 1))
    assert rows_of(feed.run(live_daily)) == [("2024-01-01", 3), ("2024-01-02", 2)]


def test_open_days_are_shown_by_the_latest_result(feed):
    feed.send((1, 1, 1), (2, 30, 1))
    assert rows_of(feed.run(live_daily, keep_latest)) == [("2024-01-01", 1), ("2024-01-02", 1)]
    feed.send((3, 31, 1))
    assert rows_of(feed.run(live_daily, keep_latest)) == [("2024-01-01", 1), ("2024-01-02", 2)]
    assert rows_of(feed.run(live_daily, keep_latest)) == [("2024-01-01", 1), ("2024-01-02", 2)]


def test_latest_result_equals_the_batch_result(spark):
    events = read_tables(spark, SMALL, ("events",))["events"]
    days = events.groupBy(events.ts.cast("date").cast("timestamp_ntz").alias("day")).count()
    stream = read_event_stream(spark, f"{SMALL}/{{events}}.parquet")
    assert rows_of(keep_latest(live_daily(stream))) == rows_of(days)


@pytest.mark.parametrize("splits", [1, 4])
def test_resent_events_are_dropped(feed, splits):
    dedupe = lambda stream: stream_dedupe(stream, splits=splits).drop("t")
    feed.send((1, 1, 1), (2, 1, 1), (1, 1, 1))
    feed.send(*[(2, 1, 1)] * 500)
    assert rows_of(feed.run(dedupe), "event_id") == [(1,), (2,)]
    feed.send((1, 1, 1), (3, 1.5, 1))
    assert rows_of(feed.run(dedupe), "event_id") == [(1,), (2,), (3,)]
    # Far ahead: the earlier ids are forgotten, and old events count as late.
    feed.send((4, 48, 1))
    feed.run(dedupe)
    feed.send((1, 1, 1), (4, 48, 1), (5, 48, 1))
    assert rows_of(feed.run(dedupe), "event_id") == [(1,), (2,), (3,), (4,), (5,)]


def test_sessions(feed):
    feed.send((1, 0, 1), (2, 5, 1), (3, 10, 1), (4, 16, 1), (5, 3, 2))
    feed.run(user_sessions)
    feed.send((6, 100, 3))
    # The event at 16 h is exactly the gap after the one at 10 h: same session.
    assert rows_of(feed.run(user_sessions)) == [
        (1, "2024-01-01", "2024-01-01 22:00:00", 4),
        (2, "2024-01-01 03:00:00", "2024-01-01 09:00:00", 1),
    ]


def test_a_busy_user_is_one_session(feed):
    feed.send(*[(number, number / 1000, 1) for number in range(3000)], (3001, 0.5, 2))
    feed.send((9999, 50, 9))
    assert rows_of(feed.run(user_sessions), "user_id", "n") == [(1, 3000), (2, 1)]


def test_session_setting_is_put_back(spark, feed):
    name = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    spark.conf.set(name, "false")
    try:
        feed.send((1, 0, 1))
        feed.run(user_sessions)
        assert spark.conf.get(name) == "false"
    finally:
        spark.conf.set(name, "true")


def test_other_time_zones_are_refused(spark, feed):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="UTC"):
            read_event_stream(spark, feed.source)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_latest_result_stays_small_over_many_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    for number in range(9):
        feed.send((number, 30 * number, 1))
        found = feed.run(live_daily, sink=keep_latest)
        assert sum(row.n for row in found.collect()) == number + 1
        folders = {p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("slot=")}
        assert folders <= {"slot=0", "slot=1", "slot=2"}
    assert found.count() == len({30 * number // 24 for number in range(9)})


def seen_sessions(feed):
    found = feed.run(session_changes, sink=keep_sessions)
    return [
        (user, (start - START).total_seconds() / 3600, (end - START).total_seconds() / 3600, n, closed)
        for user, start, end, n, closed in sorted(
            map(tuple, found.collect()), key=lambda row: (row[0] is None, row[0] or 0, row[1])
        )
    ]


def test_open_sessions_grow_merge_and_close(feed):
    feed.send((1, 0, 1), (2, 13, 1), (3, 3, 2), (4, 2, None), (5, 4, None))
    assert seen_sessions(feed) == [
        (1, 0, 6, 1, True),
        (1, 13, 19, 1, False),
        (2, 3, 9, 1, True),
        (None, 2, 10, 2, True),
    ]
    # Joins the open session, which so starts earlier; another one begins after it.
    feed.send((6, 12, 1), (7, 26, 1))
    assert seen_sessions(feed)[:3] == [(1, 0, 6, 1, True), (1, 12, 19, 2, True), (1, 26, 32, 1, False)]
    # Its own session would have ended before the watermark, which is at 25: late.
    feed.send((8, 18.5, 1), (9, 26.5, 2))
    feed.send((10, 20.5, 2), (11, 32.5, 2))
    assert seen_sessions(feed) == [
        (1, 0, 6, 1, True),
        (1, 12, 19, 2, True),
        (1, 26, 32, 1, False),
        (2, 3, 9, 1, True),
        (2, 20.5, 38.5, 3, False),
        (None, 2, 10, 2, True),
    ]
    assert len(seen_sessions(feed)) == 6  # nothing new: the same again


def test_a_session_between_two_merges_them(feed):
    feed.send((1, 0, 1), (2, 6.5, 1))
    assert seen_sessions(feed) == [(1, 0, 6, 1, False), (1, 6.5, 12.5, 1, False)]
    feed.send((3, 3, 1), (4, 3, 1), (5, 0, 1))
    assert seen_sessions(feed) == [(1, 0, 12.5, 5, False)]


def test_sessions_over_many_batches_cover_every_event(spark, feed):
    import random

    rng = random.Random(3)
    sent, last = [], {}
    for batch in range(6):
        # All within the hour that events may be late, so none is left out.
        events = [(batch * 50 + i, batch * 4 + rng.random(), rng.randrange(4)) for i in range(12)]
        feed.send(*events)
        sent += events
        found = seen_sessions(feed)
        assert sum(n for *_, n, _ in found) == len(sent)
    for _, hours, user in sorted(sent, key=lambda e: e[1]):
        runs = last.setdefault(user, [])
        if runs and hours - runs[-1][1] <= 6:
            runs[-1][1] = hours
            runs[-1][2] += 1
        else:
            runs.append([hours, hours, 1])
    expected = sorted((u, round(a, 4), round(b + 6, 4), n) for u, r in last.items() for a, b, n in r)
    assert [(u, round(a, 4), round(b, 4), n) for u, a, b, n, _ in found] == expected
    open_folders = {p.name for p in (feed.folder / "out" / "open").iterdir()}
    assert open_folders <= {"slot=0", "slot=1", "slot=none"}


def test_a_busy_user_is_merged_before_the_shuffle(feed):
    feed.send(*[(number, number / 1000, 1) for number in range(3000)], (3001, 0.5, 2))
    assert [row[3] for row in seen_sessions(feed)] == [3000, 1]


def test_sessions_need_no_setting_for_their_state(spark, feed):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(name, default)
    try:
        feed.send((1, 0, 1), (2, 6.5, 1))
        assert seen_sessions(feed) == [(1, 0, 6, 1, False), (1, 6.5, 12.5, 1, False)]
        assert spark.conf.get(name) == default
    finally:
        spark.conf.set(name, before)


def test_sessions_start_where_the_package_cannot_be_imported(tmp_path):
    sent = CPickleSerializer().dumps(stateful._sessions())
    environment = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    load = [sys.executable, "-c", "import pickle, sys; pickle.load(sys.stdin.buffer)"]
    done = subprocess.run(load, input=sent, cwd=tmp_path, env=environment, capture_output=True)
    assert done.returncode == 0, done.stderr.decode()


def test_no_sessions_of_nothing(feed):
    feed.send()
    assert seen_sessions(feed) == []


def paired(spark, folder, how, within="2 hours"):
    def stream(name, prefix):
        events = read_event_stream(spark, str(folder / name))
        return events.select(
            *(events[c].alias(f"{prefix}_{c}") for c in ("event_id", "user_id", "t"))
        )

    joined = interval_join(
        stream("buys", "b"), stream("clicks", "c"), [("b_user_id", "c_user_id")], "b_t", "c_t", within, how=how
    )
    out = append_to_files(
        joined.select("b_event_id", "c_event_id"), str(folder / f"out-{how}"), str(folder / f"state-{how}")
    )
    return rows_of(out)


@pytest.fixture
def send(spark, tmp_path):
    def write(name, *events):
        feed = Feed(spark, tmp_path)
        feed.source = str(tmp_path / name)
        feed.send(*events)

    return write


def test_pairs_of_two_streams_replayed_late(spark, tmp_path, send):
    clicks = [(1, 0, 1), (2, 1, 1), (3, 1, 2), (4, 3, 1), (5, 2.9, 1), (6, 3.5, None)]
    buys = [(11, 2, 1), (12, 3, 1), (13, 1, 2), (14, 5.2, 1), (15, 3.6, None)]
    for number in range(3):  # clicks and purchases come in pieces, the later ones first
        send("clicks", *clicks[::-1][number::3])
        send("buys", *buys[::-1][number::3])
    expected = sorted(
        (b, c) for b, tb, ub in buys for c, tc, uc in clicks
        if ub == uc and ub is not None and 0 <= tb - tc <= 2
    )
    assert paired(spark, tmp_path, "inner") == expected
    # Purchases without a click are told once no click can come any more.
    send("clicks", (90, 50, 9))
    send("buys", (91, 50, 9))
    kept = [pair for pair in paired(spark, tmp_path, "left") if pair[0] < 90]
    alone = [(b, None) for b, *_ in buys if b not in {pair[0] for pair in expected}]
    assert kept == sorted(expected + alone, key=lambda p: (p[0], p[1] is None, p[1] or 0))


def test_pairs_across_restarts_and_state_that_ends(spark, tmp_path, send):
    send("clicks", (1, 0, 1), (2, 0.5, 1))
    send("buys", (11, 1, 1))
    assert paired(spark, tmp_path, "inner") == [(11, 1), (11, 2)]
    send("buys", (12, 2.25, 1))
    send("clicks", (3, 1.5, 1))
    assert paired(spark, tmp_path, "inner") == [(11, 1), (11, 2), (12, 2), (12, 3)]
    send("clicks", (4, 30, 1))
    send("buys", (13, 30, 1))
    found = paired(spark, tmp_path, "inner")
    assert found[-1] == (13, 4)
    # Now far past the watermark: dropped as late.
    send("buys", (14, 1, 1))
    send("clicks", (5, 1, 1))
    assert paired(spark, tmp_path, "inner") == found


def test_joined_streams_need_names_of_their_own(spark, tmp_path, send):
    send("buys", (1, 0, 1))
    events = read_event_stream(spark, str(tmp_path / "buys"))
    with pytest.raises(ValueError, match="rename"):
        interval_join(events, events, [("user_id", "user_id")], "t", "t", "1 hour")
    with pytest.raises(ValueError, match="inner or left"):
        interval_join(events, events.toDF(*(f"o_{c}" for c in events.columns)), [], "t", "o_t", "1 hour", how="full")
