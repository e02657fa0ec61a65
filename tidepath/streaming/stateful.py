"""Streaming operators with state of their own: sessions with timers, joins of two streams."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PARTS = "user_id long, start long, finish long, n long"
CHANGES = "user_id long, start long, finish long, n long, change string"


def _seconds(span: str) -> int:
    """Length of a span such as `6 hours` in whole seconds."""
    number, unit = span.split()
    # Seconds in each unit.
    sizes = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return int(number) * sizes[unit.rstrip("s")]


def _merged_parts(gap: int):
    """Turns batches of events into the bursts within each batch: far fewer rows to shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).sort_by(
                [("user_id", "ascending"), ("start", "ascending")]
            )
            user = table.column("user_id").combine_chunks()
            known = np.asarray(user.is_valid())
            ids = np.asarray(user.fill_null(0))
            start = np.asarray(table.column("start").combine_chunks())
            opens = np.ones(len(start), bool)
            opens[1:] = (
                (ids[1:] != ids[:-1]) | (known[1:] != known[:-1]) | (start[1:] - start[:-1] > gap)
            )
            first = np.flatnonzero(opens)
            after = np.append(first[1:], len(start))
            yield pa.RecordBatch.from_arrays(
                [
                    user.take(pa.array(first)),
                    pa.array(start[first]),
                    pa.array(start[after - 1] + gap),
                    pa.array(after - first),
                ],
                names=["user_id", "start", "finish", "n"],
            )

    return run


def _sessions() -> StatefulProcessor:
    """A processor that is sent whole, as a class within a function is.

    The process that starts a stateful query on the driver sees no files sent with
    `--py-files` and need not find this package; a class by name would have to be imported.
    """

    class Sessions(StatefulProcessor):
        """Open sessions of a user in order of their start, with one timer for the earliest end.

        A user has few of them: one ends before the next begins, and those whose end the
        watermark has passed are gone. State and timers are reached through a socket, so a
        user costs a few calls a batch, however many sessions the batch holds.
        """

        def init(self, handle) -> None:
            self.handle = handle
            kind = "starts array<long>, finishes array<long>, sizes array<long>"
            self.held = handle.getValueState("open", kind)

        @staticmethod
        def _timer(finish: int) -> int:
            return -(-finish // 1000)

        def _read(self) -> dict[int, tuple[int, int]]:
            value = self.held.get()
            return {start: (finish, n) for start, finish, n in zip(*value)} if value else {}

        def _write(self, now: dict[int, tuple[int, int]]) -> None:
            if now:
                order = sorted(now)
                self.held.update((order, [now[s][0] for s in order], [now[s][1] for s in order]))
            else:
                self.held.clear()

        def _due(self, now: dict[int, tuple[int, int]]) -> int | None:
            return min((self._timer(finish) for finish, _ in now.values()), default=None)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            before = self._read()
            now = dict(before)
            # Sessions lie apart, so their starts and their ends are in one order.
            order = sorted(now)
            for row in rows:
                start, finish, n = row.start, row.finish, row.n
                # Both ends count: events exactly the gap apart are one session.
                low = high = bisect_left(order, start)
                while low and now[order[low - 1]][0] >= start:
                    low -= 1
                while high < len(order) and order[high] <= finish:
                    high += 1
                for other in order[low:high]:
                    end, size = now.pop(other)
                    start, finish, n = min(start, other), max(finish, end), n + size
                order[low:high] = [start]
                now[start] = (finish, n)
            old, new = self._due(before), self._due(now)
            if old != new:
                if old is not None:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(new)
            self._write(now)
            for start, (finish, _) in before.items():
                if start not in now:
                    yield Row(user_id=key[0], start=start, finish=finish, n=0, change="merged")
            for start, (finish, n) in now.items():
                if before.get(start) != (finish, n):
                    yield Row(user_id=key[0], start=start, finish=finish, n=n, change="open")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            now = self._read()
            # The earliest end stands for all that the watermark has passed.
            passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
            left = {start: held for start, held in now.items() if self._timer(held[0]) > passed}
            self._write(left)
            if left:
                self.handle.registerTimer(self._due(left))
            for start, (finish, n) in now.items():
                if start not in left:
                    yield Row(user_id=key[0], start=start, finish=finish, n=n, change="closed")

        def close(self) -> None:
            pass

    return Sessions()


def session_changes(stream: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """What happens to sessions: `user_id, session_start, session_end, n, change`.

    Sessions are those of `user_sessions`, but seen from their first event on. `change` is
    `open` for one that is new or has grown (with all it has so far), `closed` once the
    watermark has passed its end, and `merged` for one that went into an earlier one, or
    into one that now starts earlier. A key of `user_id` and `session_start` names a
    session; its newest change holds. `keep_sessions` makes a table of that.

    An event is late, and left out, if the watermark has passed the end of the session it
    would make alone. Null times are left out; a null user is a user.

    Tasks merge the events they read into bursts first, so a busy user sends a row for
    each burst and batch instead of one for each event.
    """
    wide = _seconds(gap)
    parts = (
        stream.where("t is not null")
        .select("user_id", F.unix_micros("t").alias("start"))
        .mapInArrow(_merged_parts(wide * 1_000_000), PARTS)
    )
    # The watermark runs on ends, which are a gap after the last events.
    ends = parts.withColumn("ends", F.timestamp_micros("finish")).withWatermark(
        "ends", f"{wide + _seconds(delay)} seconds"
    )
    found = ends.groupBy("user_id").transformWithState(
        _sessions(), CHANGES, outputMode="Update", timeMode="EventTime"
    )

    def moment(column: str) -> Column:
        return F.timestamp_micros(column).cast("timestamp_ntz")

    return found.select(
        "user_id", moment("start").alias("session_start"), moment("finish").alias("session_end"),
        "n", "change",
    )


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_time: str,
    right_time: str,
    within: str,
    delay: str = "1 hour",
    how: str = "inner",
) -> DataFrame:
    """Pairs of a row of `left` and a row of `right` at most `within` before it, or at its time.

    Both are streams, with `timestamp` columns `left_time` and `right_time` and columns of
    different names; `on` names columns that must be equal. Rows may come up to `delay`
    late. State is bounded: a row is dropped once the watermark says that no partner can
    come. With `how="left"` rows of `left` without a partner are kept, with nulls; they
    appear when that is certain.

    For inner pairs time is cut into bins as wide as `within`: a row of `right` lies in
    one, a row of `left` looks into its own and the one before. So a pair meets once, and
    a very frequent key is spread over as many state stores as there are bins.
    """
    both = {name.lower() for name in left.columns} & {name.lower() for name in right.columns}
    if both:
        raise ValueError(f"both sides have columns named {sorted(both)}; rename one of them")
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how}")
    width = _seconds(within)
    mine = left.withWatermark(left_time, delay)
    theirs = right.withWatermark(right_time, delay)
    span = F.expr(f"interval {width} seconds")
    matches = [F.col(ours) == F.col(other) for ours, other in on]
    matches += [
        F.col(right_time) <= F.col(left_time),
        F.col(right_time) >= F.col(left_time) - span,
    ]
    if how == "inner":
        bin_of = F.floor(F.unix_seconds(F.col(left_time)) / width)
        mine = mine.withColumn("_left_bin", F.explode(F.array(bin_of - 1, bin_of)))
        theirs = theirs.withColumn("_right_bin", F.floor(F.unix_seconds(F.col(right_time)) / width))
        matches.append(F.col("_left_bin") == F.col("_right_bin"))
    return mine.join(theirs, reduce(Column.__and__, matches), how).select(*left.columns, *right.columns)
