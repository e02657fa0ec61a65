"""Live counts over the events stream."""

from tidepath.streaming.live import (
    live_daily,
    read_event_stream,
    stream_dedupe,
    user_sessions,
)
from tidepath.streaming.run import append_to_files, keep_latest, keep_sessions
from tidepath.streaming.stateful import interval_join, session_changes

__all__ = [
    "append_to_files",
    "interval_join",
    "keep_latest",
    "keep_sessions",
    "live_daily",
    "read_event_stream",
    "session_changes",
    "stream_dedupe",
    "user_sessions",
]
