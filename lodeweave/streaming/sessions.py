"""Streams of changes and episodes: debouncing, bursts, arcs, ledgers, running statistics."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeweave.operators.episodes import ARC, _NEEDED, _Session, observe_rows
from lodeweave.operators.triggers import COOLDOWN_TURNS, LEDGER_OUT, LEDGER_STATE, PER_SESSION, PER_TURN, _ledger

QUIET, BURST_QUIET, BURST_FILES = "2 seconds", "15 seconds", 8
LATE, IDLE = "1 day", 6 * 3600.0  # how late rows may come; seconds after which the state of a silent session goes


def event_time(df: DataFrame, ts: str, late: str = "10 minutes") -> DataFrame:
    """df with the watermark column event_time of epoch seconds or a timestamp."""
    is_time = dict(df.dtypes)[ts].startswith("timestamp")
    at = F.col(ts).cast("timestamp") if is_time else F.timestamp_seconds(F.col(ts))
    out = df.withColumn("event_time", at)
    return out.withWatermark("event_time", late) if df.isStreaming else out


def debounced(changes: DataFrame, key: str = "path", ts: str = "ts", action: str = "action", quiet: str = QUIET) -> DataFrame:
    """(key, started, ended, changes, action): a change of a key each time it falls silent; the last action counts."""
    rows = event_time(changes, ts)
    per = rows.groupBy(key, F.session_window("event_time", quiet).alias("w"))
    out = per.agg(F.count(F.lit(1)).alias("changes"), F.max_by(action, "event_time").alias("action"))
    return out.select(key, F.unix_timestamp("w.start").alias("started"), F.unix_timestamp("w.end").alias("ended"), "changes", "action")


def bursts(changes: DataFrame, key: str = "path", ts: str = "ts", group: str = "workspace", quiet: str = BURST_QUIET, least: int = BURST_FILES) -> DataFrame:
    """(group, started, ended, keys): stretches in which more than `least` keys changed before it fell silent."""
    rows = event_time(changes, ts)
    per = rows.groupBy(group, F.session_window("event_time", quiet).alias("w")).agg(F.size(F.collect_set(key)).alias("keys"))
    return per.filter(F.col("keys") > least).select(group, F.unix_timestamp("w.start").alias("started"), F.unix_timestamp("w.end").alias("ended"), "keys")


def running_language_stats(chunks: DataFrame) -> DataFrame:
    """(language, chunks) of signed changes, for update or complete mode."""
    return chunks.groupBy("language").agg(F.sum(F.coalesce(F.col("sign"), F.lit(1))).alias("chunks"))


def _arcs(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    session = _Session(json.loads(state.get[0]) if state.exists else None)
    rows = pd.concat(list(batches)).sort_values(["ts", "id"], na_position="first", kind="stable")
    out = observe_rows(session, rows)
    state.update((json.dumps(session.kept()),))
    yield pd.DataFrame(out, columns=["session_id", "failure_ids", "success_id", "confidence", "changed", "changes"])


def _forgotten(run, idle_seconds: float):
    """run, whose state of a key goes when the watermark has passed what last came for it by so many seconds."""

    def with_timeout(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        yield from run(key, batches, state)
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + int(idle_seconds * 1000))

    return with_timeout


def stream_arcs(derived_episodes: DataFrame, late: str = LATE, idle_seconds: float = IDLE) -> DataFrame:
    """arcs() of a stream of derived() episodes: the same arcs, if rows arrive in the order of ts within a session.

    Rows more than `late` behind the newest are dropped. A session's state goes when the watermark is idle_seconds beyond its
    last row; what comes then begins anew.
    """
    rows = event_time(derived_episodes.filter("session_id is not null"), "ts", late).select(*_NEEDED, "event_time")
    return rows.groupBy("session_id").applyInPandasWithState(_forgotten(_arcs, idle_seconds), ARC, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_ledger(fires: DataFrame, session_budget: int = PER_SESSION, turn_budget: int = PER_TURN, cooldown: int = COOLDOWN_TURNS, late: str = LATE, idle_seconds: float = IDLE) -> DataFrame:
    """ledger() of a stream of fires, with the times of stream_arcs()."""
    run = _forgotten(_ledger(session_budget, turn_budget, cooldown), idle_seconds)
    return event_time(fires, "ts", late).groupBy("session_id").applyInPandasWithState(run, LEDGER_OUT, LEDGER_STATE, "append", GroupStateTimeout.EventTimeTimeout)
