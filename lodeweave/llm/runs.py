"""Problem 6: collapse runs of repeated consecutive events.

Method: within a session, row number minus row number among rows of the same canonical command is
constant exactly along a run. Sessions are range-partitioned by (session, ts, id), so a session
with a third of all rows spreads over many tasks; each task numbers its own rows, and the runs at
the edges of the partitions (at most two a partition) are joined in a second, tiny step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.plans.runtime import cut, shuffle_width

_RUNS = "session_id string, command string, first_id long, last_id long, n long, start_ts double, end_ts double, part int, at long, head boolean, tail boolean"


def canonical_command(cmd: Column) -> Column:
    """Digits of numbers and lower-case hexadecimal ids (six or more characters, at least one digit) become 0; white space one blank."""
    c = F.regexp_replace(cmd, r"(?<![A-Za-z0-9_])(?=[a-f]*[0-9])[0-9a-f]{6,}(?![A-Za-z0-9_])", "0")
    c = F.regexp_replace(c, r"[0-9]+", "0")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _runs_of(rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of one stretch of sorted rows, in order; rows without command are runs of their own."""
    entity = rows.groupby("session_id", sort=False).cumcount()
    value = rows.groupby(["session_id", "command"], sort=False, dropna=False).cumcount()
    rows = rows.assign(gap=entity - value)
    g = rows.groupby(["session_id", "command", "gap"], sort=False, dropna=False)
    out = g.agg(first_id=("id", "first"), last_id=("id", "last"), n=("id", "size"), start_ts=("ts", "first"), end_ts=("ts", "last"), at=("seq", "first"))
    return out.reset_index().sort_values("at", kind="stable").drop(columns="gap").reset_index(drop=True)


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of a whole sorted partition: single rows are left out unless they stand at its edge."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    open_run: pd.DataFrame | None = None
    head = True

    def ready(runs: pd.DataFrame, tail: bool) -> pd.DataFrame:
        nonlocal head
        if runs.empty:
            return runs
        runs = runs.assign(part=part, head=False, tail=False)
        if head:
            runs.loc[runs.index[0], "head"] = True
            head = False
        if tail:
            runs.loc[runs.index[-1], "tail"] = True
        keep = runs["head"] | runs["tail"] | ((runs["n"] > 1) & runs["command"].notna())
        return runs[keep]

    seq = 0
    for rows in batches:
        if rows.empty:
            continue
        rows = rows.assign(seq=range(seq, seq + len(rows)))
        seq += len(rows)
        runs = _runs_of(rows)
        if open_run is not None:
            a, b = open_run.iloc[0], runs.iloc[0]
            if a["session_id"] == b["session_id"] and (a["command"] == b["command"] or (pd.isna(a["command"]) and pd.isna(b["command"]))):
                runs.loc[0, ["first_id", "start_ts", "at"]] = [a["first_id"], a["start_ts"], a["at"]]
                runs.loc[0, "n"] = a["n"] + b["n"]
            else:
                runs = pd.concat([open_run, runs], ignore_index=True)
        open_run = runs.iloc[-1:].reset_index(drop=True)
        done = ready(runs.iloc[:-1].reset_index(drop=True), tail=False)
        if not done.empty:
            yield done
    if open_run is not None:
        yield ready(open_run, tail=True)


def collapse_runs(
    events: DataFrame,
    session: str = "session_id",
    ts: str = "ts",
    event_id: str = "id",
    command: str = "cmd_raw",
    tool: str = "tool",
    edit_tool: str = "edit",
) -> DataFrame:
    """Longest stretches of two or more consecutive equal commands of a session.

    Result: session_id, first_id, last_id, run_length, start_ts, end_ts, duration_s, command (canonical).
    Rows are ordered by ts, then id. Rows with NULL session or ts (or a NaN ts) are left out before;
    repeated rows (same session, ts, id and command) count once; rows of the edit tool and rows whose
    command is NULL or blank end a stretch and are never in one. Equal ts are ordered by id; rows that
    share even the id by their command. An empty table gives an empty result; other columns are ignored.
    """
    canon = canonical_command(F.col(command))
    no_command = F.col(command).isNull() | (canon == "") | F.coalesce(F.lower(F.col(tool)) == edit_tool, F.lit(False))
    rows = events.select(
        F.col(session).cast("string").alias("session_id"),
        F.col(ts).cast("double").alias("ts"),
        F.col(event_id).cast("long").alias("id"),
        F.when(~no_command, canon).alias("command"),
    ).filter("session_id is not null and ts is not null and not isnan(ts)")
    rows = rows.dropDuplicates()
    order = ["session_id", "ts", "id", "command"]
    rows = rows.repartitionByRange(shuffle_width(events.sparkSession), *order).sortWithinPartitions(*order)
    # written once: the bounds of range partitions come from a sample, so a second pass over the rows could see others
    runs = cut(rows.mapInPandas(_local, _RUNS))
    inner = runs.filter(~F.col("head") & ~F.col("tail"))
    edges = runs.filter(F.col("head") | F.col("tail"))
    # at most two rows a partition: joining them in one task is bounded by the number of tasks
    w = Window.orderBy("part", "at")
    joins = F.lag("tail").over(w) & F.col("head") & (F.lag("session_id").over(w) == F.col("session_id")) & F.lag("command").over(w).eqNullSafe(F.col("command"))
    edges = edges.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("part", "at")
    edges = edges.groupBy("_island", "session_id", "command").agg(
        F.min_by("first_id", place).alias("first_id"),
        F.max_by("last_id", place).alias("last_id"),
        F.sum("n").alias("n"),
        F.min_by("start_ts", place).alias("start_ts"),
        F.max_by("end_ts", place).alias("end_ts"),
    )
    cols = ["session_id", "command", "first_id", "last_id", "n", "start_ts", "end_ts"]
    out = inner.select(cols).unionByName(edges.select(cols)).filter("n > 1 and command is not null")
    return out.select("session_id", "first_id", "last_id", F.col("n").alias("run_length"), "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("duration_s"), "command")
