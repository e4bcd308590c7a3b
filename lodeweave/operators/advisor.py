"""When a session's retrieved context weighs too much, and what of it can go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the pressure.
TOKENS, TOOL_CALLS, RETRIEVALS, SECONDS = 40_000, 10, 1, 180.0
REARM_RETRIEVALS, MOST_REFETCH = 4, 5  # further retrievals after which a hint may be given again


def running_pressure(calls: DataFrame) -> DataFrame:
    """(session_id, seq, tokens, tool_calls, retrievals, elapsed, should_evict) after each of calls(session_id, seq, ts, kind, chunk_key, tokens).

    A chunk's tokens count when it is first retrieved; should_evict if any threshold is passed.
    """
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("session_id", "chunk_key").orderBy("seq")) == 1
    rows = calls.withColumn("_new", F.when(F.col("chunk_key").isNotNull() & first, F.col("tokens")).otherwise(0))
    rows = rows.select(
        "session_id",
        "seq",
        F.sum("_new").over(w).alias("tokens"),
        F.count(F.lit(1)).over(w).alias("tool_calls"),
        F.sum((F.col("kind") == "retrieval").cast("int")).over(w).alias("retrievals"),
        (F.col("ts") - F.min("ts").over(w)).alias("elapsed"),
    )
    over = (F.col("tokens") >= TOKENS) | (F.col("tool_calls") > TOOL_CALLS) | (F.col("retrievals") > RETRIEVALS) | (F.col("elapsed") >= SECONDS)
    return rows.withColumn("should_evict", over)


def _hints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    session, last = None, None
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            if r.session_id != session:
                session, last = r.session_id, None
            if not r.should_evict:
                continue
            grown = last is None or r.tokens - last[0] >= TOKENS or r.retrievals - last[1] >= REARM_RETRIEVALS or r.elapsed - last[2] >= SECONDS
            if grown:
                last = (r.tokens, r.retrievals, r.elapsed)
                out.append((r.session_id, r.seq))
        yield pd.DataFrame(out, columns=["session_id", "seq"])


def hints(pressure: DataFrame) -> DataFrame:
    """(session_id, seq) at which running_pressure's rows give a hint: when it first is too much, and again after 40,000 tokens, four retrievals or 180 seconds more.

    A session is read as a stream within its task; only its last hint is held.
    """
    rows = pressure.select("session_id", "seq", "tokens", "retrievals", "elapsed", "should_evict").repartition("session_id").sortWithinPartitions("session_id", "seq")
    return rows.mapInPandas(_hints, "session_id string, seq long")


def refetch_keys(calls: DataFrame, most: int = MOST_REFETCH) -> DataFrame:
    """(session_id, chunk_key, place): the chunks retrieved last."""
    last = calls.filter("chunk_key is not null").groupBy("session_id", "chunk_key").agg(F.max("seq").alias("seq"))
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"), "chunk_key")
    return last.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("session_id", "chunk_key", "place")


def cache_metrics(log: DataFrame) -> DataFrame:
    """One row (hits, misses, hit_rate, tokens_saved) of a log(event, tokens) of hits and misses."""
    hits, all_ = F.count_if(F.col("event") == "hit"), F.count_if(F.col("event").isin("hit", "miss"))
    return log.agg(hits.alias("hits"), F.count_if(F.col("event") == "miss").alias("misses"), F.round(F.coalesce(hits / F.nullif(all_, F.lit(0)), F.lit(0.0)), 6).alias("hit_rate"), F.coalesce(F.sum(F.when(F.col("event") == "hit", F.col("tokens"))), F.lit(0)).alias("tokens_saved"))
