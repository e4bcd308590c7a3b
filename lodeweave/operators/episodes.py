"""Episodes of shell commands: digests, outcomes, retention, and arcs from failure to success."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.commands import TRANSIENT, identical, in_band, markers, normal_form, outcome, similarity, termination
from lodeweave.plans.runtime import spread

# Windows of the arc search and of retention.
MOST_COMMANDS, MOST_SECONDS, MOST_PENDING, TS_STEP = 20, 600.0, 5, 0.001
FLAKE_COUNT, FLAKE_LEAST = 2, 0.95
KEEP_ROWS, KEEP_DAYS = 5000, 30


def unique_episodes(episodes: DataFrame) -> DataFrame:
    return episodes.dropDuplicates(["id"])


def collapse_lines(text: Column) -> Column:
    """Consecutive equal lines as one with [xN] behind it."""
    lines = F.split(text, "\r?\n")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"))
    shown = lambda s: F.when(s["n"] > 1, F.concat(s["last"], F.lit(" [x"), s["n"].cast("string"), F.lit("]"))).otherwise(s["last"])

    def step(s: Column, x: Column) -> Column:
        same = (s["n"] > 0) & (s["last"] == x)
        out = F.when(same | (s["n"] == 0), s["out"]).otherwise(F.concat(s["out"], F.array(shown(s))))
        return F.struct(out.alias("out"), x.alias("last"), F.when(same, s["n"] + 1).otherwise(F.lit(1)).alias("n"))

    return F.aggregate(lines, start, step, lambda s: F.array_join(F.concat(s["out"], F.array(shown(s))), "\n"))


def digest(text: Column, chars: int = 2000, head: int = 20, tail: int = 20) -> Column:
    """Output in at most `chars` characters: repeated lines collapsed, then the first and last lines with a hash of those between."""
    flat = collapse_lines(text)
    lines = F.split(flat, "\n")
    n = F.size(lines)
    between = F.array_join(F.slice(lines, head + 1, F.greatest(F.lit(0), n - head - tail)), "\n")
    note = F.concat(F.lit("... [elided "), (n - head - tail).cast("string"), F.lit(" lines, sha256:"), F.substring(F.sha2(between, 256), 1, 12), F.lit("] ..."))
    short = F.when(n > head + tail, F.concat_ws("\n", F.slice(lines, 1, head), note, F.slice(lines, F.greatest(F.lit(1), n - tail + 1), tail))).otherwise(flat)
    half = chars // 2
    cut = F.concat(F.substring(short, 1, half), F.lit("\n...[truncated]...\n"), F.substring(short, -half, half))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).when(F.length(flat) <= chars, flat).when(F.length(short) <= chars, short).otherwise(cut)


def derived(episodes: DataFrame) -> DataFrame:
    """Episodes with termination, markers found in their output, and outcome."""
    rows = spread(episodes).withColumn("markers", markers(F.col("stdout"), F.col("stderr")))
    rows = rows.withColumn("termination", termination(F.col("rc"), F.col("interrupted")))
    harness = F.col("harness_success") if "harness_success" in episodes.columns else None
    return unique_episodes(rows.withColumn("outcome", outcome(F.col("rc"), F.col("is_error"), F.col("interrupted"), F.col("markers"), harness)))


def list_episodes(episodes: DataFrame, workspace: str, session_id: str | None = None, since: float | None = None, until: float | None = None, limit: int = 50) -> DataFrame:
    """Episodes of a workspace, newest first."""
    rows = episodes.filter(F.col("workspace") == workspace)
    if session_id is not None:
        rows = rows.filter(F.col("session_id") == session_id)
    if since is not None:
        rows = rows.filter(F.col("ts") >= since)
    if until is not None:
        rows = rows.filter(F.col("ts") <= until)
    return unique_episodes(rows).orderBy(F.col("ts").desc_nulls_last(), F.desc("id")).limit(limit)


def retained(episodes: DataFrame, now: float, rows: int = KEEP_ROWS, days: float = KEEP_DAYS) -> DataFrame:
    """The newest `rows` episodes of each workspace that are at most `days` old."""
    w = Window.partitionBy("workspace").orderBy(F.col("ts").desc_nulls_last(), F.desc("id"))
    young = unique_episodes(episodes.filter(F.col("ts") >= now - days * 86400))
    return young.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= rows).drop("_r")


def episode_counts(episodes: DataFrame) -> DataFrame:
    return unique_episodes(episodes).groupBy("workspace").agg(F.count(F.lit(1)).alias("episodes"))


ARC = "session_id string, failure_ids array<long>, success_id long, confidence string, changed array<string>, changes array<struct<axis:string,old:string,new:string>>"
_NEEDED = ["id", "session_id", "ts", "cwd", "tool", "cmd_raw", "outcome", "termination", "markers", "env_delta_names", "file_path"]


_form = functools.lru_cache(1 << 14)(normal_form)


def differences(a: dict, env_a: list, b: dict, env_b: list) -> list[tuple[str, str, str]]:
    """(axis, old, new) in which two commands (normal forms and names of their environment) differ."""
    sides = [("verb", a["verb"], b["verb"]), ("flag", sorted(set(a["flags"])), sorted(set(b["flags"]))), ("arg", list(a["args"]), list(b["args"])), ("env", sorted(set(env_a)), sorted(set(env_b)))]
    shown = lambda x: x if isinstance(x, str) else " ".join(x)
    return [(axis, shown(old), shown(new)) for axis, old, new in sides if old != new]


class _Session:
    """What is pending in one session: failures by (tool, directory), recent edits, commands known to be flaky."""

    transient = TRANSIENT  # markers under which an arc is of low confidence

    def __init__(self, kept: dict | None = None):
        kept = kept or {}
        self.count, self.last = kept.get("count", 0), kept.get("last", 0.0)
        self.pending: dict[tuple, list[dict]] = {tuple(k): v for k, v in kept.get("pending", [])}
        self.edits: list[list] = kept.get("edits", [])
        self.flaky: dict[tuple, int] = {(v, tuple(f), tuple(a)): n for (v, f, a), n in kept.get("flaky", [])}

    def kept(self) -> dict:
        return {"count": self.count, "last": self.last, "pending": [[list(k), v] for k, v in self.pending.items()], "edits": self.edits, "flaky": [[list(map(lambda x: x if isinstance(x, str) else list(x), k)), n] for k, n in self.flaky.items()]}

    def _near(self, ts: float, at: int) -> bool:
        return self.last - ts <= MOST_SECONDS and self.count - at <= MOST_COMMANDS

    @staticmethod
    def _sign(n: dict) -> tuple:
        return n["verb"], tuple(sorted(set(n["flags"]))), tuple(n["args"])

    def observe(self, e: dict) -> tuple | None:
        if e["tool"] not in ("bash", "edit"):
            return None
        self.last = e["ts"] if e["ts"] is not None and e["ts"] == e["ts"] else self.last + TS_STEP
        self.count += 1
        self.pending = {k: p for k, ps in self.pending.items() if (p := [x for x in ps if self._near(x["ts"], x["at"])])}
        self.edits = [x for x in self.edits if self._near(x[0], x[1])]
        if e["tool"] == "edit":
            self.edits.append([self.last, self.count, e["file_path"]])
            return None
        if e["outcome"] not in ("failure", "soft_failure", "success") or e["termination"] in ("signal", "cancelled"):
            return None
        n = _form(e["cmd_raw"])
        if not n["verb"]:
            return None
        env = sorted(set(e["env_delta_names"]))
        key = (n["verb"].split(" ")[0], n["cd_target"] if n["cd_target"] is not None else e["cwd"])
        if e["outcome"] != "success":
            bucket = self.pending.setdefault(key, [])
            bucket.append({"id": e["id"], "n": n, "ts": self.last, "at": self.count, "env": env, "markers": e["markers"]})
            del bucket[:-MOST_PENDING]
            return None
        return self._resolve(key, e, n, env)

    def _resolve(self, key: tuple, e: dict, n: dict, env: list) -> tuple | None:
        bucket = self.pending.get(key, [])
        same = [p for p in bucket if identical(p["n"], n)]
        noise: list[dict] = []
        files: list = []
        if same:
            anchor = same[-1]
            edits = [x for x in self.edits if anchor["at"] < x[1]]
            if not edits and anchor["env"] == env:
                sign = self._sign(n)
                self.flaky[sign] = self.flaky.get(sign, 0) + 1
                self._drop(key, [anchor])
                return None
            files = edits
        else:
            scored = [(similarity(p["n"], n), p["at"], p) for p in bucket]
            scored = [s for s in scored if in_band(s[0])]
            noise = [p for s, _, p in scored if s >= FLAKE_LEAST and self.flaky.get(self._sign(p["n"]), 0) >= FLAKE_COUNT]
            scored = [s for s in scored if s[2] not in noise]
            if not scored:
                self._drop(key, noise)
                return None
            anchor = max(scored, key=lambda s: s[:2])[2]
        chain, front = [anchor], anchor
        for p in sorted((p for p in bucket if p["at"] < anchor["at"]), key=lambda p: -p["at"]):
            if identical(p["n"], front["n"]) or in_band(similarity(p["n"], front["n"])):
                chain.insert(0, p)
                front = p
        self._drop(key, chain + noise)
        first = chain[0]
        changes = [(axis, old, new) for axis, old, new in differences(first["n"], first["env"], n, env)]
        if files:
            changes.append(("files", "", " ".join(dict.fromkeys(x[2] or "" for x in files))))
        low = any(m in self.transient for p in chain for m in p["markers"])
        return e["session_id"], [p["id"] for p in chain], e["id"], "low" if low else "normal", [a for a, _, _ in changes], [{"axis": a, "old": o, "new": w} for a, o, w in changes]

    def _drop(self, key: tuple, gone: list[dict]) -> None:
        left = [p for p in self.pending.get(key, []) if all(p is not g for g in gone)]
        self.pending.pop(key, None)
        if left:
            self.pending[key] = left


def observe_rows(session: _Session, rows: pd.DataFrame) -> list[tuple]:
    """Arcs of a session's episodes; rows are taken in the order they have."""
    out = []
    for values in zip(*(rows[c].tolist() for c in _NEEDED)):
        r = dict(zip(_NEEDED, values))
        r["ts"] = None if pd.isna(r["ts"]) else float(r["ts"])
        for name in ("cwd", "cmd_raw", "file_path", "outcome", "termination"):
            r[name] = r[name] if isinstance(r[name], str) else None
        r["tool"] = r["tool"].lower() if isinstance(r["tool"], str) else None
        for name in ("markers", "env_delta_names"):
            r[name] = [] if r[name] is None else [x for x in r[name] if x is not None]
        if arc := session.observe(r):
            out.append(arc)
    return out


def _sessions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, session = None, _Session()
    for rows in batches:
        out: list[tuple] = []
        for sid, part in rows.groupby("session_id", sort=False):
            if sid != current:
                current, session = sid, _Session()
            out += observe_rows(session, part)
        if out:
            yield pd.DataFrame(out, columns=["session_id", "failure_ids", "success_id", "confidence", "changed", "changes"])


def arcs(episodes: DataFrame) -> DataFrame:
    """(session_id, failure_ids, success_id, confidence, changed, changes): commands that failed until something changed, and how.

    A session is read in the order of ts, then id, as a stream within its task: only what is pending is held in memory,
    however long the session is. Rows without session are left out; a row without ts comes first and counts as just after the one
    before it. A success is matched with the most similar pending failure of the same tool and directory within 20
    commands and 600 seconds; an identical command that succeeds with nothing changed is a flake and gives no arc.
    """
    rows = derived(episodes.filter("session_id is not null")).select(*_NEEDED)
    rows = rows.repartition("session_id").sortWithinPartitions("session_id", "ts", "id")
    return rows.mapInPandas(_sessions, ARC)


def list_arcs(found: DataFrame, episodes: DataFrame, limit: int = 50) -> DataFrame:
    """(session_id, success_id, confidence, failed, succeeded): arcs with their commands, sure ones and old ones first."""
    e = unique_episodes(episodes).select("id", "cmd_raw", "ts")
    failed = found.select("success_id", F.posexplode("failure_ids").alias("pos", "id")).join(e, "id")
    failed = failed.groupBy("success_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("cmd_raw", F.lit("")).alias("c")))), lambda x: x["c"]), "\n").alias("failed"))
    out = found.join(failed, "success_id", "left").join(e.select(F.col("id").alias("success_id"), F.col("cmd_raw").alias("succeeded"), "ts"), "success_id", "left")
    return out.orderBy(F.when(F.col("confidence") == "normal", 0).otherwise(1), "ts", "success_id").limit(limit).select("session_id", "success_id", "confidence", "failed", "succeeded")


def pending_arcs(found: DataFrame, marks: DataFrame) -> DataFrame:
    """(session_id, pending): arcs that no row of marks(success_id, status) has distilled or dismissed yet."""
    done = marks.filter("status in ('distilled', 'dismissed')").select("success_id").distinct()
    return found.join(done, "success_id", "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("pending"))


def mark_episodes(episodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, arc_id): episodes that belong to an arc, named by the id of its success; of several arcs the first."""
    inside = found.select(F.explode(F.concat("failure_ids", F.array("success_id"))).alias("id"), F.col("success_id").alias("arc_id"))
    return unique_episodes(episodes.select("id")).join(inside.groupBy("id").agg(F.min("arc_id").alias("arc_id")), "id")


def epoch_seconds(ts: Column) -> Column:
    """A time given as seconds, or in ISO 8601 with Z or an offset, as seconds; NULL for others."""
    text = F.trim(ts.cast("string"))
    iso = F.regexp_replace(F.regexp_replace(text, "Z$", "+00:00"), "^(\\d{4}-\\d{2}-\\d{2}) ", "$1T")
    return F.coalesce(text.try_cast("double"), F.unix_micros(iso.try_cast("timestamp")) / 1e6)


def resolve(found: DataFrame, ids: list[int], status: str) -> DataFrame:
    """(success_id, status): those of the asked arcs that there are get a status, the others unknown."""
    asked = found.sparkSession.createDataFrame([(i,) for i in ids], "success_id long")
    there = found.select("success_id", F.lit(status).alias("_s")).distinct()
    return asked.join(there, "success_id", "left").select("success_id", F.coalesce("_s", F.lit("unknown")).alias("status"))
