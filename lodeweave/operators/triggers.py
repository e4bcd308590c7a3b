"""Trigger rules of notes against lifecycle moments, their order, and packing under budgets.

A moment is a row (moment_id, workspace, event, file_path, command_verb, session_id, branch, ts). Rules are rows of their own,
joined to moments by what they name: a path without wildcards, else an event, else the workspace alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.text import glob_column, token_estimate, trim_to_cap
from lodeweave.operators.memory import fold_states, live

# Orders, budgets in tokens, thresholds, shapes of the gate.
KIND_ORDER = ["directive", "gotcha", "operational", "task", "finding", "reference"]
PRIORITY_ORDER = ["high", "medium", "low"]
PER_SESSION, PER_TURN = 8000, 500
PER_KIND = {"directive": 400, "gotcha": 100, "operational": 250}
FULL_TEXT_KINDS = ["directive", "gotcha", "operational"]
THETA = {"directive": 0.72, "gotcha": 0.72, "operational": 0.75, "task": 0.75, "finding": 0.78, "reference": 0.80}
COOLDOWN_TURNS = 10
GATE_LEAST, GATE_ITEMS, GATE_CHARS, GATE_WEAK, GATE_RING = 0.35, 3, 800, 1, 30
EVENTS = ["session-start", "prompt-submit", "pre-edit", "post-edit", "pre-command", "post-compaction", "session-end"]

_TRIGGER = "struct<path:string,event:string,symbol:string,semantic:boolean,command:string,not_before:double,expires_visibility:double,cooldown:double>"


def _trigger(**fields) -> Column:
    names = ["path", "event", "symbol", "semantic", "command", "not_before", "expires_visibility", "cooldown"]
    return F.struct(*[(fields[n] if isinstance(fields.get(n), Column) else F.lit(fields.get(n))).alias(n) for n in names]).cast(_TRIGGER)


def default_triggers(kind: Column, anchors: Column, priority: Column) -> Column:
    """The rules of a note that declares none, by its kind."""
    none = F.array().cast(f"array<{_TRIGGER}>")
    by_path = F.transform(F.filter(F.coalesce(anchors, F.array().cast("array<struct<path:string,hash:string>>")), lambda a: F.coalesce(a["path"] != "", F.lit(False))), lambda a: _trigger(path=a["path"], event="pre-edit"))
    return (
        F.when(kind == "directive", F.array(_trigger(event="session-start"), _trigger(event="post-compaction")))
        .when((kind == "task") & (priority == "high"), F.array(_trigger(event="session-start")))
        .when(kind == "gotcha", by_path)
        .when(kind == "operational", F.array(_trigger(event="prompt-submit", semantic=True)))
        .otherwise(none)
    )


def effective_triggers(triggers: Column, kind: Column, anchors: Column, priority: Column) -> Column:
    """Declared rules replace the kind's own ones altogether."""
    given = F.transform(triggers, lambda t: t.cast(_TRIGGER))
    return F.when(F.size(triggers) > 0, given).otherwise(default_triggers(kind, anchors, priority))


def invalid_triggers(notes: DataFrame) -> DataFrame:
    """(note_id, pos, problem) of declared rules without an axis, with an unknown event or a negative cooldown."""
    t = notes.select("note_id", F.posexplode("triggers").alias("pos", "t"))
    empty = F.col("t.path").isNull() & F.col("t.event").isNull() & F.col("t.symbol").isNull() & F.col("t.command").isNull() & ~F.coalesce("t.semantic", F.lit(False))
    problem = F.when(empty, "no axis").when(F.col("t.event").isNotNull() & ~F.col("t.event").isin(EVENTS), "unknown event").when(F.col("t.cooldown") < 0, "negative cooldown")
    return t.select("note_id", "pos", problem.alias("problem")).filter("problem is not null")


def scope_permits(path: Column) -> Column:
    """Whether a note's scope lets a moment (columns prefixed m_) see it."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^[./]+", "")
    inside = lambda a: (plain(path) == plain(a["path"])) | (
        F.contains(plain(a["path"]), F.lit("/")) & plain(path).startswith(F.concat(F.regexp_replace(plain(a["path"]), r"/[^/]*$", ""), F.lit("/")))
    )
    scope = F.coalesce("scope", F.lit("workspace"))
    return F.coalesce(
        F.when(scope == "session", F.col("session_id") == F.col("m_session_id"))
        .when(scope == "branch", F.col("branch") == F.col("m_branch"))
        .when(scope == "path-subtree", F.exists("anchors", inside))
        .otherwise(F.lit(True)),
        F.lit(False),
    )


def fire(notes: DataFrame, events: DataFrame, moments: DataFrame, symbols: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """(moment_id, note_id, trigger_index, faded): the first rule of each live note that a moment satisfies.

    All axes that a rule names must match: path glob against the moment's path as given and below its workspace, event,
    symbol among those of symbols(moment_id, names), semantic if semantic(moment_id, note_id) holds a row, command glob
    against the verb. not_before and cooldown hold a rule back, expires_visibility only marks it faded.
    """
    rows = live(notes).join(fold_states(events).filter("state in ('expired', 'revoked')").select("note_id"), "note_id", "left_anti")
    m = moments.select(*[F.col(c).alias(f"m_{c}") for c in ("moment_id", "workspace", "event", "file_path", "command_verb", "session_id", "branch", "ts")])
    if symbols is not None:
        m = m.join(symbols.select(F.col("moment_id").alias("m_moment_id"), F.col("names").alias("m_names")), "m_moment_id", "left")
    else:
        m = m.withColumn("m_names", F.lit(None).cast("array<string>"))
    root = F.concat(F.col("m_workspace"), F.lit("/"))
    m = m.withColumn("m_below", F.when(F.col("m_file_path").startswith(root), F.substring("m_file_path", F.length(root) + 1, F.length("m_file_path"))).otherwise(F.col("m_file_path")))
    rules = effective_triggers(F.col("triggers"), F.col("kind"), F.col("anchors"), F.col("priority"))
    rows = rows.select("note_id", "workspace", "scope", "branch", "session_id", "anchors", "last_fired", F.posexplode(rules).alias("_at", "_t"))
    exact = F.coalesce(~F.col("_t.path").rlike(r"[*?]"), F.lit(False))
    forms = m.withColumn("m_form", F.explode(F.array_distinct(F.array("m_file_path", "m_below"))))
    here = F.col("workspace") == F.col("m_workspace")
    pairs = rows.filter(exact).join(forms, here & (F.col("_t.path") == F.col("m_form"))).drop("m_form")
    pairs = pairs.unionByName(rows.filter(~exact & F.col("_t.event").isNotNull()).join(m, here & (F.col("_t.event") == F.col("m_event"))))
    pairs = pairs.unionByName(rows.filter(~exact & F.col("_t.event").isNull()).join(m, here))
    if semantic is not None:
        hit = semantic.select(F.col("moment_id").alias("m_moment_id"), "note_id", F.lit(True).alias("m_semantic"))
        pairs = pairs.join(hit, ["m_moment_id", "note_id"], "left")
    else:
        pairs = pairs.withColumn("m_semantic", F.lit(None).cast("boolean"))
    below = F.col("m_below")

    def holds(t: Column) -> Column:
        none = t["path"].isNull() & t["event"].isNull() & t["symbol"].isNull() & ~F.coalesce(t["semantic"], F.lit(False)) & t["command"].isNull()
        glob = glob_column(t["path"])
        path = t["path"].isNull() | F.coalesce(F.regexp_like("m_file_path", glob) | F.regexp_like(below, glob), F.lit(False))
        event = t["event"].isNull() | F.coalesce(t["event"] == F.col("m_event"), F.lit(False))
        symbol = t["symbol"].isNull() | F.coalesce(F.array_contains("m_names", t["symbol"]), F.lit(False))
        meaning = ~F.coalesce(t["semantic"], F.lit(False)) | F.coalesce("m_semantic", F.lit(False))
        command = t["command"].isNull() | F.coalesce(F.regexp_like("m_command_verb", glob_column(t["command"])), F.lit(False))
        begun = t["not_before"].isNull() | (F.col("m_ts") >= t["not_before"])
        rested = t["cooldown"].isNull() | F.col("last_fired").isNull() | (F.col("m_ts") - F.col("last_fired") >= t["cooldown"])
        return ~none & path & event & symbol & meaning & command & begun & rested

    pairs = pairs.filter(scope_permits(F.coalesce(below, F.lit(""))) & holds(F.col("_t")))
    faded = F.coalesce(F.col("m_ts") >= F.col("_t.expires_visibility"), F.lit(False))
    first = pairs.groupBy(F.col("m_moment_id").alias("moment_id"), "note_id").agg(F.min(F.struct("_at", faded.alias("faded"))).alias("_f"))
    return first.select("moment_id", "note_id", F.col("_f._at").alias("trigger_index"), "_f.faded")


def semantic_matches(scores: DataFrame, notes: DataFrame) -> DataFrame:
    """(moment_id, note_id) of scores(moment_id, note_id, score) over the threshold of the note's kind; kinds without one never match."""
    theta = F.create_map(*[F.lit(x) for kv in THETA.items() for x in kv])[F.coalesce("kind", F.lit(""))]
    return scores.join(live(notes).select("note_id", "kind"), "note_id").filter(F.col("score") >= theta).select("moment_id", "note_id")


def total_order() -> list[Column]:
    """Kind, priority, last use (for tasks the newest note), id."""
    rank = lambda names, c: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)), F.lit(0)), F.lit(len(names) + 1))
    task = F.coalesce(F.col("kind") == "task", F.lit(False))
    used = F.when(task, 0.0).otherwise(F.coalesce("last_fired", "last_accessed", F.lit(0.0)))
    return [rank(KIND_ORDER, "kind").asc(), rank(PRIORITY_ORDER, "priority").asc(), used.desc(), F.when(task, -F.col("note_id")).otherwise(F.col("note_id")).asc()]


def pack(items: DataFrame, group: str, budget: int = PER_SESSION) -> DataFrame:
    """(group, note_id, place, tier, tokens, text): notes packed in total order into each group's budget.

    items: group, the note's columns, full_text and index_text. Full-text kinds are trimmed to their kind's cap, others give
    their index line. What does not fit is tried as its index line; the first that does not fit then ends the packing.
    """
    full = F.coalesce(F.col("kind").isin(FULL_TEXT_KINDS), F.lit(False))
    trimmed = F.col("full_text")
    for kind, cap in PER_KIND.items():
        trimmed = F.when(F.col("kind") == kind, trim_to_cap(F.col("full_text"), cap)).otherwise(trimmed)
    rows = items.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*total_order())))
    rows = rows.withColumn("_full", F.when(full, trimmed)).select(group, "note_id", "place", "_full", "index_text")
    rows = rows.withColumn("_n1", F.when(F.col("_full").isNotNull(), token_estimate(F.col("_full")))).withColumn("_n0", token_estimate(F.col("index_text")))
    # every item takes a token at least, so no more than `budget` items can be packed: the list stays bounded
    rows = rows.filter(F.col("place") <= budget)
    packed = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("place", "note_id", "_n1", "_n0"))).alias("_l"))
    state = F.struct(F.lit(budget).alias("left"), F.lit(False).alias("done"), F.array().cast("array<struct<place:int,note_id:bigint,tier:string,tokens:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        tier = F.when(x["_n1"].isNotNull() & (x["_n1"] <= s["left"]), "full").when(x["_n0"] <= s["left"], "index")
        tokens = F.when(tier == "full", x["_n1"]).otherwise(x["_n0"])
        stop = s["done"] | tier.isNull()
        item = F.struct(x["place"].cast("int").alias("place"), x["note_id"].cast("bigint").alias("note_id"), tier.alias("tier"), tokens.cast("int").alias("tokens"))
        return F.struct(F.when(stop, s["left"]).otherwise(s["left"] - tokens).cast("int").alias("left"), stop.alias("done"), F.when(stop, s["out"]).otherwise(F.concat(s["out"], F.array(item))).alias("out"))

    out = packed.select(group, F.explode(F.aggregate("_l", state, step)["out"]).alias("p")).select(group, "p.*")
    texts = rows.select(group, "note_id", "_full", "index_text")
    return out.join(texts, [group, "note_id"]).select(group, "note_id", "place", "tier", "tokens", F.when(F.col("tier") == "full", F.col("_full")).otherwise(F.col("index_text")).alias("text"))


def gate(candidates: DataFrame, seen: DataFrame | None = None, structural_only: bool = False) -> DataFrame:
    """(session_id, anchor_id, place, score): what is injected of candidates(session_id, anchor_id, score, provenance_rank, line, is_structural, tier).

    The best candidate of each anchor, over the floor, not among the session's last anchors seen(session_id, anchor_id); then by
    score at most three items and 800 characters: a second mere mention is skipped, the first line that does not fit ends it.
    """
    best = Window.partitionBy("session_id", "anchor_id").orderBy(F.desc("score"), "provenance_rank", "line")
    rows = candidates.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == 1).filter(F.col("score") >= GATE_LEAST)
    if structural_only:
        rows = rows.filter("is_structural")
    if seen is not None:
        rows = rows.join(seen.select("session_id", "anchor_id"), ["session_id", "anchor_id"], "left_anti")
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), "provenance_rank", "anchor_id")
    weak = F.coalesce(F.col("tier") == "mention", F.lit(False)).cast("int")
    rows = rows.withColumn("_weak", weak).withColumn("_w", F.sum("_weak").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a mention after the first is skipped, so it neither counts nor stops
    rows = rows.filter((F.col("_weak") == 0) | (F.col("_w") <= GATE_WEAK)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= GATE_ITEMS)
    size = F.sum(F.length("line")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("place") - 1
    return rows.withColumn("_size", size).filter(F.col("_size") <= GATE_CHARS).select("session_id", "anchor_id", "place", "score")


def ring(injected: DataFrame, n: int = GATE_RING) -> DataFrame:
    """The last n anchors of each session, of injected(session_id, anchor_id, seq)."""
    last = injected.groupBy("session_id", "anchor_id").agg(F.max("seq").alias("seq"))
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"), "anchor_id")
    return last.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def first_relation(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(note_id, file_path, relation): each note's strongest relation to one of files(pos, file_path): anchor, trigger, then mention."""
    f = F.col("file_path")
    name = F.element_at(F.split(f, "/"), -1)
    anchor = F.exists("anchors", lambda a: a["path"] == f)
    trigger = F.exists("triggers", lambda t: t["path"].isNotNull() & F.regexp_like(f, glob_column(t["path"])))
    mention = F.regexp_like(F.coalesce("content", F.lit("")), F.concat(F.lit(r"(?<![\w])\Q"), name, F.lit(r"\E(?![\w])")))
    rank = F.when(F.coalesce(anchor, F.lit(False)), 0).when(F.coalesce(trigger, F.lit(False)), 1).when(mention, 2)
    rows = live(notes).select("note_id", "content", "anchors", "triggers").crossJoin(F.broadcast(files)).withColumn("_rank", rank).filter("_rank is not null")  # a window's files: a handful
    best = rows.groupBy("note_id").agg(F.min(F.struct("_rank", "pos", "file_path")).alias("m"))
    return best.select("note_id", "m.file_path", F.element_at(F.array(F.lit("anchor"), F.lit("trigger"), F.lit("mention")), F.col("m._rank") + 1).alias("relation"))


def _ledger(session_budget: int, turn_budget: int, cooldown: int):
    def run(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fired, spent, turn, turn_spent, turn_notes = state.get if state.exists else ("", 0, 0, 0, "")
        last = dict(tuple(map(int, x.split(":"))) for x in fired.split(",") if x)
        in_turn = {int(x) for x in turn_notes.split(",") if x}
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples(index=False):
            if r.event == "prompt-submit":
                turn, turn_spent, in_turn = turn + 1, 0, set()
            if r.event == "post-compaction":
                last, spent = {}, 0
            if pd.isna(r.note_id):
                continue
            note, tokens = int(r.note_id), int(r.tokens)
            rested = note not in last or (bool(r.semantic) and turn - last[note] >= cooldown)
            if note in in_turn or not rested or spent + tokens > session_budget or turn_spent + tokens > turn_budget:
                continue
            last[note] = turn
            in_turn.add(note)
            spent, turn_spent = spent + tokens, turn_spent + tokens
            out.append((key[0], int(r.seq), note, turn, spent))
        state.update((",".join(f"{k}:{v}" for k, v in last.items()), spent, turn, turn_spent, ",".join(map(str, in_turn))))
        yield pd.DataFrame(out, columns=["session_id", "seq", "note_id", "turn", "spent"])

    return run


LEDGER_OUT = "session_id string, seq long, note_id long, turn int, spent int"
LEDGER_STATE = "fired string, spent int, turn int, turn_spent int, turn_notes string"


class _Memory:
    """The state of one key in a batch."""

    exists = False
    get = ()

    def update(self, value: tuple) -> None:
        self.get, self.exists = value, True


def deliver(notes: DataFrame, events: DataFrame, moments: DataFrame, tokens: int = 120, budget: int = PER_SESSION) -> DataFrame:
    """(session_id, note_id, place, tier, tokens): what sessions get of the notes that their moments fire: each once, within the ledger's budgets, packed in order.

    Only what is delivered is charged to a session's ledger; a note's tokens are estimated at `tokens` there.
    """
    at = moments.select("moment_id", "session_id", "ts", "event").filter("session_id is not null")
    fired = fire(notes, events, moments).filter("not faded").join(at, "moment_id")
    fires = fired.select("session_id", F.xxhash64("moment_id", "note_id").alias("seq"), "ts", "event", "note_id", F.lit(tokens).alias("tokens"), F.lit(False).alias("semantic"))
    got = ledger(fires, budget).select(F.col("session_id").alias("to_session"), "note_id").distinct()
    items = got.join(live(notes), "note_id").withColumn("full_text", F.coalesce("content", F.lit(""))).withColumn("index_text", F.concat(F.lit("["), F.col("note_id").cast("string"), F.lit("] "), F.coalesce("title", F.lit(""))))
    return pack(items, "to_session", budget).select(F.col("to_session").alias("session_id"), "note_id", "place", "tier", "tokens")


def ledger(fires: DataFrame, session_budget: int = PER_SESSION, turn_budget: int = PER_TURN, cooldown: int = COOLDOWN_TURNS) -> DataFrame:
    """(session_id, seq, note_id, turn, spent) of the fires(session_id, seq, ts, event, note_id, tokens, semantic) that are delivered.

    A note is delivered once a session, a semantic one again after ten turns, each within the session's and the turn's
    budget; a prompt begins a turn, a compaction the session's ledger. Rows without a note only mark events.
    """
    run = _ledger(session_budget, turn_budget, cooldown)

    def batch(key, rows: pd.DataFrame) -> pd.DataFrame:
        return next(run(key, iter([rows]), _Memory()))

    return fires.groupBy("session_id").applyInPandas(batch, LEDGER_OUT)
