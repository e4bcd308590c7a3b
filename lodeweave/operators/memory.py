"""Working memory: bi-temporal notes, their lifecycle log, recall, decay, staleness, snapshots.

Notes and events are append-only tables; every change is rows to append. `now` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.text import boundary_match, date_text, glob_column, title_tokens
from lodeweave.functions.vectors import cosine, vector

# Half-lives and times to live in days by kind (None: exempt), limits of the floors and pools.
HALF_LIFE = {"directive": None, "operational": 14, "task": 21, "gotcha": 30, "finding": 30, "reference": 45, "decision": 60}
TTL = {"directive": None, "operational": 60, "task": 90, "gotcha": 120, "finding": 120, "reference": 180, "decision": 240}
STATES = {"created": "active", "reinstated": "active", "superseded": "superseded", "revoked": "revoked", "expired": "expired"}
FLOOR_SHARE, FLOOR_LEAST, FLOOR_MOST, FLOOR_POOL = 0.2, 2, 5, 2000
RELATED_LIMIT, RELATED_LEAST = 3, 0.75
BOOT_DIRECTIVES, BOOT_TASKS, RESUME_GOTCHAS, SNAPSHOT_NOTES = 100, 5, 5, 100
LADDER = ["auto", "agent", "user"]
DAY = 86400.0


def unique_notes(notes: DataFrame) -> DataFrame:
    """Notes without repeated rows (same note_id)."""
    return notes.dropDuplicates(["note_id"])


def _by_kind(days: dict, kind: Column) -> Column:
    known = [x for k, v in days.items() if v is not None for x in (F.lit(k), F.lit(float(v)))]
    return F.create_map(*known)[F.coalesce(kind, F.lit(""))]


def fold_states(events: DataFrame) -> DataFrame:
    """(note_id, state, reason, actor, since): the last state-changing event of each note by id, not by time."""
    named = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.coalesce("event", F.lit(""))]
    rows = events.withColumn("_state", named).filter("_state is not null and note_id is not null")
    last = F.max_by(F.struct(F.col("_state").alias("state"), "reason", "actor", F.col("ts").alias("since")), "id")
    return rows.groupBy("note_id").agg(last.alias("r")).select("note_id", "r.*")


def without_expired(notes: DataFrame, events: DataFrame) -> DataFrame:
    return notes.join(fold_states(events).filter("state = 'expired'").select("note_id"), "note_id", "left_anti")


def in_session(session_id: str | None) -> Column:
    """Notes of the scope session only for the session that wrote them."""
    mine = F.col("session_id") == session_id if session_id else F.lit(False)
    return F.coalesce((F.coalesce("scope", F.lit("workspace")) != "session") | mine, F.lit(False))


def _order(sort_by: str) -> list[Column]:
    created, note = F.col("created_at"), F.col("note_id")
    if sort_by == "recency":
        return [created.desc_nulls_last(), note.desc()]
    if sort_by == "priority":
        rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
        return [rank.asc(), created.desc_nulls_last(), note.desc()]
    if sort_by == "chronological":
        return [created.asc_nulls_last(), note.asc()]
    task = F.coalesce(F.col("kind") == "task", F.lit(False))
    trust = F.when(task, 1.0).otherwise(F.col("author_trust_score"))
    decay = F.when(task, 1.0).otherwise(F.col("decay_score"))
    return [trust.desc_nulls_last(), decay.desc_nulls_last(), created.desc_nulls_last(), note.desc()]


def live(notes: DataFrame, workspace: str | None = None, superseded: bool = False) -> DataFrame:
    rows = notes if workspace is None else notes.filter(F.col("workspace") == workspace)
    # filters go first: rows of one note agree in all columns, and none but those asked for are shuffled
    return unique_notes(rows if superseded else rows.filter("valid_until is null"))


def recall(notes: DataFrame, events: DataFrame, workspace: str, now: float, query: str | None = None, tags: list[str] | None = None, priority: str | None = None, kind: str | None = None, limit: int = 10, sort_by: str = "relevance", max_age_days: float | None = None, superseded: bool = False, session_id: str | None = None) -> DataFrame:
    """The best `limit` notes of a workspace with the asked properties; tags match if one does, the query is a substring.

    All filters come before the limit, so a recall never has fewer rows than there are.
    """
    rows = live(notes, workspace, superseded)
    if priority:
        rows = rows.filter(F.col("priority") == priority)
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if tags:
        rows = rows.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if query:
        rows = rows.filter(F.col("content").ilike(f"%{query}%"))
    if max_age_days is not None:
        rows = rows.filter(F.col("created_at") >= now - max_age_days * DAY)
    rows = without_expired(rows.filter(in_session(session_id)), events)
    return rows.orderBy(*_order(sort_by)).limit(limit)


def semantic_recall(notes: DataFrame, events: DataFrame, vectors: DataFrame, workspace: str, query_vector, limit: int = 10, least: float = 0.0, session_id: str | None = None) -> DataFrame:
    """Live notes by cosine of their vectors(note_id, embedding) to the query's; score is added. Exact, filters first."""
    rows = without_expired(live(notes, workspace).filter(in_session(session_id)), events)
    near = vectors.select("note_id", F.round(cosine(F.col("embedding"), vector(query_vector)), 9).alias("score")).filter(F.col("score") >= least)
    return rows.join(near, "note_id").orderBy(F.desc("score"), F.desc("note_id")).limit(limit)


def floor_cap(limit: int) -> int:
    """How many pinned notes a recall of `limit` begins with."""
    share = int(limit * FLOOR_SHARE)
    return min(FLOOR_MOST, max(max(1, min(FLOOR_LEAST, share)), share))


def recall_with_floor(notes: DataFrame, events: DataFrame, workspace: str, now: float, limit: int = 10, **filters) -> DataFrame:
    """(note_id, place): pinned notes first, newest first up to floor_cap, then ranked ones, each note once, `limit` in all."""
    ranked = recall(notes, events, workspace, now, limit=limit, **filters)
    pinned = without_expired(live(notes, workspace).filter("pinned").filter(in_session(filters.get("session_id"))), events)
    pinned = pinned.orderBy(F.col("created_at").desc_nulls_last(), F.desc("note_id")).limit(floor_cap(limit))
    one = Window.partitionBy(F.lit(1))  # pages of at most `limit` rows
    a = pinned.select("note_id", F.lit(0).alias("_block"), F.row_number().over(one.orderBy(F.col("created_at").desc_nulls_last(), F.desc("note_id"))).alias("_at"))
    b = ranked.select("note_id", F.lit(1).alias("_block"), F.row_number().over(one.orderBy(*_order(filters.get("sort_by", "relevance")))).alias("_at"))
    first = a.unionByName(b).groupBy("note_id").agg(F.min(F.struct("_block", "_at")).alias("_p"))
    return first.select("note_id", F.row_number().over(one.orderBy("_p")).alias("place")).filter(F.col("place") <= limit)


def metadata_match(notes: DataFrame, query: str) -> DataFrame:
    """(note_id, fields, length): how many declared fields (title words, tags, anchor paths) a query names, and the longest name."""
    text = F.lit(query.lower())
    words = title_tokens(text)
    none = F.array().cast("array<string>")
    titles = F.array_intersect(title_tokens(F.coalesce("title", F.lit(""))), words)
    tags = F.filter(F.coalesce("tags", none), lambda t: text.contains(F.lower(t)))
    anchors = F.filter(F.coalesce(F.transform("anchors", lambda a: a["path"]), none), lambda p: text.contains(F.lower(p)))
    longest = F.array_max(F.transform(F.concat(titles, tags, anchors), lambda x: F.length(x)))
    fields = (F.size(titles) > 0).cast("int") + (F.size(tags) > 0).cast("int") + (F.size(anchors) > 0).cast("int")
    return unique_notes(notes).select("note_id", fields.alias("fields"), F.coalesce(longest, F.lit(0)).alias("length")).filter("fields > 0")


def recall_for_path(notes: DataFrame, events: DataFrame, workspace: str, path: str, limit: int = 10, kind: str | None = None, session_id: str | None = None) -> DataFrame:
    """Notes about a file with their tier: 0 it is an anchor, 1 a trigger's glob matches, 2 it is named in the text; then by rank."""
    name = path.rpartition("/")[2]
    relative = path[len(workspace) + 1 :] if path.startswith(workspace + "/") else path
    forms = F.array(*[F.lit(p) for p in dict.fromkeys([path, relative])])
    rows = live(notes, workspace).filter(in_session(session_id))
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    anchored = F.arrays_overlap(F.transform("anchors", lambda a: a["path"]), forms)
    matches = lambda t: t["path"].isNotNull() & F.exists(forms, lambda f: F.regexp_like(f, glob_column(t["path"])))
    content = F.coalesce("content", F.lit(""))
    tier = F.when(F.coalesce(anchored, F.lit(False)), 0).when(F.coalesce(F.exists("triggers", matches), F.lit(False)), 1).when(boundary_match(content, F.lit(name)) | boundary_match(content, F.lit(relative)), 2)
    rows = without_expired(rows.withColumn("tier", tier).filter("tier is not null"), events)
    return rows.orderBy("tier", *_order("relevance")).limit(limit)


def boot_set(notes: DataFrame, events: DataFrame, workspace: str) -> DataFrame:
    """(block, note_id, ...): all directives, oldest first, then the newest tasks of high priority."""
    rows = without_expired(live(notes, workspace), events)
    a = rows.filter("kind = 'directive'").orderBy(F.asc("created_at"), "note_id").limit(BOOT_DIRECTIVES).withColumn("block", F.lit(0))
    b = rows.filter("kind = 'task' and priority = 'high'").orderBy(F.desc("created_at"), F.desc("note_id")).limit(BOOT_TASKS).withColumn("block", F.lit(1))
    return a.unionByName(b)


def resume(notes: DataFrame, events: DataFrame, workspace: str, gotchas: int = RESUME_GOTCHAS) -> DataFrame:
    """(part, note_id, truncated): the last task and the newest gotchas; truncated tells that there are more of these."""
    rows = without_expired(live(notes, workspace), events)
    newest = [F.desc("created_at"), F.desc("note_id")]
    task = rows.filter("kind = 'task'").orderBy(*newest).limit(1).select(F.lit("task").alias("part"), "note_id", F.lit(False).alias("truncated"))
    some = rows.filter("kind = 'gotcha'").orderBy(*newest).limit(gotchas + 1)
    one = Window.partitionBy(F.lit(1))
    some = some.withColumn("_r", F.row_number().over(one.orderBy(*newest))).withColumn("truncated", F.count(F.lit(1)).over(one) > gotchas)
    return task.unionByName(some.filter(F.col("_r") <= gotchas).select(F.lit("gotcha").alias("part"), "note_id", "truncated"))


def decay(notes: DataFrame, now: float, half_life: dict = HALF_LIFE) -> DataFrame:
    """(note_id, decay_score): 0.5 ^ (age / half-life of the kind); 1 for notes of the future, unchanged for exempt kinds."""
    life = _by_kind(half_life, F.col("kind")) * DAY
    age = now - F.col("created_at")
    fresh = F.when(age <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age / life))
    return unique_notes(notes).select("note_id", F.when(life.isNull() | age.isNull(), F.col("decay_score")).otherwise(fresh).alias("decay_score"))


def expirations(notes: DataFrame, events: DataFrame, now: float, ttl: dict = TTL) -> DataFrame:
    """Events to append: notes past the time to live of their kind that are neither expired nor revoked nor superseded yet."""
    limit = _by_kind(ttl, F.col("kind")) * DAY
    rows = live(notes).filter(limit.isNotNull() & (now - F.col("created_at") > limit))
    done = fold_states(events).filter("state in ('expired', 'revoked')").select("note_id")
    rows = rows.join(done, "note_id", "left_anti")
    return rows.select("workspace", "note_id", F.lit("expired").alias("event"), F.lit("system").alias("actor"), F.lit("ttl").alias("reason"), F.lit(now).alias("ts"))


def stale_tasks(notes: DataFrame, now: float, days: float = 7) -> DataFrame:
    """(workspace, stale, oldest): live task notes older than `days`, and the oldest of them."""
    rows = live(notes).filter((F.col("kind") == "task") & (F.col("created_at") < now - days * DAY))
    return rows.groupBy("workspace").agg(F.count(F.lit(1)).alias("stale"), F.min_by("note_id", F.struct("created_at", "note_id")).alias("oldest"))


def append_event(notes: DataFrame, ids: list[int], event: str, actor: str, now: float, reason: str | None = None) -> DataFrame:
    """Events revoked, reinstated, superseded and the like, for those of the notes that there are."""
    rows = unique_notes(notes).filter(F.col("note_id").isin(ids))
    return rows.select("workspace", "note_id", F.lit(event).alias("event"), F.lit(actor).alias("actor"), F.lit(reason).cast("string").alias("reason"), F.lit(None).cast("string").alias("payload"), F.lit(now).alias("ts"))


def remember(notes: DataFrame, new: DataFrame) -> DataFrame:
    """notes with new ones; a note named in a new one's supersedes ends when that one begins."""
    ends = new.filter("supersedes is not null").groupBy(F.col("supersedes").alias("note_id")).agg(F.min_by(F.struct(F.col("created_at").alias("_end"), F.col("note_id").alias("_by")), "created_at").alias("_e"))
    old = unique_notes(notes).join(ends, "note_id", "left")
    old = old.withColumn("valid_until", F.coalesce("valid_until", "_e._end")).withColumn("superseded_by_note_id", F.coalesce("superseded_by_note_id", "_e._by")).drop("_e")
    return old.select(notes.columns).unionByName(new.select(notes.columns))


def promote(notes: DataFrame, note_id: int, to: str) -> DataFrame:
    """notes with one note's provenance a single step higher; other steps leave it as it is."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LADDER]), F.col("provenance"))
    ok = (F.col("note_id") == note_id) & (rank + 1 == LADDER.index(to) + 1)
    return notes.withColumn("provenance", F.when(ok, F.lit(to)).otherwise(F.col("provenance")))


def update_fields(notes: DataFrame, note_id: int, **fields) -> DataFrame:
    """notes with fields of one note set: kind, priority, pinned and the like."""
    for name, value in fields.items():
        notes = notes.withColumn(name, F.when(F.col("note_id") == note_id, F.lit(value)).otherwise(F.col(name)))
    return notes


def forget(table: DataFrame, ids: list[int] | None = None, workspace: str | None = None) -> DataFrame:
    """A table of notes, events or vectors without the given notes, or without a workspace, or empty."""
    if ids is not None:
        return table.filter(~F.coalesce(F.col("note_id").isin(ids), F.lit(False)))
    return table.limit(0) if workspace is None else table.filter(~F.col("workspace").eqNullSafe(workspace))


def get_note(notes: DataFrame, workspace: str, note_id: int) -> DataFrame:
    return unique_notes(notes.filter((F.col("workspace") == workspace) & (F.col("note_id") == note_id)))


def note_counts(notes: DataFrame) -> DataFrame:
    """(workspace, notes, live)."""
    return unique_notes(notes).groupBy("workspace").agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("valid_until").isNull()).alias("live"))


def author_trust(notes: DataFrame) -> DataFrame:
    """(author_id, notes, trust): each further note adds 0.05 to a trust that is 1 at most."""
    per = unique_notes(notes).filter("author_id is not null").groupBy("author_id").agg(F.count(F.lit(1)).alias("notes"), F.min("author_trust_score").alias("_base"))
    return per.select("author_id", "notes", F.least(F.lit(1.0), F.col("_base") + 0.05 * (F.col("notes") - 1)).alias("trust"))


def snapshot(notes: DataFrame, events: DataFrame, workspace: str, label: str, now: float) -> DataFrame:
    """One row (workspace, label, created_at, payload): up to 100 live notes as JSON, the best first."""
    rows = without_expired(live(notes, workspace), events).orderBy(*_order("relevance")).limit(SNAPSHOT_NOTES)
    one = Window.partitionBy(F.lit(1)).orderBy(*_order("relevance"))
    rows = rows.select(F.row_number().over(one).alias("place"), "note_id", "kind", "title", "content")
    packed = F.to_json(F.sort_array(F.collect_list(F.struct("place", "note_id", "kind", "title", "content"))))
    return rows.agg(packed.alias("payload")).select(F.lit(workspace).alias("workspace"), F.lit(label).alias("label"), F.lit(now).alias("created_at"), "payload")


def restore_snapshot(snapshots: DataFrame) -> DataFrame:
    """(label, place, note_id, kind, title, content) of stored snapshots."""
    schema = "array<struct<place:int,note_id:bigint,kind:string,title:string,content:string>>"
    return snapshots.select("label", F.explode(F.from_json("payload", schema)).alias("n")).select("label", "n.*")


def staleness(notes: DataFrame, files: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """(note_id, reasons): anchors whose file is gone or changed, and superseded notes. files: (workspace, path, hash)."""
    rows = unique_notes(notes).select("note_id", "workspace", "valid_until", F.explode_outer("anchors").alias("a"))
    known = files.select(F.col("workspace").alias("_w"), F.col("path").alias("_p"), F.col("hash").alias("_h"))
    full = F.concat_ws("/", "workspace", "a.path")
    rows = rows.join(known, (F.col("_w") == F.col("workspace")) & (F.col("_p") == full), "left")
    why = F.when(F.col("a.path").isNotNull() & F.col("_p").isNull(), F.concat(F.lit("missing:"), F.col("a.path"))).when((F.col("a.hash") != "") & (F.col("_h") != F.col("a.hash")), F.concat(F.lit("changed:"), F.col("a.path")))
    per = rows.groupBy("note_id").agg(F.collect_set(why).alias("_r"), F.max("valid_until").alias("_v"))
    reasons = F.array_sort(F.concat("_r", F.when(F.col("_v").isNotNull(), F.array(F.lit("superseded"))).otherwise(F.array().cast("array<string>"))))
    return per.select("note_id", reasons.alias("reasons")).filter("size(reasons) > 0")


def latest_payload(events: DataFrame, event: str) -> DataFrame:
    """(note_id, payload) of each note's last event of a kind, by id."""
    return events.filter(F.col("event") == event).groupBy("note_id").agg(F.max_by("payload", "id").alias("payload"))


def related(vectors: DataFrame, events: DataFrame, note_id: int, state: str = "active", limit: int = RELATED_LIMIT, least: float = RELATED_LEAST) -> DataFrame:
    """(note_id, score): the notes of a state nearest to one note by cosine."""
    me = vectors.filter(F.col("note_id") == note_id).select(F.col("embedding").alias("_me")).limit(1)
    others = vectors.filter(F.col("note_id") != note_id).join(fold_states(events).filter(F.col("state") == state).select("note_id"), "note_id", "left_semi")
    scored = others.crossJoin(F.broadcast(me)).select("note_id", F.round(cosine(F.col("embedding"), F.col("_me")), 9).alias("score"))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "note_id").limit(limit)


def missing_vectors(notes: DataFrame, vectors: DataFrame) -> DataFrame:
    return unique_notes(notes).join(vectors.select("note_id"), "note_id", "left_anti").select("note_id", "content")


def eviction_groups(chunks: DataFrame) -> DataFrame:
    """(file_path, ranges): retrieved chunks by file with their line ranges in order."""
    ranges = F.transform(F.sort_array(F.collect_set(F.struct("start_line", "end_line"))), lambda r: F.concat(r["start_line"].cast("string"), F.lit("-"), r["end_line"].cast("string")))
    return chunks.groupBy("file_path").agg(F.array_join(ranges, ", ").alias("ranges"))


def export_markdown(notes: DataFrame, events: DataFrame, workspace: str) -> DataFrame:
    """(kind, body): live notes of a workspace as one block of Markdown a kind, oldest first."""
    rows = without_expired(live(notes, workspace), events)
    head = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.regexp_extract(F.coalesce("content", F.lit("")), r"^([^\n]*)", 1))
    line = F.concat(F.lit("## ["), F.col("note_id").cast("string"), F.lit("] "), head, F.lit("\n"), F.concat_ws(" ", "priority", date_text(F.col("created_at"))), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    rows = rows.groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("created_at", F.lit(0.0)).alias("t"), "note_id", line.alias("x")))).alias("_n"))
    return rows.select("kind", F.concat(F.lit("# "), F.col("kind"), F.lit("\n\n"), F.array_join(F.transform("_n", lambda n: n["x"]), "\n")).alias("body"))


def parse_markdown(exported: DataFrame) -> DataFrame:
    """(note_id, kind, content) read back from export_markdown, also after editing."""
    blocks = F.split("body", r"(?m)^## \[")
    rows = exported.select("kind", F.explode(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(1)))).alias("_b"))
    return rows.select(F.regexp_extract("_b", r"^(\d+)\]", 1).try_cast("long").alias("note_id"), "kind", F.regexp_replace(F.regexp_extract("_b", r"(?s)^[^\n]*\n[^\n]*\n\n(.*)$", 1), r"\n+$", "").alias("content")).filter("note_id is not null")


def edit_plan(before: DataFrame, after: DataFrame, forgotten: DataFrame | None = None) -> DataFrame:
    """(note_id, operation) between two (note_id, kind, content) tables: remember, supersede, field_update, revoke, or forget for those of forgotten(note_id)."""
    a, b = before.select("note_id", F.col("kind").alias("k0"), F.col("content").alias("c0"), F.lit(1).alias("_a")), after.select("note_id", F.col("kind").alias("k1"), F.col("content").alias("c1"), F.lit(1).alias("_b"))
    op = F.when(F.col("_a").isNull(), "remember").when(F.col("_b").isNull(), "revoke").when(~F.col("c0").eqNullSafe(F.col("c1")), "supersede").when(~F.col("k0").eqNullSafe(F.col("k1")), "field_update")
    plan = a.join(b, "note_id", "full").select("note_id", op.alias("operation")).filter("operation is not null")
    if forgotten is None:
        return plan
    marked = forgotten.select("note_id", F.lit(True).alias("_f")).distinct()
    return plan.join(marked, "note_id", "left").select("note_id", F.when((F.col("operation") == "revoke") & F.coalesce("_f", F.lit(False)), "forget").otherwise(F.col("operation")).alias("operation"))


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots, the newest first."""
    return snapshots.orderBy(F.desc("created_at"), "workspace", "label")


def bind_quote(content: Column, quote: Column, least: int = 12) -> Column:
    """Whether a quote of at least `least` characters stands in a text, white space aside."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.coalesce((F.length(flat(quote)) >= least) & flat(content).contains(flat(quote)), F.lit(False))
