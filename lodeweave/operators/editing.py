"""Writing notes: what may be kept of a new one, where they come from, edits of an exported buffer, and which recall a request is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.vectors import cosine, vector
from lodeweave.operators import memory

# What a note may be.
KINDS = ["directive", "gotcha", "operational", "task", "finding", "reference", "decision", "convention", "preference"]
PRIORITIES = ["high", "medium", "low"]
SCOPES = ["workspace", "repo", "branch", "session", "path-subtree"]
MOST_CHARS, TITLE_CHARS, COMMIT_FILES = 20_000, 80, 10


def problems(new: DataFrame) -> DataFrame:
    """(note_id, problem) of notes that are not to be kept: blank or too long, or of an unknown kind, priority or scope."""
    known = lambda c, values: F.col(c).isNull() | F.col(c).isin(values)
    problem = (
        F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "no content")
        .when(F.length("content") > MOST_CHARS, "too long")
        .when(~known("kind", KINDS), "unknown kind")
        .when(~known("priority", PRIORITIES), "unknown priority")
        .when(~known("scope", SCOPES), "unknown scope")
    )
    return new.select("note_id", problem.alias("problem")).filter("problem is not null")


def prepared(new: DataFrame, files: DataFrame) -> DataFrame:
    """The notes that may be kept, with what they leave out: title, priority, scope, and the hashes of their anchors' files.

    A quote that does not stand in the content is dropped; an anchor whose file is unknown keeps no hash. files: (workspace, path, hash).
    """
    good = memory.unique_notes(new).join(problems(new).select("note_id").distinct(), "note_id", "left_anti")
    title = F.substring(F.trim(F.regexp_extract("content", r"^\s*([^\n]*)", 1)), 1, TITLE_CHARS)
    good = good.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), title)).withColumn("priority", F.coalesce("priority", F.lit("medium"))).withColumn("scope", F.coalesce("scope", F.lit("workspace")))
    good = good.withColumn("user_quote", F.when(memory.bind_quote(F.col("content"), F.col("user_quote")), F.col("user_quote")))
    asked = good.select("note_id", "workspace", F.posexplode("anchors").alias("_pos", "_a")).select("note_id", "workspace", "_pos", F.col("_a.path").alias("_path"))
    known = files.select("workspace", F.col("path").alias("_full"), "hash")
    found = asked.withColumn("_full", F.concat_ws("/", "workspace", "_path")).join(known, ["workspace", "_full"], "left")
    found = found.groupBy("note_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_path", "hash"))), lambda x: F.struct(x["_path"].alias("path"), x["hash"].alias("hash"))).alias("_anchors"))
    out = good.join(found, "note_id", "left").withColumn("anchors", F.coalesce("_anchors", "anchors"))
    return out.select(new.columns)


def creations(new: DataFrame) -> DataFrame:
    """Events to append for new notes: each is created, and what it supersedes is superseded."""
    none = F.lit(None).cast("string")
    made = new.select("workspace", "note_id", F.lit("created").alias("event"), F.col("author_id").alias("actor"), none.alias("reason"), F.col("created_at").alias("ts"))
    ended = new.filter("supersedes is not null").select("workspace", F.col("supersedes").alias("note_id"), F.lit("superseded").alias("event"), F.col("author_id").alias("actor"), F.col("note_id").cast("string").alias("reason"), F.col("created_at").alias("ts"))
    return made.unionByName(ended)


def commit_notes(commits: DataFrame) -> DataFrame:
    """(sha, kind, title, content, tags, provenance) of one note for each of commits(sha, subject, branch, files)."""
    files = F.array_sort(F.array_distinct("files"))
    named = F.array_join(F.slice(files, 1, COMMIT_FILES), ", ")
    more = F.when(F.size(files) > COMMIT_FILES, F.concat(F.lit(" and "), (F.size(files) - COMMIT_FILES).cast("string"), F.lit(" more"))).otherwise("")
    content = F.concat(F.lit("Commit "), "sha", F.lit(" on "), "branch", F.lit(": "), "subject", F.lit("\nFiles: "), named, more)
    return commits.select("sha", F.lit("finding").alias("kind"), F.concat(F.lit("Commit "), "sha", F.lit(": "), F.substring("subject", 1, TITLE_CHARS)).alias("title"), content.alias("content"), F.array(F.lit("commit")).alias("tags"), F.lit("auto").alias("provenance"))


def suggestions(vectors: DataFrame, events: DataFrame, note_id: int, files: DataFrame, least: float = memory.RELATED_LEAST) -> DataFrame:
    """(kind, suggestion) to go with a new note: related notes, revoked ones like it, and files(domain, glob, path) to anchor it at."""
    near = memory.related(vectors, events, note_id, least=least).select(F.lit("related").alias("kind"), F.col("note_id").cast("string").alias("suggestion"))
    gone = memory.related(vectors, events, note_id, state="revoked", limit=1, least=least).select(F.lit("revoked").alias("kind"), F.col("note_id").cast("string").alias("suggestion"))
    return near.unionByName(gone).unionByName(files.select(F.lit("anchor").alias("kind"), F.col("path").alias("suggestion")))


def editable(notes: DataFrame, events: DataFrame, workspace: str) -> DataFrame:
    """(note_id, kind, priority, tags, content, fingerprint) of the live notes of a workspace that are neither expired nor revoked."""
    gone = memory.fold_states(events).filter("state in ('expired', 'revoked')").select("note_id")
    rows = memory.live(notes, workspace).join(gone, "note_id", "left_anti")
    return rows.select("note_id", "kind", "priority", "tags", "content", fingerprint().alias("fingerprint"))


def fingerprint() -> Column:
    """What must not have changed between the export of a note and the edit of it."""
    return F.substring(F.sha2(F.concat_ws("\x00", F.coalesce("content", F.lit("")), F.coalesce("kind", F.lit("")), F.coalesce("priority", F.lit("")), F.array_join(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), "\x01")), 256), 1, 16)


def conflicts(plan: DataFrame, exported: DataFrame, current: DataFrame) -> DataFrame:
    """(note_id) of a plan's notes that have changed or gone since their export; a plan with any of them is not applied."""
    touched = plan.filter("operation <> 'remember'").select("note_id")
    then, now = exported.select("note_id", F.col("fingerprint").alias("_then")), current.select("note_id", F.col("fingerprint").alias("_now"))
    both = touched.join(then, "note_id", "left").join(now, "note_id", "left")
    return both.filter(~F.col("_then").eqNullSafe(F.col("_now"))).select("note_id")


def applied(plan: DataFrame, exported: DataFrame, current: DataFrame) -> DataFrame:
    """plan with applied: whether its operations may be carried out, all of them or none."""
    clean = conflicts(plan, exported, current).agg((F.count(F.lit(1)) == 0).alias("applied"))
    return plan.crossJoin(F.broadcast(clean))


def recall_routed(notes: DataFrame, events: DataFrame, workspace: str, now: float, *, note_id: int | None = None, boot: bool = False, file_path: str | None = None, query_vector=None, vectors: DataFrame | None = None, fired: DataFrame | None = None, limit: int = 10, **filters) -> DataFrame:
    """(note_id) by the kind of recall a request is for: one note, the boot set, a file, a meaning, or properties; without those of fired(note_id)."""
    if note_id is not None:
        rows = memory.get_note(notes, workspace, note_id)
    elif boot:
        rows = memory.boot_set(notes, events, workspace)
    elif file_path is not None:
        rows = memory.recall_for_path(notes, events, workspace, file_path, limit=limit)
    elif query_vector is not None and vectors is not None:
        rows = memory.semantic_recall(notes, events, vectors, workspace, query_vector, limit)
    else:
        rows = memory.recall_with_floor(notes, events, workspace, now, limit=limit, **filters)
    rows = rows.select("note_id")
    return rows if fired is None else rows.join(fired.select("note_id").distinct(), "note_id", "left_anti")


def candidate_pool(notes: DataFrame, events: DataFrame, workspace: str, most: int = memory.FLOOR_POOL) -> DataFrame:
    """The newest live notes of a workspace, at most `most`: what a floor of declared matches is looked for in."""
    return memory.without_expired(memory.live(notes, workspace), events).orderBy(F.col("created_at").desc_nulls_last(), F.desc("note_id")).limit(most)


def matched(structural: DataFrame, semantic: DataFrame, code: DataFrame, states: DataFrame) -> DataFrame:
    """(note_id, source, rank): candidates of three sources, each note by its strongest; notes whose state is not known to be active are left out."""
    parts = [df.select("note_id", F.lit(name).alias("source"), F.lit(i).alias("rank")) for i, (name, df) in enumerate((("structural", structural), ("semantic", semantic), ("code", code)))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(states.filter("state = 'active'").select("note_id"), "note_id", "left_semi")
    return both.groupBy("note_id").agg(F.min(F.struct("rank", "source")).alias("m")).select("note_id", "m.source", "m.rank")


def similar(vectors: DataFrame, query_vector, least: float) -> DataFrame:
    """(note_id, score) of vectors over a threshold."""
    near = vectors.select("note_id", F.round(cosine(F.col("embedding"), vector(query_vector)), 9).alias("score"))
    return near.filter(F.col("score") >= least)


def charged(deferred: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Rows of deferred(token, session_id, note_id, tokens, ts) that are charged to their session: those whose delivery confirmed(token) says took place."""
    return deferred.join(confirmed.select("token").distinct(), "token", "left_semi")


def last_sessions(ledger: DataFrame, most: int = 512) -> DataFrame:
    """(session_id) of the ledgers that are kept: the most recently used."""
    return ledger.groupBy("session_id").agg(F.max("ts").alias("_ts")).orderBy(F.desc("_ts"), "session_id").limit(most).select("session_id")
