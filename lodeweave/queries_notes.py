"""Queries of the symbol graph, of notes, triggers and episodes, beyond those of queries.py, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave.functions import commands, vectors
from lodeweave.operators import advisor, catalog, editing, episodes, graph, memory, search, triggers
from lodeweave.plans.runtime import cut, table
from lodeweave.queries import _ALL, _CUR, _EDGE, _EP, _LIVE, _NOTE, _STATE, _SYM, _TOP, _VEC0, NOW, WS, _BUILT, _docs, _moments, _note_events, _note_vectors, _notes, _round, _some_name, _top_callee, _vec0, query
from lodeweave.queries_more import _folder, _list
from lodeweave.sources import files as sources

# --- symbol graph

_SY = "s AS (SELECT workspace, name, kind, file_path, start_line, min(symbol_id) AS symbol_id, min(end_line) AS end_line FROM symbols GROUP BY ALL)"
_TESTP = "(regexp_matches(regexp_replace(lower(regexp_extract(file_path, '([^/]*)$', 1)), '\\.[^.]*$', ''), '^(test[_\\-]|tests?$)|(_test|\\.test|\\.spec|_spec)$') OR list_has_any(list_transform(string_split(file_path, '/')[:-2], lambda x: lower(x)), ['test', 'tests', 'testing', '__tests__']))"


@query(
    f"WITH {_EDGE}, {_TOP}, k AS (SELECT DISTINCT name FROM symbols WHERE workspace = '{WS}'), a AS (SELECT 'caller' AS direction, from_symbol AS symbol, from_file AS file_path, count(DISTINCT (from_line, edge_type)) AS sites FROM e, t WHERE workspace = '{WS}' AND to_symbol = x GROUP BY ALL ORDER BY sites DESC, file_path, symbol LIMIT 10),"
    f" p AS (SELECT to_symbol, count(DISTINCT (from_file, from_line)) AS sites, to_symbol IN (SELECT name FROM k) AS defined FROM e, t WHERE workspace = '{WS}' AND from_symbol = x AND edge_type <> 'use' GROUP BY ALL), b AS (SELECT * FROM p WHERE defined OR to_symbol NOT IN ({_BUILT}) ORDER BY defined DESC, sites DESC, to_symbol LIMIT 10)"
    " SELECT * FROM a UNION ALL SELECT 'callee', to_symbol, NULL, sites FROM b"
)
def trace_symbol(spark, d):
    return graph.trace(table(spark, d, "edges"), table(spark, d, "symbols"), WS, "Any." + _top_callee(spark, d))


@query(f"WITH {_SY}, t AS (SELECT min(name) AS x FROM symbols WHERE workspace = '{WS}') SELECT name, kind, file_path, start_line FROM s, t WHERE workspace = '{WS}' AND name = x ORDER BY {_TESTP}::INT, end_line - start_line DESC, file_path, start_line, symbol_id LIMIT 5")
def symbol_definitions(spark, d):
    return graph.definitions(table(spark, d, "symbols"), WS, _some_name(spark, d)).select("name", "kind", "file_path", "start_line")


@query(
    f"WITH {_SY}, q AS (SELECT row_number() OVER (ORDER BY name) - 1 AS pos, name AS token FROM (SELECT DISTINCT name FROM symbols WHERE workspace = '{WS}') QUALIFY pos < 3), h AS (SELECT pos, token, file_path, start_line, row_number() OVER (PARTITION BY token ORDER BY file_path, start_line, symbol_id) AS r FROM s JOIN q ON name = token WHERE workspace = '{WS}') SELECT token, file_path, start_line FROM h WHERE pos < 2 AND r <= 3"
)
def identifier_hints(spark, d):
    names = [r[0] for r in table(spark, d, "symbols").filter(F.col("workspace") == WS).select("name").distinct().orderBy("name").limit(3).collect()]
    return graph.identifier_hints(table(spark, d, "symbols"), WS, ["no such name", *names])


@query(
    "WITH s AS (SELECT workspace, file_path, name, kind, start_line, coalesce(end_line, start_line) AS end_line FROM (SELECT DISTINCT ON (workspace, name, kind, file_path, start_line) * FROM symbols)), i AS (SELECT a.workspace, a.file_path, a.name, a.start_line, b.name AS bn, b.kind AS bk, b.start_line AS bs FROM s a JOIN s b USING (workspace, file_path) WHERE b.start_line < a.start_line AND a.start_line <= b.end_line),"
    " g AS (SELECT workspace, file_path, name, start_line, arg_max(CASE WHEN bk = 'class' THEN bn END, (bs, bn)) FILTER (bk = 'class') AS owner, count(DISTINCT (bs, bn)) AS depth FROM i GROUP BY ALL) SELECT DISTINCT s.workspace, s.file_path, s.name, s.start_line, owner, coalesce(depth, 0) AS depth FROM s LEFT JOIN g USING (workspace, file_path, name, start_line)"
)
def enclosing_types(spark, d):
    return graph.enclosed(table(spark, d, "symbols"))


_RANKED = (
    "i AS (SELECT a.workspace, a.file_path, a.name, a.start_line, b.name AS bn, b.kind AS bk, b.start_line AS bs FROM s a JOIN s b USING (workspace, file_path) WHERE b.start_line < a.start_line AND a.start_line <= b.end_line),"
    " g AS (SELECT workspace, file_path, name, start_line, arg_max(bn, (bs, bn)) FILTER (bk = 'class') AS owner, count(DISTINCT (bs, bn)) AS depth FROM i GROUP BY ALL), r AS (SELECT s.*, owner, coalesce(depth, 0) AS depth FROM s LEFT JOIN g USING (workspace, file_path, name, start_line))"
)
_RANK_KEYS = f"CASE WHEN lower(name) = 'ra' THEN 0 WHEN starts_with(lower(name), 'ra') THEN 1 ELSE 2 END, CASE WHEN kind IN ('class', 'struct', 'interface', 'enum', 'trait', 'function', 'method') THEN 0 WHEN kind IN ('impl', 'alias') THEN 2 ELSE 1 END, ({_TESTP} OR starts_with(regexp_extract(file_path, '([^/]*)$', 1), '_'))::INT, depth, (owner IS NULL)::INT, CASE WHEN end_line - start_line >= 100 THEN 0 WHEN end_line - start_line >= 10 THEN 1 ELSE 2 END, length(name), file_path, start_line, symbol_id"


@query(f"WITH {_SY}, {_RANKED} SELECT name, kind, file_path, start_line, owner, depth FROM r WHERE workspace = '{WS}' AND name ILIKE '%ra%' ORDER BY {_RANK_KEYS} LIMIT 10")
def locate_by_rank(spark, d):
    return graph.locate_ranked(table(spark, d, "symbols"), WS, "ra")


@query(
    f"WITH {_SY}, k AS (SELECT *, CASE WHEN name = 'ra' THEN 0 WHEN name ILIKE '%ra%' AND starts_with(file_path, '{WS}/core/') THEN 2 WHEN name ILIKE '%ra%' THEN 4 WHEN abs(length(name) - 2) <= 1 AND lower(name[1]) = 'r' AND levenshtein(lower(name), 'ra') <= 1 THEN 5 END AS step FROM s WHERE workspace = '{WS}'), b AS (SELECT * FROM k WHERE step = (SELECT min(step) FROM k))"
    f" SELECT name, kind, file_path, start_line, CASE step WHEN 0 THEN 'exact' WHEN 2 THEN 'same_module' WHEN 4 THEN 'substring' ELSE 'fuzzy' END AS strategy FROM b ORDER BY CASE WHEN step = 5 THEN levenshtein(lower(name), 'ra') ELSE 0 END, {_RANK_KEYS.replace('depth, (owner IS NULL)::INT, ', '')} LIMIT 10"
)
def locate_cascade(spark, d):
    return graph.locate_cascade(table(spark, d, "symbols"), WS, "ra", caller_file=f"{WS}/core/x.py").select("name", "kind", "file_path", "start_line", "strategy")


_LIKE = "round(1 - levenshtein(lower(coalesce({0}, '')), 'snapshotkelor') / greatest(length(coalesce({0}, '')), 13), 6)"


@query(f"WITH {_SY}, {_RANKED} SELECT name, kind, file_path, start_line, owner, depth FROM r WHERE workspace = '{WS}' AND name ILIKE '%ra%' ORDER BY {_LIKE.format('owner')} DESC, " + _LIKE.format("regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]*$', '')") + f" DESC, {_RANK_KEYS} LIMIT 10")
def locate_by_qualifier(spark, d):
    return graph.locate_ranked(table(spark, d, "symbols"), WS, "SnapshotKelor.ra")


@query(
    f"WITH {_EDGE}, c AS (SELECT workspace, coalesce(file_path, '') AS from_file, regexp_extract(verb, '([^.:]+)$', 1) AS from_symbol, 0 AS from_line, regexp_extract(tool, '([^.:]+)$', 1) AS to_symbol, 'dynamic' AS edge_type FROM episodes WHERE verb IS NOT NULL AND tool IS NOT NULL), u AS (SELECT * FROM e UNION SELECT * FROM c) SELECT workspace, edge_type, count(*) AS edges FROM u GROUP BY ALL"
)
def traces_ingested(spark, d):
    e = table(spark, d, "episodes").filter("verb is not null and tool is not null").select("workspace", F.col("verb").alias("caller"), F.col("tool").alias("callee"), F.col("file_path").alias("caller_file"), F.lit(None).cast("int").alias("caller_line"))
    return graph.ingest_traces(table(spark, d, "edges"), e).groupBy("workspace", "edge_type").agg(F.count(F.lit(1)).alias("edges"))


# --- search


@query(
    f"WITH s AS (SELECT vec_id, greatest(0, list_cosine_similarity(embedding::DOUBLE[], {_VEC0}::DOUBLE[])) * 4 AS x FROM embeddings ORDER BY vec_id LIMIT 40), o AS (SELECT max((x < 0 OR x > 1)::INT) AS o FROM s) SELECT vec_id, round(CASE WHEN o = 1 THEN 1 / (1 + exp(-x)) ELSE x END, 6) AS score FROM s, o"
)
def scores_normalised(spark, d):
    page = search.dense(table(spark, d, "embeddings"), _vec0(spark, d)).select("vec_id", (F.col("dense") * 4).alias("score")).orderBy("vec_id").limit(40)
    return _round(search.normalised_scores(page, "score"), "score").select("vec_id", "score")


@query("SELECT doc_id, length(text)::DOUBLE AS ce_score FROM documents WHERE text IS NOT NULL AND length(text) < 2000")
def reranked(spark, d):
    """A page of short texts under a scorer that counts characters."""
    page = _docs(spark, d).filter("length(text) < 2000").select("doc_id", F.col("text").alias("content"))
    return search.rerank(page, "q", scorer=lambda q, texts: texts.str.len().astype("float64")).select("doc_id", "ce_score")


# --- notes: writing

_NEW_SQL = (
    "w AS (SELECT note_id + 1000000 AS note_id, workspace, content, title, tags, CASE WHEN note_id % 7 = 0 THEN 'urgent' ELSE priority END AS priority, CASE WHEN note_id % 11 = 0 THEN 'rumour' ELSE kind END AS kind, created_at + 1 AS created_at, author_id, scope, anchors, user_quote, CASE WHEN note_id % 3 = 0 THEN note_id END AS supersedes FROM n)"
)
_BADK = f"CASE WHEN trim(coalesce(content, '')) = '' THEN 'no content' WHEN length(content) > 20000 THEN 'too long' WHEN kind NOT IN ({', '.join(repr(k) for k in editing.KINDS)}) THEN 'unknown kind' WHEN priority NOT IN ('high', 'medium', 'low') THEN 'unknown priority' WHEN scope NOT IN ({', '.join(repr(k) for k in editing.SCOPES)}) THEN 'unknown scope' END"


def _new(spark, d):
    n = memory.unique_notes(_notes(spark, d))
    number = F.col("note_id")
    n = n.withColumn("supersedes", F.when(F.pmod("note_id", F.lit(3)) == 0, number)).withColumn("priority", F.when(F.pmod("note_id", F.lit(7)) == 0, "urgent").otherwise(F.col("priority"))).withColumn("kind", F.when(F.pmod("note_id", F.lit(11)) == 0, "rumour").otherwise(F.col("kind")))
    return n.withColumn("note_id", number + 1_000_000).withColumn("created_at", F.col("created_at") + 1)


def _hashes(spark, d):
    return catalog.current_files(table(spark, d, "source_files")).select("workspace", "path", F.substring(F.sha2("content", 256), 1, 12).alias("hash"))


@query(f"WITH {_NOTE}, {_NEW_SQL}, b AS (SELECT note_id, {_BADK} AS problem FROM w) SELECT note_id, problem FROM b WHERE problem IS NOT NULL")
def notes_refused(spark, d):
    return editing.problems(_new(spark, d))


@query(
    f"WITH {_NOTE}, {_CUR}, {_NEW_SQL}, g AS (SELECT *, trim(regexp_replace(user_quote, '\\s+', ' ', 'g')) AS uq FROM w WHERE {_BADK} IS NULL), a AS (SELECT note_id, g.workspace, unnest(anchors).path AS p, generate_subscripts(anchors, 1) AS i FROM g WHERE len(anchors) > 0), h AS (SELECT note_id, string_agg(p || '=' || coalesce(sha256(content)[:12], ''), ' ' ORDER BY i) AS hashes FROM a LEFT JOIN cur ON cur.workspace = a.workspace AND cur.path = a.workspace || '/' || p GROUP BY note_id)"
    " SELECT note_id, coalesce(nullif(trim(title), ''), left(trim(regexp_extract(content, '^\\s*([^\\n]*)', 1)), 80)) AS title, coalesce(priority, 'medium') AS priority, coalesce(scope, 'workspace') AS scope, coalesce(length(uq) >= 12 AND contains(trim(regexp_replace(content, '\\s+', ' ', 'g')), uq), false) AS quoted, coalesce(hashes, '') AS hashes FROM g LEFT JOIN h USING (note_id)"
)
def notes_prepared(spark, d):
    p = editing.prepared(_new(spark, d), _hashes(spark, d))
    hashes = F.array_join(F.transform(F.coalesce("anchors", F.array().cast("array<struct<path:string,hash:string>>")), lambda a: F.concat(a["path"], F.lit("="), F.coalesce(a["hash"], F.lit("")))), " ")
    return p.select("note_id", "title", "priority", "scope", F.col("user_quote").isNotNull().alias("quoted"), hashes.alias("hashes"))


@query(f"WITH {_NOTE}, {_NEW_SQL}, e AS (SELECT supersedes AS note_id, min(created_at) AS t, arg_min(note_id, created_at) AS b FROM w WHERE supersedes IS NOT NULL GROUP BY 1) SELECT n.note_id, coalesce(n.valid_until, e.t) AS valid_until, coalesce(n.superseded_by_note_id, e.b) AS by FROM n LEFT JOIN e USING (note_id) UNION ALL SELECT w.note_id, n.valid_until, n.superseded_by_note_id FROM w JOIN n ON w.note_id = n.note_id + 1000000")
def notes_remembered(spark, d):
    return memory.remember(_notes(spark, d), _new(spark, d)).select("note_id", "valid_until", F.col("superseded_by_note_id").alias("by"))


@query(f"WITH {_NOTE}, {_NEW_SQL} SELECT note_id, 'created' AS event, NULL AS reason FROM w UNION ALL SELECT supersedes, 'superseded', note_id::VARCHAR FROM w WHERE supersedes IS NOT NULL")
def note_creations(spark, d):
    return editing.creations(_new(spark, d)).select("note_id", "event", "reason")


@query(f"WITH {_NOTE}, t AS (SELECT min(note_id) AS a, max(note_id) AS z FROM notes) SELECT n.workspace, note_id, 'revoked' AS event, 'wrong' AS reason FROM n, t WHERE note_id IN (a, z)")
def notes_revoked(spark, d):
    lo, hi = _notes(spark, d).agg(F.min("note_id"), F.max("note_id")).head()
    return memory.append_event(_notes(spark, d), [lo, hi, -1], "revoked", "user", NOW, "wrong").select("workspace", "note_id", "event", "reason")


@query(
    f"WITH {_NOTE}, t AS (SELECT min(note_id) AS a FROM notes), v AS (SELECT *, row_number() OVER (ORDER BY id) AS r FROM (SELECT DISTINCT ON (id) * FROM note_events)), u AS (SELECT note_id, event, id FROM v UNION ALL SELECT a, 'revoked', 1000000000 FROM t UNION ALL SELECT a, 'reinstated', 1000000001 FROM t), f AS (SELECT note_id, arg_max(CASE WHEN event IN ('created', 'reinstated') THEN 'active' ELSE event END, id) AS state FROM u WHERE event IN ('created', 'reinstated', 'superseded', 'revoked', 'expired') AND note_id IS NOT NULL GROUP BY 1) SELECT state, count(*) AS notes FROM f GROUP BY state"
)
def note_reinstated(spark, d):
    lo = _notes(spark, d).agg(F.min("note_id")).head()[0]
    events = _note_events(spark, d)
    for i, kind in enumerate(("revoked", "reinstated")):
        new = memory.append_event(_notes(spark, d), [lo], kind, "user", NOW).withColumn("id", F.lit(1_000_000_000 + i).cast("long"))
        events = events.unionByName(new.select(events.columns))
    return memory.fold_states(events).groupBy("state").agg(F.count(F.lit(1)).alias("notes"))


@query(f"WITH {_NOTE}, t AS (SELECT min(note_id) AS a FROM notes) SELECT note_id, CASE WHEN note_id = a THEN 'low' ELSE priority END AS priority, CASE WHEN note_id = a THEN true ELSE pinned END AS pinned FROM n, t")
def note_fields_updated(spark, d):
    lo = _notes(spark, d).agg(F.min("note_id")).head()[0]
    return memory.update_fields(memory.unique_notes(_notes(spark, d)), lo, priority="low", pinned=True).select("note_id", "priority", "pinned")


@query(f"WITH {_NOTE}, l AS (SELECT note_id, CASE WHEN note_id % 2 = 0 THEN 'agent' ELSE 'auto' END AS p FROM n), t AS (SELECT min(note_id) FILTER (note_id % 2 = 0) AS a FROM n) SELECT note_id, CASE WHEN note_id = a THEN 'user' ELSE p END AS provenance FROM l, t")
def note_promoted(spark, d):
    n = memory.unique_notes(_notes(spark, d)).select("note_id", F.when(F.pmod("note_id", F.lit(2)) == 0, "agent").otherwise("auto").alias("provenance"))
    even = n.filter("provenance = 'agent'").agg(F.min("note_id")).head()[0]
    odd = n.filter("provenance = 'auto'").agg(F.min("note_id")).head()[0]
    return memory.promote(memory.promote(n, even, "user"), odd, "user")  # the second goes two steps at once, so it stays


@query(f"WITH t AS (SELECT min(note_id) AS a FROM notes) SELECT 'one' AS what, count(DISTINCT note_id) AS kept FROM notes, t WHERE note_id <> a UNION ALL SELECT 'workspace', count(DISTINCT note_id) FROM notes WHERE workspace <> '{WS}' UNION ALL SELECT 'all', 0")
def notes_forgotten(spark, d):
    n = memory.unique_notes(_notes(spark, d))
    lo = n.agg(F.min("note_id")).head()[0]
    parts = [("one", memory.forget(n, ids=[lo])), ("workspace", memory.forget(n, workspace=WS)), ("all", memory.forget(n))]
    counts = [df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("what"), "kept") for name, df in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"WITH t AS (SELECT max(note_id) AS a FROM notes WHERE workspace = '{WS}') SELECT DISTINCT note_id, content FROM notes, t WHERE workspace = '{WS}' AND note_id = a")
def note_by_id(spark, d):
    hi = _notes(spark, d).filter(F.col("workspace") == WS).agg(F.max("note_id")).head()[0]
    return memory.get_note(_notes(spark, d), WS, hi).select("note_id", "content")


@query("SELECT DISTINCT note_id FROM notes WHERE note_id NOT IN (SELECT vec_id FROM embeddings)")
def notes_without_vectors(spark, d):
    return memory.missing_vectors(_notes(spark, d), _note_vectors(spark, d)).select("note_id")


@query(f"WITH {_NOTE} SELECT note_id, 64 AS dimensions FROM n WHERE content IS NOT NULL AND note_id NOT IN (SELECT vec_id FROM embeddings)")
def vectors_backfilled(spark, d):
    gone = memory.missing_vectors(_notes(spark, d), _note_vectors(spark, d)).filter("content is not null")
    return gone.select("note_id", F.size(vectors.embed(F.col("content"), 64)).alias("dimensions"))


@query("WITH r AS (SELECT note_id, payload, row_number() OVER (PARTITION BY note_id ORDER BY id DESC) AS r FROM (SELECT DISTINCT ON (id) * FROM note_events) WHERE event = 'recalled') SELECT note_id, payload FROM r WHERE r = 1")
def last_payloads(spark, d):
    return memory.latest_payload(_note_events(spark, d), "recalled")


_COMMITS = "c AS (SELECT sha256(session_id)[:8] AS sha, session_id AS subject, 'main' AS branch, list_sort(list_distinct(list(file_path))) AS f FROM episodes WHERE session_id IS NOT NULL AND file_path IS NOT NULL GROUP BY session_id)"


@query(f"WITH {_COMMITS} SELECT sha, 'Commit ' || sha || ': ' || left(subject, 80) AS title, 'Commit ' || sha || ' on main: ' || subject || chr(10) || 'Files: ' || array_to_string(f[:10], ', ') || CASE WHEN len(f) > 10 THEN ' and ' || (len(f) - 10) || ' more' ELSE '' END AS content FROM c")
def commits_noted(spark, d):
    e = table(spark, d, "episodes").filter("session_id is not null and file_path is not null")
    commits = e.groupBy("session_id").agg(F.collect_set("file_path").alias("files")).select(F.substring(F.sha2("session_id", 256), 1, 8).alias("sha"), F.col("session_id").alias("subject"), F.lit("main").alias("branch"), "files")
    return editing.commit_notes(commits).select("sha", "title", "content")


# --- notes: editing

_EDITABLE = f"{_NOTE}, {_STATE}, b AS (SELECT n.* FROM n WHERE valid_until IS NULL AND workspace = '{WS}' AND note_id NOT IN (SELECT note_id FROM f WHERE state IN ('expired', 'revoked')))"
_PRINT = "sha256(coalesce(content, '') || chr(0) || coalesce(kind, '') || chr(0) || coalesce(priority, '') || chr(0) || array_to_string(list_sort(coalesce(tags, [])), chr(1)))[:16]"


@query(f"WITH {_EDITABLE} SELECT note_id, kind, {_PRINT} AS fingerprint FROM b")
def notes_for_edit(spark, d):
    return editing.editable(_notes(spark, d), _note_events(spark, d), WS).select("note_id", "kind", "fingerprint")


def _edited(spark, d):
    """(before, after, forgotten): every fifth note gone, of these every tenth for good, every seventh reworded, every eleventh of another kind, one new."""
    before = editing.editable(_notes(spark, d), _note_events(spark, d), WS)
    n = F.col("note_id")
    after = before.filter("note_id % 5 <> 0").select("note_id", F.when(n % 11 == 0, "other").otherwise(F.col("kind")).alias("kind"), F.when(n % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    new = before.agg((F.max("note_id") + 1).alias("note_id")).select("note_id", F.lit("task").alias("kind"), F.lit("new").alias("content"))
    return before, after.unionByName(new), before.filter("note_id % 10 = 0").select("note_id")


_PLAN = (
    f"WITH {_EDITABLE}, o AS (SELECT note_id, CASE WHEN note_id % 10 = 0 THEN 'forget' WHEN note_id % 5 = 0 THEN 'revoke' WHEN note_id % 7 = 0 AND content IS NOT NULL THEN 'supersede' WHEN note_id % 11 = 0 AND kind IS DISTINCT FROM 'other' THEN 'field_update' END AS operation FROM b UNION ALL SELECT max(note_id) + 1, 'remember' FROM b), p AS (SELECT * FROM o WHERE operation IS NOT NULL)"
)


@query(f"{_PLAN} SELECT note_id, operation, true AS applied FROM p")
def edit_plan_applied(spark, d):
    before, after, gone = _edited(spark, d)
    return editing.applied(memory.edit_plan(before, after, gone), before, before)


@query(f"{_PLAN} SELECT note_id, operation, false AS applied FROM p")
def edit_plan_in_conflict(spark, d):
    before, after, gone = _edited(spark, d)
    current = before.withColumn("fingerprint", F.when(F.col("note_id") % 5 == 0, "changed since").otherwise(F.col("fingerprint")))
    return editing.applied(memory.edit_plan(before, after, gone), before, current)


@query(
    f"WITH {_NOTE}, {_STATE}, l AS (SELECT *, coalesce(nullif(title, ''), regexp_extract(coalesce(content, ''), '^([^\\n]*)', 1)) AS h FROM n WHERE valid_until IS NULL AND workspace = '{WS}' AND note_id NOT IN (SELECT note_id FROM f WHERE state = 'expired')),"
    " t AS (SELECT coalesce(kind, 'none') AS kind, coalesce(created_at, 0.0) AS c, note_id, '## [' || note_id || '] ' || h || chr(10) || concat_ws(' ', priority, strftime(to_timestamp(floor(created_at)) AT TIME ZONE 'UTC', '%Y-%m-%d')) || chr(10) || chr(10) || coalesce(content, '') || chr(10) AS x FROM l) SELECT kind, md5('# ' || kind || chr(10) || chr(10) || string_agg(x, chr(10) ORDER BY c, note_id)) AS body FROM t GROUP BY kind"
)
def markdown_exported(spark, d):
    """The whole text of the projection, written to a folder and read again."""
    folder = _folder(spark, "export")
    memory.export_markdown(_notes(spark, d), _note_events(spark, d), WS).write.parquet(folder)
    return spark.read.parquet(folder).select("kind", F.md5("body").alias("body"))


# --- notes: recall


@query(f"WITH {_LIVE}, v AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VEC0}::DOUBLE[]), 9) AS s FROM embeddings) SELECT note_id, round(s, 6) AS score FROM l JOIN v ON vec_id = note_id WHERE s >= 0 ORDER BY s DESC, note_id DESC LIMIT 10")
def semantic_recall(spark, d):
    return _round(memory.semantic_recall(_notes(spark, d), _note_events(spark, d), _note_vectors(spark, d), WS, _vec0(spark, d)).select("note_id", "score"), "score")


_RELEVANCE = "CASE WHEN kind = 'task' THEN 1.0 ELSE author_trust_score END DESC NULLS LAST, CASE WHEN kind = 'task' THEN 1.0 ELSE decay_score END DESC NULLS LAST, created_at DESC NULLS LAST, note_id DESC"


@query(f"WITH {_ALL} SELECT row_number() OVER (ORDER BY {_RELEVANCE})::INT AS place, note_id, kind, title FROM l QUALIFY place <= 100")
def snapshot_roundtrip(spark, d):
    return memory.restore_snapshot(memory.snapshot(_notes(spark, d), _note_events(spark, d), WS, "check", NOW)).select("place", "note_id", "kind", "title")


@query("SELECT DISTINCT workspace AS label, dense_rank() OVER (ORDER BY workspace DESC)::INT AS place FROM notes WHERE workspace IS NOT NULL")
def snapshots_listed(spark, d):
    made = table(spark, d, "notes").filter("workspace is not null").select(F.col("workspace").alias("label")).distinct()
    made = made.select(F.lit("w").alias("workspace"), "label", F.rank().over(Window.orderBy("label")).cast("double").alias("created_at"))
    return memory.list_snapshots(made).select("label", F.row_number().over(Window.orderBy(F.desc("created_at"))).alias("place"))


_WORDS = "['orphan', 'store', 'module', 'idle', 'vahel', 'transport']"
_ASKED = "orphan store module idle src/vahel/transport.py"


@query(
    f"WITH {_NOTE}, k AS (SELECT note_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9_]+')), lambda w: list_contains({_WORDS}, w)) AS t, list_filter(coalesce(tags, []), lambda x: contains('{_ASKED}', lower(x))) AS g, list_filter(list_transform(coalesce(anchors, []), lambda a: a.path), lambda p: contains('{_ASKED}', lower(p))) AS a FROM n),"
    " c AS (SELECT note_id, (len(t) > 0)::INT + (len(g) > 0)::INT + (len(a) > 0)::INT AS fields, coalesce(list_max(list_transform(t || g || a, lambda x: length(x))), 0)::INT AS length FROM k) SELECT note_id, fields, length FROM c WHERE fields > 0"
)
def metadata_match(spark, d):
    return memory.metadata_match(_notes(spark, d), _ASKED)


@query(f"WITH {_ALL} SELECT note_id FROM l ORDER BY created_at DESC NULLS LAST, note_id DESC LIMIT 2000")
def recall_candidates(spark, d):
    return editing.candidate_pool(_notes(spark, d), _note_events(spark, d), WS).select("note_id")


@query(
    f"WITH {_ALL}, b AS (SELECT note_id FROM (SELECT note_id FROM l WHERE kind = 'directive' ORDER BY created_at, note_id LIMIT 100) UNION ALL SELECT note_id FROM (SELECT note_id FROM l WHERE kind = 'task' AND priority = 'high' ORDER BY created_at DESC, note_id DESC LIMIT 5)),"
    f" m AS (SELECT note_id FROM l JOIN (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VEC0}::DOUBLE[]), 9) AS s FROM embeddings) v ON vec_id = note_id WHERE coalesce(scope, 'workspace') <> 'session' AND s >= 0 ORDER BY s DESC, note_id DESC LIMIT 10)"
    " SELECT 'boot' AS way, note_id FROM b UNION ALL SELECT 'meaning', note_id FROM m WHERE note_id NOT IN (SELECT note_id FROM b)"
)
def recall_ways(spark, d):
    notes, events = _notes(spark, d), _note_events(spark, d)
    boot = editing.recall_routed(notes, events, WS, NOW, boot=True)
    near = editing.recall_routed(notes, events, WS, NOW, query_vector=_vec0(spark, d), vectors=_note_vectors(spark, d), fired=boot)
    return boot.select(F.lit("boot").alias("way"), "note_id").unionByName(near.select(F.lit("meaning").alias("way"), "note_id"))


_NEAR7 = "v AS (SELECT vec_id AS note_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]), 9) AS s FROM embeddings WHERE vec_id <> 7)"


@query(
    f"WITH {_STATE}, {_NEAR7}, r AS (SELECT note_id FROM v WHERE s >= 0.1 AND note_id IN (SELECT note_id FROM f WHERE state = 'active') ORDER BY s DESC, note_id LIMIT 3), x AS (SELECT note_id FROM v WHERE s >= 0.1 AND note_id IN (SELECT note_id FROM f WHERE state = 'revoked') ORDER BY s DESC, note_id LIMIT 1), p AS (SELECT DISTINCT path FROM source_files WHERE regexp_matches(path, '^.*\\.json$') ORDER BY path LIMIT 20)"
    " SELECT 'related' AS kind, note_id::VARCHAR AS suggestion FROM r UNION ALL SELECT 'revoked', note_id::VARCHAR FROM x UNION ALL SELECT 'anchor', path FROM p"
)
def note_suggestions(spark, d):
    anchors = catalog.proxy_anchors(table(spark, d, "source_files"), [("config", "*.json")])
    return editing.suggestions(_note_vectors(spark, d), _note_events(spark, d), 7, anchors, least=0.1)


# --- triggers, ledgers, delivery


@query(f"WITH {_NOTE}, t AS (SELECT note_id, unnest(triggers) AS t, generate_subscripts(triggers, 1) - 1 AS pos FROM n WHERE len(triggers) > 0), p AS (SELECT note_id, pos::INT AS pos, CASE WHEN t.path IS NULL AND t.event IS NULL AND t.symbol IS NULL AND t.command IS NULL AND NOT coalesce(t.semantic, false) THEN 'no axis' WHEN t.event NOT IN ({', '.join(repr(e) for e in triggers.EVENTS)}) THEN 'unknown event' WHEN t.cooldown < 0 THEN 'negative cooldown' END AS problem FROM t) SELECT * FROM p WHERE problem IS NOT NULL")
def invalid_triggers(spark, d):
    return triggers.invalid_triggers(memory.unique_notes(_notes(spark, d)))


_SCORES = "c AS (SELECT a.vec_id AS m, b.vec_id AS note_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 0.6 AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"


@query(f"WITH {_NOTE}, {_SCORES} SELECT m AS moment_id, note_id FROM c JOIN n USING (note_id) WHERE valid_until IS NULL AND round(s, 9) >= CASE kind WHEN 'directive' THEN 0.72 WHEN 'gotcha' THEN 0.72 WHEN 'operational' THEN 0.75 WHEN 'task' THEN 0.75 WHEN 'finding' THEN 0.78 WHEN 'reference' THEN 0.80 END")
def meanings_matched(spark, d):
    e = _note_vectors(spark, d)
    asked = F.broadcast(e.filter("note_id % 20 = 0").select(F.col("note_id").alias("moment_id"), F.col("embedding").alias("_q")))  # the stated query set
    scores = e.join(asked, F.lit(True)).select("moment_id", "note_id", F.round(vectors.cosine(F.col("embedding"), F.col("_q")) + 0.6, 9).alias("score"))
    return triggers.semantic_matches(scores, _notes(spark, d))


@query(
    f"WITH {_NOTE}, l AS (SELECT * FROM n WHERE valid_until IS NULL), f AS (SELECT row_number() OVER (ORDER BY p) - 1 AS pos, p FROM (SELECT DISTINCT unnest(list_transform(anchors, lambda a: a.path)) AS p FROM l) WHERE p IS NOT NULL QUALIFY pos < 5),"
    " k AS (SELECT note_id, pos, p, CASE WHEN list_contains(list_transform(anchors, lambda a: a.path), p) THEN 0 WHEN len(list_filter(triggers, lambda t: t.path IS NOT NULL AND regexp_matches(p, '^' || replace(regexp_replace(t.path, '([.+^$(){}|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*') || '$'))) > 0 THEN 1 WHEN regexp_matches(' ' || coalesce(content, '') || ' ', '[^A-Za-z0-9_]' || regexp_escape(regexp_extract(p, '([^/]*)$', 1)) || '[^A-Za-z0-9_]') THEN 2 END AS r FROM l, f)"
    " SELECT note_id, arg_min(p, (r, pos)) AS file_path, CASE min(r) WHEN 0 THEN 'anchor' WHEN 1 THEN 'trigger' ELSE 'mention' END AS relation FROM k WHERE r IS NOT NULL GROUP BY note_id"
)
def relations_of_files(spark, d):
    rows = memory.live(_notes(spark, d))
    files = rows.select(F.explode("anchors.path").alias("file_path")).filter("file_path is not null").distinct().orderBy("file_path").limit(5)
    return triggers.first_relation(_notes(spark, d), files.select((F.row_number().over(Window.orderBy("file_path")) - 1).alias("pos"), "file_path"))


@query(
    f"WITH {_NOTE}, {_STATE}, s AS (SELECT note_id FROM n WHERE valid_until IS NULL AND len(anchors) > 0), m AS (SELECT vec_id AS note_id FROM embeddings WHERE round(list_cosine_similarity(embedding::DOUBLE[], {_VEC0}::DOUBLE[]), 9) >= 0.1), c AS (SELECT note_id FROM n WHERE valid_until IS NULL AND len(triggers) > 0),"
    " u AS (SELECT note_id, 0 AS r, 'structural' AS source FROM s UNION ALL SELECT note_id, 1, 'semantic' FROM m UNION ALL SELECT note_id, 2, 'code' FROM c) SELECT note_id, arg_min(source, r) AS source, min(r)::INT AS rank FROM u WHERE note_id IN (SELECT note_id FROM f WHERE state = 'active') GROUP BY note_id"
)
def matches_of_three_sources(spark, d):
    rows = memory.live(_notes(spark, d))
    states = memory.fold_states(_note_events(spark, d))
    return editing.matched(rows.filter("size(anchors) > 0"), editing.similar(_note_vectors(spark, d), _vec0(spark, d), 0.1), rows.filter("size(triggers) > 0"), states)


def _deferred(spark, d):
    e = episodes.unique_episodes(table(spark, d, "episodes")).filter("session_id is not null and ts is not null")
    return e.select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("token"), "session_id", F.col("id").alias("note_id"), F.lit(100).alias("tokens"), "ts", "rc")


@query(f"WITH {_EP} SELECT session_id, count(*) * 100 AS spent FROM ep WHERE session_id IS NOT NULL AND ts IS NOT NULL AND rc = 0 GROUP BY session_id")
def deliveries_charged(spark, d):
    """Only what was confirmed (a command that ended well) is charged."""
    rows = _deferred(spark, d)
    return editing.charged(rows, rows.filter("rc = 0")).groupBy("session_id").agg(F.sum("tokens").alias("spent"))


@query(f"WITH {_EP} SELECT session_id FROM ep WHERE session_id IS NOT NULL AND ts IS NOT NULL GROUP BY session_id ORDER BY max(ts) DESC, session_id LIMIT 512")
def ledgers_kept(spark, d):
    return editing.last_sessions(_deferred(spark, d))


_CALLS = f"{_EP}, c AS (SELECT session_id, id AS seq, ts, CASE WHEN id % 3 = 0 THEN 'retrieval' ELSE 'tool' END AS kind, CASE WHEN id % 3 = 0 THEN cwd END AS ck, 500 AS tokens FROM ep WHERE session_id IS NOT NULL AND ts IS NOT NULL)"


def _calls(spark, d):
    e = episodes.unique_episodes(table(spark, d, "episodes")).filter("session_id is not null and ts is not null")
    third = F.pmod("id", F.lit(3)) == 0
    return e.select("session_id", F.col("id").alias("seq"), "ts", F.when(third, "retrieval").otherwise("tool").alias("kind"), F.when(third, F.col("cwd")).alias("chunk_key"), F.lit(500).alias("tokens"))


_FIRED_ON_EDIT = (
    f"{_NOTE}, {_STATE}, l AS (SELECT * FROM n WHERE valid_until IS NULL AND note_id NOT IN (SELECT note_id FROM f WHERE state IN ('expired', 'revoked'))), {_EP}, m AS (SELECT id AS moment_id, workspace, file_path AS p, CASE WHEN starts_with(file_path, workspace || '/') THEN substr(file_path, length(workspace) + 2) ELSE file_path END AS b, session_id AS sid, ts FROM ep WHERE lower(tool) = 'edit' AND file_path IS NOT NULL AND ts IS NOT NULL),"
    " d AS (SELECT note_id, (generate_subscripts(triggers, 1) - 1)::INT AS i, unnest(triggers) AS t FROM l WHERE len(triggers) > 0), r AS (SELECT note_id, i, t.path AS path, t.not_before AS nb, t.expires_visibility AS ev, t.cooldown AS cd FROM d WHERE (t.event IS NULL OR t.event = 'pre-edit') AND t.symbol IS NULL AND NOT coalesce(t.semantic, false) AND t.command IS NULL AND (t.path IS NOT NULL OR t.event IS NOT NULL)"
    " UNION ALL SELECT note_id, (generate_subscripts(a, 1) - 1)::INT, unnest(a), NULL, NULL, NULL FROM (SELECT note_id, list_filter(list_transform(anchors, lambda a: a.path), lambda x: x <> '') AS a FROM l WHERE kind = 'gotcha' AND coalesce(len(triggers), 0) = 0)),"
    " x AS (SELECT moment_id, note_id, i, coalesce(m.ts >= ev, false) AS faded FROM r JOIN l USING (note_id) JOIN m USING (workspace) WHERE (r.path IS NULL OR regexp_matches(p, '^' || replace(regexp_replace(r.path, '([.+^$(){}|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*') || '$') OR regexp_matches(b, '^' || replace(regexp_replace(r.path, '([.+^$(){}|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*') || '$'))"
    " AND (nb IS NULL OR m.ts >= nb) AND (cd IS NULL OR last_fired IS NULL OR m.ts - last_fired >= cd) AND coalesce(CASE coalesce(scope, 'workspace') WHEN 'session' THEN session_id = sid WHEN 'branch' THEN branch = 'main' WHEN 'path-subtree' THEN len(list_filter(anchors, lambda a: a.path = b OR (contains(a.path, '/') AND starts_with(b, regexp_replace(a.path, '/[^/]*$', '') || '/')))) > 0 ELSE true END, false))"
)


@query(f"WITH {_FIRED_ON_EDIT} SELECT moment_id, note_id, min(i)::INT AS trigger_index, arg_min(faded, i) AS faded FROM x GROUP BY ALL")
def trigger_on_edit(spark, d):
    return triggers.fire(_notes(spark, d), _note_events(spark, d), _moments(spark, d))


@query()
def eviction_hints(spark, d):
    return advisor.hints(advisor.running_pressure(_calls(spark, d)))


@query()
def notes_delivered(spark, d):
    return triggers.deliver(_notes(spark, d), _note_events(spark, d), _moments(spark, d))


@query(f"WITH {_CALLS}, l AS (SELECT session_id, ck, max(seq) AS s FROM c WHERE ck IS NOT NULL GROUP BY ALL) SELECT session_id, ck AS chunk_key, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, ck)::INT AS place FROM l QUALIFY place <= 5")
def chunks_to_refetch(spark, d):
    return advisor.refetch_keys(_calls(spark, d))


@query(f"WITH {_EP}, l AS (SELECT CASE WHEN rc = 0 THEN 'hit' WHEN rc IS NOT NULL THEN 'miss' ELSE 'other' END AS e, length(cmd_raw) AS t FROM ep) SELECT count(*) FILTER (e = 'hit') AS hits, count(*) FILTER (e = 'miss') AS misses, round(count(*) FILTER (e = 'hit') / count(*) FILTER (e <> 'other'), 6) AS hit_rate, sum(t) FILTER (e = 'hit')::BIGINT AS tokens_saved FROM l")
def cache_metrics(spark, d):
    e = episodes.unique_episodes(table(spark, d, "episodes"))
    return advisor.cache_metrics(e.select(F.when(F.col("rc") == 0, "hit").when(F.col("rc").isNotNull(), "miss").otherwise("other").alias("event"), F.length("cmd_raw").alias("tokens")))


# --- episodes and arcs


@query(f"WITH {_EP}, k AS (SELECT id, ts, strftime(to_timestamp(floor(ts)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso FROM ep WHERE ts IS NOT NULL) SELECT id, ts AS plain, floor(ts)::DOUBLE AS iso, true AS none FROM k")
def times_parsed(spark, d):
    e = episodes.unique_episodes(table(spark, d, "episodes")).filter("ts is not null")
    iso = F.date_format(F.timestamp_seconds(F.floor("ts")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select("id", episodes.epoch_seconds(F.col("ts")).alias("plain"), episodes.epoch_seconds(iso).alias("iso"), episodes.epoch_seconds(F.lit("no time")).isNull().alias("none"))


@query(
    f"WITH {_EP}, m AS (SELECT id, rc, is_error, interrupted, coalesce(stdout, '') || chr(10) || coalesce(stderr, '') AS o FROM ep), k AS (SELECT *, "
    + ", ".join(f"regexp_matches(o, '(?m){p}') AS {k}" for k, p in (("fa", "|".join(p for _, p, kind in commands.MARKERS if kind == "failure")), ("su", "|".join(p for _, p, kind in commands.MARKERS if kind == "success"))))
    + " FROM m), z AS (SELECT CASE WHEN coalesce(interrupted, false) OR rc < 0 OR rc > 128 THEN 'interrupted' WHEN fa THEN CASE WHEN rc IS NULL OR rc = 0 THEN 'soft_failure' ELSE 'failure' END WHEN su THEN 'success' WHEN rc IS NOT NULL THEN CASE WHEN rc = 0 THEN 'success' ELSE 'failure' END WHEN coalesce(is_error, false) THEN 'failure' WHEN id % 3 = 0 THEN 'success' WHEN id % 3 = 1 THEN 'failure' ELSE 'unknown' END AS outcome FROM k) SELECT outcome, count(*) AS n FROM z GROUP BY outcome"
)
def outcomes_by_harness(spark, d):
    """Where nothing else tells how a command ended, the harness does."""
    e = table(spark, d, "episodes").withColumn("harness_success", F.when(F.pmod("id", F.lit(3)) == 0, F.lit(True)).when(F.pmod("id", F.lit(3)) == 1, F.lit(False)))
    return episodes.derived(e).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query()
def arc_changes(spark, d):
    found = episodes.arcs(table(spark, d, "episodes"))
    return found.select("success_id", F.explode("changes").alias("c")).select("success_id", "c.axis", "c.old", "c.new")


@query()
def arcs_pending(spark, d):
    found = cut(episodes.arcs(table(spark, d, "episodes")))
    marks = episodes.resolve(found, [r[0] for r in found.select("success_id").orderBy("success_id").limit(3).collect()], "distilled")
    return episodes.pending_arcs(found, marks)


@query()
def episodes_marked(spark, d):
    return episodes.mark_episodes(table(spark, d, "episodes"), episodes.arcs(table(spark, d, "episodes")))
