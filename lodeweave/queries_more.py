"""Further queries of the engine's own operators, and the SQL they are held against; registered with those of queries.py.

Where the test tables hold no links between files, files and graphs are derived from supplier, part and lineitem: a supplier is a file,
a part a name, a delivery a call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave.functions import binding, commands, text, vectors
from lodeweave.operators import advisor, catalog, chunking, definitions, episodes, graph, memory, quality, search, triggers
from lodeweave.plans.runtime import cut, shared_folder, table
from lodeweave.queries import _ALL, _CUR, _EDGE, _EP, _LIVE, _ML, _NOTE, _STATE, _SYM, _VEC0, _chunks, _docs, _files, _note_events, _note_vectors, _notes, _round, _some_name, _top_callee, _vec0, NOW, WS, query
from lodeweave.sources import files as sources

_CH = "ch AS (SELECT DISTINCT ON (chunk_id) * FROM chunks)"
_PATHS = "p AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM source_files WHERE path IS NOT NULL)"


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/lodeweave-{name}-{uuid.uuid4().hex}"


# --- files, manifests, indexing

_ELIGIBLE = (
    f"list_contains({_list(catalog.EXTENSIONS)}, lower(regexp_extract(path, '\\.(\\w+)$', 1))) AND NOT (lower(s[-1]) IN ({', '.join(repr(x) for x in quality.CONFIG_NAMES)}) OR list_has_any(s, {_list(quality.CONFIG_DIRS)}))"
    f" AND NOT (regexp_matches(lower(s[-1]), '(_db\\.h|_metadata\\.h|\\.pb\\.(go|cc|h|py)|_pb2\\.pyi?|\\.min\\.(js|css)|\\.g\\.dart)$|\\.generated\\.') OR list_has_any(list_transform(s, lambda x: lower(x)), {_list(quality.GENERATED_DIRS)}))"
    f" AND NOT list_has_any(list_transform(s[:-2], lambda x: lower(x)), {_list(catalog.EXCLUDED_DIRS)}) AND len(list_filter(s[:-2], lambda x: regexp_matches(lower(x), '(\\.egg-info|\\.dist-info)$'))) = 0"
)


@query(f"WITH {_PATHS} SELECT path, {_ELIGIBLE} AS eligible FROM p")
def index_eligible(spark, d):
    return table(spark, d, "source_files").filter("path is not null").select("path").distinct().select("path", catalog.eligible(F.col("path")).alias("eligible"))


@query(f"WITH {_PATHS} SELECT path, {_ELIGIBLE} AND NOT list_contains(list_transform(s[:-2], lambda x: lower(x)), 'core') AND NOT ends_with(s[-1], '.ts') AND NOT regexp_matches(path, 'a_[0-9]+') AS eligible FROM p")
def ignore_rules_applied(spark, d):
    rules = sources.ignore_rules(["# what is not indexed", "core/", "*.ts", "re:a_[0-9]+", "re:(", ""])
    rows = table(spark, d, "source_files").filter("path is not null").select("path").distinct()
    return rows.select("path", catalog.eligible(F.col("path"), rules["dirs"], rules["globs"], rules["regexes"]).alias("eligible"))


@query(f"WITH {_PATHS} SELECT path, ends_with(s[-1], '.json') AS by_glob, list_contains(list_transform(s[:-2], lambda x: lower(x)), 'tests') AS by_dir, starts_with(path, '/srv/ws/jolan-core/') AS by_tree FROM p")
def ignore_patterns(spark, d):
    p = F.col("path")
    rows = table(spark, d, "source_files").filter("path is not null").select("path").distinct()
    return rows.select("path", catalog.ignored(p, "*.json").alias("by_glob"), catalog.ignored(p, "tests/").alias("by_dir"), catalog.ignored(p, "/srv/ws/jolan-core/*").alias("by_tree"))


@query("SELECT path, max(mtime) AS mtime FROM source_files WHERE path IS NOT NULL GROUP BY path")
def manifest_roundtrip(spark, d):
    rows = table(spark, d, "source_files").filter("path is not null").groupBy("path").agg(F.max("mtime").alias("mtime"))
    folder = _folder(spark, "manifest")
    sources.write_manifest(rows.limit(0), folder, 1)
    sources.write_manifest(rows, folder, 2)
    return sources.read_manifest(spark, folder, 2)


@query(f"WITH {_CH}, c AS (SELECT DISTINCT path FROM source_files WHERE ends_with(path, '.py')) SELECT file_path, count(*) FILTER (NOT ends_with(file_path, '.py')) AS kept, count(*) FILTER (ends_with(file_path, '.py')) AS renewed FROM ch GROUP BY file_path")
def replace_files(spark, d):
    """Chunks of changed files (those of Python here) go, new ones come; the others stay."""
    old = _chunks(spark, d).select("chunk_id", "file_path", F.lit(0).alias("age"))
    changed = table(spark, d, "source_files").filter("path like '%.py'").select("path").distinct()
    new = _chunks(spark, d).filter("file_path like '%.py'").select("chunk_id", "file_path", F.lit(1).alias("age"))
    rows = catalog.replace_files(old, changed, new)
    return rows.groupBy("file_path").agg(F.count_if(F.col("age") == 0).alias("kept"), F.count_if(F.col("age") == 1).alias("renewed"))


@query(f"WITH {_CH} SELECT file_path, count(*) AS chunks FROM ch WHERE file_path <> (SELECT min(file_path) FROM chunks) GROUP BY file_path")
def delete_file(spark, d):
    c = _chunks(spark, d)
    gone = c.agg(F.min("file_path").alias("path"))
    return catalog.replace_files(c.select("chunk_id", "file_path"), gone, c.select("chunk_id", "file_path").limit(0)).groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"))


_BEARING = "coalesce(symbol_name <> '' AND node_type NOT IN ('window', 'section', 'navigational'), false)"


@query(f"WITH {_CH} SELECT file_path, count(*) AS missing FROM ch WHERE {_BEARING} AND NOT coalesce(language = 'python', false) GROUP BY file_path")
def purpose_pending(spark, d):
    """Files whose chunks lack purpose vectors, where those of Python have theirs."""
    have = _chunks(spark, d).filter("language = 'python'").select("chunk_id")
    return catalog.pending_purpose(_chunks(spark, d), have)


@query(f"WITH {_CH} SELECT file_path, count(*) AS chunks, sum(coalesce(length(content), 0))::BIGINT AS chars FROM ch WHERE file_path IN (SELECT file_path FROM symbols WHERE workspace = '{WS}') GROUP BY file_path")
def body_chunks_of_files(spark, d):
    asked = table(spark, d, "symbols").filter(F.col("workspace") == WS).select(F.col("file_path").alias("path"))
    rows = catalog.chunks_of_files(_chunks(spark, d), asked)
    return rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("chars"))


@query(f"WITH {_CH} SELECT coalesce(language, '') AS language, count(*) AS chunks FROM ch GROUP BY ALL")
def chunks_written(spark, d):
    folder = _folder(spark, "chunks")
    sources.write_chunks(_chunks(spark, d).withColumn("language", F.coalesce("language", F.lit("none"))).select("chunk_id", "language", "content"), folder)
    rows = spark.read.parquet(folder).groupBy("language").agg(F.count(F.lit(1)).alias("chunks"))
    return rows.select(F.when(F.col("language") == "none", "").otherwise(F.col("language")).alias("language"), "chunks")


@query(f"WITH {_CH} SELECT language, count(*) FILTER (file_path <> (SELECT min(file_path) FROM chunks)) AS chunks FROM ch WHERE language IS NOT NULL GROUP BY language HAVING chunks > 0")
def stats_after_delta(spark, d):
    c = _chunks(spark, d).filter("language is not null")
    gone = c.join(F.broadcast(table(spark, d, "chunks").agg(F.min("file_path").alias("file_path"))), "file_path", "left_semi")
    delta = gone.groupBy("language").agg((-F.count(F.lit(1))).alias("chunks"))
    return catalog.apply_delta(catalog.language_stats(c), delta)


@query("WITH w AS (SELECT workspace, count(*) AS n FROM (SELECT DISTINCT workspace, path FROM source_files) GROUP BY workspace) SELECT 'workspace=' || coalesce(workspace, '') || ' files=' || n AS line FROM w")
def audit_lines(spark, d):
    rows = table(spark, d, "source_files").select("workspace", "path").distinct().groupBy("workspace").agg(F.count(F.lit(1)).alias("files"))
    folder = _folder(spark, "audit")
    sources.write_audit(rows, folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query("SELECT vec_id, 'm' AS embed_model FROM embeddings")
def one_model(spark, d):
    return sources.assert_one_model(table(spark, d, "embeddings").select("vec_id", F.lit("m").alias("embed_model")))


@query("SELECT round(avg(CASE WHEN regexp_matches(coalesce(text, ''), '\"\"\"|/\\*\\*|///|(?m)^\\s*#\\s|^\\s*//') THEN 1 ELSE 0 END), 2) AS doc_ratio, count(*) AS files FROM documents")
def doc_coverage(spark, d):
    return catalog.fingerprint(_docs(spark, d).select(F.col("lang").alias("language"), "text")).select("doc_ratio", "files")


@query("SELECT doc_id, length(left(text, 1500))::INT AS chars, md5(left(text, 1500)) AS snippet FROM documents WHERE text IS NOT NULL AND regexp_matches(lower(source), '(^|/)readme[^/]*$')")
def readme_snippets(spark, d):
    return catalog.readme_snippets(_docs(spark, d), path="source").select("doc_id", F.length("snippet").alias("chars"), F.md5("snippet").alias("snippet"))


@query("SELECT substr(sha256('schema-3|parsers-1|model-m'), 1, 16) AS stamp, true AS current, false AS other")
def graph_stamp(spark, d):
    stamp = catalog.tool_fingerprint("schema-3", "parsers-1", "model-m")
    meta = spark.range(1).select(F.lit(WS).alias("workspace"), stamp.alias("stamp"), F.lit(True).alias("complete"))
    at = graph.is_current(meta, stamp).select(F.col("current").alias("_c"))
    other = graph.is_current(meta, catalog.tool_fingerprint("schema-4")).select(F.col("current").alias("_o"))
    return meta.join(at, F.lit(True)).join(other, F.lit(True)).select("stamp", F.col("_c").alias("current"), F.col("_o").alias("other"))


@query(
    f"WITH {_CH}, n AS (SELECT DISTINCT ON (note_id) * FROM notes), a AS (SELECT workspace, count(*) AS chunks, count(DISTINCT file_path) AS files FROM ch GROUP BY 1), b AS (SELECT workspace, count(*) AS symbols FROM (SELECT DISTINCT workspace, name, kind, file_path, start_line FROM symbols) GROUP BY 1),"
    " c AS (SELECT workspace, count(*) AS notes FROM n WHERE valid_until IS NULL GROUP BY 1), e AS (SELECT workspace, count(DISTINCT id) AS episodes FROM episodes GROUP BY 1)"
    " SELECT a.workspace, files, chunks, coalesce(symbols, 0) AS symbols, coalesce(notes, 0) AS notes, coalesce(episodes, 0) AS episodes FROM a LEFT JOIN b USING (workspace) LEFT JOIN c USING (workspace) LEFT JOIN e USING (workspace)"
)
def workspace_status(spark, d):
    return catalog.status(_chunks(spark, d), table(spark, d, "symbols"), _notes(spark, d), table(spark, d, "episodes"))


# --- definitions and chunks


@query("SELECT DISTINCT file_path, name, start_line, end_line, kind FROM symbols WHERE kind <> 'class'")
def definitions_found(spark, d):
    """Functions and methods of the symbol table, as they are extracted again from the files of all languages."""
    found = definitions.definitions(_files(spark, d)).select(F.col("path").alias("file_path"), F.col("symbol_name").alias("name"), "start_line", "end_line", "kind").distinct()
    asked = table(spark, d, "symbols").filter("kind <> 'class'").select("file_path", "name", "start_line").distinct()
    return found.join(asked, ["file_path", "name", "start_line"], "left_semi").select("file_path", "name", "start_line", "end_line", "kind")


@query("SELECT DISTINCT file_path, name, start_line FROM symbols WHERE kind = 'class'")
def types_found(spark, d):
    found = definitions.definitions(_files(spark, d)).filter("kind = 'class'").select(F.col("path").alias("file_path"), F.col("symbol_name").alias("name"), "start_line").distinct()
    asked = table(spark, d, "symbols").filter("kind = 'class'").select("file_path", "name", "start_line").distinct()
    return found.join(asked, ["file_path", "name", "start_line"], "left_semi")


@query(
    "WITH s AS (SELECT DISTINCT file_path, name, kind, start_line, end_line FROM symbols) SELECT m.file_path, m.name, m.start_line, arg_min(c.name, (m.start_line - c.start_line, c.name)) AS owner"
    " FROM s m JOIN s c ON m.file_path = c.file_path AND c.kind = 'class' AND c.start_line < m.start_line AND m.start_line <= c.end_line WHERE m.kind = 'method' AND NOT ends_with(m.file_path, '.go') GROUP BY ALL"
)
def owners_found(spark, d):
    found = definitions.definitions(_files(spark, d)).filter("kind = 'method' and language <> 'go'").select(F.col("path").alias("file_path"), F.col("symbol_name").alias("name"), "start_line", "owner").distinct()
    asked = table(spark, d, "symbols").filter("kind = 'method'").select("file_path", "name", "start_line").distinct()
    types = table(spark, d, "symbols").filter("kind = 'class'").select("file_path", F.col("name").alias("owner")).distinct()
    return found.join(asked, ["file_path", "name", "start_line"], "left_semi").join(types, ["file_path", "owner"], "left_semi").select("file_path", "name", "start_line", "owner")


@query(
    "WITH p AS (SELECT DISTINCT CASE WHEN starts_with(path, '/srv/ws/') THEN substr(path, 9) ELSE path END AS path FROM source_files), s AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS directory FROM p WHERE len(string_split(path, '/')) <= 4) SELECT directory, path FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY directory ORDER BY path) <= 15) ORDER BY path LIMIT 120"
)
def directory_sketch(spark, d):
    files = table(spark, d, "source_files").select(text.relative_path(F.col("path"), F.lit("/srv/ws")).alias("path"))
    return catalog.directory_sketch(files)


@query(
    "WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents WHERE length(text) > 0), i AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l), r AS (SELECT doc_id, l, i, l[i] AS a, coalesce(l[i + 1], '') AS b FROM i),"
    " h AS (SELECT doc_id, l, i FROM r WHERE i = 1 OR (trim(a) <> '' AND NOT regexp_matches(a, '{R}') AND regexp_matches(b, '{R}') AND length(rtrim(b)) >= length(rtrim(a)))), s AS (SELECT doc_id, l, i AS a, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, len(l)) AS z, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS no FROM h),"
    " k AS (SELECT *, unnest(generate_series(a, z, 150)) AS p FROM s WHERE NOT regexp_matches(array_to_string(l[a:z], chr(10)), '^\\s*$')) SELECT doc_id AS path, no::INT AS section_no, p::INT AS start_line, least(p + 149, z)::INT AS end_line FROM k".replace("{R}", "^(={3,}|-{3,}|~{3,}|\\^{3,}|\"{3,}|''{3,}|`{3,}|#{3,}|\\*{3,}|\\+{3,}|:{3,}|\\.{3,})\\s*$")
)
def rst_sections(spark, d):
    return chunking.underlined_sections(_docs(spark, d), "doc_id").select("path", "section_no", "start_line", "end_line")


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[a-z0-9]{2}') THEN 1.0 ELSE 0.0 END AS length FROM documents WHERE text IS NOT NULL")
def embed_documents(spark, d):
    rows = _docs(spark, d).filter("text is not null").select("doc_id", vectors.embed(F.col("text")).alias("v"))
    return rows.select("doc_id", F.round(vectors.norm(F.col("v")), 6).alias("length"))


@query("WITH s AS (SELECT DISTINCT file_path, name, kind, start_line, end_line FROM symbols) SELECT c.file_path, c.name, c.start_line FROM s c WHERE kind = 'class' AND EXISTS (SELECT 1 FROM s m WHERE m.file_path = c.file_path AND m.start_line > c.start_line AND m.start_line <= c.end_line)")
def containers_found(spark, d):
    found = definitions.containers(definitions.definitions(_files(spark, d))).select(F.col("path").alias("file_path"), F.col("symbol_name").alias("name"), "start_line")
    asked = table(spark, d, "symbols").filter("kind = 'class'").select("file_path", "name", "start_line").distinct()
    return found.join(asked, ["file_path", "name", "start_line"], "left_semi")


@query(
    "WITH f AS (SELECT DISTINCT workspace, path, CASE WHEN starts_with(path, workspace || '/') THEN substr(path, length(workspace) + 2) ELSE path END AS b FROM source_files WHERE path IS NOT NULL), n AS (SELECT workspace, count(*) AS files FROM f GROUP BY 1),"
    " c AS (SELECT workspace, language, count(DISTINCT chunk_id) AS n FROM chunks WHERE language IS NOT NULL GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY n DESC, language) AS r FROM c), g AS (SELECT workspace, string_agg(language, ',' ORDER BY r) AS languages FROM l WHERE r <= 10 GROUP BY 1),"
    " e AS (SELECT workspace, string_split(b, '/')[1] AS d, count(*) AS n FROM f WHERE contains(b, '/') GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY n DESC, d) AS r FROM e), h AS (SELECT workspace, string_agg(d, ',' ORDER BY r) AS directories FROM t WHERE r <= 10 GROUP BY 1) SELECT workspace, files, languages, directories FROM n LEFT JOIN g USING (workspace) LEFT JOIN h USING (workspace)"
)
def codebase_maps(spark, d):
    return catalog.codebase_map(_files(spark, d).filter("path is not null"), table(spark, d, "chunks")).select("workspace", "files", "languages", "directories")


@query()
def calls_found(spark, d):
    return definitions.calls(_files(spark, d))


@query()
def chunk_files(spark, d):
    return definitions.chunk_files(_files(spark, d)).select("chunk_id", "language", "node_type", "symbol_name", F.md5("content").alias("content"))


@query(
    f"WITH {_CH} SELECT chunk_id, coalesce(lower(language) IN ('python', 'java', 'javascript', 'typescript', 'go', 'rust'), false) AS symbols, coalesce(list_contains(string_split(CASE language "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in definitions.RESERVED.items())
    + " END, ' '), symbol_name), false) AS reserved FROM ch"
)
def symbol_support(spark, d):
    c = _chunks(spark, d)
    return c.select("chunk_id", definitions.supports_symbols(F.col("language")).alias("symbols"), definitions.is_reserved(F.col("symbol_name"), F.col("language")).alias("reserved"))


@query()
def module_names(spark, d):
    return definitions.module_names(_files(spark, d))


@query("SELECT doc_id, md5(array_to_string(regexp_split_to_array(text, '\\r?\\n')[3:14], chr(10))) AS snippet FROM documents WHERE text IS NOT NULL")
def snippets(spark, d):
    return _docs(spark, d).filter("text is not null").select("doc_id", F.md5(chunking.snippet(F.col("text"), F.lit(3))).alias("snippet"))


@query("SELECT doc_id, substr(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) AS signature FROM documents WHERE text IS NOT NULL")
def snippet_signatures(spark, d):
    return _docs(spark, d).filter("text is not null").select("doc_id", graph.signature_hash(F.col("text")).alias("signature"))


@query("SELECT doc_id, regexp_matches(left(text, 2000), '@flow\\b') AS flow FROM documents WHERE text IS NOT NULL")
def flow_scripts(spark, d):
    return _docs(spark, d).filter("text is not null").select("doc_id", binding.is_flow_script(F.col("text")).alias("flow"))


_DERIVED = "f AS (SELECT 'pkg/s' || s_suppkey || '.py' AS path, s_nationkey AS k FROM supplier), g AS (SELECT 'geo/n' || n_nationkey || '.py' AS path, n_nationkey AS k FROM nation)"


def _modules(spark, d):
    """A file for each supplier that imports that of its nation."""
    s = table(spark, d, "supplier")
    importing = F.concat(F.lit("import os\nfrom geo.n"), F.col("s_nationkey").cast("string"), F.lit(" import name\n\n@app.get('/suppliers/"), F.col("s_suppkey").cast("string"), F.lit("')\ndef f():\n    pass\n"))
    a = s.select(F.concat(F.lit("pkg/s"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"), importing.alias("text"))
    b = table(spark, d, "nation").select(F.concat(F.lit("geo/n"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.lit("name = 1\n").alias("text"))
    return a.unionByName(b)


@query(f"WITH {_DERIVED} SELECT f.path AS from_file, g.path AS to_file FROM f JOIN g USING (k)")
def import_graph(spark, d):
    return chunking.import_graph(_modules(spark, d))


@query("SELECT 'pkg/s' || s_suppkey || '.py' AS path, 4 AS line, '/suppliers/' || s_suppkey AS route FROM supplier")
def http_routes(spark, d):
    return chunking.routes(_modules(spark, d))


def _deliveries(spark, d):
    """(edges, symbols) of suppliers that call parts; a part is defined by the supplier of its number, every tenth by a second one, too."""
    s = lambda c: F.concat(F.lit("s"), c.cast("string"))
    n = table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))
    line = table(spark, d, "lineitem")
    edges = line.select(F.lit("w").alias("workspace"), s(F.col("l_suppkey")).alias("from_file"), F.lit("f").alias("from_symbol"), F.lit(1).alias("from_line"), F.concat(F.lit("m.p"), F.col("l_partkey").cast("string")).alias("to_symbol"), F.lit("call").alias("edge_type")).distinct()
    p = table(spark, d, "part").crossJoin(F.broadcast(n))
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    one = p.select(name.alias("name"), s(F.pmod("p_partkey", "n") + 1).alias("file_path"))
    two = p.filter("p_partkey % 10 = 0").select(name.alias("name"), s(F.pmod(F.col("p_partkey") * 7, F.col("n")) + 1).alias("file_path"))
    symbols = one.unionByName(two).distinct().select(F.lit("w").alias("workspace"), "name", F.lit("function").alias("kind"), "file_path", F.lit(1).alias("start_line"))
    return edges, symbols


_DELIVERIES = (
    "n AS (SELECT count(*) AS n FROM supplier), e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS leaf FROM lineitem), y AS (SELECT 'p' || p_partkey AS leaf, 's' || (p_partkey % n + 1) AS f FROM part, n UNION SELECT 'p' || p_partkey, 's' || (p_partkey * 7 % n + 1) FROM part, n WHERE p_partkey % 10 = 0),"
    " c AS (SELECT leaf, count(*) AS c FROM y GROUP BY leaf)"
)


@query(f"WITH {_DELIVERIES}, o AS (SELECT leaf FROM c WHERE c = 1) SELECT 'w' AS workspace, f AS file_path, count(DISTINCT src) AS fan_in FROM e JOIN y USING (leaf) WHERE src <> f AND leaf IN (SELECT leaf FROM o) GROUP BY f")
def fan_in_derived(spark, d):
    return graph.fan_in(*_deliveries(spark, d))


@query(f"WITH {_DELIVERIES} SELECT 'w' AS workspace, src, f AS dst, round(sum(1 / c), 6) AS weight FROM e JOIN y USING (leaf) JOIN c USING (leaf) WHERE src <> f GROUP BY ALL")
def file_links_derived(spark, d):
    return _round(graph.file_links(*_deliveries(spark, d)), "weight")


@query(
    f"WITH RECURSIVE {_DELIVERIES}, l AS MATERIALIZED (SELECT src, f AS dst, sum(1 / c) AS w FROM e JOIN y USING (leaf) JOIN c USING (leaf) WHERE src <> f AND src IN (SELECT f FROM y) GROUP BY ALL), o AS (SELECT src, sum(w) AS o FROM l GROUP BY src), k AS MATERIALIZED (SELECT src, dst, w / o AS s FROM l JOIN o USING (src)), v AS MATERIALIZED (SELECT DISTINCT f FROM y), z AS (SELECT count(*) AS z FROM v),"
    " r(i, f, x) AS (SELECT 0, f, 1.0::DOUBLE / z FROM v, z UNION ALL SELECT q.i + 1, q.f, 0.15 / z + 0.85 * (q.g + (1 - sum(q.g) OVER ()) / z) FROM (SELECT r.i, r.f, coalesce(a.g, 0) AS g FROM r LEFT JOIN (SELECT k.dst, sum(k.s * r2.x) AS g FROM r AS r2 JOIN k ON k.src = r2.f GROUP BY k.dst) a ON a.dst = r.f) q, z WHERE q.i < 60)"
    " SELECT 'w' AS workspace, f AS file_path, round(x / max(x) OVER (), 5) AS importance FROM r WHERE i = 60"
)
def pagerank(spark, d):
    return _round(graph.page_rank(*_deliveries(spark, d)), "importance", digits=5)


@query()
def module_communities(spark, d):
    return graph.communities(graph.file_links(*_deliveries(spark, d)))


# --- chunk quality

_LONE = quality._LONE.replace("'", "''")
_IMP = quality._IMPORT.replace("'", "''")
_DECL = quality._DECLARED.replace("'", "''")
_NAV = f"(len(m) >= 2 AND len(list_filter(m, lambda x: NOT (regexp_matches(x, '{_IMP}') OR regexp_matches(x, '{_LONE}') OR regexp_matches(x, '{_DECL}')))) = 0)"
_FILLED = "len(list_filter(regexp_split_to_array(coalesce(content, ''), '\\r?\\n'), lambda x: trim(x) <> ''))"
_TRIVIAL = (
    f"CASE WHEN lower(language) IN ('html', 'htm', 'text', 'txt') AND {_FILLED} <= 2 THEN true WHEN len(m) = 0 THEN {_FILLED} <= 2"
    f" WHEN len(m) = 1 THEN regexp_matches(m[1], '{_LONE}') OR regexp_matches(m[1], '{_IMP}') OR regexp_matches(m[1], '^(class|struct|enum|def|fn|func|type|interface)\\b[^=]*[:;{{]?$') OR length(m[1]) <= 3"
    " WHEN len(m) = 2 AND regexp_matches(m[1], '^(async\\s+)?(def|class)\\b.*:$') AND regexp_matches(m[2], '^(pass|\\.\\.\\.|return(\\s+None)?)$') THEN true"
    " ELSE coalesce(regexp_matches(m[1], '^class\\s+\\w+[^:]*:$') AND len(m) BETWEEN 3 AND 7 AND len(list_filter(m[2:], lambda x: NOT regexp_matches(x, '^\\w+\\s*(:[^=]+)?=\\s*[^(.]+$'))) = 0, false) END"
)
_TYPES = ", ".join(f"'{x}'" for x in quality.TYPE_NODES)
_FUNCS = ", ".join(f"'{x}'" for x in quality.FUNCTION_NODES)
_DEFN = f"coalesce(symbol_name <> '' AND node_type IN ({_TYPES}, {_FUNCS}), false)"
_M = f"q AS (SELECT *, string_split(file_path, '/') AS s, {_ML} AS m FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks))"
_TESTC = "(regexp_matches(lower(s[-1]), '^test_|(_test\\.(py|go|c|h)|\\.(test|spec)\\.(ts|js))$|^test.*\\.(java|kt)$|^_test.*\\.(c|h)$') OR list_has_any(list_transform(s[:-2], lambda x: lower(x)), ['test', 'tests', '__tests__', 'spec', 'testing']) OR coalesce(language = 'rust' AND regexp_matches(regexp_extract(content, '^((?:\\s*(?:#|//|/\\*|\\*|@)[^\\n]*\\n|\\s*\\n)*[^\\n]*)', 1), '(?m)^\\s*#\\[\\s*(test|tokio::test|cfg\\(test\\))\\s*\\]\\s*$'), false))"
_GENC = f"(regexp_matches(lower(s[-1]), '(_db\\.h|_metadata\\.h|\\.pb\\.(go|cc|h|py)|_pb2\\.pyi?|\\.min\\.(js|css)|\\.g\\.dart)$|\\.generated\\.') OR list_has_any(list_transform(s, lambda x: lower(x)), {_list(quality.GENERATED_DIRS)}))"
_CONF = f"(lower(s[-1]) IN ({', '.join(repr(x) for x in quality.CONFIG_NAMES)}) OR list_has_any(s, {_list(quality.CONFIG_DIRS)}))"
_DOCL = f"coalesce(list_contains({_list(quality.DOC_LANGUAGES)}, lower(language)), false)"
_PRIV = "coalesce(starts_with(symbol_name, '_') AND NOT starts_with(symbol_name, '__'), false)"
_HEAD = "(len(m) = 0 OR (len(m) <= 2 AND len(array_to_string(m, ' ')) < 40))"


@query(
    f"WITH {_M} SELECT chunk_id, round(CASE WHEN {_CONF} THEN 0.10 WHEN node_type = 'navigational' OR {_NAV} THEN 0.35 WHEN {_TRIVIAL} AND NOT {_DEFN} THEN 0.15 WHEN language = 'markdown' AND {_HEAD} THEN 0.40"
    f" ELSE CASE WHEN {_GENC} THEN 0.45::DOUBLE ELSE 1.0 END * CASE WHEN {_TESTC} THEN 0.46 ELSE 1.0 END * CASE WHEN {_DOCL} THEN 0.70 ELSE 1.0 END * CASE WHEN {_PRIV} THEN 0.80 ELSE 1.0 END * CASE WHEN len(m) <= 2 THEN 0.80 ELSE 1.0 END END::DOUBLE, 6) AS quality,"
    f" CASE WHEN {_CONF} THEN 'config' WHEN node_type = 'navigational' OR {_NAV} THEN 'navigational' WHEN {_TRIVIAL} AND NOT {_DEFN} THEN 'trivial' WHEN language = 'markdown' AND {_HEAD} THEN 'heading_only' WHEN {_GENC} THEN 'generated' WHEN {_TESTC} THEN 'test' WHEN {_DOCL} THEN 'doc' WHEN {_PRIV} THEN 'private' WHEN len(m) <= 2 THEN 'short' END AS reason FROM q"
)
def quality_score_case(spark, d):
    args = [F.col(x) for x in ("content", "file_path", "language", "node_type", "symbol_name")]
    return _chunks(spark, d).select("chunk_id", F.round(quality.quality_score(*args), 6).alias("quality"), quality.demotion_reason(*args).alias("reason"))


@query(f"WITH {_M} SELECT chunk_id, CASE WHEN {_NAV} THEN 'navigational' ELSE node_type END AS node_type FROM q WHERE NOT ({_TRIVIAL} AND NOT {_DEFN})")
def trivial_filter(spark, d):
    return chunking.postprocess(_chunks(spark, d)).select("chunk_id", "node_type")


@query(
    f"WITH {_M} SELECT chunk_id, {_DEFN} AS definition, coalesce(node_type IN ({_TYPES}), false) AS type, {_BEARING} AS bearing, {_PRIV} AS private,"
    f" coalesce(node_type IN ({_FUNCS}), false) AND regexp_extract(content, '(?m)^\\s*# class: (\\w+)\\s*$', 1) = '' AS module_level, array_to_string(list_transform(list_filter(m, lambda x: regexp_matches(x, '{_DECL}')), lambda x: regexp_extract(x, '{_DECL}', 1)), ' ') AS declared FROM q WHERE content IS NOT NULL"
)
def chunk_predicates(spark, d):
    c, s, n = F.col("content"), F.col("symbol_name"), F.col("node_type")
    return _chunks(spark, d).filter("content is not null").select(
        "chunk_id", quality.is_definition(s, n).alias("definition"), quality.is_type_definition(n).alias("type"), quality.is_symbol_bearing(s, n).alias("bearing"), quality.is_private_name(s).alias("private"),
        quality.is_module_level_function(n, c).alias("module_level"), F.array_join(quality.declared_names(c), " ").alias("declared"),
    )


@query(
    f"WITH {_M}, p AS (SELECT chunk_id, symbol_name, nullif(regexp_extract(content, '(?m)^\\s*# class: (\\w+)\\s*$', 1), '') AS owner, list_filter(m, lambda x: contains(x, '(') OR regexp_matches(x, '^(class|struct|enum|interface|type|impl|trait)\\b'))[1] AS sig, regexp_extract(content, '(?s)(?:\"\"\"|''''''|/\\*\\*|///)\\s*\\**\\s*([^\\n\"*]*)', 1) AS doc FROM q WHERE {_BEARING})"
    " SELECT chunk_id, trim(concat_ws(' ', concat_ws('.', owner, symbol_name), coalesce(sig, ''), trim(doc))) AS purpose FROM p"
)
def purpose_text(spark, d):
    return chunking.purpose_text(_chunks(spark, d))


@query(
    "WITH t AS (SELECT lang, coalesce(text, '') AS t FROM documents), a AS (SELECT count(*) AS n, round(avg(CASE WHEN regexp_matches(t, '\"\"\"|/\\*\\*|///|(?m)^\\s*#\\s|^\\s*//') THEN 1 ELSE 0 END), 2) AS r, round(avg(len(regexp_split_to_array(t, '\\r?\\n'))), 2) AS l FROM t)"
    " SELECT (SELECT lang FROM t WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1) AS language, CASE WHEN n < 100 THEN 'small' WHEN n < 1000 THEN 'medium' ELSE 'large' END AS size_class, CASE WHEN l < 100 THEN 'low' WHEN l < 300 THEN 'medium' ELSE 'high' END AS complexity, round(greatest(0.4, least(0.85, CASE WHEN r >= 0.6 THEN 0.75 WHEN r >= 0.3 THEN 0.70 ELSE 0.55 END - CASE WHEN n >= 1000 THEN 0.05 ELSE 0 END)), 2)::DOUBLE AS dense_weight FROM a"
)
def strategy_weights(spark, d):
    return catalog.strategy(catalog.fingerprint(_docs(spark, d).select(F.col("lang").alias("language"), "text")))


# --- texts, paths, names


@query("WITH c AS (SELECT DISTINCT chunk_id FROM chunks) SELECT chunk_id, regexp_extract(chunk_id, '^(.*):(\\d+)-(\\d+)$', 1) AS path, regexp_extract(chunk_id, '^(.*):(\\d+)-(\\d+)$', 2)::INT AS first, regexp_extract(chunk_id, '^(.*):(\\d+)-(\\d+)$', 3)::INT AS last FROM c")
def chunk_ids_parsed(spark, d):
    return table(spark, d, "chunks").select("chunk_id").distinct().select("chunk_id", text.parse_chunk_id(F.col("chunk_id")).alias("p")).select("chunk_id", "p.*")


@query("SELECT DISTINCT file_path, CASE WHEN starts_with(file_path, workspace || '/') THEN substr(file_path, length(workspace) + 2) ELSE file_path END AS relative, lower(regexp_extract(file_path, '([^/]*)$', 1)) AS base FROM chunks")
def relative_paths(spark, d):
    f = F.col("file_path")
    return table(spark, d, "chunks").select("file_path", text.relative_path(f, F.col("workspace")).alias("relative"), F.lower(text.base_name(f)).alias("base")).distinct()


@query("WITH s AS (SELECT DISTINCT name FROM symbols), q AS (SELECT name, upper(left(name, 1)) || substr(name, 2) || '.run' AS n FROM s) SELECT name, left(n, length(n) - 4) AS qualifier, 'run' AS leaf, name AS plain FROM q")
def qualified_names(spark, d):
    n = table(spark, d, "symbols").select("name").distinct()
    whole = F.concat(F.upper(F.substring("name", 1, 1)), F.substring("name", 2, 1000), F.lit(".run"))
    return n.select("name", text.split_qualifier(whole).alias("q"), text.split_qualifier(F.col("name")).alias("p")).select("name", "q.qualifier", "q.leaf", F.col("p.leaf").alias("plain"))


_AGE = "1425000000.0 - created_at"


@query(
    f"WITH {_NOTE} SELECT note_id, CASE WHEN {_AGE} < 60 THEN 'just now' WHEN {_AGE} < 3600 THEN floor(({_AGE}) / 60)::BIGINT || 'm ago' WHEN {_AGE} < 86400 THEN floor(({_AGE}) / 3600)::BIGINT || 'h ago' ELSE floor(({_AGE}) / 86400)::BIGINT || 'd ago' END AS age, strftime(to_timestamp(floor(created_at)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM n WHERE created_at IS NOT NULL"
)
def note_ages(spark, d):
    n = memory.unique_notes(_notes(spark, d)).filter("created_at is not null")
    return n.select("note_id", text.age_text(F.lit(NOW) - F.col("created_at")).alias("age"), text.date_text(F.col("created_at")).alias("day"))


@query(
    "WITH t AS (SELECT doc_id, text, left(text, 399) AS h FROM documents WHERE text IS NOT NULL), k AS (SELECT *, regexp_extract(h, '(?s)^(.*[.!?])(?:\\s|$)', 1) AS a, regexp_extract(h, '(?s)^(.*\\S)\\s', 1) AS b FROM t)"
    " SELECT doc_id, md5(CASE WHEN greatest(1, length(text) // 4) <= 100 THEN text ELSE CASE WHEN length(a) >= 199 THEN a WHEN length(b) >= 199 THEN b ELSE h END || '…' END) AS trimmed FROM k"
)
def trim_to_cap(spark, d):
    return _docs(spark, d).filter("text is not null").select("doc_id", F.md5(text.trim_to_cap(F.col("text"), 100)).alias("trimmed"))


@query(
    f"WITH {_NOTE}, t AS (SELECT note_id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS l FROM n), k AS (SELECT *, left(l, 79) AS h, regexp_extract(left(l, 79), '^(.*\\S)\\s', 1) AS w FROM t) SELECT note_id, CASE WHEN length(l) <= 80 THEN l ELSE CASE WHEN length(w) >= 40 THEN w ELSE h END || '…' END AS line FROM k"
)
def one_line_notes(spark, d):
    return memory.unique_notes(_notes(spark, d)).select("note_id", binding.one_line(F.col("content"), 80).alias("line"))


_CODE_WORD = r"\w+_\w+|[a-z]+[A-Z]\w*|\w+\(\)|\.\w{1,4}\b|(?i:\b(?:where|defined|function|class|file|calls?|implements?)\b)"
_TALK_WORD = r"(?i)\b(?:explain|why|opinion|thanks|hello|general|concept)\b"


@query(
    f"WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '{_CODE_WORD}')) AS a, len(regexp_extract_all(text, '{_TALK_WORD}')) AS b FROM documents WHERE text IS NOT NULL) SELECT doc_id, a > b AS needs_tool, round(abs(a - b) / greatest(1, a + b), 4) AS confidence FROM c"
)
def code_questions(spark, d):
    rows = _docs(spark, d).filter("text is not null").select("doc_id", binding.asks_for_code(F.col("text")).alias("a"))
    return rows.select("doc_id", "a.needs_tool", "a.confidence")


@query(
    "WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS x, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) AS i FROM documents WHERE text IS NOT NULL), b AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS n FROM l), g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b),"
    " r AS (SELECT doc_id, g, x || CASE WHEN count(*) > 1 THEN ' [x' || count(*) || ']' ELSE '' END AS t FROM g GROUP BY doc_id, g, x) SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY g)) AS collapsed FROM r GROUP BY doc_id"
)
def lines_collapsed(spark, d):
    return _docs(spark, d).filter("text is not null").select("doc_id", F.md5(episodes.collapse_lines(F.col("text"))).alias("collapsed"))


@query(
    "WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS x, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) AS i FROM documents WHERE text IS NOT NULL), b AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS n FROM l), g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b),"
    " r AS (SELECT doc_id, g, x || CASE WHEN count(*) > 1 THEN ' [x' || count(*) || ']' ELSE '' END AS t FROM g GROUP BY doc_id, g, x), f AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY g) AS f, list(t ORDER BY g) AS k, count(*) AS n FROM r GROUP BY doc_id),"
    " s AS (SELECT *, CASE WHEN n > 40 THEN array_to_string(k[1:20], chr(10)) || chr(10) || '... [elided ' || (n - 40) || ' lines, sha256:' || sha256(array_to_string(k[21:n - 20], chr(10)))[:12] || '] ...' || chr(10) || array_to_string(k[n - 19:n], chr(10)) ELSE f END AS s FROM f)"
    " SELECT d.doc_id, md5(CASE WHEN coalesce(d.text, '') = '' THEN '' WHEN length(f) <= 2000 THEN f WHEN length(s) <= 2000 THEN s ELSE left(s, 1000) || chr(10) || '...[truncated]...' || chr(10) || right(s, 1000) END) AS digest FROM documents d LEFT JOIN s USING (doc_id)"
)
def digest_collapse(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(episodes.digest(F.col("text"))).alias("digest"))


@query(
    f"WITH {_EP}, w AS (SELECT DISTINCT unnest(regexp_split_to_array(cmd_raw, '\\s+')) AS w FROM ep WHERE cmd_raw IS NOT NULL) SELECT w AS word, CASE "
    + " ".join(f"WHEN regexp_matches(w, '{p}') THEN '{n}'" for n, p in commands.ARGUMENT_CLASSES)
    + " ELSE w END AS class FROM w"
)
def argument_classes(spark, d):
    e = table(spark, d, "episodes").filter("cmd_raw is not null").select(F.explode(F.split("cmd_raw", r"\s+")).alias("word")).distinct()
    return e.select("word", commands.argument_class_column(F.col("word")).alias("class"))


@query(f"WITH {_EP} SELECT id, sha256('{{\"system\":' || to_json(coalesce(verb, '')) || ',\"tools\":' || to_json(coalesce(tool, '')) || '}}')[:16] AS signature FROM ep")
def prefix_signatures(spark, d):
    e = episodes.unique_episodes(table(spark, d, "episodes"))
    return e.select("id", binding.prefix_signature(F.coalesce("verb", F.lit("")), F.coalesce("tool", F.lit(""))).alias("signature"))


@query(
    f"WITH {_EP}, k AS (SELECT sha256('{{\"args\":[{{\"key\":\"command\",\"value\":' || to_json(coalesce(cmd_raw, '')) || '}},{{\"key\":\"cwd\",\"value\":' || to_json(coalesce(cwd, '')) || '}}],\"epoch\":1,\"kind\":\"search\"}}') AS key FROM ep) SELECT key, count(*) AS n FROM k GROUP BY key"
)
def request_keys(spark, d):
    e = episodes.unique_episodes(table(spark, d, "episodes"))
    args = F.create_map(F.lit("cwd"), F.coalesce("cwd", F.lit("")), F.lit("command"), F.coalesce("cmd_raw", F.lit("")))
    return e.select(binding.canonical_key(F.lit("search"), args, F.lit(1)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NOTE} SELECT note_id, (4 * ceil((28 + octet_length(encode(content))) / 3))::INT AS size, true AS apart FROM n WHERE content IS NOT NULL")
def encrypted_sizes(spark, d):
    """AES-GCM adds 28 bytes, Base64 a third; two encryptions of one text differ."""
    key = F.lit("0123456789abcdef")
    n = memory.unique_notes(_notes(spark, d)).filter("content is not null").select("note_id", "content", binding.encrypt(F.col("content"), key).alias("a"), binding.encrypt(F.concat("content", F.lit("")), key).alias("b"))
    return n.select("note_id", F.length(F.regexp_replace("a", "\\s", "")).alias("size"), (F.col("a") != F.col("b")).alias("apart"))
