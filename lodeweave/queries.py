"""The queries of the engine's own operators over the test tables, and the SQL they are held against.

`now` and names that a query asks for are taken from the tables themselves, so that queries have rows at every size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import binding, commands, text, vectors
from lodeweave.operators import advisor, catalog, chunking, episodes, graph, memory, quality, search, triggers
from lodeweave.plans.runtime import table
from lodeweave.sources.files import as_text
from lodeweave.streaming import sessions

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

NOW = 1_425_000_000.0
WS = "/srv/ws/jolan-core"
QUERY = "token bucket retry scheduler"


def query(sql: str | None = None):
    def register(f):
        _REGISTRY[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Parts of SQL that several queries share.
_TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: len(t) >= 2)"
_QT = "['token', 'bucket', 'retry', 'scheduler']"
_BM25 = (
    "t AS (SELECT doc_id, " + _TOKENS.format("text") + " AS k FROM documents WHERE text IS NOT NULL),"
    " n AS (SELECT count(*) AS n, avg(len(k)) AS a FROM t),"
    f" q AS (SELECT unnest({_QT}) AS w), d AS (SELECT w, (SELECT count(*) FROM t WHERE list_contains(k, w)) AS df FROM q),"
    " p AS (SELECT doc_id, len(k) AS dl, w, df, len(list_filter(k, lambda x: x = w)) AS tf FROM t, d WHERE df > 0),"
    " b AS (SELECT doc_id, sum(ln((n.n + 1) / df) * (1 + tf * 2.5 / (1.5 * (0.25 + 0.75 * dl / n.a) + tf))) AS s FROM p, n GROUP BY doc_id),"
    " bm AS (SELECT t.doc_id, coalesce(s, 0) / CASE WHEN max(coalesce(s, 0)) OVER () > 0 THEN max(coalesce(s, 0)) OVER () ELSE 1 END AS bm25 FROM t LEFT JOIN b USING (doc_id))"
)
_SYM = "s AS (SELECT DISTINCT workspace, name, kind, file_path, start_line, min(symbol_id) AS symbol_id, min(end_line) AS end_line FROM symbols GROUP BY ALL)"
_EDGE = "e AS (SELECT DISTINCT workspace, from_file, from_symbol, from_line, to_symbol, edge_type FROM edges)"
_NOTE = "n AS (SELECT DISTINCT ON (note_id) * FROM notes)"
_STATE = (
    "f AS (SELECT note_id, arg_max(CASE WHEN event IN ('created', 'reinstated') THEN 'active' ELSE event END, id) AS state, arg_max(coalesce(reason, chr(1)), id) AS reason, arg_max(actor, id) AS actor, arg_max(ts, id) AS since"
    " FROM note_events WHERE event IN ('created', 'reinstated', 'superseded', 'revoked', 'expired') AND note_id IS NOT NULL GROUP BY note_id)"
)
_LIVE = f"{_NOTE}, {_STATE}, x AS (SELECT note_id FROM f WHERE state = 'expired'), l AS (SELECT * FROM n WHERE valid_until IS NULL AND workspace = '{WS}' AND coalesce(scope, 'workspace') <> 'session' AND note_id NOT IN (SELECT note_id FROM x))"
_EP = "ep AS (SELECT DISTINCT ON (id) * FROM episodes)"
_CUR = "cur AS (SELECT workspace, path, arg_max(content, (coalesce(mtime, '-infinity'::DOUBLE), content)) AS content, max(mtime) AS mtime FROM source_files GROUP BY ALL)"
_VEC0 = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def _files(spark: SparkSession, d: str) -> DataFrame:
    return as_text(catalog.current_files(table(spark, d, "source_files")))


def _vec0(spark: SparkSession, d: str):
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).head()["embedding"]


# --- tokens and lexical search


@query("SELECT w AS token, count(*) AS df, sum(c)::BIGINT AS cf FROM (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(" + _TOKENS.format("text") + ") AS w FROM documents) GROUP BY ALL) GROUP BY w")
def tokenize_df(spark, d):
    return search.document_frequency(_docs(spark, d))


@query("WITH " + _BM25 + " SELECT doc_id, round(bm25, 6) AS bm25 FROM bm ORDER BY bm.bm25 DESC, doc_id LIMIT 10")
def search_bm25_topk(spark, d):
    return _round(search.top(search.bm25(_docs(spark, d), QUERY), "bm25", "doc_id", 10), "bm25")


@query("WITH " + _BM25 + " SELECT doc_id, round(bm25, 6) AS bm25 FROM bm JOIN documents USING (doc_id) WHERE lang = 'markdown' ORDER BY bm.bm25 DESC, doc_id LIMIT 10")
def search_bm25_lang_filter(spark, d):
    docs = _docs(spark, d)
    scores = search.bm25(docs, QUERY).join(docs.filter("lang = 'markdown'").select("doc_id"), "doc_id", "left_semi")
    return _round(search.top(scores, "bm25", "doc_id", 10), "bm25")


@query(f"SELECT w AS token FROM (SELECT unnest(['zqxword', 'token', 'bucket']) AS w) WHERE w NOT IN (SELECT DISTINCT unnest({_TOKENS.format('text')}) FROM documents WHERE text IS NOT NULL)")
def low_confidence_tokens(spark, d):
    return search.unknown_tokens(_docs(spark, d), "the zqxword token bucket")


@query("SELECT doc_id, array_to_string(list_distinct_ordered, ' ') AS names FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\\b(?:[A-Za-z_]\\w*(?:\\.\\w+)+|\\w+_\\w+|[a-z]+[A-Z]\\w*|[A-Z][a-z]+[A-Z]\\w*)\\b'))) AS list_distinct_ordered FROM documents WHERE text IS NOT NULL) WHERE len(list_distinct_ordered) > 0")
def identifier_tokens(spark, d):
    names = F.array_sort(text.identifier_tokens(F.col("text")))
    return _docs(spark, d).select("doc_id", F.array_join(names, " ").alias("names")).filter("names <> ''")


# --- vectors


@query(f"SELECT vec_id, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], {_VEC0}::DOUBLE[])), 6) AS dense FROM embeddings ORDER BY greatest(0, list_cosine_similarity(embedding::DOUBLE[], {_VEC0}::DOUBLE[])) DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    return _round(search.dense(table(spark, d, "embeddings"), _vec0(spark, d), k=20), "dense")


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VEC0}::DOUBLE[]), 6) AS dense FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {_VEC0}::DOUBLE[]) >= 0.2")
def cosine_threshold(spark, d):
    return _round(search.dense(table(spark, d, "embeddings"), _vec0(spark, d), least=0.2), "dense")


@query(f"SELECT vec_id, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], {_VEC0}::DOUBLE[])), 6) AS dense FROM embeddings WHERE vec_id IN (3, 5, 7, 11)")
def vector_by_ids(spark, d):
    return _round(search.dense(table(spark, d, "embeddings").filter(F.col("vec_id").isin(3, 5, 7, 11)), _vec0(spark, d)), "dense")


@query(
    f"WITH v AS (SELECT vec_id, greatest(0, list_cosine_similarity(embedding::DOUBLE[], {_VEC0}::DOUBLE[])) AS a, label FROM embeddings), w AS (SELECT vec_id, greatest(0, list_cosine_similarity(list_reverse(embedding)::DOUBLE[], {_VEC0}::DOUBLE[])) AS b FROM embeddings)"
    " SELECT vec_id, round(greatest(a, coalesce(b, 0)), 6) AS dense, round(coalesce(b, 0), 6) AS purpose FROM v LEFT JOIN w USING (vec_id)"
)
def dual_vector_max_merge(spark, d):
    e = table(spark, d, "embeddings")
    purpose = e.withColumn("embedding", F.reverse("embedding"))
    both = search.merge_dense(search.dense(e, _vec0(spark, d)), search.dense(purpose, _vec0(spark, d)), "vec_id")
    return _round(both, "dense", "purpose")


_HYBRID = (
    f"WITH {_BM25}, v AS (SELECT vec_id AS doc_id, greatest(0, list_cosine_similarity(embedding::DOUBLE[], {_VEC0}::DOUBLE[])) AS dense FROM embeddings),"
    " h AS (SELECT coalesce(v.doc_id, bm.doc_id) AS doc_id, coalesce(dense, 0) AS dense, coalesce(bm25, 0) AS bm25, 0.7 * coalesce(dense, 0) + 0.3 * coalesce(bm25, 0) AS hybrid FROM v FULL JOIN bm ON v.doc_id = bm.doc_id)"
)


def _hybrid(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return search.merge_hybrid(search.dense(e, _vec0(spark, d), "doc_id"), search.bm25(_docs(spark, d), QUERY), "doc_id")


@query(_HYBRID + " SELECT doc_id, round(hybrid, 6) AS hybrid FROM h ORDER BY round(h.hybrid, 9) DESC, doc_id LIMIT 20")
def hybrid_merge_topk(spark, d):
    h = _hybrid(spark, d).select("doc_id", F.round("hybrid", 9).alias("hybrid"))
    return _round(search.top(h, "hybrid", "doc_id", 20), "hybrid")


@query(
    _HYBRID
    + ", r AS (SELECT doc_id, round(dense, 9) AS dense, round(bm25, 9) AS bm25, round(hybrid, 9) AS hybrid FROM h), ta AS (SELECT doc_id FROM r ORDER BY dense DESC, doc_id LIMIT 60), tb AS (SELECT doc_id FROM r ORDER BY bm25 DESC, doc_id LIMIT 60), m AS (SELECT * FROM r ORDER BY hybrid DESC, doc_id LIMIT 200) SELECT doc_id FROM m WHERE doc_id IN (SELECT doc_id FROM ta UNION SELECT doc_id FROM tb)"
)
def union_signals_topk(spark, d):
    h = _hybrid(spark, d).select("doc_id", *[F.round(c, 9).alias(c) for c in ("dense", "bm25", "hybrid")])
    return search.union_of_signals(h, "doc_id").select("doc_id")


@query(
    _HYBRID
    + ", r AS (SELECT doc_id, row_number() OVER (ORDER BY round(hybrid, 9) DESC, doc_id) - 1 AS i FROM h QUALIFY i < 200), c AS (SELECT r.doc_id, (1 - i / 200.0) * CASE WHEN lang IN ('markdown', 'text') THEN 0.7 ELSE 1.0 END AS s FROM r LEFT JOIN documents USING (doc_id)) SELECT doc_id, round(s, 6) AS score FROM c ORDER BY round(s, 9) DESC, doc_id LIMIT 20"
)
def rank_composite(spark, d):
    pool = search.top(_hybrid(spark, d).withColumn("hybrid", F.round("hybrid", 9)), "hybrid", "doc_id", 200)
    rank = F.row_number().over(Window.orderBy(F.desc("hybrid"), "doc_id")) - 1
    pool = pool.withColumn("rank", rank).join(_docs(spark, d).select("doc_id", "lang"), "doc_id", "left")
    q = F.when(quality.is_doc_language(F.col("lang")), 0.7).otherwise(1.0)
    none = F.lit(0.0)
    pool = pool.withColumn("score", F.round(search.composite(q, F.col("rank"), F.lit(200.0), none, none, none, F.lit(False)), 9))
    return _round(search.top(pool, "score", "doc_id", 20).select("doc_id", "score"), "score")


@query("SELECT min(doc_id) AS doc_id, count(*) - 1 AS dup_count FROM documents WHERE text IS NOT NULL GROUP BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))")
def exact_dedup_count(spark, d):
    docs = _docs(spark, d).filter("text is not null").select("doc_id", "text")
    return search.collapse_copies(docs, "doc_id", "text", [F.col("doc_id")]).select("doc_id", "dup_count")


@query()
def search_chunks(spark, d):
    return _round(search.search(table(spark, d, "chunks"), "snapshot region lookup handler", k=10).select("place", "chunk_id", "score", "quality", "dup_count", "low_confidence"), "score", "quality")


@query()
def near_dup_collapse(spark, d):
    page = search.top(search.bm25(_chunks(spark, d), QUERY, "chunk_id", "content").join(_chunks(spark, d), "chunk_id"), "bm25", "chunk_id", 200)
    page = search.collapse_copies(page, "chunk_id", "content", [-F.col("bm25")]).withColumn("place", F.row_number().over(Window.orderBy(F.desc("bm25"), "chunk_id")))
    return search.collapse_near_copies(page, "chunk_id", "content", "node_type", "place").select("chunk_id", "dup_count")


@query(f"WITH v AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VEC0}::DOUBLE[]), 9) AS ce FROM embeddings ORDER BY ce DESC, vec_id LIMIT 100), r AS (SELECT *, row_number() OVER (ORDER BY ce DESC, vec_id) AS place FROM v) SELECT vec_id, place::INT AS place FROM r WHERE place = 1 OR ce >= 0.02")
def result_floor(spark, d):
    page = search.top(search.dense(table(spark, d, "embeddings"), _vec0(spark, d)).withColumn("dense", F.round("dense", 9)), "dense", "vec_id", 100)
    page = page.withColumn("place", F.row_number().over(Window.orderBy(F.desc("dense"), "vec_id")))
    return search.result_floor(page, "dense", "place").select("vec_id", "place")


@query(
    "WITH r AS (SELECT a.vec_id AS q, b.vec_id AS k, a.label = b.label AS rel, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS place FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),"
    " p AS (SELECT q, count(*) FILTER (rel) AS n, count(*) FILTER (rel AND place <= 10) AS h FROM r GROUP BY q HAVING count(*) FILTER (rel) > 0) SELECT round(avg(h / n), 6) AS macro_recall, round(sum(h) / sum(n), 6) AS micro_recall, count(*) AS queries FROM p"
)
def recall_metrics(spark, d):
    e = table(spark, d, "embeddings")
    asked = F.broadcast(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qe"), F.col("label").alias("ql")))  # the stated query set
    pairs = e.join(asked, F.col("vec_id") != F.col("query"))
    scored = pairs.select("query", F.col("vec_id").alias("key"), F.round(vectors.cosine(F.col("embedding"), F.col("qe")), 9).alias("s"), (F.col("label") == F.col("ql")).alias("rel"))
    found = scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "key")))
    return _round(search.recall_at_k(found, scored.filter("rel").select("query", "key"), 10), "macro_recall", "micro_recall")


# --- chunk quality

_ML = "list_filter(list_transform(regexp_split_to_array(coalesce(content, ''), '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|//|/\\*|\\*|<!--|--|;;)'))"


@query(
    f"WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, content, {_ML} AS m FROM chunks) SELECT chunk_id, len(m)::INT AS lines, len(m) = 0 OR (len(m) <= 2 AND len(array_to_string(m, ' ')) < 40) AS heading_only FROM c"
)
def doc_predicates(spark, d):
    return _chunks(spark, d).select("chunk_id", F.size(quality.meaningful_lines(F.col("content"))).alias("lines"), quality.is_heading_only(F.col("content")).alias("heading_only"))


@query(
    "WITH c AS (SELECT DISTINCT ON (file_path) file_path AS p, string_split(file_path, '/') AS s FROM chunks), b AS (SELECT p, lower(s[-1]) AS n, list_transform(s, lambda x: lower(x)) AS l FROM c) SELECT p AS file_path,"
    " regexp_matches(n, '(_db\\.h|_metadata\\.h|\\.pb\\.(go|cc|h|py)|_pb2\\.pyi?|\\.min\\.(js|css)|\\.g\\.dart)$|\\.generated\\.') OR list_has_any(l, ['clinic', 'generated', '__generated__', 'gen', 'node_modules']) AS generated,"
    " regexp_matches(n, '^test_|(_test\\.(py|go|c|h)|\\.(test|spec)\\.(ts|js))$|^test.*\\.(java|kt)$|^_test.*\\.(c|h)$') OR list_has_any(l[:-2], ['test', 'tests', '__tests__', 'spec', 'testing']) AS test FROM b"
)
def path_predicates(spark, d):
    f = F.col("file_path")
    return _chunks(spark, d).select("file_path").distinct().select("file_path", quality.is_generated_file(f).alias("generated"), quality.is_test_file(f).alias("test"))


@query("SELECT chunk_id, nullif(regexp_extract(content, '(?m)^\\s*# class: (\\w+)\\s*$', 1), '') AS owner FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks) WHERE owner IS NOT NULL")
def owner_class(spark, d):
    return _chunks(spark, d).select("chunk_id", quality.owner_class(F.col("content")).alias("owner")).filter("owner is not null")


# --- chunkers


@query(
    "WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents WHERE length(text) > 0), w AS (SELECT doc_id, l, unnest(generate_series(0, len(l) - 1, 150)) AS s FROM l)"
    " SELECT doc_id AS path, (s / 150)::INT AS chunk_no, (s + 1)::INT AS start_line, least(s + 200, len(l))::INT AS end_line, md5(array_to_string(l[s + 1 : s + 200], chr(10))) AS content FROM w WHERE s = 0 OR s + 50 < len(l)"
)
def window_chunks(spark, d):
    return chunking.window_chunks(_docs(spark, d), "doc_id").withColumn("content", F.md5("content"))


@query(
    "WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents WHERE length(text) > 0 AND lang = 'markdown'), i AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l), h AS (SELECT doc_id, l, i FROM i WHERE i = 1 OR regexp_matches(l[i], '^#{1,6}\\s')),"
    " s AS (SELECT doc_id, l, i AS a, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, len(l)) AS z, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS no FROM h)"
    " SELECT doc_id AS path, no::INT AS section_no, a::INT AS start_line, z::INT AS end_line, trim(regexp_extract(l[a], '^#{1,6}\\s+(.*)', 1)) AS heading FROM s WHERE trim(regexp_replace(array_to_string(l[a:z], chr(10)), '\\s+', ' ', 'g')) <> ''"
)
def markdown_sections(spark, d):
    return chunking.markdown_sections(_docs(spark, d).filter("lang = 'markdown'"), "doc_id").drop("content")


@query(
    "WITH m AS (SELECT workspace, id, cmd_raw, row_number() OVER (PARTITION BY workspace ORDER BY id DESC) AS r FROM (SELECT DISTINCT ON (id) * FROM episodes)), g AS (SELECT workspace, string_agg(coalesce(cmd_raw, ''), chr(10) ORDER BY id) AS j FROM m WHERE r <= 20 GROUP BY workspace) SELECT workspace, CASE WHEN length(j) <= 2000 THEN j ELSE right(j, 2000) END AS window_text FROM g"
)
def window_assemble(spark, d):
    e = episodes.unique_episodes(table(spark, d, "episodes"))
    return chunking.request_window(e, "workspace", "id", "cmd_raw").select("workspace", F.col("window").alias("window_text"))


# --- the chunk store


@query(
    "WITH c AS (SELECT DISTINCT chunk_id, language, file_path FROM chunks) SELECT language, count(DISTINCT file_path) AS files, count(*) AS chunks FROM c GROUP BY language"
)
def language_stats(spark, d):
    return catalog.language_stats(table(spark, d, "chunks"))


@query("SELECT DISTINCT chunk_id FROM chunks WHERE file_path NOT IN (SELECT path FROM source_files WHERE path IS NOT NULL AND path NOT LIKE '%.py')")
def prune_orphans(spark, d):
    files = table(spark, d, "source_files").filter("path not like '%.py'")
    return catalog.orphans(_chunks(spark, d), files).select("chunk_id").distinct()


@query(
    f"WITH {_CUR}, old AS (SELECT path, min(mtime) AS mtime FROM source_files WHERE path NOT LIKE '%.json' GROUP BY path), new AS (SELECT path, mtime FROM cur WHERE path NOT LIKE '%.md')"
    " SELECT * FROM (SELECT coalesce(new.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' WHEN new.mtime <> old.mtime THEN 'modified' END AS change FROM new FULL JOIN old USING (path)) WHERE change IS NOT NULL"
)
def mtime_diff(spark, d):
    files = table(spark, d, "source_files")
    seen = catalog.current_files(files).filter("path not like '%.md'")
    old = files.filter("path not like '%.json'").groupBy("path").agg(F.min("mtime").alias("mtime"))
    return catalog.manifest_diff(seen, old)


@query(
    "WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, file_path, start_line, end_line FROM chunks), p AS (SELECT DISTINCT from_file AS file_path, from_line AS line FROM edges WHERE from_line IS NOT NULL)"
    " SELECT file_path, line, arg_min(chunk_id, (end_line - start_line, chunk_id)) AS chunk_id FROM p JOIN c USING (file_path) WHERE line BETWEEN start_line AND end_line GROUP BY ALL"
)
def span_containment(spark, d):
    places = table(spark, d, "edges").select(F.col("from_file").alias("file_path"), F.col("from_line").alias("line"))
    return catalog.covering_spans(table(spark, d, "chunks"), places)


def _asked(spark, d) -> list[str]:
    rows = [r[0] for r in table(spark, d, "chunks").select("chunk_id", "file_path").distinct().orderBy("chunk_id").select("chunk_id").limit(3).collect()]
    return [rows[1], rows[0], rows[0].rpartition(":")[0] + ":2-3", "/nowhere/x.py:1-5"]


_ASK = (
    "o AS (SELECT DISTINCT chunk_id AS id FROM chunks ORDER BY 1 LIMIT 2), a AS (SELECT 0 AS pos, max(id) AS rid FROM o UNION ALL SELECT 1, min(id) FROM o UNION ALL SELECT 2, regexp_replace((SELECT min(id) FROM o), ':[0-9]+-[0-9]+$', ':2-3') UNION ALL SELECT 3, '/nowhere/x.py:1-5')"
)


@query(
    f"WITH {_ASK}, c AS (SELECT DISTINCT ON (chunk_id) chunk_id, file_path, content FROM chunks) SELECT pos, rid AS requested_id, chunk_id IS NOT NULL AS found, CASE WHEN chunk_id IS NULL THEN CASE WHEN regexp_replace(rid, ':[0-9]+-[0-9]+$', '') IN (SELECT file_path FROM c) THEN 'misaligned' ELSE 'file_changed' END END AS reason, md5(content) AS content FROM a LEFT JOIN c ON chunk_id = rid"
)
def fetch_in_order(spark, d):
    return catalog.fetch(table(spark, d, "chunks"), _asked(spark, d)).drop("nearest").withColumn("content", F.md5("content"))


@query(
    f"WITH {_ASK}, c AS (SELECT DISTINCT ON (chunk_id) chunk_id, file_path, start_line, end_line FROM chunks), r AS (SELECT pos, rid, chunk_id, row_number() OVER (PARTITION BY pos ORDER BY greatest(0, start_line - 3, 2 - end_line), abs(start_line - 2), chunk_id) AS k FROM a JOIN c ON file_path = regexp_replace(rid, ':[0-9]+-[0-9]+$', '') WHERE pos = 2) SELECT pos, string_agg(chunk_id, ',' ORDER BY k) AS nearest FROM r WHERE k <= 5 AND (SELECT count(*) FROM c WHERE chunk_id = (SELECT rid FROM a WHERE pos = 2)) = 0 GROUP BY pos"
)
def nearest_span(spark, d):
    return catalog.fetch(table(spark, d, "chunks"), _asked(spark, d)).filter("pos = 2 and nearest is not null").select("pos", "nearest")


@query(
    "WITH t AS (SELECT lang, coalesce(text, '') AS t FROM documents), m AS (SELECT lang, count(*) AS c FROM t WHERE lang IS NOT NULL GROUP BY lang), s AS (SELECT count(*) AS files, round(avg(len(regexp_split_to_array(t, '\\r?\\n'))), 2) AS avg_lines, count(DISTINCT lang) AS languages FROM t)"
    " SELECT files, (SELECT lang FROM m ORDER BY c DESC, lang LIMIT 1) AS language, avg_lines, languages, CASE WHEN files < 100 THEN 'small' WHEN files < 1000 THEN 'medium' ELSE 'large' END AS size_class, CASE WHEN avg_lines < 100 THEN 'low' WHEN avg_lines < 300 THEN 'medium' ELSE 'high' END AS complexity FROM s"
)
def corpus_fingerprint(spark, d):
    docs = _docs(spark, d).select(F.col("lang").alias("language"), "text")
    return catalog.fingerprint(docs).drop("doc_ratio")


@query("SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\b[A-Z][a-z]{3,}\\b')) AS term FROM documents) GROUP BY term HAVING n >= 3 ORDER BY n DESC, term LIMIT 20")
def domain_terms(spark, d):
    return catalog.domain_terms(_docs(spark, d))


@query("SELECT lower(regexp_extract(path, '\\.(\\w+)$', 1)) AS extension, count(*) AS files FROM (SELECT DISTINCT path FROM source_files) WHERE regexp_matches(path, '\\.\\w+$') GROUP BY ALL")
def extension_languages(spark, d):
    return catalog.extension_languages(table(spark, d, "source_files"))


@query(
    "WITH p AS (SELECT DISTINCT path FROM source_files), m AS (SELECT path, CASE WHEN regexp_matches(path, '^.*/tests/.*$') THEN 0 WHEN regexp_matches(path, '^.*\\.json$') THEN 1 END AS pos FROM p) SELECT CASE pos WHEN 0 THEN 'testing' ELSE 'config' END AS domain, CASE pos WHEN 0 THEN '*/tests/*' ELSE '*.json' END AS glob, path FROM m WHERE pos IS NOT NULL ORDER BY pos, path LIMIT 20"
)
def proxy_anchors(spark, d):
    return catalog.proxy_anchors(table(spark, d, "source_files"), [("testing", "*/tests/*"), ("config", "*.json")])


# --- the symbol graph


@query(f"WITH {_SYM} SELECT name, file_path, start_line FROM s WHERE workspace = '{WS}' AND name ILIKE '%ra%' ORDER BY CASE WHEN name = 'ra' THEN 0 ELSE 1 END, length(name), file_path, start_line, symbol_id LIMIT 10")
def locate_substring(spark, d):
    return graph.locate(table(spark, d, "symbols"), WS, "ra").select("name", "file_path", "start_line")


def _some_name(spark, d) -> str:
    return table(spark, d, "symbols").filter(F.col("workspace") == WS).agg(F.min("name")).head()[0]


@query(f"WITH {_SYM}, t AS (SELECT min(name) AS x FROM symbols WHERE workspace = '{WS}') SELECT DISTINCT name, 'exact' AS strategy FROM s, t WHERE workspace = '{WS}' AND name = x")
def locate_exact(spark, d):
    return graph.locate_cascade(table(spark, d, "symbols"), WS, _some_name(spark, d), limit=1000).select("name", "strategy").distinct()


@query(
    f"WITH {_SYM}, t AS (SELECT min(name) || 'q' AS x FROM symbols WHERE workspace = '{WS}') SELECT DISTINCT name, 'fuzzy' AS strategy FROM s, t WHERE workspace = '{WS}' AND NOT EXISTS (SELECT 1 FROM s s2 WHERE s2.workspace = '{WS}' AND s2.name ILIKE '%' || x || '%') AND lower(name[1]) = lower(x[1]) AND levenshtein(lower(name), lower(x)) <= CASE WHEN length(x) <= 4 THEN 1 ELSE 2 END"
)
def locate_fuzzy(spark, d):
    return graph.locate_cascade(table(spark, d, "symbols"), WS, _some_name(spark, d) + "q", limit=1000).select("name", "strategy").distinct()


@query(
    f"WITH t AS (SELECT min(name) || 'tail' AS x FROM symbols WHERE workspace = '{WS}'), s AS (SELECT DISTINCT name FROM symbols WHERE workspace = '{WS}') SELECT name FROM s, t WHERE name <> x AND (levenshtein(lower(name), lower(x)) <= 2 OR (length(name) >= 6 AND starts_with(lower(x), lower(name)))) ORDER BY CASE WHEN levenshtein(lower(name), lower(x)) <= 2 THEN 0 ELSE 1 END, CASE WHEN levenshtein(lower(name), lower(x)) <= 2 THEN levenshtein(lower(name), lower(x)) ELSE -length(name) END, name LIMIT 3"
)
def nearest_prefix(spark, d):
    return graph.nearest_names(table(spark, d, "symbols"), WS, _some_name(spark, d) + "tail")


@query(f"SELECT DISTINCT to_symbol AS name FROM edges WHERE workspace = '{WS}' AND to_symbol IN (SELECT name FROM symbols WHERE workspace = '{WS}')")
def known_names_semi(spark, d):
    names = table(spark, d, "edges").filter(F.col("workspace") == WS).select(F.col("to_symbol").alias("name"))
    return graph.known_names(table(spark, d, "symbols"), names, WS)


@query(f"WITH f AS (SELECT min(file_path) AS f FROM symbols WHERE workspace = '{WS}') SELECT name FROM symbols, f WHERE workspace = '{WS}' AND file_path = f UNION SELECT to_symbol FROM edges, f WHERE workspace = '{WS}' AND from_file = f AND to_symbol IS NOT NULL")
def symbols_touching(spark, d):
    f = table(spark, d, "symbols").filter(F.col("workspace") == WS).agg(F.min("file_path")).head()[0]
    return graph.touching(table(spark, d, "symbols"), table(spark, d, "edges"), WS, f)


_TOP = "t AS (SELECT to_symbol AS x FROM e WHERE workspace = '" + WS + "' GROUP BY to_symbol ORDER BY count(*) DESC, to_symbol LIMIT 1)"


def _top_callee(spark, d) -> str:
    e = graph.unique_edges(table(spark, d, "edges")).filter(F.col("workspace") == WS)
    return e.groupBy("to_symbol").count().orderBy(F.desc("count"), "to_symbol").limit(1).head()[0]


@query(f"WITH {_EDGE}, {_TOP} SELECT from_symbol, from_file, count(DISTINCT (from_line, edge_type)) AS sites FROM e, t WHERE workspace = '{WS}' AND to_symbol = x GROUP BY ALL ORDER BY sites DESC, from_file, from_symbol LIMIT 10")
def edge_aggregate_callers(spark, d):
    return graph.callers(table(spark, d, "edges"), WS, _top_callee(spark, d))


_CALLER = "c AS (SELECT from_symbol AS y FROM e WHERE workspace = '" + WS + "' AND edge_type <> 'use' GROUP BY from_symbol ORDER BY count(*) DESC, from_symbol LIMIT 1)"
_BUILT = ", ".join(f"'{b}'" for b in graph.BUILTINS)


@query(
    f"WITH {_EDGE}, {_CALLER}, k AS (SELECT DISTINCT name FROM symbols WHERE workspace = '{WS}'), p AS (SELECT to_symbol, count(DISTINCT (from_file, from_line)) AS sites, to_symbol IN (SELECT name FROM k) AS defined FROM e, c WHERE workspace = '{WS}' AND from_symbol = y AND edge_type <> 'use' GROUP BY ALL) SELECT * FROM p WHERE defined OR to_symbol NOT IN ({_BUILT}) ORDER BY defined DESC, sites DESC, to_symbol LIMIT 10"
)
def edge_aggregate_callees(spark, d):
    e = graph.unique_edges(table(spark, d, "edges")).filter((F.col("workspace") == WS) & (F.col("edge_type") != "use"))
    name = e.groupBy("from_symbol").count().orderBy(F.desc("count"), "from_symbol").limit(1).head()[0]
    return graph.callees(table(spark, d, "edges"), table(spark, d, "symbols"), WS, name)


@query("SELECT workspace, to_symbol, count(DISTINCT from_symbol) AS callers FROM edges WHERE from_symbol IS NOT NULL GROUP BY ALL")
def caller_in_degree(spark, d):
    return graph.in_degree(table(spark, d, "edges"))


@query("WITH c AS (SELECT workspace, to_symbol, count(DISTINCT from_symbol) AS callers FROM edges WHERE from_symbol IS NOT NULL GROUP BY ALL) SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY workspace, callers) > 1")
def tied_counts(spark, d):
    return graph.tied_counts(graph.in_degree(table(spark, d, "edges")))


@query(f"WITH {_EDGE} SELECT workspace, to_symbol, count(*) AS sites FROM e WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.workspace = e.workspace AND s.name = e.to_symbol) GROUP BY ALL")
def ingest_edges_unresolved(spark, d):
    return graph.unresolved(table(spark, d, "edges"), table(spark, d, "symbols"))


@query(
    "WITH d AS (SELECT workspace, name AS leaf, min(file_path) AS f FROM symbols GROUP BY ALL HAVING count(DISTINCT file_path) = 1), u AS (SELECT DISTINCT workspace, from_file, regexp_extract(to_symbol, '([^.:]+)$', 1) AS leaf FROM edges) SELECT workspace, f AS file_path, count(DISTINCT from_file) AS fan_in FROM u JOIN d USING (workspace, leaf) WHERE from_file <> f GROUP BY ALL"
)
def fan_in_unambiguous(spark, d):
    return graph.fan_in(table(spark, d, "edges"), table(spark, d, "symbols"))


@query(
    "WITH l AS (SELECT array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda x: NOT regexp_matches(trim(x), '^(import|from|export|use|pub use)\\b')), chr(10)) AS t FROM documents), w AS (SELECT unnest(regexp_extract_all(t, '\\b[A-Za-z_]\\w*\\b')) AS name FROM l), c AS (SELECT name, count(*) AS n FROM w WHERE name IN (SELECT name FROM symbols) GROUP BY name) SELECT name, n, round(ln(1 + n) / ln(1 + (SELECT max(n) FROM c)), 6) AS importance FROM c"
)
def name_frequency(spark, d):
    return _round(graph.name_frequency(_docs(spark, d), table(spark, d, "symbols").select("name")), "importance")


@query("SELECT workspace, count(*) AS symbols FROM (SELECT DISTINCT workspace, name, kind, file_path, start_line FROM symbols) GROUP BY workspace")
def symbol_count(spark, d):
    return graph.unique_symbols(table(spark, d, "symbols")).groupBy("workspace").agg(F.count(F.lit(1)).alias("symbols"))


# --- working memory


def _notes(spark, d):
    return table(spark, d, "notes")


def _note_events(spark, d):
    return table(spark, d, "note_events")


@query(f"WITH {_STATE} SELECT note_id, state, nullif(reason, chr(1)) AS reason, actor, since FROM f")
def note_state_fold(spark, d):
    return memory.fold_states(_note_events(spark, d))


def _recall(sort_by: str, order: str):
    def run(spark, d):
        return memory.recall(_notes(spark, d), _note_events(spark, d), WS, NOW, limit=20, sort_by=sort_by).select("note_id", "kind")

    run.__name__ = f"note_recall_{sort_by}"
    query(f"WITH {_LIVE} SELECT note_id, kind FROM l ORDER BY {order} LIMIT 20")(run)


_recall("relevance", "CASE WHEN kind = 'task' THEN 1.0 ELSE author_trust_score END DESC NULLS LAST, CASE WHEN kind = 'task' THEN 1.0 ELSE decay_score END DESC NULLS LAST, created_at DESC NULLS LAST, note_id DESC")
_recall("recency", "created_at DESC NULLS LAST, note_id DESC")
_recall("priority", "CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, created_at DESC NULLS LAST, note_id DESC")
_recall("chronological", "created_at ASC NULLS LAST, note_id ASC")


@query(f"WITH {_LIVE} SELECT note_id FROM l WHERE priority = 'high' AND created_at >= {NOW} - 40 * 86400 AND content ILIKE '%the%' ORDER BY created_at DESC NULLS LAST, note_id DESC LIMIT 20")
def note_recall_filtered(spark, d):
    return memory.recall(_notes(spark, d), _note_events(spark, d), WS, NOW, query="the", priority="high", limit=20, sort_by="recency", max_age_days=40).select("note_id")


@query(
    f"WITH {_LIVE}, p AS (SELECT note_id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, note_id DESC) AS k FROM l WHERE pinned QUALIFY k <= 4), r AS (SELECT note_id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, note_id DESC) AS k FROM l QUALIFY k <= 20),"
    " a AS (SELECT note_id, 0 AS b, k FROM p UNION ALL SELECT note_id, 1, k FROM r), m AS (SELECT note_id, min((b, k)) AS o FROM a GROUP BY note_id) SELECT note_id, row_number() OVER (ORDER BY o)::INT AS place FROM m QUALIFY place <= 20"
)
def recall_floor_merge(spark, d):
    return memory.recall_with_floor(_notes(spark, d), _note_events(spark, d), WS, NOW, limit=20, sort_by="recency")


_ALL = f"{_NOTE}, {_STATE}, x AS (SELECT note_id FROM f WHERE state = 'expired'), l AS (SELECT * FROM n WHERE valid_until IS NULL AND workspace = '{WS}' AND note_id NOT IN (SELECT note_id FROM x))"


@query(f"WITH {_ALL} SELECT * FROM ((SELECT 0 AS block, note_id FROM l WHERE kind = 'directive' ORDER BY created_at, note_id LIMIT 100) UNION ALL (SELECT 1, note_id FROM l WHERE kind = 'task' AND priority = 'high' ORDER BY created_at DESC, note_id DESC LIMIT 5))")
def boot_set(spark, d):
    return memory.boot_set(_notes(spark, d), _note_events(spark, d), WS).select("block", "note_id")


@query(f"WITH {_ALL}, g AS (SELECT note_id, row_number() OVER (ORDER BY created_at DESC, note_id DESC) AS k, count(*) OVER () > 5 AS t FROM l WHERE kind = 'gotcha') SELECT * FROM ((SELECT 'task' AS part, note_id, false AS truncated FROM l WHERE kind = 'task' ORDER BY created_at DESC, note_id DESC LIMIT 1) UNION ALL (SELECT 'gotcha', note_id, t FROM g WHERE k <= 5))")
def resume_gotchas(spark, d):
    return memory.resume(_notes(spark, d), _note_events(spark, d), WS)


_HL = "CASE kind WHEN 'operational' THEN 14 WHEN 'task' THEN 21 WHEN 'gotcha' THEN 30 WHEN 'finding' THEN 30 WHEN 'reference' THEN 45 WHEN 'decision' THEN 60 END"
_TTL = "CASE kind WHEN 'operational' THEN 60 WHEN 'task' THEN 90 WHEN 'gotcha' THEN 120 WHEN 'finding' THEN 120 WHEN 'reference' THEN 180 WHEN 'decision' THEN 240 END"


@query(f"WITH {_NOTE} SELECT note_id, round(CASE WHEN {_HL} IS NULL OR created_at IS NULL THEN decay_score WHEN created_at >= {NOW} THEN 1.0 ELSE pow(0.5, ({NOW} - created_at) / ({_HL} * 86400.0)) END, 6) AS decay_score FROM n")
def decay_score(spark, d):
    return _round(memory.decay(_notes(spark, d), NOW), "decay_score")


@query(f"WITH {_NOTE}, {_STATE} SELECT note_id, workspace FROM n WHERE valid_until IS NULL AND {NOW} + 4e6 - created_at > {_TTL} * 86400.0 AND note_id NOT IN (SELECT note_id FROM f WHERE state IN ('expired', 'revoked'))")
def expire_ttl(spark, d):
    return memory.expirations(_notes(spark, d), _note_events(spark, d), NOW + 4e6).select("note_id", "workspace")


@query(f"WITH {_NOTE} SELECT workspace, count(*) AS stale, arg_min(note_id, (created_at, note_id)) AS oldest FROM n WHERE valid_until IS NULL AND kind = 'task' AND created_at < {NOW} - 7 * 86400 GROUP BY workspace")
def stale_tasks(spark, d):
    return memory.stale_tasks(_notes(spark, d), NOW)


@query(f"WITH {_NOTE} SELECT workspace, count(*) AS notes, count(*) FILTER (valid_until IS NULL) AS live FROM n GROUP BY workspace")
def note_counts(spark, d):
    return memory.note_counts(_notes(spark, d))


@query(f"WITH {_NOTE} SELECT author_id, count(*) AS notes, round(least(1.0, min(author_trust_score) + 0.05 * (count(*) - 1)), 6) AS trust FROM n WHERE author_id IS NOT NULL GROUP BY author_id")
def author_trust(spark, d):
    return _round(memory.author_trust(_notes(spark, d)), "trust")


def _anchor(spark, d) -> str:
    a = memory.live(_notes(spark, d), WS).select(F.explode("anchors.path").alias("p")).groupBy("p").count()
    return a.orderBy(F.desc("count"), "p").limit(1).head()[0]


_PATH = f"(SELECT p FROM (SELECT unnest(list_transform(anchors, lambda a: a.path)) AS p FROM n WHERE valid_until IS NULL AND workspace = '{WS}') GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)"
_GLOB = "'^' || replace(replace(regexp_replace(t.path, '([.+^$(){{}}|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*'), '?', '.') || '$'"


@query(
    f"WITH {_LIVE}, g AS (SELECT {_PATH} AS p), h AS (SELECT p, string_split(p, '/')[-1] AS b FROM g),"
    " c AS (SELECT note_id, kind, author_trust_score, decay_score, created_at, CASE WHEN list_contains(list_transform(anchors, lambda a: a.path), p) THEN 0 WHEN len(list_filter(triggers, lambda t: t.path IS NOT NULL AND regexp_full_match(p, replace(replace(regexp_replace(t.path, '([.+^$(){}|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*'), '?', '.')))) > 0 THEN 1"
    " WHEN regexp_matches(' ' || coalesce(content, '') || ' ', '[^A-Za-z0-9_]' || regexp_escape(b) || '[^A-Za-z0-9_]') OR regexp_matches(' ' || coalesce(content, '') || ' ', '[^A-Za-z0-9_]' || regexp_escape(p) || '[^A-Za-z0-9_]') THEN 2 END AS tier FROM l, h)"
    " SELECT note_id, tier FROM c WHERE tier IS NOT NULL ORDER BY tier, CASE WHEN kind = 'task' THEN 1.0 ELSE author_trust_score END DESC NULLS LAST, CASE WHEN kind = 'task' THEN 1.0 ELSE decay_score END DESC NULLS LAST, created_at DESC NULLS LAST, note_id DESC LIMIT 10"
)
def path_recall_tiers(spark, d):
    return memory.recall_for_path(_notes(spark, d), _note_events(spark, d), WS, _anchor(spark, d)).select("note_id", "tier")


@query("SELECT workspace, count(*) AS open FROM (SELECT DISTINCT ON (note_id) * FROM notes) WHERE coalesce(scope, 'workspace') <> 'session' OR session_id = 's-000000018898' GROUP BY workspace")
def scope_filter(spark, d):
    rows = memory.unique_notes(_notes(spark, d)).filter(memory.in_session("s-000000018898"))
    return rows.groupBy("workspace").agg(F.count(F.lit(1)).alias("open"))


def _note_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("note_id"), "embedding")


_KNN = "v AS (SELECT vec_id AS note_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]), 9) AS score FROM embeddings WHERE vec_id <> 7)"


@query(f"WITH {_STATE}, {_KNN} SELECT note_id, round(score, 6) AS score FROM v WHERE score >= 0.1 AND note_id IN (SELECT note_id FROM f WHERE state = 'active') ORDER BY v.score DESC, note_id LIMIT 3")
def related_knn(spark, d):
    return _round(memory.related(_note_vectors(spark, d), _note_events(spark, d), 7, least=0.1), "score")


@query(f"WITH {_STATE}, {_KNN} SELECT note_id, round(score, 6) AS score FROM v WHERE score >= -1 AND note_id IN (SELECT note_id FROM f WHERE state = 'revoked') ORDER BY v.score DESC, note_id LIMIT 1")
def revoked_knn(spark, d):
    return _round(memory.related(_note_vectors(spark, d), _note_events(spark, d), 7, state="revoked", limit=1, least=-1.0), "score")


@query(f"WITH {_ALL} SELECT note_id, kind FROM l")
def export_markdown(spark, d):
    return memory.parse_markdown(memory.export_markdown(_notes(spark, d), _note_events(spark, d), WS)).select("note_id", "kind")


@query(
    f"WITH {_NOTE}, {_CUR}, a AS (SELECT note_id, workspace, valid_until, unnest(CASE WHEN len(anchors) > 0 THEN anchors ELSE [NULL] END) AS a FROM n), r AS (SELECT note_id, valid_until, CASE WHEN a.path IS NOT NULL AND cur.path IS NULL THEN 'missing:' || a.path WHEN a.hash <> '' AND sha256(cur.content)[:12] <> a.hash THEN 'changed:' || a.path END AS w FROM a LEFT JOIN cur ON cur.workspace = a.workspace AND cur.path = a.workspace || '/' || a.a.path),"
    " g AS (SELECT note_id, list_sort(list_distinct(coalesce(list(w) FILTER (w IS NOT NULL), [])) || CASE WHEN max(valid_until) IS NOT NULL THEN ['superseded'] ELSE [] END) AS l FROM r GROUP BY note_id) SELECT note_id, array_to_string(l, ',') AS reasons FROM g WHERE len(l) > 0"
)
def note_staleness(spark, d):
    files = catalog.current_files(table(spark, d, "source_files")).select("workspace", "path", F.substring(F.sha2("content", 256), 1, 12).alias("hash"))
    return memory.staleness(_notes(spark, d), files).select("note_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT file_path, string_agg(start_line || '-' || end_line, ', ' ORDER BY start_line, end_line) AS ranges FROM (SELECT DISTINCT file_path, start_line, end_line FROM chunks) GROUP BY file_path")
def eviction_groups(spark, d):
    return memory.eviction_groups(table(spark, d, "chunks"))


# --- triggers, budgets, gate


def _moments(spark, d, event: str = "pre-edit") -> DataFrame:
    e = episodes.unique_episodes(table(spark, d, "episodes")).filter("lower(tool) = 'edit' and file_path is not null and ts is not null")
    return e.select(F.col("id").alias("moment_id"), "workspace", F.lit(event).alias("event"), "file_path", F.lit(None).cast("string").alias("command_verb"), "session_id", F.lit("main").alias("branch"), "ts")


_FIRED = (
    f"WITH {_NOTE}, {_STATE}, l AS (SELECT * FROM n WHERE valid_until IS NULL AND note_id NOT IN (SELECT note_id FROM f WHERE state IN ('expired', 'revoked'))), w AS (SELECT DISTINCT workspace FROM episodes),"
    " t AS (SELECT l.note_id, l.kind, CASE WHEN len(triggers) > 0 THEN list_position(list_transform(triggers, lambda t: t.event = 'session-start' AND t.path IS NULL AND t.symbol IS NULL AND NOT coalesce(t.semantic, false) AND t.command IS NULL AND (t.not_before IS NULL OR 1.425e9 >= t.not_before) AND (t.cooldown IS NULL OR l.last_fired IS NULL OR 1.425e9 - l.last_fired >= t.cooldown)), true)"
    " WHEN kind = 'directive' OR (kind = 'task' AND priority = 'high') THEN 1 END AS p, l.workspace, l.scope, l.branch, l.session_id FROM l JOIN w USING (workspace))"
    " SELECT workspace AS moment_id, note_id, (p - 1)::INT AS trigger_index FROM t WHERE p > 0 AND (coalesce(scope, 'workspace') IN ('workspace', 'repo') OR (scope = 'branch' AND branch = 'main'))"
)


@query(_FIRED)
def trigger_eval(spark, d):
    m = table(spark, d, "episodes").select("workspace").distinct().filter("workspace is not null")
    none = F.lit(None).cast("string")
    m = m.select(F.col("workspace").alias("moment_id"), "workspace", F.lit("session-start").alias("event"), none.alias("file_path"), none.alias("command_verb"), none.alias("session_id"), F.lit("main").alias("branch"), F.lit(NOW).alias("ts"))
    return triggers.fire(_notes(spark, d), _note_events(spark, d), m).select("moment_id", "note_id", "trigger_index")


@query(
    f"WITH {_ALL} SELECT note_id, row_number() OVER (ORDER BY coalesce(list_position(['directive', 'gotcha', 'operational', 'task', 'finding', 'reference'], kind), 7), coalesce(list_position(['high', 'medium', 'low'], priority), 4), CASE WHEN kind = 'task' THEN 0.0 ELSE coalesce(last_fired, last_accessed, 0.0) END DESC, CASE WHEN kind = 'task' THEN -note_id ELSE note_id END)::INT AS place FROM l"
)
def trigger_total_order(spark, d):
    rows = memory.without_expired(memory.live(_notes(spark, d), WS), _note_events(spark, d))
    return rows.select("note_id", F.row_number().over(Window.partitionBy("workspace").orderBy(*triggers.total_order())).alias("place"))


def _items(spark, d) -> DataFrame:
    rows = memory.without_expired(memory.live(_notes(spark, d)), _note_events(spark, d))
    return rows.withColumn("full_text", F.coalesce("content", F.lit(""))).withColumn("index_text", F.concat(F.lit("["), F.col("note_id").cast("string"), F.lit("] "), F.coalesce("title", F.lit(""))))


@query()
def pack_budget(spark, d):
    return triggers.pack(_items(spark, d), "workspace", 800).select("workspace", "note_id", "place", "tier", "tokens")


def _candidates(spark, d) -> DataFrame:
    rows = memory.live(_notes(spark, d)).filter("session_id is not null")
    tier = F.when(F.size("anchors") > 0, "anchor").when(F.size("triggers") > 0, "trigger").otherwise("mention")
    score = F.round(0.2 + 0.8 * F.pmod(F.col("note_id") * 7919, F.lit(1000)) / 1000, 6)
    return rows.select("session_id", F.col("note_id").cast("string").alias("anchor_id"), score.alias("score"), F.lit(0).alias("provenance_rank"), F.coalesce("title", F.lit("")).alias("line"), F.lit(True).alias("is_structural"), tier.alias("tier"))


@query(
    f"WITH {_NOTE}, c AS (SELECT session_id, note_id::VARCHAR AS a, round(0.2 + 0.8 * ((note_id * 7919) % 1000) / 1000, 6) AS s, coalesce(title, '') AS line, len(anchors) = 0 AND len(triggers) = 0 AS weak FROM n WHERE valid_until IS NULL AND session_id IS NOT NULL), e AS (SELECT *, sum(weak::INT) OVER (PARTITION BY session_id ORDER BY s DESC, a) AS w FROM c WHERE s >= 0.35),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, a) AS place FROM e WHERE NOT weak OR w <= 1), z AS (SELECT *, sum(length(line)) OVER (PARTITION BY session_id ORDER BY place) + place - 1 AS size FROM k WHERE place <= 3) SELECT session_id, a AS anchor_id, place::INT AS place, s AS score FROM z WHERE size <= 800"
)
def gate_select(spark, d):
    return triggers.gate(_candidates(spark, d))


@query(
    f"WITH {_EP}, a AS (SELECT session_id, cwd AS anchor_id, max(id) AS seq FROM ep WHERE session_id IS NOT NULL AND cwd IS NOT NULL GROUP BY ALL) SELECT session_id, anchor_id, seq FROM a QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC, anchor_id) <= 30"
)
def session_ring(spark, d):
    e = episodes.unique_episodes(table(spark, d, "episodes")).filter("session_id is not null and cwd is not null")
    return triggers.ring(e.select("session_id", F.col("cwd").alias("anchor_id"), F.col("id").alias("seq")))


def _fires(spark, d) -> DataFrame:
    e = episodes.unique_episodes(table(spark, d, "episodes")).filter("session_id is not null and ts is not null")
    event = F.when(F.pmod("id", F.lit(10)) == 0, "prompt-submit").when(F.pmod("id", F.lit(97)) == 0, "post-compaction").otherwise("pre-edit")
    return e.select("session_id", F.col("id").alias("seq"), "ts", event.alias("event"), F.pmod(F.xxhash64("cmd_raw"), F.lit(50)).alias("note_id"), F.lit(120).alias("tokens"), (F.pmod("id", F.lit(3)) == 0).alias("semantic"))


@query()
def fire_ledger(spark, d):
    return triggers.ledger(_fires(spark, d))


# --- episodes


@query(
    f"WITH {_EP}, m AS (SELECT id, rc, is_error, interrupted, coalesce(stdout, '') || chr(10) || coalesce(stderr, '') AS o FROM ep), k AS (SELECT *, "
    + ", ".join(f"regexp_matches(o, '(?m){p}') AS {k}" for k, p in (("fa", "|".join(p for _, p, kind in commands.MARKERS if kind == "failure")), ("su", "|".join(p for _, p, kind in commands.MARKERS if kind == "success"))))
    + ", CASE WHEN coalesce(interrupted, false) THEN 'cancelled' WHEN rc IS NULL THEN 'unknown' WHEN rc < 0 OR rc > 128 THEN 'signal' ELSE 'normal' END AS termination FROM m)"
    " SELECT id, termination, CASE WHEN termination IN ('signal', 'cancelled') THEN 'interrupted' WHEN fa THEN CASE WHEN rc IS NULL OR rc = 0 THEN 'soft_failure' ELSE 'failure' END WHEN su THEN 'success' WHEN rc IS NOT NULL THEN CASE WHEN rc = 0 THEN 'success' ELSE 'failure' END WHEN coalesce(is_error, false) THEN 'failure' ELSE 'unknown' END AS outcome FROM k"
)
def outcome_cascade(spark, d):
    return episodes.derived(table(spark, d, "episodes")).select("id", "termination", "outcome")


@query(
    f"WITH {_EP}, o AS (SELECT coalesce(stdout, '') || chr(10) || coalesce(stderr, '') AS o FROM ep) "
    + " UNION ALL ".join(f"SELECT '{i}' AS marker, count(*) AS n FROM o WHERE regexp_matches(o, '(?m){p}') HAVING count(*) > 0" for i, p, _ in commands.MARKERS)
)
def markers_match(spark, d):
    rows = episodes.derived(table(spark, d, "episodes"))
    return rows.select(F.explode("markers").alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


@query()
def command_normalize(spark, d):
    rows = episodes.unique_episodes(table(spark, d, "episodes")).select("cmd_raw").distinct().select("cmd_raw", commands.normalize_command(F.col("cmd_raw")).alias("n"))
    return rows.select("cmd_raw", "n.verb", F.array_join("n.flags", " ").alias("flags"), F.array_join("n.args", " ").alias("args"), F.array_join("n.arg_classes", " ").alias("classes"))


@query()
def command_similarity(spark, d):
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    rows = episodes.unique_episodes(table(spark, d, "episodes")).filter("session_id is not null and cmd_raw <> ''").withColumn("before", F.lag("cmd_raw").over(w)).filter("before is not null")
    return rows.select("id", F.round(commands.command_similarity(F.col("before"), F.col("cmd_raw")), 6).alias("similarity"))


@query(
    f"WITH {_EP}, t AS (SELECT id, list_distinct(string_split(cmd_raw, ' ')) AS a, list_distinct(string_split(lag(cmd_raw) OVER (PARTITION BY session_id ORDER BY ts, id), ' ')) AS b FROM ep WHERE session_id IS NOT NULL AND ts IS NOT NULL AND cmd_raw IS NOT NULL) SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS j FROM t WHERE b IS NOT NULL"
)
def token_jaccard(spark, d):
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    rows = episodes.unique_episodes(table(spark, d, "episodes")).filter("session_id is not null and ts is not null and cmd_raw is not null")
    rows = rows.withColumn("b", F.lag("cmd_raw").over(w)).filter("b is not null")
    return rows.select("id", F.round(text.jaccard(F.split("cmd_raw", " "), F.split("b", " ")), 6).alias("j"))


@query(f"WITH {_EP} SELECT id FROM ep WHERE workspace = '{WS}' AND ts BETWEEN 1.4205e9 AND 1.4215e9 ORDER BY ts DESC NULLS LAST, id DESC LIMIT 50")
def list_episodes(spark, d):
    return episodes.list_episodes(table(spark, d, "episodes"), WS, since=1.4205e9, until=1.4215e9).select("id")


@query(f"WITH {_EP} SELECT id FROM ep WHERE ts >= 1.4215e9 - 20 * 86400 QUALIFY row_number() OVER (PARTITION BY workspace ORDER BY ts DESC NULLS LAST, id DESC) <= 100")
def retention_ring(spark, d):
    return episodes.retained(table(spark, d, "episodes"), 1.4215e9, rows=100, days=20).select("id")


@query(f"WITH {_EP} SELECT workspace, count(*) AS episodes FROM ep GROUP BY workspace")
def episode_counts(spark, d):
    return episodes.episode_counts(table(spark, d, "episodes"))


@query()
def arcs_batch(spark, d):
    found = episodes.arcs(table(spark, d, "episodes"))
    return found.select("session_id", F.array_join(F.transform("failure_ids", lambda x: x.cast("string")), ",").alias("failures"), "success_id", "confidence", F.array_join("changed", ",").alias("changed"))


@query()
def arcs_listed(spark, d):
    e = table(spark, d, "episodes")
    return episodes.list_arcs(episodes.arcs(e), e)


_SESSION = "o AS (SELECT *, CASE WHEN tt - lag(tt) OVER (PARTITION BY k ORDER BY tt) < INTERVAL {1} THEN 0 ELSE 1 END AS b FROM {0}), g AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY tt ROWS UNBOUNDED PRECEDING) AS s FROM o)"


@query(
    "WITH c AS (SELECT user_id AS k, ts AS tt FROM events), "
    + _SESSION.format("c", "'1 hour'")
    + " SELECT k AS user_id, epoch(date_trunc('second', min(tt)))::BIGINT AS started, epoch(date_trunc('second', max(tt) + INTERVAL '1 hour'))::BIGINT AS ended, count(*) AS changes FROM g GROUP BY k, s"
)
def debounce_sessions(spark, d):
    e = table(spark, d, "events")
    return sessions.debounced(e, "user_id", "ts", "event_type", "1 hour").select("user_id", "started", "ended", "changes")


@query(
    "WITH c AS (SELECT event_type AS k, ts AS tt, user_id FROM events), "
    + _SESSION.format("c", "'1 hour'")
    + " SELECT k AS event_type, epoch(date_trunc('second', min(tt)))::BIGINT AS started, epoch(date_trunc('second', max(tt) + INTERVAL '1 hour'))::BIGINT AS ended, count(DISTINCT user_id)::INT AS keys FROM g GROUP BY k, s HAVING count(DISTINCT user_id) > 3"
)
def burst_detect(spark, d):
    return sessions.bursts(table(spark, d, "events"), "user_id", "ts", "event_type", "1 hour", least=3)


@query(
    f"WITH {_EP}, c AS (SELECT session_id, id AS seq, ts, CASE WHEN id % 3 = 0 THEN 'retrieval' ELSE 'tool' END AS kind, CASE WHEN id % 3 = 0 THEN cwd END AS ck, 500 AS tokens FROM ep WHERE session_id IS NOT NULL AND ts IS NOT NULL), f AS (SELECT *, CASE WHEN ck IS NOT NULL AND row_number() OVER (PARTITION BY session_id, ck ORDER BY seq) = 1 THEN tokens ELSE 0 END AS new FROM c),"
    " r AS (SELECT session_id, seq, sum(new) OVER w AS tokens, count(*) OVER w AS tool_calls, sum((kind = 'retrieval')::INT) OVER w AS retrievals, ts - min(ts) OVER w AS elapsed FROM f WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT session_id, seq, tokens::BIGINT AS tokens, tool_calls, tokens >= 40000 OR tool_calls > 10 OR retrievals > 1 OR elapsed >= 180 AS should_evict FROM r"
)
def eviction_pressure(spark, d):
    e = episodes.unique_episodes(table(spark, d, "episodes")).filter("session_id is not null and ts is not null")
    third = F.pmod("id", F.lit(3)) == 0
    calls = e.select("session_id", F.col("id").alias("seq"), "ts", F.when(third, "retrieval").otherwise("tool").alias("kind"), F.when(third, F.col("cwd")).alias("chunk_key"), F.lit(500).alias("tokens"))
    return advisor.running_pressure(calls).select("session_id", "seq", "tokens", "tool_calls", "should_evict")


@query("SELECT doc_id, CASE WHEN text IS NOT NULL THEN greatest(1, length(text) // 4) END::INT AS tokens FROM documents")
def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", F.when(F.col("text").isNotNull(), text.token_estimate(F.col("text"))).alias("tokens"))


@query(
    "WITH s AS (SELECT DISTINCT * FROM daemon_status), l AS (SELECT regexp_replace(workspace_root, '/+$', '') AS workspace, unnest(languages) AS l FROM s) SELECT workspace, l.language AS language, max(l.files) AS files, max(l.chunks) AS chunks FROM l GROUP BY ALL"
)
def status_languages(spark, d):
    s = table(spark, d, "daemon_status").dropDuplicates(["run_id", "workspace_root", "last_indexed", "phase"])
    rows = s.select(F.regexp_replace("workspace_root", "/+$", "").alias("workspace"), F.explode("languages").alias("l"))
    return rows.groupBy("workspace", F.col("l.language").alias("language")).agg(F.max("l.files").alias("files"), F.max("l.chunks").alias("chunks"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?:[A-Za-z0-9_.\\-]+/)+[A-Za-z0-9_.\\-]+\\.[A-Za-z0-9]{1,6}'))), ' ') AS paths FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(?:[A-Za-z0-9_.\\-]+/)+[A-Za-z0-9_.\\-]+\\.[A-Za-z0-9]{1,6}')")
def named_paths(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(F.array_sort(binding.file_paths(F.col("text"))), " ").alias("paths")).filter("paths <> ''")


@query("SELECT DISTINCT ON (note_id) note_id, length(trim(regexp_replace(user_quote, '\\s+', ' ', 'g'))) >= 12 AND contains(trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')), trim(regexp_replace(user_quote, '\\s+', ' ', 'g'))) AS bound FROM notes WHERE user_quote IS NOT NULL")
def quote_binding(spark, d):
    n = memory.unique_notes(_notes(spark, d)).filter("user_quote is not null")
    return n.select("note_id", memory.bind_quote(F.coalesce("content", F.lit("")), F.col("user_quote")).alias("bound"))


@query(f"WITH {_NOTE} SELECT note_id, content FROM n WHERE content IS NOT NULL")
def encryption_roundtrip(spark, d):
    key = F.lit("0123456789abcdef")
    n = memory.unique_notes(_notes(spark, d)).filter("content is not null")
    return n.select("note_id", binding.decrypt(binding.encrypt(F.col("content"), key), key).alias("content"))


@query("SELECT workspace, coalesce(len(list_distinct(list(path) FILTER (regexp_matches(path, '/(package\\.json|pyproject\\.toml|go\\.mod|Cargo\\.toml|pom\\.xml)$')))), 0) >= 3 AS monorepo FROM source_files GROUP BY workspace")
def monorepos(spark, d):
    files = table(spark, d, "source_files").groupBy("workspace").agg(F.collect_set(F.when(F.col("path").rlike(r"(package\.json|\.toml|go\.(mod|work)|pom\.xml|lerna\.json|pnpm-workspace\.yaml|nx\.json|turbo\.json|WORKSPACE)$"), F.col("path"))).alias("p"))
    return files.select("workspace", binding.is_monorepo(F.col("p")).alias("monorepo"))


import lodeweave.queries_more  # noqa: E402, F401 - registers its queries, with what stands above
import lodeweave.queries_notes  # noqa: E402, F401
