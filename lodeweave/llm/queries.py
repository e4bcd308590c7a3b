"""The queries of the training-data operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.docs import documented_functions
from lodeweave.llm.mix import mix_sources, source_name
from lodeweave.llm.near_dup import expand_pairs, near_duplicates
from lodeweave.llm.origin import file_origins
from lodeweave.llm.pack import pack_documents
from lodeweave.llm.parse import checked_files, invalid_rates
from lodeweave.llm.runs import collapse_runs
from lodeweave.llm.secrets import credentials
from lodeweave.llm.spans import linked_pairs, shared_share, shared_spans
from lodeweave.llm.split import split_oversized
from lodeweave.plans.runtime import table


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunks"), table(spark, d, "piece_limits"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).select("chunk_id").distinct()


def p1_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of each chunk that is cut: whether all of its pieces fit, are numbered without a gap, stand in it, and reach from its beginning to its end."""
    pieces = p1_pieces(spark, d)
    limits = table(spark, d, "piece_limits").groupBy("node_type").agg(F.min("max_chars").alias("max_chars"))
    whole = table(spark, d, "chunks").select("chunk_id", F.col("content").alias("whole")).dropDuplicates(["chunk_id"])
    rows = pieces.join(F.broadcast(limits), "node_type").join(whole, "chunk_id")
    last = F.max_by(F.col("whole").endswith(F.col("content")), "piece_no")
    return rows.groupBy("chunk_id").agg(
        F.every(F.length("content") <= F.col("max_chars")).alias("fits"),
        (F.max("piece_no") + 1 == F.count(F.lit(1))).alias("numbered"),
        F.every(F.contains("whole", "content")).alias("inside"),
        (F.min_by(F.col("whole").startswith(F.col("content")), "piece_no") & last & (F.sum(F.length("content")) + F.count(F.lit(1)) - 1 >= F.max(F.length("whole")))).alias("complete"),
    )


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pairs(spark, d).select("chunk_id").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = expand_pairs(*near_duplicates(table(spark, d, "notes")))
    return pairs.select(F.col("a").alias("note_id_a"), F.col("b").alias("note_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a note: its class (notes of the same words) and to how many other classes it is linked."""
    members, links = near_duplicates(table(spark, d, "notes"))
    ends = links.select("grp", F.col("class_a").alias("class_id")).unionByName(links.select("grp", F.col("class_b").alias("class_id")))
    degree = ends.groupBy("grp", "class_id").agg(F.count(F.lit(1)).alias("links"))
    out = members.join(degree, ["grp", "class_id"], "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    return out.select(F.col("grp").alias("workspace"), F.col("rec_id").alias("note_id"), "class_id", "links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return checked_files(table(spark, d, "source_files"), costs=None).filter("edits > 0").select("file_path").distinct()


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid_rates(checked_files(table(spark, d, "source_files"), costs=None), table(spark, d, "daemon_status"))


def p4_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of files that do not parse: by file and language, how many and how much text."""
    bad = checked_files(table(spark, d, "source_files"), costs=None).filter("edits > 0").select("file_path", "kind")
    chunks = table(spark, d, "chunks").select("chunk_id", "file_path", "language", F.length("content").alias("chars")).dropDuplicates(["chunk_id"])
    return chunks.join(bad, "file_path").groupBy("file_path", "language", "kind").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chars").alias("chars"))


def p5_origins(spark: SparkSession, d: str) -> DataFrame:
    return file_origins(table(spark, d, "source_files"), table(spark, d, "upstream_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_origins(spark, d).filter("origin <> 'hand-written'").select("file_path").distinct()


def p5_hand_written(spark: SparkSession, d: str) -> DataFrame:
    """What remains of chunks: chunks of hand-written files, by file."""
    hand = p5_origins(spark, d).filter("origin = 'hand-written'").select("file_path")
    chunks = table(spark, d, "chunks").select("chunk_id", "file_path", "language").dropDuplicates(["chunk_id"])
    return chunks.join(hand, "file_path", "left_semi").groupBy("file_path", "language").agg(F.count(F.lit(1)).alias("chunks"))


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(table(spark, d, "episodes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_runs(spark, d).select("session_id", "first_id", "last_id")


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("origin"), F.col("chunk_id").alias("record_key"), F.col("content").alias("text"))
    episodes = table(spark, d, "episodes").select(F.lit("episodes").alias("origin"), F.col("id").cast("string").alias("record_key"), F.col("cmd_raw").alias("text"))
    return credentials(chunks.unionByName(episodes))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_redacted(spark, d).select("origin", "record_key", F.explode("found.line_no").alias("line_no")).distinct()


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    """Of each capacity: documents, containers, the least number that their tokens need, and the share of unused space."""
    packed = p8_pack(spark, d)
    caps = table(spark, d, "pack_capacities").groupBy("container").agg(F.max("capacity_tokens").alias("capacity"))
    each = packed.groupBy("container", "container_no").agg(F.sum("tokens").alias("tokens"))
    used = each.groupBy("container").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return used.join(F.broadcast(caps), "container").select("container", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "fullest", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of each capacity: documents that are in a container, overfull containers, documents cut although they fit, and those whose pieces leave a gap."""
    packed = p8_pack(spark, d)
    caps = table(spark, d, "pack_capacities").groupBy("container").agg(F.max("capacity_tokens").alias("capacity"))
    over = packed.groupBy("container", "container_no").agg(F.sum("tokens").alias("t")).join(F.broadcast(caps), "container").groupBy("container").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    docs = packed.groupBy("container", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max(F.col("token_from") + F.col("tokens")).alias("end")).join(F.broadcast(caps), "container")
    docs = docs.groupBy("container").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity"))).alias("cut"), F.count_if(F.col("t") != F.col("end")).alias("gaps"))
    return docs.join(over, "container")


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Of each target source: its limit of repeats, documents used more often, and documents of another source among its own."""
    docs = table(spark, d, "documents")
    chosen, report = mix_sources(docs, table(spark, d, "mix_targets"))
    own = docs.select("doc_id", source_name(F.col("source")).alias("own")).distinct()
    used = chosen.join(own, "doc_id").join(report.select("source", "max_repeats"), "source").groupBy("source").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("own") != F.col("source")).alias("of_others"))
    out = report.select("source", F.round("target_share", 6).alias("target_share"), "max_repeats").join(used, "source", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("too_often", "of_others")})


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_pairs(*shared_spans(table(spark, d, "documents")))


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return shared_share(docs, *shared_spans(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


# a lower-case hexadecimal id: six or more characters, one of the first six or a later one a digit
_HEX = "|".join(["[0-9][0-9a-f]{5,}", "[a-f][0-9][0-9a-f]{4,}", "[a-f]{2}[0-9][0-9a-f]{3,}", "[a-f]{3}[0-9][0-9a-f]{2,}", "[a-f]{4}[0-9][0-9a-f]+", "[a-f]{5,}[0-9][0-9a-f]*"])
_CANON = rf"trim(regexp_replace(regexp_replace(regexp_replace(cmd_raw, '\b({_HEX})\b', '0', 'g'), '[0-9]+', '0', 'g'), '\s+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT DISTINCT chunk_id FROM chunks JOIN piece_limits USING (node_type) WHERE length(content) > max_chars",
        "p1_whole": """
            SELECT DISTINCT chunk_id, true AS fits, true AS numbered, true AS inside, true AS complete FROM chunks JOIN piece_limits USING (node_type) WHERE length(content) > max_chars""",
        "p8_whole": """
            SELECT container, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, 0 AS overfull, 0 AS cut, 0 AS gaps FROM pack_capacities WHERE capacity_tokens >= 1 GROUP BY container""",
        "p9_kept": """
            SELECT regexp_replace(lower(trim(source)), '[\\s\\-]+', '_', 'g') AS source, round(sum(target_share), 6) AS target_share, max(max_repeats)::BIGINT AS max_repeats, 0 AS too_often, 0 AS of_others
            FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats >= 1 GROUP BY 1""",
        "p3_groups": """
            WITH n AS (SELECT DISTINCT note_id, workspace, list_sort(list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+'))) AS w FROM notes WHERE content IS NOT NULL AND workspace IS NOT NULL),
            m AS (SELECT workspace, note_id, w, min(note_id) OVER (PARTITION BY workspace, w) AS class_id FROM n WHERE len(w) > 0), c AS (SELECT DISTINCT workspace, class_id, w FROM m),
            p AS (SELECT a.workspace, a.class_id AS x, b.class_id AS y FROM c a JOIN c b ON a.workspace = b.workspace AND a.class_id < b.class_id
                  AND 10 * len(list_intersect(a.w, b.w)) >= 7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
            g AS (SELECT workspace, class_id, count(*) AS links FROM (SELECT workspace, x AS class_id FROM p UNION ALL SELECT workspace, y FROM p) GROUP BY ALL)
            SELECT workspace, note_id, class_id, coalesce(links, 0) AS links FROM m LEFT JOIN g USING (workspace, class_id)""",
        "p6_runs": f"""
            WITH e AS (SELECT DISTINCT session_id, ts, id, CASE WHEN lower(tool) = 'edit' OR cmd_raw IS NULL OR trim(cmd_raw) = '' THEN NULL ELSE {_CANON} END AS c
                       FROM episodes WHERE session_id IS NOT NULL AND ts IS NOT NULL),
            r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) - row_number() OVER (PARTITION BY session_id, c ORDER BY ts, id) AS g FROM e)
            SELECT session_id, arg_min(id, (ts, id)) AS first_id, arg_max(id, (ts, id)) AS last_id, count(*) AS run_length, min(ts) AS start_ts, max(ts) AS end_ts, max(ts) - min(ts) AS duration_s, c AS command
            FROM r WHERE c IS NOT NULL GROUP BY session_id, c, g HAVING count(*) > 1""",
        "p3_found": """
            WITH n AS (SELECT DISTINCT note_id, workspace, list_sort(list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+'))) AS w FROM notes WHERE content IS NOT NULL),
            p AS (SELECT a.note_id AS x, b.note_id AS y, len(list_intersect(a.w, b.w)) AS c, len(a.w) + len(b.w) AS s
                  FROM n a JOIN n b ON a.workspace = b.workspace AND a.note_id < b.note_id AND 10 * least(len(a.w), len(b.w)) >= 7 * greatest(len(a.w), len(b.w))
                  WHERE len(a.w) > 0 AND len(b.w) > 0)
            SELECT DISTINCT x AS note_id_a, y AS note_id_b FROM p WHERE 10 * c >= 7 * (s - c)""",
        "p6_found": f"""
            WITH e AS (SELECT DISTINCT session_id, ts, id, CASE WHEN lower(tool) = 'edit' OR cmd_raw IS NULL OR trim(cmd_raw) = '' THEN NULL ELSE {_CANON} END AS c
                       FROM episodes WHERE session_id IS NOT NULL AND ts IS NOT NULL),
            r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) - row_number() OVER (PARTITION BY session_id, c ORDER BY ts, id) AS g FROM e)
            SELECT session_id, arg_min(id, (ts, id)) AS first_id, arg_max(id, (ts, id)) AS last_id FROM r WHERE c IS NOT NULL
            GROUP BY session_id, c, g HAVING count(*) > 1""",
    }
