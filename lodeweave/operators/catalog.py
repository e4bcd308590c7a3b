"""The chunk store as tables: manifests, incremental changes, lookups, spans, statistics, corpus fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.text import base_name, directories, glob_regex
from lodeweave.operators import quality as q
from lodeweave.operators.chunking import lines_of
from lodeweave.plans.runtime import small

MOST_IDS, MOST_NEAREST = 20, 5
# What is indexed, and what never is.
EXTENSIONS = ["py", "java", "js", "jsx", "ts", "tsx", "go", "rs", "c", "h", "cc", "cpp", "hpp", "cs", "rb", "php", "kt", "swift", "scala", "sh", "md", "rst", "txt", "html", "json", "yaml", "yml", "toml", "properties", "sql", "zig"]
EXCLUDED_DIRS = [".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".idea", "dist", "build", "target"]


def current_files(files: DataFrame) -> DataFrame:
    """The newest version of each path; of equal ones the greatest content."""
    newest = F.struct(F.coalesce("mtime", F.lit(float("-inf"))), "content")
    return files.groupBy("workspace", "path").agg(F.max_by(F.struct("mtime", "content"), newest).alias("r")).select("workspace", "path", "r.mtime", "r.content")


def eligible(path: Column, extra_dirs: list[str] = (), globs: list[str] = (), regexes: list[str] = ()) -> Column:
    """Whether a path is to be indexed: by extension, kind of file, excluded directories, ignore globs and expressions."""
    extension = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    out = extension.isin(EXTENSIONS) & ~q.is_config_file(path) & ~q.is_generated_file(path) & ~q.is_artifact_file(path)
    out = out & ~F.arrays_overlap(directories(path), q.literals([*EXCLUDED_DIRS, *extra_dirs]))
    for g in globs:
        out = out & ~ignored(path, g)
    for r in regexes:
        out = out & ~path.rlike(r)
    return F.coalesce(out, F.lit(False))


def ignored(path: Column, pattern: str) -> Column:
    """An ignore pattern: a glob of the file name or the whole path, or with a slash at its end a directory."""
    if pattern.endswith("/"):
        return F.array_contains(directories(path), pattern.rstrip("/").lower())
    return base_name(path).rlike(glob_regex(pattern)) | path.rlike(glob_regex(pattern))


def manifest_diff(seen: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, change): added, modified or removed, of two (path, mtime) tables."""
    a, b = seen.select("path", F.col("mtime").alias("_new")), manifest.select("path", F.col("mtime").alias("_old"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_new") != F.col("_old"), "modified")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change is not null")


def replace_files(chunks: DataFrame, changed: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """chunks with those of the changed paths replaced by new ones."""
    return chunks.join(small(changed.select(F.col("path").alias("file_path")).distinct()), "file_path", "left_anti").unionByName(new_chunks)


def prune_orphans(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunks whose file is still there."""
    return chunks.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")


def orphans(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")


def pending_purpose(chunks: DataFrame, purpose: DataFrame) -> DataFrame:
    """(file_path, missing): files with symbol-bearing chunks that have no purpose vector yet."""
    need = chunks.filter(q.is_symbol_bearing(F.col("symbol_name"), F.col("node_type"))).select("chunk_id", "file_path").distinct()
    return need.join(purpose.select("chunk_id"), "chunk_id", "left_anti").groupBy("file_path").agg(F.count(F.lit(1)).alias("missing"))


def chunks_of_files(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """chunks of the files of paths(path)."""
    return chunks.join(small(paths.select(F.col("path").alias("file_path")).distinct()), "file_path", "left_semi")


def readme_snippets(docs: DataFrame, path: str = "path", text: str = "text", chars: int = 1500) -> DataFrame:
    """docs whose file is a readme, with snippet: the first characters of the text."""
    return docs.filter(F.lower(path).rlike(r"(^|/)readme[^/]*$") & F.col(text).isNotNull()).withColumn("snippet", F.substring(F.col(text), 1, chars))


def status(chunks: DataFrame, symbols: DataFrame, notes: DataFrame, episodes: DataFrame) -> DataFrame:
    """(workspace, files, chunks, symbols, notes, episodes): what there is of each indexed workspace."""
    out = chunks.select("workspace", "chunk_id", "file_path").dropDuplicates(["chunk_id"]).groupBy("workspace").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"))
    others = [
        (symbols.select("workspace", "name", "kind", "file_path", "start_line").distinct(), "symbols"),
        (notes.filter("valid_until is null").select("workspace", "note_id").distinct(), "notes"),
        (episodes.select("workspace", "id").distinct(), "episodes"),
    ]
    for rows, name in others:
        out = out.join(rows.groupBy("workspace").agg(F.count(F.lit(1)).alias(name)), "workspace", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def codebase_map(files: DataFrame, chunks: DataFrame, most: int = 10) -> DataFrame:
    """(workspace, files, languages, directories, readme): what a summary of each workspace is made of, of files(workspace, path, text).

    languages are the most frequent by chunks, directories the largest at the top of the tree, readme the beginning of the first one.
    """
    below = F.when(F.col("path").startswith(F.concat("workspace", F.lit("/"))), F.substring("path", F.length("workspace") + 2, F.length("path"))).otherwise(F.col("path"))
    rows = files.select("workspace", "path", "text", below.alias("_b")).dropDuplicates(["workspace", "path"])
    size = rows.groupBy("workspace").agg(F.count(F.lit(1)).alias("files"), F.min_by(F.substring("text", 1, 1500), F.when(F.lower("_b").rlike(r"(^|/)readme[^/]*$"), F.col("path"))).alias("readme"))

    def leading(counts: DataFrame, name: str, out: str) -> DataFrame:
        w = Window.partitionBy("workspace").orderBy(F.desc("n"), name)  # of a workspace as many rows as it has languages or top directories
        kept = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
        return kept.groupBy("workspace").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", name))), lambda x: x[name]), ",").alias(out))

    n = F.count(F.lit(1)).alias("n")
    languages = chunks.filter("language is not null").select("workspace", "language", "chunk_id").distinct().groupBy("workspace", "language").agg(n)
    tops = rows.filter(F.contains("_b", F.lit("/"))).groupBy("workspace", F.split("_b", "/")[0].alias("directory")).agg(n)
    return size.join(leading(languages, "language", "languages"), "workspace", "left").join(leading(tops, "directory", "directories"), "workspace", "left")


def fetch(chunks: DataFrame, ids: list[str], most: int = MOST_IDS) -> DataFrame:
    """(pos, requested_id, found, reason, nearest, content) of chunks by id, in the order asked for.

    A miss is misaligned if its file has chunks (nearest then names up to five by overlap, distance and id), else file_changed.
    """
    spark = chunks.sparkSession
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(ids[:most])], "pos int, requested_id string")
    shape = r"^(.*):(\d+)-(\d+)$"
    asked = asked.select("pos", "requested_id", F.regexp_extract("requested_id", shape, 1).alias("file_path"), *[F.regexp_extract("requested_id", shape, i).try_cast("int").alias(n) for i, n in ((2, "_first"), (3, "_last"))])
    unique = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", "file_path", "start_line", "end_line", "content")
    hits = unique.join(F.broadcast(asked.select("pos", "requested_id")), F.col("chunk_id") == F.col("requested_id")).select("pos", F.col("content").alias("_content"), F.lit(True).alias("_hit"))
    near = unique.drop("content").join(F.broadcast(asked), "file_path")
    distance = F.greatest(F.lit(0), F.col("start_line") - F.col("_last"), F.col("_first") - F.col("end_line"))
    order = Window.partitionBy("pos").orderBy(distance, F.abs(F.col("start_line") - F.col("_first")), "chunk_id")
    near = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= MOST_NEAREST)
    near = near.groupBy("pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("_nearest"))
    out = asked.join(hits, "pos", "left").join(near, "pos", "left")
    miss = F.when(F.col("_nearest").isNotNull(), "misaligned").otherwise("file_changed")
    found = F.coalesce("_hit", F.lit(False))
    return out.select("pos", "requested_id", found.alias("found"), F.when(~found, miss).alias("reason"), F.when(~found, F.col("_nearest")).alias("nearest"), F.col("_content").alias("content"))


def covering_spans(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """(file_path, line, chunk_id): the smallest chunk that holds each (file_path, line); no row if none does."""
    unique = chunks.select("chunk_id", "file_path", "start_line", "end_line").dropDuplicates(["chunk_id"])
    held = places.select("file_path", "line").distinct().join(unique, "file_path").filter("line between start_line and end_line")
    smallest = F.min_by("chunk_id", F.struct(F.col("end_line") - F.col("start_line"), F.col("chunk_id")))
    return held.groupBy("file_path", "line").agg(smallest.alias("chunk_id"))


def language_stats(chunks: DataFrame) -> DataFrame:
    """(language, files, chunks) of distinct chunks."""
    per = chunks.select("chunk_id", "language", "file_path").distinct()
    return per.groupBy("language").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"))


def apply_delta(stats: DataFrame, delta: DataFrame) -> DataFrame:
    """language_stats after adding (language, chunks) of signed counts; languages without chunks go."""
    both = stats.select("language", "chunks").unionByName(delta.select("language", "chunks"))
    return both.groupBy("language").agg(F.sum("chunks").alias("chunks")).filter("chunks > 0")


def fingerprint(files: DataFrame) -> DataFrame:
    """One row about a corpus of (path, language, text): languages, size, documentation, length."""
    n = F.count(F.lit(1))
    lines = F.size(lines_of(F.coalesce("text", F.lit(""))))
    documented = F.coalesce("text", F.lit("")).rlike(r'"""|/\*\*|///|(?m)^\s*#\s|^\s*//')
    out = files.agg(
        n.alias("files"),
        F.mode("language", deterministic=True).alias("language"),
        F.round(F.avg(documented.cast("int")), 2).alias("doc_ratio"),
        F.round(F.avg(lines), 2).alias("avg_lines"),
        F.countDistinct("language").alias("languages"),
    )
    size = F.when(F.col("files") < 100, "small").when(F.col("files") < 1000, "medium").otherwise("large")
    kind = F.when(F.col("avg_lines") < 100, "low").when(F.col("avg_lines") < 300, "medium").otherwise("high")
    return out.withColumn("size_class", size).withColumn("complexity", kind)


def strategy(print_: DataFrame) -> DataFrame:
    """The dense weight that fits a fingerprint: more for documented corpora, less for large ones."""
    base = F.when(F.col("doc_ratio") >= 0.6, 0.75).when(F.col("doc_ratio") >= 0.3, 0.70).otherwise(0.55)
    size = F.when(F.col("size_class") == "large", -0.05).otherwise(0.0)
    weight = F.round(F.greatest(F.lit(0.4), F.least(F.lit(0.85), base + size)), 2)
    return print_.select("language", "size_class", "complexity", weight.alias("dense_weight"))


def domain_terms(docs: DataFrame, text: str = "text", least: int = 3, most: int = 20) -> DataFrame:
    """(term, n): capitalised words that stand at least `least` times, the most frequent first."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]{3,}(?![A-Za-z0-9_])"), F.lit(0))
    counts = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(most)


def directory_sketch(files: DataFrame, depth: int = 3, per_dir: int = 15, most: int = 120) -> DataFrame:
    """(directory, path): a sample of the tree, at most `depth` levels, `per_dir` files a directory and `most` in all, by name."""
    parts = F.split("path", "/")
    rows = files.select("path").distinct().filter(F.size(parts) <= depth + 1)
    rows = rows.withColumn("directory", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    w = Window.partitionBy("directory").orderBy("path")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_dir).select("directory", "path").orderBy("path").limit(most)


def extension_languages(files: DataFrame) -> DataFrame:
    """(extension, files), most frequent first."""
    ext = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    return files.select("path").distinct().select(ext.alias("extension")).filter("extension <> ''").groupBy("extension").agg(F.count(F.lit(1)).alias("files"))


def frameworks(files: DataFrame, signals: dict[str, str]) -> DataFrame:
    """(framework): those whose signal stands in the text of a dependency file."""
    spark = files.sparkSession
    known = spark.createDataFrame(list(signals.items()), "framework string, signal string")
    deps = files.filter(base_name(F.col("path")).rlike(r"^(requirements.*\.txt|package\.json|pyproject\.toml|pom\.xml|build\.gradle|go\.mod|Cargo\.toml)$"))
    return deps.join(F.broadcast(known), F.lower("text").contains(F.col("signal"))).select("framework").distinct()


def proxy_anchors(files: DataFrame, manifest: list[tuple[str, str]], most: int = 20) -> DataFrame:
    """(domain, glob, path): paths that match the globs of a manifest, in its order, each path once."""
    spark = files.sparkSession
    table = spark.createDataFrame([(i, d, g, glob_regex(g)) for i, (d, g) in enumerate(manifest)], "pos int, domain string, glob string, regex string")
    hits = files.select("path").distinct().join(F.broadcast(table), F.expr("path rlike regex"))
    first = hits.groupBy("path").agg(F.min_by(F.struct("pos", "domain", "glob"), "pos").alias("m"))
    return first.select("m.pos", "m.domain", "m.glob", "path").orderBy("pos", "path").limit(most).drop("pos")


def tool_fingerprint(*parts: str) -> Column:
    """16 digits that change when schema, parsers or model do."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.lit(p) for p in parts]), 256), 1, 16)
