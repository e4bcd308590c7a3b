"""Reading source trees and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.catalog import eligible


def read_tree(spark: SparkSession, folder: str, globs: list[str] = (), regexes: list[str] = (), extra_dirs: list[str] = ()) -> DataFrame:
    """(path, mtime, content) of the eligible files below a folder; contents of the others are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", "^file:(//)?", "")
    rows = files.select(path.alias("path"), F.col("modificationTime").cast("double").alias("mtime"), "content")
    return rows.filter(eligible(F.col("path"), list(extra_dirs), list(globs), list(regexes)))


def stream_tree(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """The same as a stream of new files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.col("modificationTime").cast("double").alias("mtime"), "content")


def as_text(files: DataFrame) -> DataFrame:
    """files with text: content as UTF-8, without byte order mark and carriage returns; invalid bytes as replacement characters."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.withColumn("text", F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n", "\n"))


def ignore_rules(lines: list[str]) -> dict[str, list[str]]:
    """dirs, globs and regexes of the lines of an ignore file; comments and invalid expressions are left out."""
    import re

    out: dict[str, list[str]] = {"dirs": [], "globs": [], "regexes": []}
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        if line.startswith("re:"):
            try:
                re.compile(line[3:])
                out["regexes"].append(line[3:])
            except re.error:
                continue
        elif any(c in line for c in "*?["):
            out["globs"].append(line)
        else:
            out["dirs"].append(line.rstrip("/"))
    return out


def read_manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """(path, mtime) of a manifest of this version; empty if there is none, so that everything counts as new."""
    done = sorted(_complete(spark, folder))
    if not done:
        return spark.createDataFrame([], "path string, mtime double")
    return spark.read.parquet(f"{folder.rstrip('/')}/{done[-1]}").filter(F.col("version") == version).select("path", "mtime")


def write_manifest(files: DataFrame, folder: str, version: int) -> None:
    """A manifest in a folder of its own beside the older ones; it counts from the moment its _SUCCESS file is there, and older ones go after that."""
    spark = files.sparkSession
    old = _complete(spark, folder)
    new = f"{max([int(x) for x in old], default=0) + 1:010d}"
    base = folder.rstrip("/")
    files.select("path", "mtime", F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{base}/{new}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for x in sorted(old)[:-1]:  # the last one stays for readers that have just begun
        fs.delete(path(f"{base}/{x}"), True)


def _complete(spark: SparkSession, folder: str) -> list[str]:
    """The manifests below a folder that have been written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return [x for x in names if x.isdigit() and fs.exists(path(f"{folder.rstrip('/')}/{x}/_SUCCESS"))]


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """Chunks as a table partitioned by language."""
    chunks.write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).partitionBy("language").parquet(folder)


def write_note_bodies(exported: DataFrame, folder: str) -> None:
    """An exported projection (kind, body) of the notes, one file of text."""
    exported.select(F.struct("kind", "body").alias("_s")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_s")), lambda x: x["body"]), "\n").alias("value")).write.mode("overwrite").text(folder)


def read_note_body(root: str, path: str, most_bytes: int = 200_000, also: tuple[str, ...] = ()) -> str:
    """The text of a file below root or one of the other folders; an error for files elsewhere, links out of them, and larger files."""
    from pathlib import Path

    whole = (Path(root) / path).resolve()
    if not any(whole.is_relative_to(Path(r).resolve()) for r in (root, *also)):
        raise ValueError(f"{path} lies outside of {root}")
    if whole.stat().st_size > most_bytes:
        raise ValueError(f"{path} has more than {most_bytes} bytes")
    return whole.read_text("utf-8", "replace")


def write_passport(row: DataFrame, folder: str) -> None:
    """A summary of one row, as JSON."""
    row.coalesce(1).write.mode("overwrite").json(folder)


def read_passport(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def write_audit(rows: DataFrame, folder: str) -> None:
    """Audit lines key=value, appended."""
    pairs = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns])
    rows.select(pairs.alias("value")).write.mode("append").text(folder)


def assert_one_model(vectors: DataFrame, model: str = "embed_model") -> DataFrame:
    """vectors, whose reading fails if they are of more than one embedding model."""
    n = vectors.agg(F.countDistinct(model).alias("_models"))
    checked = n.select(F.when(F.col("_models") > 1, F.raise_error(F.lit("vectors of several models"))).otherwise(F.lit(True)).cast("boolean").alias("_one"))
    return vectors.crossJoin(F.broadcast(checked)).filter("_one").drop("_one")
