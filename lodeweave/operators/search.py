"""Hybrid retrieval: BM25+, exact dense top-k, merging, priors, collapse of copies, confidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.text import code_tokens, normalized_content, query_tokens_py
from lodeweave.functions.vectors import cosine, embed, vector
from lodeweave.operators.quality import is_type_definition, quality_score
from lodeweave.plans.runtime import cut, spread

# BM25+ and the priors of the order.
K1, B, DELTA = 1.5, 0.75, 1.0
FILE_PRIOR, CLASS_PRIOR, PURPOSE_PRIOR, TYPE_PRIOR = 0.25, 0.35, 0.9, 0.15
LEXICAL_WEIGHT = 0.30
LIST_DEPTH, FETCH_DEPTH = 60, 200
LEAST_SHOWN, LEAST_SURE, SURE = 0.02, 0.30, 0.70
SAME_BODY = 0.75
STOPWORDS = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "how", "what", "where", "which", "when", "does", "into", "not", "all", "use", "used"]


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, key, tf, dl): how often each token stands in each document of dl tokens."""
    rows = spread(docs.select(F.col(key), F.col(text).alias("_x"))).select(key, code_tokens(F.col("_x")).alias("_t")).withColumn("dl", F.size("_t"))
    return rows.select(key, "dl", F.explode("_t").alias("token")).groupBy(key, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, df, cf): in how many documents and how often at all a token stands."""
    return postings(docs, key, text).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _is(token: str):
    return lambda x: x == token


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", normalise: bool = True) -> DataFrame:
    """(key, bm25) of every document with a text; divided by the greatest score, if normalise.

    Only the query's own tokens are counted: one pass over the texts gives each document's length and the
    counts of these tokens, so nothing of the size of the vocabulary is shuffled.
    """
    tokens = query_tokens_py(query)
    rows = spread(docs.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_x"))).select(key, code_tokens(F.col("_x")).alias("_t"))
    rows = rows.select(key, F.size("_t").alias("_dl"), *[F.size(F.filter("_t", _is(t))).alias(f"_tf{i}") for i, t in enumerate(tokens)])
    rows = cut(rows)  # a few numbers a document: the texts are read and cut into tokens once, for all that follows
    df = [F.sum((F.col(f"_tf{i}") > 0).cast("int")).alias(f"_df{i}") for i in range(len(tokens))]
    corpus = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), *df)
    rows = rows.crossJoin(F.broadcast(corpus))  # one row
    score: Column = F.lit(0.0)
    for i in range(len(tokens)):
        d, t = F.col(f"_df{i}"), F.col(f"_tf{i}")
        length = K1 * (1 - B + B * F.col("_dl") / F.col("_avg"))
        part = F.log((F.col("_n") + 1) / d) * (DELTA + t * (K1 + 1) / (length + t))
        score = score + F.when(d > 0, part).otherwise(F.lit(0.0))
    rows = rows.select(key, score.alias("bm25"))
    if not normalise:
        return rows
    top = rows.agg(F.max("bm25").alias("_top"))
    return rows.crossJoin(F.broadcast(top)).select(key, (F.col("bm25") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(F.lit(1.0))).alias("bm25"))


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k rows of greatest score, ties by key: a bounded heap in each task, no global sort."""
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def dense(vectors: DataFrame, query, key: str = "vec_id", embedding: str = "embedding", k: int | None = None, least: float | None = None) -> DataFrame:
    """(key, dense): cosine similarity to the query vector, never under 0; exact."""
    out = vectors.select(F.col(key), F.greatest(F.lit(0.0), cosine(F.col(embedding), vector(query))).alias("dense"))
    if least is not None:
        out = out.filter(F.col("dense") >= least)
    return top(out, "dense", key, k) if k else out


def merge_dense(body: DataFrame, purpose: DataFrame, key: str, body_weight: float | None = None) -> DataFrame:
    """(key, dense) of two spaces, each (key, dense): the greater of both, or a weighted mean; a missing side is 0."""
    a, b = body.select(key, F.col("dense").alias("_a")), purpose.select(key, F.col("dense").alias("_b"))
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    mixed = F.greatest(x, y) if body_weight is None else body_weight * x + (1 - body_weight) * y
    return a.join(b, key, "full").select(key, mixed.alias("dense"), y.alias("purpose"))


def merge_hybrid(dense_scores: DataFrame, lexical: DataFrame, key: str, dense_weight: float = 1 - LEXICAL_WEIGHT) -> DataFrame:
    """(key, hybrid, dense, bm25) over all keys of either side."""
    d, b = F.coalesce("dense", F.lit(0.0)), F.coalesce("bm25", F.lit(0.0))
    both = dense_scores.select(key, "dense").join(lexical.select(key, "bm25"), key, "full")
    return both.select(key, (dense_weight * d + (1 - dense_weight) * b).alias("hybrid"), d.alias("dense"), b.alias("bm25"))


def union_of_signals(merged: DataFrame, key: str, depth: int = LIST_DEPTH, fetch: int = FETCH_DEPTH) -> DataFrame:
    """The merged top `fetch`, of which only those stay that are in the top `depth` of either signal."""
    either = top(merged, "dense", key, depth).select(key).union(top(merged, "bm25", key, depth).select(key)).distinct()
    return top(merged, "hybrid", key, fetch).join(either, key, "left_semi")


def composite(quality: Column, rank: Column, total: Column, file_prior: Column, class_prior: Column, purpose: Column, is_type: Column) -> Column:
    """What results are ordered by: place in the list, quality and priors."""
    base = 1 - rank / total
    return base * quality * (1 + FILE_PRIOR * file_prior) * (1 + CLASS_PRIOR * class_prior) * (1 + PURPOSE_PRIOR * purpose * quality) * (1 + TYPE_PRIOR * is_type.cast("int"))


def collapse_copies(df: DataFrame, key: str, content: str, order: list[Column]) -> DataFrame:
    """One row for texts that are equal but for case and white space, the least by `order` and key, with dup_count of the others.

    A sum by digest, so that many copies of one text are added up before they meet in one task; key must be unique.
    """
    digests = df.select(F.sha2(normalized_content(F.col(content)), 256).alias("_d"), F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.col(key).alias("_k")).alias("_o"))
    first = digests.groupBy("_d").agg(F.min("_o").alias("_o"), (F.count(F.lit(1)) - 1).alias("dup_count"))
    return df.join(first.select(F.col("_o._k").alias("_k"), "dup_count"), F.col(key) == F.col("_k")).drop("_k")


def docstring_key(content: Column) -> Column:
    """The first three lines of a leading doc block, normalised; empty if under 20 characters."""
    doc = F.regexp_extract(content, r'(?s)(?:"""|\'\'\'|/\*\*)(.*?)(?:"""|\'\'\'|\*/)', 1)
    lines = F.slice(F.filter(F.transform(F.split(doc, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*+", ""))), lambda x: x != ""), 1, 3)
    joined = normalized_content(F.array_join(lines, " "))
    return F.when(F.length(joined) >= 20, joined).otherwise(F.lit(""))


def _same_body(rows: pd.DataFrame, most_compared: int | None = None) -> pd.DataFrame:
    import difflib

    kept: list[list] = []
    for r in rows.sort_values(["place", "key"]).itertuples(index=False):
        twin = None
        if r.doc_key:
            both = difflib.SequenceMatcher(None, "", r.content)
            for k in kept[:most_compared]:
                if k[1].node_type != r.node_type:
                    continue
                both.set_seq1(k[1].content)
                # the first two are upper bounds of the third
                if both.real_quick_ratio() >= SAME_BODY and both.quick_ratio() >= SAME_BODY and both.ratio() >= SAME_BODY:
                    twin = k
                    break
        if twin:
            twin[0] += 1 + int(r.dup_count)
        else:
            kept.append([int(r.dup_count), r])
    return pd.DataFrame([(r.key, n) for n, r in kept], columns=["key", "dup_count"])


def collapse_near_copies(results: DataFrame, key: str, content: str, node_type: str, place: str, seen: int | None = None, most_compared: int | None = None) -> DataFrame:
    """results (a ranked page, so few rows) without those that share a doc block and most of their body with one before.

    Whole contents are compared with all rows kept before, unless seen (characters of a content) or most_compared (first
    kept rows of a doc block) limit that.
    """
    text = F.col(content) if seen is None else F.substring(F.col(content), 1, seen)
    r = results.select(F.col(key).cast("string").alias("key"), text.alias("content"), F.coalesce(node_type, F.lit("")).alias("node_type"), F.col(place).cast("long").alias("place"), F.col("dup_count").cast("long").alias("dup_count"))
    r = r.withColumn("doc_key", docstring_key(F.col("content")))
    group = F.when(F.col("doc_key") != "", F.col("doc_key")).otherwise(F.concat(F.lit("\x00"), "key"))
    kept = r.withColumn("group", group).groupBy("group").applyInPandas(lambda rows: _same_body(rows, most_compared), "key string, dup_count long")
    return results.drop("dup_count").join(kept.select(F.col("key").alias("_k"), "dup_count"), F.col(key).cast("string") == F.col("_k")).drop("_k")


def result_floor(results: DataFrame, score: str, place: str, least: float = LEAST_SHOWN) -> DataFrame:
    """Results whose reranked score is at least `least` or unknown; the first one stays in any case."""
    return results.filter((F.col(place) == 1) | F.col(score).isNull() | (F.col(score) >= least))


def unknown_tokens(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """(token) of a query's content words that stand in no document: the sign of a query that misses the corpus."""
    words = [t for t in query_tokens_py(query) if len(t) >= 3 and t not in STOPWORDS]
    spark = docs.sparkSession
    asked = spark.createDataFrame([(w,) for w in words], "token string")
    there = docs.select(F.explode(F.array_intersect(code_tokens(F.col(text)), F.array(*[F.lit(w) for w in words] or [F.lit("")]))).alias("token")).distinct()
    return asked.join(F.broadcast(there), "token", "left_anti")


def normalised_scores(df: DataFrame, score: str) -> DataFrame:
    """A batch of scores through the logistic function, if any lies outside of [0, 1]."""
    w = Window.partitionBy(F.lit(1))  # a page of results
    outside = F.max(((F.col(score) < 0) | (F.col(score) > 1)).cast("int")).over(w) == 1
    return df.withColumn(score, F.when(outside, 1 / (1 + F.exp(-F.col(score)))).otherwise(F.col(score)))


def rerank(results: DataFrame, query: str, scorer=None, content: str = "content", seen: int | None = None) -> DataFrame:
    """results with ce_score from scorer(query, Series of texts) -> Series, in Arrow batches; NULL without a scorer, which leaves the order as it was. seen: characters of a content that are scored; without it the whole."""
    if scorer is None:
        return results.withColumn("ce_score", F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return scorer(query, texts)

    return results.withColumn("ce_score", score(F.col(content) if seen is None else F.substring(F.col(content), 1, seen)))


def search(chunks: DataFrame, query: str, k: int = 10, language: str | None = None, importance: DataFrame | None = None, dense_weight: float = 1 - LEXICAL_WEIGHT, scorer=None, vectors: DataFrame | None = None, purpose: DataFrame | None = None, names: DataFrame | None = None, asked=None) -> DataFrame:
    """The k best chunks for a query: dense and lexical signals merged, reranked, weighed by quality and priors, copies collapsed.

    Result: place, chunk_id, file_path, symbol_name, start_line, end_line, score, quality, dup_count, low_confidence.
    vectors(chunk_id, embedding) are the stored body vectors, purpose(chunk_id, embedding) those of the second space, asked the
    query's own vector; without them texts are embedded here. names(name, importance) are the priors of classes and functions.
    Scores of BM25 are normalised over the whole corpus before the language filter. Chunks with NULL or blank content are
    left out, repeated chunks count once; ties are ordered by chunk_id.
    """
    tokens = query_tokens_py(query)
    docs = chunks.filter(F.length(F.trim("content")) > 0).dropDuplicates(["chunk_id"])
    if not tokens:
        docs = docs.limit(0)
    spark = chunks.sparkSession
    asked = asked or spark.range(1).select(embed(F.lit(query)).alias("v")).head()["v"]
    lexical = bm25(docs, query, "chunk_id", "content")
    body = docs.withColumn("embedding", embed(F.col("content"))) if vectors is None else docs.join(vectors.select("chunk_id", "embedding"), "chunk_id")
    shown = body if language is None else body.filter(F.lower("language") == language.lower())
    merged = merge_hybrid(dense(shown, asked, "chunk_id"), lexical.join(shown.select("chunk_id"), "chunk_id", "left_semi"), "chunk_id", dense_weight)
    pool = rerank(union_of_signals(merged, "chunk_id").join(docs, "chunk_id"), query, scorer)
    pool = normalised_scores(pool, "ce_score") if scorer else pool
    # from here on at most FETCH_DEPTH rows
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("ce_score"), F.desc("hybrid"), "chunk_id")
    pool = pool.withColumn("_rank", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    priors = importance.select("file_path", "importance") if importance is not None else None
    pool = pool.join(F.broadcast(priors), "file_path", "left") if priors is not None else pool.withColumn("importance", F.lit(None).cast("double"))
    pool = pool.join(F.broadcast(dense(purpose.join(pool.select("chunk_id"), "chunk_id", "left_semi"), asked, "chunk_id").select("chunk_id", F.col("dense").alias("_purpose"))), "chunk_id", "left") if purpose is not None else pool.withColumn("_purpose", F.lit(0.0))
    pool = pool.join(names.groupBy(F.col("name").alias("symbol_name")).agg(F.max("importance").alias("_class")), "symbol_name", "left") if names is not None else pool.withColumn("_class", F.lit(0.0))
    quality = quality_score(F.col("content"), F.col("file_path"), F.col("language"), F.col("node_type"), F.col("symbol_name"), query_tokens=tokens)
    pool = pool.withColumn("quality", quality)
    pool = pool.withColumn("_score", composite(F.col("quality"), F.col("_rank"), F.col("_n"), F.coalesce("importance", F.lit(0.0)), F.coalesce("_class", F.lit(0.0)), F.coalesce("_purpose", F.lit(0.0)), is_type_definition(F.col("node_type"))))
    by = [F.desc("_score"), F.desc("quality"), F.desc(F.length("content")), F.asc("_rank")]
    pool = collapse_copies(pool, "chunk_id", "content", [-F.col("_score"), -F.col("quality"), -F.length("content"), F.col("_rank")])
    pool = pool.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by, "chunk_id")))
    pool = collapse_near_copies(pool, "chunk_id", "content", "node_type", "place")
    pool = pool.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("place"))).filter(F.col("place") <= k)
    pool = result_floor(pool, "ce_score", "place")
    missing = unknown_tokens(docs, query, "content").agg((F.count(F.lit(1)) > 0).alias("_missing"))
    top_ce = F.max(F.when(F.col("place") == 1, F.col("ce_score"))).over(Window.partitionBy(F.lit(1)))
    sure = F.coalesce(top_ce >= SURE, F.lit(False))
    unsure = F.coalesce(top_ce < LEAST_SURE, F.lit(False))
    pool = pool.crossJoin(F.broadcast(missing))
    return pool.select("place", "chunk_id", "file_path", "symbol_name", "start_line", "end_line", F.coalesce("ce_score", "dense").alias("score"), "quality", "dup_count", ((F.col("_missing") & ~sure) | unsure).alias("low_confidence"))


def recall_at_k(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row (macro_recall, micro_recall, queries) of found(query, key, place) against relevant(query, key)."""
    hits = relevant.join(found.filter(F.col("place") <= k).select("query", "key").distinct().withColumn("_hit", F.lit(1)), ["query", "key"], "left")
    per = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("_hit", F.lit(0))).alias("hits"))
    return per.agg(F.avg(F.col("hits") / F.col("n")).alias("macro_recall"), (F.sum("hits") / F.sum("n")).alias("micro_recall"), F.count(F.lit(1)).alias("queries"))
