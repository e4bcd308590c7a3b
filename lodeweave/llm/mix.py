"""Problem 9: mix sources to target shares of all tokens.

Method: Efraimidis-Spirakis sampling. Every document gets the key -ln(u) / weight, u from a hash of
its id, weight its quality; within a source documents are taken in the order of their keys. The
running sum of tokens in that order decides: complete epochs of a source first, then the documents
whose running sum stays within what is left of the source's budget, the last one if that comes nearer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.tokens import VOCABULARY, count_tokens
from lodeweave.plans.ordered import number_within
from lodeweave.plans.runtime import cut, small


def source_name(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1.1: the share of letters among a text's characters; 0.1 for no text."""
    letters = F.length(F.regexp_replace(text, r"[^A-Za-z]+", ""))
    return F.lit(0.1) + F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, weight) of every document with a key, a source and at least one token; repeated rows once.

    weight names a column with the quality of a document, from any judge of it; NULL, NaN and what is not over 0 count as its
    least use, 1e-6. Without one the share of letters stands in for it.
    """
    quality = quality_weight(F.col(text)) if weight is None else F.greatest(F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(None).cast("double")), F.lit(0.0)), F.lit(1e-6))
    rows = docs.select(F.col(key).alias("doc_id"), source_name(F.col(source)).alias("source"), quality.alias("weight"), F.col(text).alias("_text"))
    rows = count_tokens(rows.filter("doc_id is not null and source is not null and _text is not null"), "_text", vocabulary)
    return cut(rows.filter("tokens > 0").dropDuplicates(["doc_id", "source", "tokens"]))


def budgets(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, share, budget) of every target source, from measured() documents.

    share is target_share among the sources that have documents. budget is share times the total; without
    total_tokens the total is the largest at which no source needs more than max_repeats times its tokens,
    with it a source's budget ends at max_repeats times its tokens.
    """
    t = targets.filter("source is not null and target_share > 0 and max_repeats >= 1").groupBy(source_name(F.col("source")).alias("source"))
    t = t.agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats"))
    have = docs.groupBy("source").agg(F.sum("tokens").alias("available"))
    t = small(t).join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    room = F.col("available") * F.col("max_repeats")
    # one row: the sum of the shares that can be met, and the largest feasible total
    met = F.when(F.col("available") > 0, F.col("target_share"))
    whole = t.agg(F.sum(met).alias("met"), F.min(F.when(F.col("available") > 0, room / F.col("target_share"))).alias("feasible"))
    t = t.crossJoin(F.broadcast(whole)).withColumn("share", F.when(F.col("available") > 0, F.col("target_share") / F.col("met")).otherwise(F.lit(0.0)))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.col("feasible") * F.col("met")
    budget = F.least(F.floor(F.col("share") * F.coalesce(total, F.lit(0.0)) + 1e-6), room)
    return t.select("source", "target_share", "max_repeats", "available", "share", budget.cast("long").alias("budget"))


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, **columns) -> tuple[DataFrame, DataFrame]:
    """(chosen, report) of a mixture with the target shares.

    chosen(doc_id, source, tokens, repeats): every document used, 1 to max_repeats times. report(source,
    target_share, max_repeats, available_tokens, budget_tokens, actual_tokens, actual_share, documents): one row
    a target source, also those without documents (share 0; theirs is divided among the others). A source
    misses its budget by at most half the tokens of one document. Documents with NULL or empty text, NULL key or
    NULL source, or with a source that is no target, are not used; sources are compared by source_name().
    Targets with NULL or no positive share or under 1 repeat are left out, those of one name are added up.
    columns may name other key, text and source columns, and in weight that of the documents' quality; see measured().
    Keys tie only if ids do; then order is by tokens. Empty tables give empty results; other columns are
    ignored. The result depends on the documents and the seed alone, not on their order or partitions.
    """
    rows = measured(docs, **columns)
    plan = cut(budgets(rows, targets, total_tokens))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = rows.join(small(plan), "source").filter("budget > 0").withColumn("es_key", -F.log(u) / F.col("weight"))
    ranked = number_within(keyed, ["source"], ["es_key", "doc_id", "tokens"], value="tokens", running="running")
    epochs = F.floor(F.col("budget") / F.col("available"))
    rest = F.col("budget") - epochs * F.col("available")
    repeats = (epochs + (F.col("running") - F.col("tokens") / 2 <= rest).cast("int")).cast("int")
    chosen = cut(ranked.select("doc_id", "source", "tokens", repeats.alias("repeats")).filter("repeats > 0"))
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"), F.count(F.lit(1)).alias("documents"))
    total = used.agg(F.sum("actual_tokens").alias("total"))
    report = plan.join(used, "source", "left").crossJoin(F.broadcast(total))
    report = report.select(
        "source",
        "target_share",
        "max_repeats",
        F.col("available").alias("available_tokens"),
        F.col("budget").alias("budget_tokens"),
        F.coalesce("actual_tokens", F.lit(0).cast("long")).alias("actual_tokens"),
        F.coalesce(F.col("actual_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("documents", F.lit(0).cast("long")).alias("documents"),
    )
    return chosen, report
