"""Keys, quotes, encryption and small text predicates."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_QUOTE, LEAST_SPAN = 12, 30


def canonical_key(kind: Column, args: Column, epoch: Column) -> Column:
    """SHA-256 of the JSON of a request: equal for equal kind, arguments (a map, in any order) and index epoch."""
    entries = F.array_sort(F.map_entries(args))
    return F.sha2(F.to_json(F.struct(entries.alias("args"), epoch.alias("epoch"), kind.alias("kind"))), 256)


def prefix_signature(system: Column, tools: Column) -> Column:
    """16 digits of what a request begins with, the same as long as it can be served from a prompt cache."""
    return F.substring(F.sha2(F.to_json(F.struct(system.alias("system"), tools.alias("tools"))), 256), 1, 16)


def encrypt(text: Column, key: Column) -> Column:
    """Base64 of the text under AES-GCM with a key of 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(text, key))


def decrypt(text: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(text), key).cast("string")


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def common_span(a: str | None, b: str | None) -> str:
    """The longest string that stands in both texts, white space collapsed; the first of equally long ones in a."""
    x, y = " ".join((a or "").split()), " ".join((b or "").split())
    m = difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match(0, len(x), 0, len(y))
    return x[m.a : m.a + m.size].strip()


def auto_quote(content: Column, message: Column, least: int = LEAST_SPAN) -> Column:
    """The longest common span of a note and a user's message, if it has at least `least` characters; else NULL."""

    def run(notes: pd.Series, messages: pd.Series) -> pd.Series:
        spans = [common_span(a, b) for a, b in zip(notes, messages)]
        return pd.Series([s if len(s) >= least else None for s in spans], dtype="object")

    return F.pandas_udf(run, "string")(content, message)


def file_paths(text: Column) -> Column:
    """File-path-shaped words of a text, in order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:[A-Za-z0-9_.\-]+/)+[A-Za-z0-9_.\-]+\.[A-Za-z0-9]{1,6}"), F.lit(0)))


def one_line(text: Column, chars: int) -> Column:
    """A text as one line of at most `chars` characters, cut at a blank in its second half, with an ellipsis."""
    line = flat(text)
    head = F.substring(line, 1, chars - 1)
    word = F.regexp_extract(head, r"^(.*\S)\s", 1)
    return F.when(F.length(line) <= chars, line).otherwise(F.concat(F.when(F.length(word) >= chars // 2, word).otherwise(head), F.lit("…")))


def is_flow_script(text: Column) -> Column:
    """Whether JavaScript announces Flow types at its beginning."""
    return F.coalesce(F.substring(text, 1, 2000).rlike(r"@flow\b"), F.lit(False))


def asks_for_code(query: Column) -> Column:
    """(needs_tool, confidence) of a query by counts of code-shaped and of general words: a simple, fixed rule."""
    code = F.size(F.regexp_extract_all(query, F.lit(r"\w+_\w+|[a-z]+[A-Z]\w*|\w+\(\)|\.\w{1,4}\b|(?i)\b(?:where|defined|function|class|file|calls?|implements?)\b"), F.lit(0)))
    talk = F.size(F.regexp_extract_all(query, F.lit(r"(?i)\b(?:explain|why|opinion|thanks|hello|general|concept)\b"), F.lit(0)))
    return F.struct((code > talk).alias("needs_tool"), F.round(F.abs(code - talk) / F.greatest(F.lit(1), code + talk), 4).alias("confidence"))


def is_monorepo(paths: Column) -> Column:
    """Whether an array of paths holds a workspace marker, or manifests in three or more directories."""
    marker = F.exists(paths, lambda p: p.rlike(r"(^|/)(lerna\.json|pnpm-workspace\.yaml|nx\.json|turbo\.json|WORKSPACE|go\.work)$"))
    manifests = F.filter(paths, lambda p: p.rlike(r"/(package\.json|pyproject\.toml|go\.mod|Cargo\.toml|pom\.xml)$"))
    return marker | (F.size(F.array_distinct(F.transform(manifests, lambda p: F.regexp_replace(p, r"/[^/]*$", "")))) >= 3)
