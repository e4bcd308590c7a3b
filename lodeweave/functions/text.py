"""String functions on columns: identifier-aware tokens, paths, globs, estimates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_tokens(text: Column) -> Column:
    """Lower-cased tokens of two or more of a-z and 0-9, split at camel humps; repeats are kept."""
    humps = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(humps), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def query_tokens(text: Column) -> Column:
    """code_tokens without repeats, in order of first appearance."""
    return F.array_distinct(code_tokens(text))


def code_tokens_py(text: str) -> list[str]:
    """code_tokens of a driver-side string, such as a query."""
    return [t for t in re.split("[^a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", text).lower()) if len(t) >= 2]


def query_tokens_py(text: str) -> list[str]:
    return list(dict.fromkeys(code_tokens_py(text)))


def normalized_content(text: Column) -> Column:
    """Lower case with white space collapsed: the key under which copies of a text fall together."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def identifier_tokens(query: Column) -> Column:
    """Identifier-shaped words of a query (camel humps, underscores, dots or calls), in order, without repeats."""
    shape = r"(?<![A-Za-z0-9_])(?:[A-Za-z_]\w*(?:\.\w+)+|\w+_\w+|[a-z]+[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*)(?![A-Za-z0-9_])"
    return F.array_distinct(F.regexp_extract_all(query, F.lit(shape), F.lit(0)))


def title_tokens(text: Column, least: int = 4) -> Column:
    """Distinct lower-cased words of at least `least` characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t) >= least))


def token_estimate(text: Column, chars_per_token: int = 4) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / chars_per_token)).cast("int")


def path_parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"\\", "/"), "/")


def base_name(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def directories(path: Column) -> Column:
    """The directory components of a path, lower-cased."""
    parts = F.transform(path_parts(path), lambda p: F.lower(p))
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def relative_path(path: Column, root: Column) -> Column:
    """path below root, else path itself."""
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def parse_chunk_id(chunk_id: Column) -> Column:
    """(path, first, last) of an id path:first-last, or NULL."""
    shape = r"^(.*):(\d+)-(\d+)$"
    part = lambda i: F.regexp_extract(chunk_id, shape, i)
    return F.when(chunk_id.rlike(shape), F.struct(part(1).alias("path"), part(2).try_cast("int").alias("first"), part(3).try_cast("int").alias("last")))


def glob_regex(glob: str) -> str:
    """A shell glob as an anchored regular expression; as in fnmatch, * also crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"^{out}$"


def glob_column(glob: Column) -> Column:
    """glob_regex for a column of globs with * and ?."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))


def boundary_match(text: Column, needle: Column) -> Column:
    """Whether needle stands in text with no identifier character on either side."""
    quoted = F.concat(F.lit(r"(?<![\w])\Q"), needle, F.lit(r"\E(?![\w])"))
    return F.regexp_like(text, quoted)


def age_text(seconds: Column) -> Column:
    """An age in words."""
    ago = lambda n, unit: F.concat(F.floor(n).cast("long").cast("string"), F.lit(unit + " ago"))
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, ago(seconds / 60, "m"))
        .when(seconds < 86400, ago(seconds / 3600, "h"))
        .otherwise(ago(seconds / 86400, "d"))
    )


def date_text(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def digest16(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def split_qualifier(name: Column) -> Column:
    """(qualifier, leaf) of Class.method or Class:method; the qualifier is empty unless it begins in upper case."""
    shape = r"^(\p{Lu}[^.:]*)[.:](.+)$"
    hit = name.rlike(shape)
    return F.struct(F.when(hit, F.regexp_extract(name, shape, 1)).otherwise("").alias("qualifier"), F.when(hit, F.regexp_extract(name, shape, 2)).otherwise(name).alias("leaf"))


def trim_to_cap(text: Column, tokens: int, chars_per_token: int = 4, least_share: float = 0.5) -> Column:
    """text cut to a number of tokens, at the end of a sentence or word in the kept part's second half, with an ellipsis."""
    room = tokens * chars_per_token - 1
    head = F.substring(text, 1, room)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    word = F.regexp_extract(head, r"(?s)^(.*\S)\s", 1)
    least = int(room * least_share)
    kept = F.when(F.length(sentence) >= least, sentence).when(F.length(word) >= least, word).otherwise(head)
    return F.when(token_estimate(text, chars_per_token) <= tokens, text).otherwise(F.concat(kept, F.lit("…")))
