"""Problem 5: generated, minified, vendored and data files among source files.

Method: thresholds on layout statistics, tuned per language: longest and mean line, shares of white
space and alphanumeric characters, density of numeric literals, share of long encoded runs. What
layout cannot tell is further evidence, recorded beside it and each part of it to be left out by a parameter: the
place in the tree, the comment at the head of the file, and the files of known libraries (Jaccard similarity
of five-word shingles of at least 0.8, by a join on the prefixes of the shingle sets).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.plans.runtime import cut, small, spread

SHINGLE, SIMILAR = 5, 0.8
#: A bitmap of this fixed size holds the prefixes of all known files: files with none of them are not joined.
BITMAP = 1 << 23
_STATS = ["longest_line", "mean_line", "blank_share", "alnum_share", "number_density", "encoded_share"]


class Layout(NamedTuple):
    """Limits of a language. Minified: long lines, little white space, much punctuation. Data: encoded runs, lists of numbers."""

    mean_line: float = 150.0  # at least, as is the longest line
    longest_line: int = 500
    blank_share: float = 0.12  # at most
    alnum_share: float = 0.82  # at most, of its characters besides white space
    data_share: float = 0.6  # at least, of its characters in encoded runs and number lists
    numbers: float = 6.0  # numeric literals a line, at least, of a file a third of which is such runs


#: By extension; the others have the default. Set by the files of sf0.1 (3,562 hand-written ones): a limit lies beyond all of these of
#: the language, at least half of the way to the nearest minified or data file. Greatest there: mean line 65, number density 1.0
#: (Python and Java 145, of files of one or two lines), least alphanumeric share 0.78; minified from 700 and at most 0.69, data from 0.96.
LAYOUTS = {
    "js": Layout(mean_line=110.0, longest_line=400, alnum_share=0.8),
    "mjs": Layout(mean_line=110.0, longest_line=400, alnum_share=0.8),
    "ts": Layout(mean_line=130.0, longest_line=400, alnum_share=0.8),
    "css": Layout(mean_line=110.0, longest_line=400, alnum_share=0.9),
    "py": Layout(mean_line=200.0, longest_line=800),
    "java": Layout(mean_line=200.0, longest_line=800),
    "go": Layout(mean_line=160.0, longest_line=800),
    "rs": Layout(mean_line=160.0, longest_line=800),
    "json": Layout(mean_line=1e9, longest_line=1 << 40, numbers=1e9),  # compact JSON is not minified code, nor are its numbers data
    "md": Layout(mean_line=1e9, longest_line=1 << 40, data_share=0.8, numbers=1e9),  # prose has long lines
    "txt": Layout(mean_line=1e9, longest_line=1 << 40, data_share=0.8, numbers=1e9),
}

# Directories, endings and head lines by which such files are known.
_VENDORED = {"node_modules", "bower_components", "vendor", "vendors", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "site-packages", "Godeps", "Pods"}
_GENERATED = {"generated", "__generated__", "_generated", "generated-sources", "generated-src", "generated_src", "autogen", "codegen", "dist"}
_GENERATED_PAIRS = {("gen", "proto"), ("gen", "java"), ("gen", "go"), ("src", "gen"), ("src-gen", ""), ("build", "gen")}
_GENERATED_END = re.compile(r"(?:\.generated\.\w+|\.gen\.\w+|\.g\.\w+|\.pb\.(?:go|cc|h|ts|js)|_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|ts)|\.designer\.cs|_generated\.\w+)$", re.I)
_MINIFIED_END = re.compile(r"(?:[.\-]min|\.bundle|\.chunk|\.packed)\.(?:js|css|mjs)$", re.I)
_HEAD = re.compile(
    r"@generated\b|<auto-?generated\b|\bauto-?generated\s+(?:by|from|file|code|using|with)\b|\bautomatically[ -]generated\b|\bcode generated\b.*\bdo not (?:edit|modify)\b"
    r"|\bgenerated (?:by|from|with|using)\b.*\b(?:do not (?:edit|modify|change)|edit\b.*\binstead|changes will be lost)|\bthis (?:file|code) (?:was|is|has been) (?:auto-?|automatically |machine[ -])?generated\b|\bmachine[ -]generated\b",
    re.I,
)
_COMMENT = re.compile(r"\s*(?://|/\*|\*|#|<!--|--|;|[rRuU]?(?:\"\"\"|'''))")
_BLOCK = re.compile(r"\s*(?:(/\*)|(<!--)|[rRuU]?(\"\"\"|'''))")
_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+")
DATA_CHARS = 512  # what is shorter is no block of data


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return table


_DIGITS = b"0123456789"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_IS_BLANK, _IS_DIGIT = _class(b" \t\n\r\x0b\x0c"), _class(_DIGITS)
_IS_WORD = _class(_DIGITS + _LETTERS + b"_" + bytes(range(128, 256)))
_IS_ENCODED = _class(_DIGITS + _LETTERS + b"+/=")
_IS_LIST = _class(_DIGITS + b"abcdefABCDEFxX+-., \t\n\r[](){}\\")
ENCODED_RUN, LIST_RUN = 48, 48


def _in_runs(mask: np.ndarray, least: int, weight: np.ndarray, digits: np.ndarray | None = None) -> int:
    """The weight inside runs of at least `least` bytes; with digits, only of runs a fifth of whose weight are digits."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    first, end = edge[::2], edge[1::2]
    long = end - first >= least
    first, end = first[long], end[long]
    if not len(first):
        return 0
    total = np.concatenate([[0], np.cumsum(weight)])
    held = total[end] - total[first]
    if digits is not None:
        some = np.concatenate([[0], np.cumsum(digits)])
        held = held[(some[end] - some[first]) * 5 >= held]
    return int(held.sum())


def layout(data: bytes) -> dict[str, float]:
    """The layout statistics of a text in UTF-8; characters count as bytes."""
    n = len(data)
    if not n:
        return {k: 0 for k in _STATS}
    x = np.frombuffer(data, dtype=np.uint8)
    lines = np.diff(np.concatenate([[-1], np.flatnonzero(x == 10), [n]])) - 1
    filled = lines[lines > 0]
    ink, digit, word = ~_IS_BLANK[x], _IS_DIGIT[x], _IS_WORD[x]
    black = max(1, int(ink.sum()))
    starts = digit.copy()  # a number starts at a digit that no word character stands before
    starts[1:] &= ~word[:-1]
    encoded = _in_runs(_IS_ENCODED[x], ENCODED_RUN, ink)
    listed = _in_runs(_IS_LIST[x], LIST_RUN, ink, digit)
    return {
        "longest_line": int(lines.max()),
        "mean_line": float(filled.mean()) if len(filled) else 0.0,
        "blank_share": 1 - int(ink.sum()) / n,
        "alnum_share": int(word.sum()) / n,
        "number_density": int(starts.sum()) / max(1, len(filled)),
        "encoded_share": min(1.0, (encoded + listed) / black),
    }


def by_place(path: str) -> str | None:
    parts = path.split("/")
    dirs, name = parts[:-1], parts[-1]
    if _VENDORED & set(dirs):
        return "vendored"
    if _GENERATED & set(dirs) or _GENERATED_PAIRS & set(zip(dirs, dirs[1:])) or _GENERATED_END.search(name):
        return "generated"
    return "minified" if _MINIFIED_END.search(name) else None


def by_head(text: str) -> str | None:
    """generated, if the comment at the top of the file, up to the first statement, says so."""
    at, close = 0, ""  # close: the mark that ends the open block
    while True:
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        inside = 0
        if not close:
            if line.strip() and not _COMMENT.match(line):
                return None
            if m := _BLOCK.match(line):
                close, inside = "*/" if m[1] else "-->" if m[2] else m[3], m.end()
        stop = line.find(close, inside) if close else -1
        if _HEAD.search(line[:stop] if stop >= 0 else line):
            return "generated"
        if stop >= 0:
            rest, close = line[stop + len(close) :], ""
            if rest.strip() and not _COMMENT.match(rest):
                return None
        if end < 0:
            return None
        at = end + 1


def by_layout(path: str, size: int, s: dict[str, float]) -> str | None:
    limits = LAYOUTS.get(path.rpartition(".")[2].lower(), Layout())
    if size >= DATA_CHARS and (s["encoded_share"] >= limits.data_share or s["number_density"] >= limits.numbers and s["encoded_share"] >= 1 / 3):
        return "data"
    long = s["mean_line"] >= limits.mean_line and s["longest_line"] >= limits.longest_line
    if long and s["blank_share"] <= limits.blank_share and s["alnum_share"] <= limits.alnum_share * (1 - s["blank_share"]):
        return "minified"
    return None


def shingles(data: bytes) -> np.ndarray:
    """Hashes of the distinct runs of five words, sorted; of a shorter text of all its words."""
    tokens = _TOKEN.findall(data)
    words = np.fromiter(map(zlib.crc32, tokens), dtype=np.uint64, count=len(tokens))
    runs = max(1, len(words) - SHINGLE + 1)
    h = np.zeros(runs if len(words) else 0, dtype=np.uint64)
    for i in range(min(SHINGLE, len(words))):
        h = (h + words[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _prefix(own: np.ndarray) -> np.ndarray:
    """The least hashes: two sets of at least the similarity have one of them in common."""
    return own[: len(own) - int(np.ceil(SIMILAR * len(own) - 1e-9)) + 1] if len(own) else own


def _plain(content) -> bytes:
    return bytes(content or b"").removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n")


_ROW = "row_key string, workspace string, file_path string, mtime double, longest_line int, mean_line double, blank_share double, alnum_share double, number_density double, encoded_share double, layout string, place string, head string, prefix array<long>, shingles array<long>"


def _scan(bitmap):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(np.frombuffer(bitmap.value, dtype=np.uint8)).view(bool) if bitmap is not None else None
        for rows in batches:
            out = []
            for key, workspace, path, mtime, content in zip(rows["row_key"], rows["workspace"], rows["path"], rows["mtime"], rows["content"]):
                data = _plain(content)
                s = layout(data)
                prefix = own = None
                if bits is not None:
                    own = shingles(data)
                    prefix = _prefix(own)
                    prefix = prefix[bits[(prefix % np.uint64(BITMAP)).astype(np.int64)]].view(np.int64)
                    own = own.view(np.int64) if len(prefix) else None
                place = path[len(workspace) :] if workspace and path.startswith(workspace) else path
                out.append((key, workspace, path, mtime, *(s[k] for k in _STATS), by_layout(path, len(data), s), by_place(place), by_head(data.decode("utf-8", "replace")), prefix, own))
            yield pd.DataFrame(out, columns=["row_key", "workspace", "file_path", "mtime", *_STATS, "layout", "place", "head", "prefix", "shingles"])

    return run


def _known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        sets = [shingles(_plain(t.encode("utf-8", "replace"))) for t in rows["content"]]
        yield pd.DataFrame({"known": rows["known"], "set": [s.view(np.int64) for s in sets], "start": [_prefix(s).view(np.int64) for s in sets]})


def _bitmap(starts: DataFrame) -> bytes:
    """Which cells hold a hash of a prefix: of a fixed size, whatever the number of known files."""
    cell = F.pmod(F.col("h"), F.lit(BITMAP))  # BITMAP is a power of two, so that signed and unsigned hashes agree
    held = starts.select(F.shiftright(cell, 3).cast("int").alias("byte"), F.pow(F.lit(2), F.lit(7) - cell % 8).cast("int").alias("bit"))
    held = held.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    out[held["byte"].to_numpy()] = held["bits"].to_numpy()
    return out.tobytes()


def _similarity(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """(row_key, upstream_similarity): the greatest similarity of a file to a known one, where it is at least SIMILAR."""
    starts = known.select("known", F.explode("start").alias("h"))
    pairs = scanned.select("row_key", F.explode("prefix").alias("h")).join(small(starts), "h").select("row_key", "known").distinct()
    both = pairs.join(scanned.select("row_key", "shingles").dropDuplicates(["row_key"]), "row_key").join(small(known.select("known", "set")), "known")
    common = F.size(F.array_intersect("shingles", "set"))
    similar = F.col("common") / (F.size("shingles") + F.size("set") - F.col("common"))
    return both.withColumn("common", common).groupBy("row_key").agg(F.max(similar).alias("upstream_similarity")).filter(F.col("upstream_similarity") >= SIMILAR)


def file_origins(files: DataFrame, upstream: DataFrame, further: tuple[str, ...] = ("place", "head", "upstream")) -> DataFrame:
    """The origin of every path's current file (that of the greatest mtime), and the evidence for it.

    Result: workspace, file_path, origin (generated, minified, vendored, data or hand-written), evidence (those of layout,
    place, head and upstream that speak against hand-written), the layout statistics and upstream_similarity (to the
    most similar known file if at least 0.8, else 0). Layout decides; where it says nothing the further evidence does, in its
    order, as far as `further` names it. Bytes that are not UTF-8 count as replacement characters in the head and as word
    characters elsewhere, byte order marks and the \\r of CR LF are left out. Empty and NULL contents are hand-written unless
    their place says otherwise; rows with NULL path are left out; a NULL mtime is older than any. Versions with equal
    mtime: one that is not hand-written counts. Repeated rows count once. Empty tables give an empty result; other columns are
    ignored.
    """
    rows = files.select("workspace", "path", F.col("mtime").cast("double").alias("mtime"), "content").filter("path is not null")
    rows = rows.withColumn("row_key", F.md5(F.concat_ws("\0", F.coalesce("workspace", F.lit("")), "path", F.coalesce(F.hex("content"), F.lit("")))))
    bitmap = known = None
    if "upstream" in further:
        texts = upstream.filter("length(content) > 0").select(F.monotonically_increasing_id().alias("known"), "content")
        known = cut(texts.mapInPandas(_known, "known long, set array<long>, start array<long>"))
        bitmap = files.sparkSession.sparkContext.broadcast(_bitmap(known.select(F.explode("start").alias("h"))))
    seen = spread(rows).mapInPandas(_scan(bitmap), _ROW)
    if known is not None:
        seen = cut(seen)
        seen = seen.join(small(cut(_similarity(seen, known))), "row_key", "left")
    else:
        seen = seen.withColumn("upstream_similarity", F.lit(None).cast("double"))
    seen = seen.withColumn("upstream", F.when(F.col("upstream_similarity").isNotNull(), F.lit("vendored"))).withColumn("upstream_similarity", F.coalesce("upstream_similarity", F.lit(0.0)))
    kinds = ["layout", *[k for k in ("place", "head", "upstream") if k in further]]
    seen = seen.withColumn("origin", F.coalesce(*kinds, F.lit("hand-written"))).withColumn("evidence", F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in kinds])))
    # of all versions: the newest, then what is not hand-written, then the most similar
    best = F.struct(F.coalesce("mtime", F.lit(float("-inf"))).alias("m"), (F.col("origin") != "hand-written").alias("o"), F.col("upstream_similarity").alias("u"), F.col("origin").alias("n"))
    cols = ["origin", "evidence", *_STATS, "upstream_similarity"]
    picked = seen.groupBy("workspace", "file_path").agg(F.max_by(F.struct(*cols), best).alias("r"))
    return picked.select("workspace", "file_path", *[F.col(f"r.{c}").alias(c) for c in cols])
