"""Problem 1: split oversized chunks at natural boundaries.

Method: lexical-cohesion segmentation. For every gap between two lines, the words of the block of
lines before it are compared with those of the block after it; a gap's depth is how far its
similarity lies below the peaks to its left and right. Each piece takes the deepest valley within
its size window; the next piece starts `overlap_lines` lines before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.plans.runtime import small

BLOCK_LINES = 6  # lines of a block on either side of a gap
DIMENSIONS = 64  # words are hashed into so many counts
LEAST_FILL = 0.5  # a piece is cut no earlier than this share of the limit, if it can be helped
HEADER_LINES = 40  # class chunks may hold only so many lines of their class
WHOLE_LINES = ("window", "section")  # their content is just the lines start_line to end_line

_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|\d+")
_CLASS_LINE = re.compile(r"\s*# class: ")
_LEAD = re.compile(r"\s*(//|#|/\*|\*|@|'''|\"\"\")")
_OPENS = re.compile(r"^\s*(#{1,6} |def |class |async def |func |fn |pub |impl |export |function |public |private |protected |@)")
_CLOSES = re.compile(r"^\s*[)\]}]")
_SOFT = re.compile(r"[\s;,(){}\[\]]")
_PIECES = "chunk_id string, workspace string, file_path string, node_type string, piece_no int, start_line int, end_line int, content string"


def lead_lines(lines: list[str], node_type: str, start_line: int, end_line: int) -> int:
    """How many lines stand in front of the line start_line: leading comments, decorators and a class line."""
    if node_type in WHOLE_LINES:
        return 0
    lead = 0
    for line in lines:
        if _CLASS_LINE.match(line):
            return lead + 1
        if not (_LEAD.match(line) or not line.strip()):
            break
        lead += 1
    span = end_line - start_line + 1
    if len(lines) > span:
        return len(lines) - span
    return lead if len(lines) - lead == HEADER_LINES < span else 0  # a class cut to its head


def valley_depths(lines: list[str]) -> np.ndarray:
    """depth[g] of the gap before line g (g >= 1); depth[0] is 0."""
    n = len(lines)
    counts = np.zeros((n + 1, DIMENSIONS), dtype=np.float32)
    for i, line in enumerate(lines):
        for w in _WORD.findall(line):
            counts[i + 1, _slot(w.lower())] += 1
    total = np.cumsum(counts, axis=0)
    g = np.arange(1, n)
    before = total[g] - total[np.maximum(0, g - BLOCK_LINES)]
    after = total[np.minimum(n, g + BLOCK_LINES)] - total[g]
    norm = np.sqrt((before**2).sum(1) * (after**2).sum(1))
    sim = np.where(norm > 0, (before * after).sum(1) / np.maximum(norm, 1e-9), 0.0)
    left, right = sim.copy(), sim.copy()
    for i in range(1, n - 1):  # climb to the peak on either side
        if left[i - 1] > sim[i]:
            left[i] = left[i - 1] if sim[i - 1] >= sim[i] else sim[i]
        j = n - 2 - i
        if right[j + 1] > sim[j]:
            right[j] = right[j + 1] if sim[j + 1] >= sim[j] else sim[j]
    return np.concatenate([[0.0], (left - sim) + (right - sim)])


_slots: dict[str, int] = {}


def _slot(word: str) -> int:
    s = _slots.get(word)
    if s is None:
        if len(_slots) > 200_000:
            _slots.clear()
        s = 0
        for ch in word:
            s = (s * 31 + ord(ch)) % 1_000_003
        s = _slots[word] = s % DIMENSIONS
    return s


def natural_gaps(lines: list[str]) -> np.ndarray:
    """Whether a gap is a natural boundary: around a blank line, before an opening line, or where the indent falls back to its least."""
    n = len(lines)
    indent = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines]
    least = min((x for x in indent[1:] if x >= 0), default=0)
    out = np.zeros(n, dtype=bool)
    for g in range(1, n):
        blank = indent[g] < 0 or indent[g - 1] < 0
        out[g] = not _CLOSES.match(lines[g]) and (blank or bool(_OPENS.match(lines[g])) or indent[g] <= least)
    return out


def split_line(line: str, limit: int) -> list[str]:
    """A line longer than the limit, cut after white space or punctuation where there is some in the window's second half."""
    out = []
    at = 0
    while len(line) - at > limit:
        end = at + limit
        cut = end
        for i in range(end - 1, at + limit // 2, -1):
            if _SOFT.match(line[i]):
                cut = i + 1
                break
        out.append(line[at:cut])
        at = cut
    out.append(line[at:])
    return out


def split_text(content: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of each piece, lines counted from 0. A text within the limit is one piece.

    Every piece has at most `limit` characters. Consecutive pieces share `overlap` lines; fewer only where
    these and one further line would not fit, none next to a line that is itself cut.
    """
    lines = content.split("\n")
    if len(content) <= limit:
        return [(0, len(lines) - 1, content)]
    depth, natural = valley_depths(lines), natural_gaps(lines)
    # the ends of lines, with their line breaks
    ends = np.cumsum([len(x) + 1 for x in lines])
    begin = lambda i: int(ends[i - 1]) if i else 0
    pieces: list[tuple[int, int, str]] = []
    start, fresh, n = 0, 0, len(lines)  # the piece starts at `start`; lines before `fresh` are in an earlier piece
    while fresh < n:
        if len(lines[fresh]) > limit:
            if fresh > start and not pieces:
                pieces.append((start, fresh - 1, "\n".join(lines[start:fresh])))
            pieces += [(fresh, fresh, x) for x in split_line(lines[fresh], limit)]
            fresh += 1
            start = fresh
            continue
        while start < fresh and int(ends[fresh]) - 1 - begin(start) > limit:
            start += 1
        top = int(np.searchsorted(ends, begin(start) + limit + 1, side="right"))  # lines start..top-1 fit
        top = min(top, n)
        long = next((i for i in range(fresh, top) if len(lines[i]) > limit), None)
        if long is not None:
            top = long
        if top >= n:
            pieces.append((start, n - 1, "\n".join(lines[start:])))
            break
        low = int(np.searchsorted(ends, begin(start) + int(limit * LEAST_FILL), side="right")) + 1
        low = min(max(low, fresh + 1), top)
        window = np.arange(low, top + 1)
        window = window[window < n]
        good = window[natural[window]]
        pick = good if len(good) else window
        cut = int(pick[len(pick) - 1 - int(np.argmax(depth[pick][::-1]))]) if len(pick) and long is None else top
        pieces.append((start, cut - 1, "\n".join(lines[start:cut])))
        fresh = cut
        start = cut if long is not None and cut == long else max(cut - overlap, pieces[-1][0] + 1)
    return pieces


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            lines = r.content.split("\n")
            start = int(r.start_line) if not pd.isna(r.start_line) else 1
            end = int(r.end_line) if not pd.isna(r.end_line) else start + len(lines) - 1
            lead = lead_lines(lines, r.node_type, start, end)
            at = lambda i: min(max(start, start + i - lead), max(start, end))  # noqa: E731, B023
            for no, (a, b, text) in enumerate(split_text(r.content, int(r.max_chars), int(r.overlap_lines))):
                out.append((r.chunk_id, r.workspace, r.file_path, r.node_type, no, at(a), at(b), text))
        if out:
            yield pd.DataFrame(out, columns=["chunk_id", "workspace", "file_path", "node_type", "piece_no", "start_line", "end_line", "content"])


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every chunk whose content has more characters than max_chars of its node_type.

    Result: chunk_id, workspace, file_path, node_type, piece_no (from 0), start_line, end_line, content.
    Every piece is within the limit; without the overlap the pieces add up to the content. Lines in front of
    start_line (leading comments, the class line) count as start_line, and end_line is never exceeded.
    Chunks with NULL or empty content, with NULL node_type or one that has no limit, and those within the limit
    give no row. A NULL max_chars or one under 1 sets no limit, a NULL overlap is 0; of several limits for a type the
    smallest counts. NULL start_line counts as 1, NULL end_line as where the content ends. Repeated chunks
    (same chunk_id and content) count once. Empty tables give an empty result; other columns are ignored.
    """
    lim = limits.filter("max_chars >= 1").groupBy("node_type").agg(F.min_by(F.struct("max_chars", F.greatest(F.coalesce("overlap_lines", F.lit(0)), F.lit(0)).alias("overlap_lines")), F.struct("max_chars", "overlap_lines")).alias("l"))
    lim = small(lim.select("node_type", "l.max_chars", "l.overlap_lines"))
    cols = ["chunk_id", "workspace", "file_path", "node_type", "start_line", "end_line", "content"]
    over = chunks.select(cols).join(lim, "node_type").filter(F.length("content") > F.col("max_chars"))
    over = over.withColumn("_same", F.xxhash64("content")).dropDuplicates(["chunk_id", "_same"]).drop("_same")
    return over.mapInPandas(_run, _PIECES)
