"""Problem 10: long exact spans shared between records.

Method: recompression. In every round, runs of one symbol and then pairs of a left and a right symbol
get a name; a name is a hash of what it stands for, so it is the same in every record of every task, and
equal substrings get equal symbols but for a bounded margin at their ends (symbols over a round's
length limit wait for a later round, which bounds that margin). The last round, named and exchanged by
Spark, joins the symbols behind a place into a phrase of at least PHRASE characters. Of the phrases that
begin within some stretch those of least name stand for all, so that every common substring of `span`
characters holds a whole phrase that stands in both records. Occurrences of a shared phrase whose
surroundings are equal form a class with one representative; only representatives are compared, in
characters, so what many records share costs rows in proportion to its occurrences, not to their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.plans.runtime import cut, release, shuffle_width, spread

#: Length limits of the rounds. Symbols have at most 2 * limit characters after a round (runs aside); what happens to a
#: symbol depends on at most MARGIN characters to either side: the sum over the rounds of the longest symbols before them.
ROUNDS = (1, 1, 2, 2, 4)
MARGIN = 1 + 2 + 2 + 4 + 4
#: Runs over RUN characters have places of their own at their ends and, over 2 * BESIDE characters, inside; see _anchors().
RUN = 16
BESIDE, INSIDE = 50, 120
PHRASE = 56
LEAST_SPAN = 200
GROUP = 64  # classes of a phrase compared pair by pair; more of them go by _windows(), with the same result

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x5851F42D4C957F2D | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def recompress(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, position, length, base length) of the symbols after all rounds; starts: where the records begin in codes.

    base length is the length of the repeated symbol in a run, else 0.
    """
    sym = _mix(codes.astype(np.uint64) * _M1 + np.uint64(1))
    pos = np.arange(len(codes), dtype=np.int64)
    first = np.zeros(len(codes) + 1, dtype=bool)  # records begin here: no symbol reaches across
    first[starts] = True
    first[-1] = True
    base = np.zeros(len(codes), dtype=np.int16)
    end = len(codes)
    for limit in ROUNDS:
        length = np.diff(pos, append=end)
        free = length <= limit
        opens = first[pos]
        # runs of one symbol
        same = np.zeros(len(sym), dtype=bool)
        same[1:] = (sym[1:] == sym[:-1]) & free[1:] & free[:-1] & ~opens[1:]
        if same.any():
            heads = np.flatnonzero(~same)
            n = np.diff(heads, append=len(sym))
            run = n > 1
            each, sym, base, pos, opens = length[heads], sym[heads], base[heads], pos[heads], opens[heads]
            sym[run] = _mix(sym[run] * _M1 + n[run].astype(np.uint64))
            base[run] = each[run]
            length = np.diff(pos, append=end)
            free = (length <= limit) & ~run
        # pairs of a left and a right symbol
        left = (sym & np.uint64(1 << 20)) != 0
        at = np.flatnonzero(left[:-1] & ~left[1:] & free[:-1] & free[1:] & ~opens[1:])
        sym[at] = _mix(sym[at] * _M1 + sym[at + 1] * _M2)
        base[at] = 0
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        sym, pos, base = sym[keep], pos[keep], base[keep]
    return sym, pos, np.diff(pos, append=end), base


class _Hash:
    """Fingerprints of stretches of an array of codes or names."""

    powers = np.ones(1, dtype=np.uint64)
    inverse = np.ones(1, dtype=np.uint64)

    @classmethod
    def reserve(cls, n: int) -> None:
        if len(cls.powers) < n:
            n = max(n, 1 << 16)
            inv = pow(_BASE, -1, 1 << 64)
            for name, b in (("powers", _BASE), ("inverse", inv)):
                p = np.full(n, np.uint64(b), dtype=np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))

    def __init__(self, codes: np.ndarray):
        self.reserve(len(codes) + 1)
        x = _mix(codes.astype(np.uint64) * _M2 + np.uint64(7))
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(x * self.powers[: len(codes)], out=self.sums[1:])

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64))


def _least(pos: np.ndarray, key: np.ndarray, size: int, reach: int) -> np.ndarray:
    """Which places have the least key of all in some stretch of `reach` characters (by two passes of blockwise minima)."""
    n = -(-(size + reach) // reach) * reach
    x = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    x[pos] = key

    def sliding(x: np.ndarray, by: np.ufunc) -> np.ndarray:  # over [i, i + reach)
        blocks = x.reshape(-1, reach)
        behind = by.accumulate(blocks, axis=1).ravel()
        ahead = by.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return by(ahead[: n - reach + 1], behind[reach - 1 :])

    lowest = np.zeros(n, dtype=np.uint64)  # of the stretch that ends at a place
    lowest[reach - 1 :] = sliding(x, np.minimum)
    lowest[: reach - 1] = np.minimum.accumulate(x[: reach - 1])
    highest = np.zeros(n, dtype=np.uint64)
    highest[: n - reach + 1] = sliding(lowest, np.maximum)
    return highest[pos] == key


def _stretch(codes: np.ndarray, lo: int, hi: int, at: int, period: int) -> tuple[int, int, int]:
    """(first, end, period): the longest stretch of the least period around the run at `at`, within [lo, hi)."""
    unit = codes[at : at + period]
    for d in range(1, period):
        if period % d == 0 and np.array_equal(unit[d:], unit[:-d]):
            period = d
            break
    first, end = at, at + period
    step = 64
    while first > lo:  # backward, in growing steps
        a = max(lo, first - step)
        differs = np.flatnonzero(codes[a:first] != codes[a + period : first + period])
        if len(differs):
            first = a + int(differs[-1]) + 1
            break
        first, step = a, 2 * step
    step = 64
    while end < hi:
        b = min(hi, end + step)
        differs = np.flatnonzero(codes[end:b] != codes[end - period : b - period])
        if len(differs):
            end += int(differs[0])
            break
        end, step = b, 2 * step
    return first, end, period


def _anchors(span: int):
    reach = span - 2 * (RUN + MARGIN) - PHRASE - max(RUN, 2 * ROUNDS[-1])

    def of(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(record, position, width, name): the phrases that stand for others, and the places at and in long runs.

        A span that touches no run over RUN characters has, between its margins, `reach` characters in each of which a
        whole phrase may begin. In others a long run begins or ends inside the span, with BESIDE characters next to it, or
        else holds a place at a fixed distance from its end with INSIDE characters around it; a span wholly inside a run is
        found by the least rotation of the period.
        """
        sym, pos, length, base = recompress(codes, bounds[:-1])
        record = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(pos, bounds)))
        names = _Hash(sym)
        end = pos + length
        last = np.searchsorted(end, pos + PHRASE)
        whole = np.flatnonzero(last < len(pos))
        whole = whole[record[last[whole]] == record[whole]]
        key = names.between(whole, last[whole] + 1)
        take = _least(pos[whole], key, len(codes), reach)
        some = whole[take]
        found = [(record[some], pos[some], (end[last[some]] - pos[some]), key[take])]

        long = np.flatnonzero((base > 0) & (length > RUN - np.where(base > 1, 2 * base, 0)))
        if len(long):
            one = base[long] == 1
            runs = {(int(p), int(p + n), 1) for p, n in zip(pos[long][one], length[long][one])}
            for i in long[~one]:
                r = int(record[i])
                runs.add(_stretch(codes, int(bounds[r]), int(bounds[r + 1]), int(pos[i]), int(base[i])))
            first, stop, period = (np.array(x, dtype=np.int64) for x in zip(*sorted(runs)))
            of = np.searchsorted(bounds, first, side="right") - 1
            parts = [(of, first - BESIDE, BESIDE), (of, stop, BESIDE)]
            for k in np.flatnonzero(stop - first > 2 * BESIDE):
                away = np.arange(0, min(stop[k] - first[k], span) + 1, INSIDE // 2)
                places = np.concatenate([first[k] + away, stop[k] - away])
                if stop[k] - first[k] >= span:
                    p = int(period[k])
                    unit = codes[first[k] : first[k] + p]
                    turn = min(range(p), key=lambda j: tuple(np.roll(unit, -j)))
                    half = -(-(span // 2) // p) * p
                    inner = first[k] + turn + half
                    places = np.concatenate([places, [inner + p], np.arange(inner, stop[k], half)])
                parts.append((np.full(len(places), of[k]), places - INSIDE // 2, INSIDE))
            text = _Hash(codes)
            for r, at, width in parts:
                ok = (at >= bounds[r]) & (at + width <= bounds[r + 1])
                r, at = r[ok], at[ok]
                found.append((r, at, np.full(len(at), width), text.between(at, at + width)))
        return tuple(np.concatenate(x) for x in zip(*found))

    return of


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after another, and where each begins and the last one ends."""
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), bounds


def _batches(ids, texts, limit: int = 400_000) -> Iterator[tuple[list, list[str]]]:
    some_ids, some, size = [], [], 0
    for i, t in zip(ids, texts):
        some_ids.append(i)
        some.append(t)
        size += len(t)
        if size >= limit:
            yield some_ids, some
            some_ids, some, size = [], [], 0
    if some:
        yield some_ids, some


def _digest(text: str) -> bytes:
    """128 bits of a cryptographic hash: texts of one digest count as equal."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_INDEX = "doc_id long, phrase long, at int, width int, digest binary"


def _index(span: int):
    anchors = _anchors(span)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for ids, texts in _batches(rows["doc_id"], rows["text"]):
                codes, bounds = _codes(texts)
                ids = np.array(ids, dtype=np.int64)
                yield pd.DataFrame({"doc_id": ids, "phrase": np.int64(0), "at": np.diff(bounds).astype(np.int32), "width": np.int32(0), "digest": [_digest(t) for t in texts]})
                record, at, width, name = anchors(codes, bounds)
                yield pd.DataFrame({"doc_id": ids[record], "phrase": name.view(np.int64), "at": (at - bounds[record]).astype(np.int32), "width": width.astype(np.int32), "digest": None})

    return run


_AROUND = "phrase long, context binary, text_key long, at int, lead int, width int, chars string"


def _around(span: int):
    """Of each occurrence as much of its text to either side as a common span of `span` characters could still need."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, text, places in zip(rows["text_key"], rows["text"], rows["places"]):
                for p in places:
                    at, width = p["at"], p["width"]
                    lo = max(0, at - max(0, span - width))
                    chars = text[lo : at + max(span, width)]
                    if len(chars) >= span:
                        out.append((p["phrase"], _digest(f"{at - lo} {width} {chars}"), key, at, at - lo, width, chars))
            for lo in range(0, len(out), 20_000):
                yield pd.DataFrame(out[lo : lo + 20_000], columns=["phrase", "context", "text_key", "at", "lead", "width", "chars"])

    return run


def _common(a: str, b: str) -> int:
    """How many characters a and b begin with in common."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


_TIE = "phrase long, context binary, rep_key long, rep_start int, skip int, length int"


def _compare(span: int):
    """Ties of the classes of one phrase, compared pair by pair; rows come sorted by phrase, at most GROUP classes of one."""
    columns = ["phrase", "context", "rep_key", "rep_start", "skip", "length"]

    def close(group: list, out: list) -> None:
        group.sort(key=lambda r: (r.text_key, r.at))
        for i, x in enumerate(group):
            out.append((x.phrase, x.context, x.text_key, x.at - x.lead, 0, len(x.chars)))
            for y in group[i + 1 :]:
                if x.width != y.width:
                    continue
                a, b, w = x.chars, y.chars, x.width
                if a[x.lead : x.lead + w] != b[y.lead : y.lead + w]:
                    continue
                left = _common(a[: x.lead][::-1], b[: y.lead][::-1])
                size = left + w + _common(a[x.lead + w :], b[y.lead + w :])
                if size >= span:
                    out.append((y.phrase, y.context, x.text_key, x.at - left, y.lead - left, size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list = []
        for rows in batches:
            out: list = []
            for r in rows.itertuples(index=False):
                if group and r.phrase != group[0].phrase:
                    close(group, out)
                    group = []
                group.append(r)
            if out:
                yield pd.DataFrame(out, columns=columns)
        out = []
        if group:
            close(group, out)
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def _windows(span: int):
    """Every stretch of `span` characters of a class that holds its phrase, by digest: two classes share one if and only if they have a common span."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            data, of, skip = [], [], []
            for i, r in enumerate(rows.itertuples(index=False)):
                last = len(r.chars) - span
                shift = range(max(0, r.lead + r.width - span), min(r.lead, last) + 1) if r.width <= span else range(0, last + 1)
                data += [_digest(r.chars[k : k + span]) for k in shift]
                of += [i] * len(shift)
                skip += shift
            of, skip = np.array(of, dtype=np.int64), np.array(skip, dtype=np.int32)
            column = lambda c: rows[c].to_numpy()[of]  # noqa: E731, B023
            yield pd.DataFrame({"stretch": data, "phrase": column("phrase"), "context": column("context"), "text_key": column("text_key"), "start": (column("at") - column("lead") + skip).astype(np.int32), "skip": skip})

    return run


def _joined(pieces: Column) -> Column:
    """Sorted intervals (lo, hi) with those that touch or overlap made one."""
    none = F.array().cast("array<struct<lo:int,hi:int>>")

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        more = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))))
        return F.when(x["lo"] <= last["hi"], more).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.sort_array(pieces), none, add)


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = LEAST_SPAN) -> tuple[DataFrame, DataFrame]:
    """(records, spans): spans of at least `span` characters (code points, exactly) that stand in more than one text.

    records(doc_id, text_key, n_chars): every record of at least `span` characters; equal texts have one text_key, the
    least doc_id that has it. spans(rep_key, rep_start, text_key, start, length): text_key has at start what its
    representative rep_key has at rep_start. Two different texts have a common span if and only if one of them is tied
    to the other or both are tied to one representative, with at least `span` characters of it in common; so none is
    lost, and a span in any number of texts takes a few rows a text. Rows of one text with itself are its repeats.
    Records with NULL key or NULL, empty or shorter text are in neither. Repeated rows (same key and text) count once.
    Texts are compared whole, of any length. An empty table gives empty results; other columns are ignored.
    """
    if span < LEAST_SPAN:
        raise ValueError(f"span must be at least {LEAST_SPAN}")
    width = shuffle_width(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter((F.length("text") >= span) & F.col("doc_id").isNotNull())
    rows = cut(spread(texts).mapInPandas(_index(span), _INDEX))
    whole = rows.filter("digest is not null").select("doc_id", "digest", F.col("at").alias("n_chars")).dropDuplicates(["doc_id", "digest"])
    first = whole.groupBy("digest").agg(F.min("doc_id").alias("text_key"))
    records = cut(whole.join(first, "digest").select("doc_id", "text_key", "n_chars"))
    places = rows.filter("digest is null").select("doc_id", "phrase", "at", "width")
    # the round of phrases: those that stand in more than one record, and in these where
    several = places.groupBy("phrase").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("phrase")
    mine = records.filter("doc_id = text_key").select("doc_id", "text_key").dropDuplicates()
    found = places.join(several, "phrase").dropDuplicates().join(mine, "doc_id")
    by_text = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("phrase", "at", "width")).alias("places"))
    around = cut(texts.join(by_text, "doc_id").select("text_key", "text", "places").mapInPandas(_around(span), _AROUND))
    release(rows)
    # classes of equal surroundings, each with its first occurrence as representative
    own = F.struct("text_key", "at", "lead", "width")
    classes = around.groupBy("phrase", "context").agg(F.min(own).alias("r"), F.max("text_key").alias("hi"), F.first("chars").alias("chars"))
    classes = cut(classes.select("phrase", "context", "r.*", "hi", "chars"))
    per = classes.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min("text_key").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi")
    few = classes.drop("hi").join(per.filter(F.col("n") <= GROUP).select("phrase"), "phrase").repartition(width, "phrase").sortWithinPartitions("phrase")
    ties = few.mapInPandas(_compare(span), _TIE)
    many = classes.drop("hi").join(per.filter(F.col("n") > GROUP).select("phrase"), "phrase").repartition(width)
    stretches = cut(many.mapInPandas(_windows(span), "stretch binary, phrase long, context binary, text_key long, start int, skip int"))
    reps = stretches.groupBy("stretch").agg(F.min(F.struct("text_key", "start")).alias("rep"))
    hot = stretches.join(reps, "stretch").select("phrase", "context", F.col("rep.text_key").alias("rep_key"), F.col("rep.start").alias("rep_start"), "skip", F.lit(span).alias("length"))
    members = around.select("phrase", "context", "text_key", (F.col("at") - F.col("lead")).alias("head"))
    tied = ties.unionByName(hot).join(members, ["phrase", "context"]).withColumn("start", F.col("head") + F.col("skip"))
    tied = tied.filter((F.col("text_key") != F.col("rep_key")) | (F.col("start") != F.col("rep_start")))
    by = tied.groupBy("rep_key", "text_key", (F.col("start") - F.col("rep_start")).alias("shift"))
    pieces = by.agg(F.collect_set(F.struct(F.col("rep_start").alias("lo"), (F.col("rep_start") + F.col("length")).alias("hi"))).alias("pieces"))
    one = pieces.select("rep_key", "text_key", "shift", F.explode(_joined(F.col("pieces"))).alias("p"))
    out = cut(one.select("rep_key", F.col("p.lo").alias("rep_start"), "text_key", (F.col("p.lo") + F.col("shift")).alias("start"), (F.col("p.hi") - F.col("p.lo")).alias("length")))
    release(around, classes, stretches)
    return records, out


def linked_pairs(records: DataFrame, spans: DataFrame, span: int = LEAST_SPAN) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: every pair of records with a common span; equal texts included."""
    ties = spans.filter("rep_key <> text_key")
    # `span` characters of a representative hold exactly one multiple of `span`, so texts that share them meet at it
    grid = F.explode(F.sequence(F.ceil(F.col("rep_start") / span).cast("int"), F.floor((F.col("rep_start") + F.col("length") - 1) / span).cast("int")))
    at = ties.select("rep_key", "text_key", F.col("rep_start").alias("lo"), (F.col("rep_start") + F.col("length")).alias("hi"), grid.alias("grid"))
    side = lambda x: at.select("rep_key", "grid", *[F.col(c).alias(f"{c}_{x}") for c in ("text_key", "lo", "hi")])
    both = side("a").join(side("b"), ["rep_key", "grid"]).filter("text_key_a < text_key_b").filter(F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b") >= span)
    keys = both.select("text_key_a", "text_key_b").unionByName(ties.select(F.col("rep_key").alias("text_key_a"), F.col("text_key").alias("text_key_b"))).dropDuplicates()
    member = lambda k, d: records.select(F.col("text_key").alias(k), F.col("doc_id").alias(d))
    across = keys.join(member("text_key_a", "x"), "text_key_a").join(member("text_key_b", "y"), "text_key_b")
    within = member("text_key_a", "x").join(member("text_key_a", "y"), "text_key_a").filter("x < y")
    pairs = across.select("x", "y").unionByName(within.select("x", "y"))
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).filter("doc_id_a < doc_id_b").dropDuplicates()


def shared_share(docs: DataFrame, records: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share): how much of each record stands elsewhere; NULL text gives 0 of 0 characters."""
    ties = spans.filter("rep_key <> text_key")
    end = lambda c: (F.col(c) + F.col("length")).alias("hi")
    sides = ties.select("text_key", F.col("start").alias("lo"), end("start")).unionByName(ties.select(F.col("rep_key").alias("text_key"), F.col("rep_start").alias("lo"), end("rep_start")))
    farthest = lambda df: df.groupBy("text_key", "lo").agg(F.max("hi").alias("hi"))  # noqa: E731 - at most one a character
    gather = lambda df: farthest(df).groupBy("text_key").agg(_joined(F.collect_list(F.struct("lo", "hi"))).alias("pieces"))
    # what a representative repeats within itself is shared as far as the repeated part is shared with another text
    repeats = spans.filter("rep_key = text_key").select("text_key", F.col("rep_start").alias("a"), (F.col("rep_start") + F.col("length")).alias("b"), (F.col("start") - F.col("rep_start")).alias("shift"))
    more = repeats.join(gather(sides), "text_key").withColumn("p", F.explode("pieces"))
    more = more.select("text_key", (F.greatest("a", "p.lo") + F.col("shift")).alias("lo"), (F.least("b", "p.hi") + F.col("shift")).alias("hi")).filter("lo < hi")
    covered = gather(sides.unionByName(more)).select("text_key", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"]).alias("covered"))
    copies = records.groupBy("text_key").agg(F.countDistinct("doc_id").alias("copies"))
    per = records.join(copies, "text_key").join(covered, "text_key", "left")
    per = per.select("doc_id", F.when(F.col("copies") > 1, F.col("n_chars").cast("long")).otherwise(F.coalesce("covered", F.lit(0).cast("long"))).alias("shared_chars"))
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars")).filter("doc_id is not null").dropDuplicates(["doc_id"])
    out = base.join(per, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("long")))
    return out.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
