"""Problem 3: near-duplicate records with small edits.

Method: records become sets of words; a pair is found if |A and B| / |A or B| >= t. Sets are put
into size-banded tiles: one tile per (group, size band, word of the set's prefix), where the prefix
holds the |A| - ceil(t |A|) + 1 rarest words, so that every pair over the threshold meets in the
tile of the first word they have in common. A set that may have partners in the next smaller band is its
guest. Within a tile, sorted by size, the place of the word in both sets and then hashed bitmap signatures
bound the overlap from above: popcount(a xor b) <= |A xor B|, hence |A and B| <= (|A| + |B| - popcount) / 2.
Pairs that pass are intersected exactly. No pair over the threshold can be lost, whatever the word order or signature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.plans.runtime import cut, release, shuffle_width, small

#: Words are ordered by a count sketch of this fixed size (as broadcast to each executor: 4 bytes a cell).
SKETCH_CELLS = 1 << 18
SIGNATURE_WORDS = 4  # 64-bit words of a bitmap signature: on notes of 40 words two would let 1.7 times the links through, four hardly more than the links
BAND = 4  # a band reaches over so many steps of the threshold: of four sets about one is a guest, too
TILE_ROWS = 2000  # a larger tile is compared in blocks of this size, each pair of blocks in its own task


def word_sets(records: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(rec_id, grp, words): the sorted set of lower-cased runs of a-z and 0-9; records without words are left out."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))))
    out = records.select(F.col(key).alias("rec_id"), F.col(group).alias("grp"), words.alias("words"))
    return out.filter("rec_id is not null and grp is not null and size(words) > 0")


def _sketch(sets: DataFrame) -> np.ndarray:
    """Document counts of hashed words: a table of fixed size, whatever the corpus."""
    cell = F.pmod(F.xxhash64("word"), F.lit(SKETCH_CELLS)).cast("int").alias("cell")
    counts = sets.select(F.explode("words").alias("word")).select(cell).groupBy("cell").count().toPandas()
    table = np.zeros(SKETCH_CELLS, dtype=np.int64)
    table[counts["cell"].to_numpy()] = counts["count"].to_numpy()
    return np.minimum(table, 2**31 - 1).astype(np.int32)


def _tiles(sketch, num: int, den: int):
    """Rows of a set: one for each prefix word in its own band, and one as a guest of the next smaller band if it may have partners there."""
    step = np.log(den / num) if num < den else 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = sketch.value
        for rows in batches:
            if rows.empty:
                continue
            sizes = rows["hashes"].map(len).to_numpy()
            flat = np.concatenate(rows["hashes"].to_numpy())
            of = np.repeat(np.arange(len(rows)), sizes)
            bits = flat.view(np.uint64) % np.uint64(64 * SIGNATURE_WORDS)
            sig = np.zeros((len(rows), SIGNATURE_WORDS), dtype=np.uint64)
            np.bitwise_or.at(sig, (of, (bits >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bits & np.uint64(63)))
            order = np.lexsort((flat, count[flat % SKETCH_CELLS], of))
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            prefix = sizes - (-(-sizes * num // den)) + 1
            keep = rank < prefix[of]
            at, word, rank = of[keep], flat[order][keep], rank[keep]
            level = np.log(sizes) / step
            band = np.floor(level / BAND + 1e-9).astype(np.int64)
            below = np.floor((level - 1) / BAND - 1e-9) < band
            for guest in (False, True):
                if guest:
                    some = below[at]
                    at, word, rank = at[some], word[some], rank[some]
                key = (word ^ rows["grp"].to_numpy()[at]) * np.int64(-7046029254386353131) + (band[at] - guest)
                yield pd.DataFrame(
                    {
                        "tile": key ^ (key >> np.int64(29)),
                        "guest": guest,
                        "rec_id": rows["rec_id"].to_numpy()[at],
                        "size": sizes[at].astype(np.int32),
                        "rank": rank.astype(np.int32),
                        **{f"s{i}": sig[at, i].view(np.int64) for i in range(SIGNATURE_WORDS)},
                    }
                )

    return run


_TILE_SCHEMA = "tile long, guest boolean, rec_id long, size int, rank int, " + ", ".join(f"s{i} long" for i in range(SIGNATURE_WORDS))


def _compare(num: int, den: int):
    """Pairs of a tile that the bounds let through; rows come sorted by tile and size, a tile is at most about 2 TILE_ROWS rows."""
    def begins(rows: pd.DataFrame) -> np.ndarray:
        """Whether a tile begins at a row."""
        new = np.ones(len(rows), dtype=bool)
        new[1:] = False
        for c in ("tile", "block_a", "block_b"):
            x = rows[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return new

    def pairs(rows: pd.DataFrame) -> pd.DataFrame | None:
        change = begins(rows)
        size = rows["size"].to_numpy().astype(np.int64)
        # rows of one tile come by size: the partners of a row end where the sizes are too large for it
        place = np.cumsum(change) * (1 << 33) + size
        most = np.searchsorted(place, np.cumsum(change) * (1 << 33) + size * den // num, side="right")
        n = most - np.arange(len(rows)) - 1
        sig = np.stack([rows[f"s{i}"].to_numpy().view(np.uint64) for i in range(SIGNATURE_WORDS)], axis=1)
        guest, block = rows["guest"].to_numpy(), rows["block"].to_numpy()
        off = (rows["block_a"] != rows["block_b"]).to_numpy()
        rest = size - rows["rank"].to_numpy()  # from the word of the tile on
        ids, out = rows["rec_id"].to_numpy(), []
        lo = 0
        total = np.cumsum(n)
        while lo < len(rows):  # so many pairs at a time that memory stays small
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + 2_000_000, side="right")))
            m = n[lo:hi]
            a = np.repeat(np.arange(lo, hi), m)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
            both = size[a] + size[b]
            # of a pair whose first common word this is, all other common words come behind it in both sets
            ok = np.minimum(rest[a], rest[b]) * (num + den) >= both * num
            # two guests meet as owners of their own band; blocks of a split tile meet once
            ok &= ~(guest[a] & guest[b]) & (ids[a] != ids[b]) & (~off[a] | (block[a] != block[b]))
            a, b, both = a[ok], b[ok], both[ok]
            apart = np.zeros(len(a), dtype=np.int64)
            for i in range(SIGNATURE_WORDS):
                apart += np.bitwise_count(sig[a, i] ^ sig[b, i])
            ok = ((both - apart) // 2) * (num + den) >= both * num
            a, b = a[ok], b[ok]
            if len(a):
                x, y = ids[a], ids[b]
                out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            lo = hi
        if not out:
            return None
        found = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for rows in batches:
            if rest is not None:
                rows = pd.concat([rest, rows], ignore_index=True)
            if rows.empty:
                continue
            cut_at = int(np.flatnonzero(begins(rows))[-1])
            rest = rows.iloc[cut_at:].reset_index(drop=True)
            if cut_at and (out := pairs(rows.iloc[:cut_at].reset_index(drop=True))) is not None:
                yield out
        if rest is not None and len(rest) > 1 and (out := pairs(rest)) is not None:
            yield out

    return run


def near_duplicates(
    records: DataFrame, key: str = "note_id", group: str = "workspace", text: str = "content", threshold: tuple[int, int] = (7, 10), tile_rows: int = TILE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records of one group whose word sets have at least threshold of their union in common.

    members(rec_id, grp, class_id): every record with words; class_id is the smallest rec_id of its group
    with exactly the same words, so copies are not expanded into pairs. links(grp, class_a, class_b,
    similarity): every pair of different classes over the threshold, class_a < class_b; no cap, exact.
    Records with NULL key, group or text and records without words (empty, blank, no a-z or 0-9) are in
    neither. Repeated rows count once. An empty table gives two empty results. Other columns are ignored.
    """
    num, den = threshold
    spark = records.sparkSession
    digest = F.unhex(F.substring(F.sha2(F.array_join("words", " "), 256), 1, 32))  # 128 bits: sets of one digest count as equal
    sets = cut(word_sets(records, key, group, text).withColumn("same", digest))
    classes = cut(sets.groupBy("grp", "same").agg(F.min("rec_id").alias("rec_id"), F.first("words").alias("words")))
    lookup = classes.select("grp", "same", F.col("rec_id").alias("class_id"))
    members = cut(sets.select("rec_id", "grp", "same").dropDuplicates().join(lookup, ["grp", "same"]).select("rec_id", "grp", "class_id"))
    release(sets)

    sketch = spark.sparkContext.broadcast(_sketch(classes))
    hashed = classes.select(F.xxhash64("grp").alias("grp"), "rec_id", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    tiles = made = cut(hashed.mapInPandas(_tiles(sketch, num, den), _TILE_SCHEMA))
    # a hot tile is cut into blocks by hash; each pair of blocks is a tile of its own
    hot = tiles.groupBy("tile").count().filter(F.col("count") > tile_rows).select("tile", F.ceil(F.col("count") / tile_rows).cast("int").alias("blocks"))
    tiles = tiles.join(small(cut(hot)), "tile", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("rec_id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = tiles.withColumn("block", block).withColumn("other", other)
    tiles = tiles.withColumn("block_a", F.least("block", "other")).withColumn("block_b", F.greatest("block", "other")).drop("other", "blocks")
    keys = ["tile", "block_a", "block_b"]
    tiles = tiles.repartition(shuffle_width(spark), *keys).sortWithinPartitions(*keys, "size")
    pairs = cut(tiles.mapInPandas(_compare(num, den), "a long, b long").dropDuplicates())
    release(made)

    side = lambda n: classes.select(F.col("rec_id").alias(n), F.col("words").alias(f"words_{n}"), F.col("grp").alias(f"grp_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("grp_a = grp_b")
    common = F.size(F.array_intersect("words_a", "words_b"))
    union = F.size("words_a") + F.size("words_b") - F.col("common")
    links = both.withColumn("common", common).withColumn("all", union).filter(F.col("common") * den >= F.col("all") * num)
    return members, links.select(F.col("grp_a").alias("grp"), F.col("a").alias("class_a"), F.col("b").alias("class_b"), (F.col("common") / F.col("all")).alias("similarity"))


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): every pair of different records, a < b, from the classes and their links."""
    m = lambda c, r: members.select("grp", F.col("class_id").alias(c), F.col("rec_id").alias(r))
    across = links.select("grp", "class_a", "class_b").join(m("class_a", "x"), ["grp", "class_a"]).join(m("class_b", "y"), ["grp", "class_b"])
    within = m("class_a", "x").join(m("class_a", "y"), ["grp", "class_a"]).filter("x < y")
    pairs = across.select("x", "y").unionByName(within.select("x", "y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").dropDuplicates()
