"""Problem 8: fill containers of fixed capacity with documents, leaving little space unused.

Method: Martello-Toth dominance reduction, then best fit for the rest. What is packed is the
histogram of sizes, which has at most `capacity` entries however many documents there are: a
reduction step fixes a set of at most three sizes that dominates every other set with its largest
item, for as many containers at once as the counts allow. Containers are numbered in ranges, so the
plan is a table of at most a few rows a size; documents find their container by their rank within
their size.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.tokens import VOCABULARY, count_tokens
from lodeweave.plans.ordered import number_within
from lodeweave.plans.runtime import cut, small


class _Sizes:
    """A multiset of sizes."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0 and s > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.order.pop(bisect.bisect_left(self.order, size))

    def largest(self, room: int) -> int:
        """The largest size of at most `room`, or 0."""
        i = bisect.bisect_right(self.order, room)
        return self.order[i - 1] if i else 0


def _dominating(sizes: _Sizes, j: int, room: int) -> tuple[int, ...] | None:
    """Sizes that, with one item of size j, dominate every other filling of its container; sizes is without that item."""
    k = sizes.largest(room)
    if not k:
        return ()
    if k == room:
        return (k,)
    # the best pair by its larger member, and the largest smaller member of any feasible pair
    order, count = sizes.order, sizes.count
    hi = bisect.bisect_right(order, room) - 1
    least = order[0] * 2 if count[order[0]] > 1 else (order[0] + order[1] if len(order) > 1 else room + 1)
    if least > room:
        return (k,)
    three = []
    for s in order[:3]:
        three += [s] * min(3 - len(three), count[s])
    fits_three = len(three) == 3 and sum(three) <= room
    rest = sizes.largest(room - order[0])
    if fits_three and order[0] + rest > k and (rest != order[0] or count[rest] > 1):
        return None  # neither one item nor a pair can dominate
    best_sum = best_low = 0
    lo = 0
    for i in range(hi, -1, -1):
        a = order[i]
        if a + order[0] > room:
            continue
        while lo + 1 < len(order) and order[lo + 1] + a <= room:
            lo += 1
        b = order[min(lo, i)]
        if b == a and count[a] < 2:
            if i == 0:
                break
            b = order[i - 1]
        best_sum, best_low = max(best_sum, a + b), max(best_low, b)
        if lo >= i:  # smaller a only give smaller pairs from here on
            break
    if k >= best_sum:
        return (k,)
    b = sizes.largest(room - k)
    if b == k and count[k] < 2:
        i = bisect.bisect_left(order, k)
        b = order[i - 1] if i else 0
    if not b or best_low > b:
        return None
    return None if fits_three else (k, b)  # the triple {j, k, b} dominates if no three items fit beside j


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(rows, containers): rows (size, rank_from, rank_to, first container, items of that size in each container)."""
    sizes = _Sizes({s: n for s, n in counts.items() if s <= capacity})
    used: dict[int, int] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    bins = 0
    open_bins: dict[int, list[tuple[int, int]]] = {}  # space left -> ranges (first, number)

    def put(size: int, first: int, number: int, each: int) -> None:
        at = used.get(size, 0)
        rows.append((size, at, at + number * each, first, each))
        used[size] = at + number * each

    def leave(first: int, number: int, room: int) -> None:
        if room:
            open_bins.setdefault(room, []).append((first, number))

    changed = True
    while changed:  # the reduction
        changed = False
        for j in list(reversed(sizes.order)):
            while sizes.count.get(j):
                sizes.take(j, 1)
                found = _dominating(sizes, j, capacity - j)
                sizes.count[j] = sizes.count.get(j, 0) + 1
                if sizes.count[j] == 1:
                    bisect.insort(sizes.order, j)
                if found is None:
                    break
                members: dict[int, int] = {}
                for s in (j, *found):
                    members[s] = members.get(s, 0) + 1
                times = min(sizes.count[s] // m for s, m in members.items())
                if len(found) and any(sizes.count[s] - times * m < 2 for s, m in members.items()):
                    times = max(1, times - 1)  # near the end of a count the test is made anew
                for s, m in members.items():
                    sizes.take(s, times * m)
                    put(s, bins, times, m)
                leave(bins, times, capacity - sum(s * m for s, m in members.items()))
                bins += times
                changed = True
    rooms = sorted(open_bins)
    for j in list(reversed(sizes.order)):  # best fit, largest first
        n = sizes.count[j]
        while n:
            i = bisect.bisect_left(rooms, j)
            if i == len(rooms):
                each = capacity // j
                number = max(1, n // each)
                first, bins = bins, bins + number
                room = capacity
            else:
                room = rooms[i]
                first, number = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
            each = min(room // j, n)
            fit = min(number, n // each)
            put(j, first, fit, each)
            n -= fit * each
            for at, count, left in ((first, fit, room - each * j), (first + fit, number - fit, room)):
                if count and left:
                    if left not in open_bins:
                        bisect.insort(rooms, left)
                    leave(at, count, left)
    return rows, bins


def pack_documents(
    docs: DataFrame, capacities: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, sizes: DataFrame | None = None
) -> DataFrame:
    """Containers of each capacity filled with documents.

    Result: container (the name of the capacity), container_no (from 0), doc_id, piece_no, token_from, tokens.
    A document is whole (piece_no 0, token_from 0) unless it has more tokens than the capacity; then it is cut
    into full containers and a rest, piece by piece. No container holds more than its capacity. A document
    with NULL text or NULL key is left out, one of no tokens takes no space and lies in container 0. Repeated
    rows (same key, same number of tokens) count once. Capacities that are NULL or under 1 are left out, of several
    with one name the largest counts. Empty tables give an empty result; other columns are ignored. `sizes` may
    hold (doc_id, tokens) counted before.
    """
    spark = docs.sparkSession
    if sizes is None:
        sizes = count_tokens(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")), "_text", vocabulary)
    sizes = cut(sizes.select("doc_id", "tokens").filter("tokens is not null and doc_id is not null").dropDuplicates())
    # one row a capacity, from a table of settings
    caps = capacities.filter("capacity_tokens >= 1").groupBy("container").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    # the full pieces of oversized documents need no plan; the rests are items like any other
    items = sizes.crossJoin(F.broadcast(caps)).withColumn("full", F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(F.lit(0)))
    items = items.withColumn("rest", F.col("tokens") - F.col("full") * F.col("capacity"))
    rests = items.filter("rest > 0 or full = 0").select("container", "capacity", "doc_id", "full", "rest")
    whole = items.filter("full > 0").select("container", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece_no"))

    histogram: dict[str, dict[int, int]] = {}
    capacity_of = {r["container"]: r["capacity"] for r in caps.collect()}
    for r in rests.groupBy("container", "rest").count().collect():  # at most `capacity` rows a capacity
        histogram.setdefault(r["container"], {})[r["rest"]] = r["count"]
    plans = []
    bins: dict[str, int] = {}
    for name, counts in histogram.items():
        rows, bins[name] = plan(counts, capacity_of[name])
        plans += [(name, *row) for row in rows]
        if counts.get(0):
            plans.append((name, 0, 0, counts[0], 0, counts[0]))
            bins[name] = max(1, bins[name])
    table = spark.createDataFrame(plans, "container string, rest long, rank_from long, rank_to long, first_no long, each long")
    ranked = number_within(rests, ["container", "rest"], ["doc_id"])
    placed = ranked.join(small(table), ["container", "rest"]).filter("rank >= rank_from and rank < rank_to")  # the plan is bounded by the capacities
    placed = placed.select(
        "container",
        (F.col("first_no") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("each"))).alias("container_no"),
        "doc_id",
        F.col("full").cast("long").alias("piece_no"),
        (F.col("full") * F.col("capacity")).cast("long").alias("token_from"),
        F.col("rest").alias("tokens"),
    )
    start = spark.createDataFrame(list(bins.items()), "container string, used long")
    whole = number_within(whole, ["container"], ["doc_id", "piece_no"]).join(F.broadcast(start), "container", "left")
    whole = whole.select(
        "container",
        (F.coalesce("used", F.lit(0)) + F.col("rank")).alias("container_no"),
        "doc_id",
        "piece_no",
        (F.col("piece_no") * F.col("capacity")).cast("long").alias("token_from"),
        F.col("capacity").alias("tokens"),
    )
    return placed.unionByName(whole)
