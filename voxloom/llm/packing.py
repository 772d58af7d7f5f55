"""Filling containers of fixed capacity with sequences.

The plan is made on the histogram of lengths, which has at most ``capacity`` rows
however many sequences there are: sequences above a third of the capacity are
matched greedily, at most two a container; shorter ones go, longest first, into
the tightest gaps. The plan says which ranks of each length go into which range of
containers, so that each sequence finds its container by its length and rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.plans.scale import bits_for, mixed, written

CAPACITY = 8192


class _Gaps:
    """Containers by what is left in them; ranges (first, count) of equal containers."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if count and gap:
            if gap not in self.ranges:
                self.ranges[gap] = []
                insort(self.sizes, gap)
            self.ranges[gap].append((first, count))

    def tightest(self, length: int) -> int | None:
        i = bisect_left(self.sizes, length)
        return self.sizes[i] if i < len(self.sizes) else None

    def take(self, gap: int, most: int) -> tuple[int, int]:
        first, count = self.ranges[gap].pop()
        if count > most:
            self.ranges[gap].append((first + most, count - most))
            count = most
        elif not self.ranges[gap]:
            del self.ranges[gap]
            self.sizes.remove(gap)
        return first, count


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rules (length, rank, count, container, each, slot) and the number of containers:
    the sequences of ``length`` with ranks rank .. rank + count - 1 (from 0) go, ``each``
    at a time, into the containers from ``container`` on. ``slot`` orders the sequences
    of a container. The number of rules depends on the capacity, not on the counts."""
    left = {k: v for k, v in histogram.items() if v > 0 and 0 < k <= capacity}
    used = dict.fromkeys(left, 0)
    rules: list[tuple[int, int, int, int, int, int]] = []
    gaps, total, slot = _Gaps(), 0, 0

    def place(length: int, count: int, container: int, each: int) -> None:
        nonlocal slot
        rules.append((length, used[length], count, container, each, slot))
        slot += 1
        used[length] += count
        left[length] -= count

    # matching of the large: the longest takes the longest large partner that fits
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large.pop()
        while left[a]:
            i = bisect_left(large, capacity - a + 1) - 1
            while i >= 0 and not left[large[i]]:
                large.pop(i)
                i -= 1
            self_pair = 2 * a <= capacity and left[a] > 1
            if self_pair:  # no longer partner than a itself is left
                pairs = left[a] // 2
                place(a, 2 * pairs, total, 2)
                gaps.add(capacity - 2 * a, total, pairs)
            elif i >= 0:
                b, pairs = large[i], min(left[a], left[large[i]])
                place(a, pairs, total, 1)
                place(b, pairs, total, 1)
                gaps.add(capacity - a - b, total, pairs)
            else:
                pairs = left[a]
                place(a, pairs, total, 1)
                gaps.add(capacity - a, total, pairs)
            total += pairs
    # the small into the tightest gaps
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            gap = gaps.tightest(s)
            if gap is None:
                each = capacity // s
                full, rest = divmod(left[s], each)
                if full:
                    place(s, full * each, total, each)
                    gaps.add(capacity - each * s, total, full)
                    total += full
                if rest:
                    place(s, rest, total, rest)
                    gaps.add(capacity - rest * s, total, 1)
                    total += 1
                continue
            each = gap // s
            if left[s] >= each:
                first, count = gaps.take(gap, left[s] // each)
                place(s, count * each, first, each)
                gaps.add(gap - each * s, first, count)
            else:
                rest = left[s]
                first, _ = gaps.take(gap, 1)
                place(s, rest, first, rest)
                gaps.add(gap - rest * s, first, 1)
    return rules, total


def pieces(sequences: DataFrame, row: str = "row_no", ids: str = "input_ids", capacity: int = CAPACITY) -> DataFrame:
    """(row_no, piece_no, start, length): a sequence within the capacity is one
    piece; a longer one is cut into full pieces and a rest. Null and empty
    sequences have one piece of length 0."""
    n = F.coalesce(F.size(F.col(ids)), F.lit(0))
    n = F.greatest(n, F.lit(0))
    sized = sequences.select(F.col(row).alias("row_no"), n.alias("_n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("_n") / capacity).cast("int") - 1)
    cut = sized.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece_no") * capacity
    return cut.select("row_no", "piece_no", start.alias("start"), F.least(F.lit(capacity), F.col("_n") - start).alias("length"))


def pack(sequences: DataFrame, row: str = "row_no", ids: str = "input_ids", capacity: int = CAPACITY) -> DataFrame:
    """(row_no, piece_no, start, length, container, slot): which container each piece
    of each sequence is in, and its order there. Pieces of length 0 take no room:
    their container and slot are null. Equal lengths are ranked by a repeatable
    random place; a length held by most rows is ranked in many parts."""
    cut = written(pieces(sequences, row, ids, capacity), "pieces")
    total = cut.count()
    # a full piece needs no rank among the others of its length beyond a container of its own
    spread = cut.filter("length > 0").withColumn("_place", mixed(F.col("row_no"), F.col("piece_no")))
    bits = bits_for(total)
    spread = spread.withColumn("_bucket", F.shiftright("_place", 62 - bits).cast("int"))
    totals = written(spread.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_k")), "histogram")
    histogram = {r["length"]: r["k"] for r in totals.groupBy("length").agg(F.sum("_k").alias("k")).collect()}  # at most `capacity` rows
    rules, _ = plan(histogram, capacity)
    spark = sequences.sparkSession
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("length", "_bucket", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("_place", "row_no", "piece_no")
    ranked = spread.withColumn("_own", F.row_number().over(within) - 1).join(offsets, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_own") + F.col("_before"))
    table = spark.createDataFrame(rules, "length int, _first long, _count long, _container long, _each int, _slot int")
    # a row a length with its rules in order of their first ranks: bounded by the capacity, and a piece stays one row
    rule = F.struct("_first", "_count", "_container", "_each", "_slot")
    table = table.groupBy("length").agg(F.array_sort(F.collect_list(rule)).alias("_rules"))
    at = F.size(F.filter(F.transform("_rules", lambda r: r["_first"]), lambda first: first <= F.col("_rank"))) - 1
    hit = ranked.join(F.broadcast(table), "length").withColumn("_rule", F.get("_rules", at)).drop("_rules").select("*", "_rule.*")
    hit = hit.filter(F.col("_rank") < F.col("_first") + F.col("_count"))
    i = F.col("_rank") - F.col("_first")
    slot = F.col("_slot").cast("long") * capacity + i % F.col("_each")
    placed = hit.select("row_no", "piece_no", "start", "length", (F.col("_container") + F.floor(i / F.col("_each"))).alias("container"), slot.alias("slot"))
    none = cut.filter("length = 0").select("*", F.lit(None).cast("long").alias("container"), F.lit(None).cast("long").alias("slot"))
    return placed.unionByName(none)


def found(packed: DataFrame, row: str = "row_no") -> DataFrame:
    """(row_no) of sequences that were cut because they are longer than a container."""
    return packed.filter("piece_no = 1").select(F.col("row_no").alias(row))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, ids, the least that could hold them, and the
    unused share of the room in 1/10000."""
    per = packed.filter("container is not null").groupBy("container").agg(F.sum("length").alias("s"), F.count(F.lit(1)).alias("k"))
    total = F.coalesce(F.sum("s"), F.lit(0))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_pieces"), total.alias("n_ids"),
        F.ceil(total / capacity).alias("least_containers"),
        F.when(F.count(F.lit(1)) > 0, F.round(10000 * (1 - total / (F.count(F.lit(1)) * capacity)), 2)).alias("unused_bp"),
        F.max("s").alias("fullest"),
    )


def containers(sequences: DataFrame, packed: DataFrame, row: str = "row_no", ids: str = "input_ids") -> DataFrame:
    """(container, row_nos, lengths, ids): the containers themselves. A container's
    pieces hold at most ``capacity`` ids together, so no group is unbounded."""
    where = packed.filter("container is not null").withColumnRenamed("row_no", row)
    parts = sequences.select(row, ids).join(where, row).select("container", F.struct("slot", F.col(row).alias("row_no"), "piece_no", F.slice(F.col(ids), F.col("start") + 1, F.col("length")).alias("ids")).alias("p"))
    out = parts.groupBy("container").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return out.select("container", F.col("p.row_no").alias("row_nos"), F.transform("p", lambda p: F.size(p["ids"])).alias("lengths"), F.flatten("p.ids").alias("ids"))


