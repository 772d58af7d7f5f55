"""Splits that keep related records together.

A component table is kept from delivery to delivery. New records become edges
between the components of their keys; pointer jumping merges components; existing
components keep their split, new ones fill what each split lacks, and a merge of
components that lie in different splits is quarantined.

The table has two resolutions. A *part* is a component as far as it has one split: it
grows by merges that bring no conflict. A *component* is closed under all ties, those of
quarantined records too. Keys that are first seen in a quarantined merge are stored as
held: records with them are quarantined as well, whenever they come.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions.forms import bare, blank_to_null
from voxloom.plans.scale import bits_for, free, mixed, running, skew_join, subfolders, written

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Components above this share of all rows are placed one by one, largest first;
#: there are at most ``1 / LARGE`` of them.
LARGE = 1 / 2000
#: A held key is a part of its own, numbered from here on: above all example ids.
HELD = 1 << 62

KEYS = "key binary, part long, split string, component long"
MEMBERS = "example_id long, key binary, speaker long, split string, counted boolean"
TOTALS = "split string, n long"


class State(NamedTuple):
    """The component table: keys (key, part, split, component), split null where held;
    members (example_id, key, speaker, split, counted), split of those without any key
    only, an example again under each key it came with later, and when it got a split
    after a quarantine; totals (split, n) of distinct examples with a split: those that
    are counted."""

    keys: DataFrame
    members: DataFrame
    totals: DataFrame


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node connected with node, for all nodes
    of ``edges`` (a, b). Each round every node points to the smallest node within
    two steps and the edges are contracted along the pointers, so that the number
    of rounds grows with the logarithm of the longest path. Each round is written
    to the shared folder; no node or edge is collected."""
    levels: list[DataFrame] = []
    sizes: list[int] = []
    live = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while n := live.count():
        both = live.union(live.select("b", "a"))
        near = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "near")
        far = skew_join(both, near, ["a"], "b", "inner", 2 * n).select(F.col("b").alias("v"), F.col("m").alias("p"))
        point = written(far.union(near).groupBy("v").agg(F.min("p").alias("p")), "pointers")
        levels.append(point)
        sizes.append(2 * n)  # a bound of the nodes
        steps = live.union(point.filter("v <> p").select(F.col("v").alias("a"), F.col("p").alias("b")))
        one = skew_join(steps, point.select(F.col("v").alias("a"), F.col("p").alias("pa")), ["a"], "b", "inner", 3 * n).select("b", "pa")
        half = written(one, "half")
        two = skew_join(half, point.select(F.col("v").alias("b"), F.col("p").alias("pb")), ["b"], "pa", "inner", 3 * n)
        ends = two.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        used, live = live, written(ends.distinct(), "edges")
        free(used, near, half)
    if not levels:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    out = levels[-1].select(F.col("v").alias("node"), F.col("p").alias("root"))
    for point, n in reversed([*zip(levels[:-1], sizes)]):
        up = skew_join(point, out.select(F.col("node").alias("p"), "root"), ["p"], "v", "left", n)
        below, out = out, written(up.select(F.col("v").alias("node"), F.coalesce("root", "p").alias("root")), "roots")
        free(below, point)
    return out


def example_keys(examples: DataFrame, clips: DataFrame) -> DataFrame:
    """(example_id, skey, tkey) of all examples: 128-bit digests of the bare
    speaker (through clip_id) and the bare reference text; null where a key ties
    nothing. Repeated clip rows count once."""
    speakers = clips.filter("id is not null").groupBy(F.col("id").alias("clip_id")).agg(F.max("speaker").alias("_speaker"))
    rows = skew_join(examples.select("example_id", "clip_id", "reference_text"), speakers, ["clip_id"], "example_id", "left")
    key = lambda kind, c: F.unhex(F.md5(F.concat(F.lit(kind), c)))
    name = bare(F.col("_speaker"))
    return rows.select(
        "example_id",
        key("s", F.when((F.length(name) > 0) & (name != "unknown"), name)).alias("skey"),
        key("t", blank_to_null(bare(F.col("reference_text")))).alias("tkey"),
    )


def empty(spark: SparkSession) -> State:
    """The component table before the first delivery."""
    return State(*[spark.createDataFrame([], s) for s in (KEYS, MEMBERS, TOTALS)])


def _speaker() -> F.Column:
    return F.when(F.col("skey").isNotNull(), F.xxhash64("skey"))


def _tied(rows: DataFrame, n: int, prior: State | None, save: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(nodes, root, touched, again) of a delivery of ``n`` rows: nodes (key, node, part, split,
    component, group) of its keys; root (node, root); touched (group, part, split) of
    the parts it ties; again (example_id, key, speaker) of examples that came before
    under another key."""
    pairs = save(rows.groupBy("skey", "tkey").agg(F.min("example_id").alias("least")), "pairs")
    sides = pairs.select(F.explode(F.array("skey", "tkey")).alias("key"), "least").filter("key is not null")
    own = sides.groupBy("key").agg(F.min("least").alias("least"))
    none = F.lit(None)
    if prior is None:
        nodes = own.select("key", F.col("least").alias("node"), "least", none.cast("long").alias("part"), none.cast("string").alias("split"), none.cast("long").alias("component"))
    else:
        nodes = own.join(prior.keys, "key", "left").select("key", F.coalesce("part", "least").alias("node"), "least", "part", "split", "component")  # a row a key on both sides
    nodes = save(nodes, "nodes")
    at = nodes.select("key", "node")
    with_s = skew_join(pairs.filter("skey is not null and tkey is not null"), at.select(F.col("key").alias("skey"), F.col("node").alias("a")), ["skey"], "least", "inner", n)
    half = save(with_s, "half")
    edges = skew_join(half, at.select(F.col("key").alias("tkey"), F.col("node").alias("b")), ["tkey"], "least", "inner", n).select("a", "b")
    touched, again = None, None
    if prior is not None:
        # the smallest example of each group must be its id also where all keys are old
        edges = edges.union(nodes.filter("part is not null").select("node", "least"))
        # an example that came before under another key, or without any, ties that to its keys now
        now = rows.select("example_id", F.coalesce("skey", "tkey").alias("now"), "skey", "tkey").filter("now is not null")
        moved = now.join(prior.members.select("example_id", F.col("key").alias("old"), F.col("split").alias("old_split")), "example_id")
        moved = moved.filter("old is null or not (old <=> skey or old <=> tkey)").select("example_id", "now", "old", "old_split", _speaker().alias("speaker"))
        moved = save(skew_join(save(moved, "moved"), at.select(F.col("key").alias("now"), "node"), ["now"], "example_id", "inner"), "moved_nodes")
        back = skew_join(moved.filter("old is not null"), prior.keys.select(F.col("key").alias("old"), F.col("part").alias("was"), F.col("split").alias("was_split")), ["old"], "example_id", "inner").select("node", "was", "was_split")
        back = save(back.unionByName(moved.filter("old is null").select("node", F.col("example_id").alias("was"), F.col("old_split").alias("was_split"))).distinct(), "back")
        edges = edges.union(back.select("node", "was"))
        again = moved.select("example_id", F.col("now").alias("key"), "speaker")
    root = roots(edges)
    grouped = save(skew_join(nodes, root, ["node"], "key", "left", 2 * n).withColumn("group", F.coalesce("root", "node")).drop("root"), "grouped")
    if prior is not None:
        old = grouped.filter("part is not null").select("group", "part", "split", "component")
        came = skew_join(back.select(F.col("node"), F.col("was").alias("part"), F.col("was_split").alias("split")), root, ["node"], "part", "left")
        touched = old.unionByName(came.select(F.coalesce("root", "node").alias("group"), "part", "split", F.lit(None).cast("long").alias("component")))
        touched = save(touched.distinct(), "touched")
    free(pairs, half)
    return grouped, root, touched, again


def components(rows: DataFrame) -> DataFrame:
    """(example_id, group_id, speaker) of one delivery of (example_id, skey, tkey):
    groups closed under shared keys. group_id is the smallest example_id of the group;
    speaker a number that is equal for equal speakers, null without one. Examples
    without any key are groups of one."""
    rows = written(rows.select("example_id", "skey", "tkey"), "keys")
    n = rows.count()
    nodes, *_ = _tied(rows, n, None, written)
    first = rows.select("example_id", F.coalesce("skey", "tkey").alias("key"), _speaker().alias("speaker"))
    joined = skew_join(first, nodes.select("key", "group"), ["key"], "example_id", "left", n)
    return joined.select("example_id", F.coalesce("group", "example_id").alias("group_id"), "speaker")


def members(state: State) -> DataFrame:
    """(example_id, group_id, speaker) of all examples of the table, one row each,
    group_id the smallest example_id of the closed component."""
    joined = skew_join(state.members, state.keys.select("key", "component"), ["key"], "example_id", "left")
    at = joined.groupBy("example_id").agg(F.min(F.coalesce("component", "example_id")).alias("group_id"), F.max("speaker").alias("speaker"))
    return written(at, "members")


def found(groups: DataFrame) -> DataFrame:
    """(example_id, group_id) of groups with two or more speakers, having none being one more."""
    stats = groups.groupBy("group_id").agg(F.min("speaker").alias("lo"), F.max("speaker").alias("hi"), F.count("speaker").alias("k"), F.count(F.lit(1)).alias("n"))
    cases = written(stats.filter("lo <> hi or (k > 0 and k < n)").select("group_id"), "cases")
    return skew_join(groups.select("example_id", "group_id"), cases, ["group_id"], "example_id", "inner").select("example_id", "group_id")


def fill(sizes: DataFrame, shares: Mapping[str, float] = SHARES, taken: Mapping[str, int] | None = None, seed: int = 1) -> DataFrame:
    """(group_id, n) -> (group_id, n, split): groups above ``LARGE`` of all rows go,
    largest first, to the split that lacks most (in proportion to its share where
    none lacks any); the others are laid end to end in random order and cut where
    the splits' remaining needs end."""
    names = [k for k, v in shares.items() if v > 0]
    taken = dict(taken or {})
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k")).first()
    goal = {k: shares[k] * (total["n"] + sum(taken.values())) - taken.get(k, 0) for k in names}
    cut = max(2.0, total["n"] * LARGE)
    large = sizes.filter(F.col("n") > cut).orderBy(F.desc("n"), "group_id").collect()  # fewer than 1 / LARGE rows
    placed = []
    for r in large:
        to = max(names, key=lambda k: (goal[k], shares[k]))
        goal[to] -= r["n"]
        placed.append((r["group_id"], r["n"], to))
    spark = sizes.sparkSession
    big = spark.createDataFrame(placed, "group_id long, n long, split string")
    need = {k: max(0.0, v) for k, v in goal.items()}
    scale = total["n"] - sum(r["n"] for r in large)
    full = sum(need.values()) or 1.0
    small = sizes.filter(F.col("n") <= cut).withColumn("_place", mixed(F.col("group_id"), seed=seed)).withColumn("_all", F.lit(1))
    laid = running(small, ["_all"], "_place", ["group_id"], bits_for(total["k"]), "n", "_end")
    middle = F.col("_end") - F.col("n") / 2
    split, edge = F.lit(names[-1]), 0.0
    bounds: list[tuple[str, float]] = []
    for k in names:
        edge += need[k] / full * scale
        bounds.append((k, edge))
    for k, edge in reversed(bounds[:-1]):
        split = F.when(middle <= edge, F.lit(k)).otherwise(split)
    return big.unionByName(laid.select("group_id", "n", split.alias("split")))


def assign(rows: DataFrame, prior: State | None = None, shares: Mapping[str, float] = SHARES, save: Callable[[DataFrame, str], DataFrame] = written) -> tuple[DataFrame, State]:
    """One delivery of (example_id, skey, tkey): (example_id, group_id, split, status)
    and the component table for the next delivery. ``save`` writes a table under a name
    and reads it back.

    status is ``new``, ``kept`` (the group was there: its split holds) or
    ``quarantine`` (the delivery ties parts of different splits, or a held key: its
    rows get no split, and the parts keep theirs). group_id is the smallest example_id
    of the closed component, earlier deliveries included. Examples without any key are
    groups of one; those delivered again keep their split and are counted once, and one
    that comes under other keys than before ties both. Equal rows are given equal
    results. An empty delivery leaves the table as it is. Ids are below ``HELD``."""
    rows = written(rows.select("example_id", "skey", "tkey"), "keys")
    n = rows.count()
    nodes, root, touched, again = _tied(rows, n, prior, written)
    first = rows.select("example_id", F.coalesce("skey", "tkey").alias("key"), _speaker().alias("speaker"))
    joined = skew_join(first, nodes.select("key", "group"), ["key"], "example_id", "left", n)
    grouped = joined.withColumn("group", F.coalesce("group", "example_id"))
    if prior is None:
        grouped = grouped.withColumns({"seen": F.lit(False), "counted": F.lit(False), "own": F.lit(None).cast("string")})
    else:
        known = prior.members.groupBy("example_id").agg(F.max("split").alias("own"), F.bool_or("counted").alias("counted"), F.lit(True).alias("seen"))
        grouped = grouped.join(known, "example_id", "left").fillna(False, ["seen", "counted"])  # a row an example on the right
    grouped = written(grouped, "grouped_rows")
    fresh = grouped.filter("not counted").dropDuplicates(["example_id"])
    sizes = grouped.groupBy("group").agg(F.max(F.when(F.col("key").isNull(), F.col("own"))).alias("own"), F.count(F.lit(1)).alias("_"))
    more = fresh.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.drop("_").join(more, "group", "left").select(F.col("group").alias("group_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "own")  # a row a group
    if prior is not None:
        had = touched.groupBy("group").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.bool_or(F.col("split").isNull()).alias("held"))
        sizes = sizes.join(had.withColumnRenamed("group", "group_id"), "group_id", "left")
        sizes = sizes.select("group_id", "n", F.coalesce("lo", "own").alias("lo"), F.coalesce("hi", "own").alias("hi"), F.coalesce("held", F.lit(False)).alias("held"))
    else:
        sizes = sizes.select("group_id", "n", *[F.lit(None).cast("string").alias(c) for c in ("lo", "hi")], F.lit(False).alias("held"))
    sizes = written(sizes, "sizes")
    taken = {r["split"]: r["n"] for r in prior.totals.collect()} if prior is not None else {}  # a row a split
    kept = sizes.filter("lo is not null or held")
    apart = F.col("held") | (F.col("lo") != F.col("hi"))
    for r in kept.filter(~apart).groupBy("lo").agg(F.sum("n").alias("n")).collect():  # a row a split
        taken[r["lo"]] = taken.get(r["lo"], 0) + r["n"]
    new = fill(sizes.filter("lo is null and not held").select("group_id", "n"), shares, taken)
    placed = new.select("group_id", "split", F.lit("new").alias("status")).unionByName(
        kept.select("group_id", F.when(~apart, F.col("lo")).alias("split"), F.when(apart, "quarantine").otherwise("kept").alias("status"))
    )
    placed = placed.withColumnRenamed("group_id", "group")
    closed = None
    if prior is not None:
        # the closed components of the groups: ties of quarantined records count too
        steps = touched.filter("component is not null").select(F.col("group").alias("a"), F.col("component").alias("b"))
        closed = roots(steps.distinct())
        placed = skew_join(written(placed, "placed_parts"), closed.select(F.col("node").alias("group"), F.col("root").alias("component")), ["group"], "status", "left")
        placed = placed.withColumn("component", F.coalesce("component", "group"))
    else:
        placed = placed.withColumn("component", F.col("group"))
    placed = written(placed, "placed")
    out = skew_join(grouped.select("example_id", "group"), placed, ["group"], "example_id", "inner", n)
    out = save(out.select("example_id", F.col("component").alias("group_id"), "split", "status"), "assigned")
    # the table: keys of this delivery, then all others, whose parts and components may have been merged
    now = skew_join(nodes.select("key", "group", F.col("part").alias("was"), F.col("split").alias("was_split")), placed, ["group"], "key", "inner", 2 * n)
    held = F.col("status") == "quarantine"
    store = now.select(
        "key",
        F.when(~held, F.col("group")).otherwise(F.coalesce("was", F.lit(HELD) + F.xxhash64("key").bitwiseAND(F.lit(HELD - 1)))).alias("part"),
        F.when(~held, F.col("split")).otherwise(F.col("was_split")).alias("split"),
        "component",
    )
    if prior is not None:
        rest = prior.keys.join(nodes.select("key"), "key", "left_anti")
        merged = touched.join(placed.filter("status <> 'quarantine'").select("group"), "group").select("part", F.col("group").alias("to")).distinct()
        rest = skew_join(written(rest, "rest"), written(merged, "merged"), ["part"], "key", "left")
        rest = written(rest.select("key", F.coalesce("to", "part").alias("part"), "split", "component"), "rest_parts")
        rest = skew_join(rest, closed.select(F.col("node").alias("component"), "root"), ["component"], "key", "left")
        store = store.unionByName(rest.select("key", "part", "split", F.coalesce("root", "component").alias("component")))
    keys = save(store, "keys")
    alone = skew_join(fresh.select("example_id", "key", "speaker", "group", "seen"), placed.select("group", "split"), ["group"], "example_id", "inner", n).filter("not seen or split is not null")
    alone = alone.select("example_id", "key", "speaker", F.when(F.col("key").isNull(), F.col("split")).alias("split"), F.col("split").isNotNull().alias("counted"))
    if again is not None:
        alone = alone.unionByName(again.distinct().withColumns({"split": F.lit(None).cast("string"), "counted": F.lit(False)}))
    grown = save(alone, "members")
    counts = sizes.select(F.col("group_id").alias("group"), "n").join(placed, "group").filter("split is not null").groupBy("split").agg(F.sum("n").alias("n"))  # a row a group
    if prior is not None:
        counts = counts.unionByName(prior.totals).groupBy("split").agg(F.sum("n").alias("n"))
        grown = prior.members.unionByName(grown)
    totals = save(counts, "totals")
    return out, State(keys, grown, totals)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of the table at ``path``: totals are written last."""
    return sorted(int(n[2:]) for n in subfolders(spark, path) if n.startswith("v=") and "_SUCCESS" in subfolders(spark, f"{path}/{n}/totals"))


def stored(spark: SparkSession, path: str) -> State | None:
    """The component table of the latest complete version, null before the first."""
    all_ = _versions(spark, path)
    if not all_:
        return None
    last = f"{path}/v={all_[-1]:06d}"
    grown = spark.read.schema(MEMBERS).parquet(*[f"{path}/v={v:06d}/members" for v in all_])
    return State(spark.read.schema(KEYS).parquet(f"{last}/keys"), grown, spark.read.schema(TOTALS).parquet(f"{last}/totals"))


def deliver(rows: DataFrame, path: str, shares: Mapping[str, float] = SHARES) -> DataFrame:
    """:func:`assign` with the table kept at ``path``: the latest version is read, the
    next one written, an earlier one never touched; what an aborted delivery left of a
    version is written anew. Members are appended, a folder a version."""
    spark = rows.sparkSession
    prior, all_ = stored(spark, path), _versions(spark, path)
    folder = f"{path}/v={(all_[-1] if all_ else 0) + 1:06d}"

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return assign(rows, prior, shares, save)[0]


def reached(assigned: DataFrame, shares: Mapping[str, float] = SHARES) -> DataFrame:
    """(split, rows, share_bp, target_bp, groups): what each split reached."""
    per = assigned.groupBy("split", "group_id").agg(F.count(F.lit(1)).alias("k")).groupBy("split").agg(F.sum("k").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))
    want = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, v)])
    all_rows = F.sum("n_rows").over(Window.partitionBy())  # a row a split
    return per.select("split", "n_rows", "n_groups", F.round(10000 * F.col("n_rows") / all_rows).cast("int").alias("share_bp"), F.round(10000 * F.try_element_at(want, F.col("split"))).cast("int").alias("target_bp"))
