"""Samples that meet target proportions, by divisor-method priorities.

Records of a category get a random rank; (rank - 0.5) / target is their priority;
records of the category's floor come first, then those with the globally smallest
priorities. A category that runs out leaves its seats to the others by itself.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.forms import label, language_code
from voxloom.plans.scale import bits_for, mixed, running, skew_join, written

#: Most target cells that are broadcast; more are joined by a shuffle.
MOST_CELLS = 20_000
REPORT = "plan_no int, cell_no int, n_rows long, target_rows double, min_rows int, target_bp int, drawn long, last_priority double, missed boolean, reason string"
ASPECTS = ("emotion", "delivery", "language")


def seats(cells: list[dict]) -> dict[int, tuple[int, float | None]]:
    """Seats and last priority of each cell of one plan.

    cells: dicts of cell_no, target, floor, rows, and ``sample``, the size of the
    plan's sample. Floors come first (no cell gets more than it has), then the
    smallest (rank - 0.5) / target, ties to the smaller cell_no, until the sample
    is full or nothing is left. Floors beyond the sample are kept nevertheless."""
    got = {c["cell_no"]: min(c["floor"], c["rows"]) for c in cells}
    left = cells[0]["sample"] - sum(got.values()) if cells else 0
    last: dict[int, float | None] = {c["cell_no"]: None for c in cells}
    open_ = {c["cell_no"]: c for c in cells if c["target"] > 0 and got[c["cell_no"]] < c["rows"]}
    # all seats up to the highest priority that surely fits, then the rest one by one
    fits = lambda level: {k: max(0, min(c["rows"], int(level * c["target"] + 0.5)) - got[k]) for k, c in open_.items()}
    low, high = 0.0, (max((c["rows"] for c in cells), default=0) + 1) / min((c["target"] for c in open_.values()), default=1)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(fits(middle).values()) <= left else (low, middle)
    if left > 0:
        for k, x in fits(low).items():
            got[k] += x
            left -= x
            if x:
                last[k] = (got[k] - 0.5) / open_[k]["target"]
        open_ = {k: c for k, c in open_.items() if got[k] < c["rows"]}
    heap = [((got[k] + 0.5) / c["target"], k) for k, c in open_.items()]
    heapq.heapify(heap)
    while heap and left > 0:
        priority, k = heapq.heappop(heap)
        got[k] += 1
        last[k] = priority
        left -= 1
        if got[k] < open_[k]["rows"]:
            heapq.heappush(heap, ((got[k] + 0.5) / open_[k]["target"], k))
    return {k: (n, last[k]) for k, n in got.items()}


def _with_cells(rows: DataFrame, cells: DataFrame, on: list[str], n_cells: int) -> DataFrame:
    if n_cells <= MOST_CELLS:
        return rows.join(F.broadcast(cells), on)
    return skew_join(rows, cells, on, "example_id", "inner")


def _members(examples: DataFrame, targets: DataFrame, n_cells: int) -> DataFrame:
    """(example_id, plan_no, cell_no): all cells that an example is in. An equi-join
    on the aspects that a cell names; a row is repeated once for each kind of cell."""
    keyed = examples.select(
        "example_id",
        label(F.col("emotion")).alias("emotion"),
        label(F.col("delivery")).alias("delivery"),
        language_code(F.col("language")).alias("language"),
    )
    kind = sum((F.when(F.col(a).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, a in enumerate(ASPECTS)), F.lit(0))
    cells = targets.select("plan_no", "cell_no", kind.alias("kind"), *[F.coalesce(F.lower(F.trim(a)), F.lit("*")).alias(a) for a in ASPECTS])
    kinds = sorted(r["kind"] for r in cells.select("kind").distinct().collect())  # 8 at most
    rows = keyed.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])) if kinds else F.lit(-1))
    for i, a in enumerate(ASPECTS):
        rows = rows.withColumn(a, F.when(F.col("kind").bitwiseAND(1 << i) == 0, F.lit("*")).otherwise(F.col(a)))
    return _with_cells(rows, cells, ["kind", *ASPECTS], n_cells).select("example_id", "plan_no", "cell_no", F.bit_count("kind").alias("names"))


def sample(examples: DataFrame, targets: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of each plan in ``targets``.

    sample: (plan_no, cell_no, example_id, rank, priority). report: (plan_no,
    cell_no, rows, target_rows, min_rows, drawn, missed, reason): ``rows`` counts
    the examples in the cell, ``target_rows`` is its share of the sample; reason is
    ``few_rows`` (fewer rows than the share), ``below_floor`` (fewer rows than
    min_rows), both joined by a comma, or ``shared`` (its rows went to other cells).
    An example in several cells of a plan is drawn for the one that names most
    aspects, ties to the smaller cell_no. Null or blank emotion and delivery are
    neutral; a label that names no language is in no cell that asks for one. Null
    target_bp, min_rows or sample_pct count as 0. An empty table of examples gives
    no sample and a report in which all cells miss theirs."""
    cells = targets.select("plan_no", "cell_no", *ASPECTS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("target_bp", "min_rows", "sample_pct")])
    cells = cells.filter("plan_no is not null and cell_no is not null")
    cells = written(cells, "cells")
    n_cells, n = cells.count(), examples.count()
    members = written(_members(examples, cells, n_cells), "members")
    best = F.min(F.struct((-F.col("names")).alias("names"), "cell_no")).alias("b")
    drawn_from = written(members.groupBy("plan_no", "example_id").agg(best).select("plan_no", "b.cell_no", "example_id"), "drawn")
    count = lambda d, name: d.groupBy("plan_no", "cell_no").agg(F.count(F.lit(1)).alias(name))
    facts = cells.join(count(members, "k"), ["plan_no", "cell_no"], "left").join(count(drawn_from, "own"), ["plan_no", "cell_no"], "left")  # a row a cell

    def seated(plan: pd.DataFrame) -> pd.DataFrame:
        own = plan.fillna({"k": 0, "own": 0}).astype({"k": "int64", "own": "int64"}).sort_values("cell_no").to_dict("records")
        size = n * int(own[0]["sample_pct"]) // 100
        got = seats([{"cell_no": r["cell_no"], "target": r["target_bp"], "floor": r["min_rows"], "rows": r["own"], "sample": size} for r in own])
        out = []
        for r in own:
            k, (seat, last) = r["k"], got[r["cell_no"]]
            few = k * 1_000_000 < int(r["target_bp"]) * int(r["sample_pct"]) * n
            why = [w for w, on in (("few_rows", few), ("below_floor", k < r["min_rows"])) if on]
            goal = int(r["target_bp"]) * int(r["sample_pct"]) * n / 1_000_000
            if not why and seat < int(goal):
                why = ["shared"]
            out.append((r["plan_no"], r["cell_no"], k, goal, r["min_rows"], r["target_bp"], seat, last, bool(why), ",".join(why) or None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in REPORT.split(", ")])

    report = written(facts.groupBy("plan_no").applyInPandas(seated, REPORT), "report")  # a plan's cells, which are a parameter, in one task
    placed = drawn_from.withColumn("_place", mixed(F.col("plan_no"), F.col("example_id"), seed=seed))
    ranked = running(placed, ["plan_no", "cell_no"], "_place", ["example_id"], bits_for(n))
    out = _with_cells(ranked, report.select("plan_no", "cell_no", "drawn", "target_bp", "min_rows"), ["plan_no", "cell_no"], n_cells).filter(F.col("rank") <= F.col("drawn"))
    priority = F.when((F.col("rank") > F.col("min_rows")) & (F.col("target_bp") > 0), (F.col("rank") - 0.5) / F.col("target_bp"))
    return out.select("plan_no", "cell_no", "example_id", "rank", priority.alias("priority")), report


def found(report: DataFrame) -> DataFrame:
    """(plan_no, cell_no) of cells whose target or floor the rows cannot meet."""
    return report.filter("missed and reason <> 'shared'").select("plan_no", "cell_no")
