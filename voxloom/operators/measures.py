"""Summaries of metrics and alignment of timed events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.tokens import let
from voxloom.plans.scale import free, written

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, without: Sequence[str] = ("id", "index")) -> list[str]:
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in without)


#: Values a column of which percentiles are taken in one buffer; more are searched for.
IN_MEMORY = 1_000_000
_SLICES = 1024


def aggregate_numeric(df: DataFrame, columns: Sequence[str] | None = None, in_memory: int = IN_MEMORY) -> DataFrame:
    """(metric, mean, median, p95, n_values) of each numeric column: nulls and values
    that aren't finite don't count, percentiles are interpolated, a column without a
    value has no row. The columns are aggregated side by side. Percentiles are exact
    at any size: of more than ``in_memory`` values by :func:`order_statistics`."""
    names = list(columns or numeric_columns(df))
    kinds = "metric string, mean double, median double, p95 double, n_values long"
    if not names:
        return df.sparkSession.createDataFrame([], kinds)
    x = [F.when(~F.isnan(F.col(k).cast("double")) & (F.abs(F.col(k).cast("double")) < float("inf")), F.col(k).cast("double")).alias(f"v{i}") for i, k in enumerate(names)]
    kept = written(df.select(*x), "values")
    facts = kept.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(len(names)) for n, f in (("n", F.count), ("m", F.avg))]).first()
    total = {i: facts[f"n{i}"] for i in range(len(names)) if facts[f"n{i}"]}
    got: dict[tuple[int, float], float] = {}
    shares = (0.5, 0.95)
    small = [i for i, n in total.items() if n <= in_memory]
    if small:
        row = kept.agg(*[F.percentile(f"v{i}", F.lit(p)).alias(f"p{i}_{j}") for i in small for j, p in enumerate(shares)]).first()
        got = {(i, p): row[f"p{i}_{j}"] for i in small for j, p in enumerate(shares)}
    wanted = {(i, r) for i, n in total.items() if n > in_memory for p in shares for r in (int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1))}
    ranked = order_statistics(kept, wanted)
    for i, n in total.items():
        for p in shares if n > in_memory else ():
            low, part = int(p * (n - 1)), p * (n - 1) - int(p * (n - 1))
            got[i, p] = ranked[i, low] * (1 - part) + ranked[i, min(n - 1, low + 1)] * part
    free(kept)
    return df.sparkSession.createDataFrame([(names[i], facts[f"m{i}"], got[i, 0.5], got[i, 0.95], n) for i, n in total.items()], kinds)


def order_statistics(values: DataFrame, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The values of ranks (column number, rank from 0) of the columns v0, v1, ...: each
    range that still holds a rank is cut in slices whose counts are summed before the
    shuffle, until it holds one value. The driver sees a row a slice and rank, never a
    value a row; memory doesn't grow with the data."""
    if not wanted:
        return {}
    ends = values.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in {i for i, _ in wanted} for n, f in (("a", F.min), ("b", F.max))]).first()
    open_ = {(i, r): (ends[f"a{i}"], ends[f"b{i}"], 0) for i, r in wanted}  # from, to, values below
    done: dict[tuple[int, int], float] = {}
    while open_:
        done |= {k: a for k, (a, b, _) in open_.items() if a == b}
        open_ = {k: v for k, v in open_.items() if v[0] != v[1]}
        ranges = sorted({(i, a, b) for (i, _), (a, b, _) in open_.items()})
        if not ranges:
            break

        def slice_of(i: int, a: float, b: float) -> Column:
            x = F.col(f"v{i}")
            return F.when(x.between(a, b), F.least(F.lit(_SLICES - 1), F.floor((x / 2 - a / 2) / (b / 2 - a / 2) * _SLICES)))

        each = F.array(*[F.struct(F.lit(k).alias("k"), slice_of(*r).alias("slice"), F.col(f"v{r[0]}").alias("x")) for k, r in enumerate(ranges)])
        cut = values.select(F.explode(each).alias("e")).filter("e.slice is not null").groupBy("e.k", "e.slice").agg(F.count(F.lit(1)).alias("n"), F.min("e.x").alias("a"), F.max("e.x").alias("b"))
        slices: dict[int, list] = {}
        for r in cut.collect():  # at most 1024 a range
            slices.setdefault(r["k"], []).append((r["slice"], r["n"], r["a"], r["b"]))
        for key, (a, b, below) in open_.items():
            for _, n, low, high in sorted(slices[ranges.index((key[0], a, b))]):
                if key[1] < below + n:
                    open_[key] = (low, high, below)
                    break
                below += n
    return done


def expected_time(event: Column, duration: Column, words: Column) -> Column:
    """When an event should be heard: its time, else by the word it follows, else the middle."""
    return F.coalesce(event["at_seconds"], duration * event["after_word"] / F.greatest(words, F.lit(1)), duration / 2)


def detected_events(windows: Column, threshold: float, first: bool = False) -> Column:
    """Events of an array of (start, scores): the best label of each window, or the
    first listed, at or over the threshold."""
    from voxloom.functions.rewards import first_over, top_label

    label = (lambda w: first_over(w["scores"], threshold)) if first else (lambda w: F.when(F.array_max(F.transform(w["scores"], lambda s: s["score"])) >= threshold, top_label(w["scores"])))
    return F.filter(F.transform(windows, lambda w: F.struct(label(w).alias("type"), w["start"].cast("double").alias("start"))), lambda e: e["type"].isNotNull())


def aligned(expected: Column, detected: Column, tolerance: float = 0.75) -> Column:
    """struct(precision, recall, f1, mean_error, count_error) of two arrays of (type,
    start): each expected event, in order, takes the nearest free detected one of its
    type within the tolerance, the first of equally near. An ordered fold in the JVM;
    the arrays are the events of one recording. Two empty sides agree fully."""
    start = F.struct(F.transform(detected, lambda d: F.struct(d["type"].alias("type"), d["start"].cast("double").alias("start"), F.lit(True).alias("free"))).alias("left"), F.array().cast("array<double>").alias("errors"))

    def step(acc: Column, e: Column) -> Column:
        far = F.transform(acc["left"], lambda d: F.when(d["free"] & (d["type"] == e["type"]), F.abs(d["start"] - e["start"])))

        def take(x: Column) -> Column:
            hit = F.coalesce(x["best"] <= tolerance, F.lit(False))
            left = F.transform(acc["left"], lambda d, i: F.struct(d["type"].alias("type"), d["start"].alias("start"), (d["free"] & ~(hit & (i == x["at"]))).alias("free")))
            return F.struct(left.alias("left"), F.when(hit, F.array_append(acc["errors"], x["best"])).otherwise(acc["errors"]).alias("errors"))

        nearest = lambda f: let(F.array_min(F.array_compact(f)), lambda b: F.struct(b.alias("best"), (F.array_position(f, b) - 1).alias("at")))
        return let(let(far, nearest), take)

    errors = F.aggregate(expected, start, step)["errors"]
    return let(errors, lambda x: event_scores(F.size(x), F.size(expected), F.size(detected), x))


def event_scores(matched: Column, expected: Column, detected: Column, errors: Column | None = None) -> Column:
    p = F.when(detected > 0, matched / detected).otherwise((expected == 0).cast("double"))
    r = F.when(expected > 0, matched / expected).otherwise((detected == 0).cast("double"))
    error = F.lit(None).cast("double") if errors is None else F.when(F.size(errors) > 0, F.aggregate(errors, F.lit(0.0), lambda a, v: a + v) / F.size(errors))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), error.alias("mean_error"), (F.abs(detected - expected) / F.greatest(expected, F.lit(1))).alias("count_error"))


def long_form(chunks: DataFrame, request: str) -> DataFrame:
    """Roll-up of the chunks of long texts: (request, n_chunks, score, accepted,
    reasons, audio_seconds, real_time_factor)."""
    seconds = F.sum("audio_seconds")
    return chunks.groupBy(request).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg("score").alias("score"), F.bool_and("accepted").alias("accepted"),
        # reasons are a small set of names: distinct before they are gathered
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("rejection_reasons")))).alias("reasons"),
        seconds.alias("audio_seconds"), F.when(seconds > 0, F.sum("total_seconds") / seconds).alias("real_time_factor"),
    )
