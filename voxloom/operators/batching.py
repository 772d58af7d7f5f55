"""Length-aware batches: bounded windows of arrival order, sorted by length inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.tokens import IGNORED_LABEL, padded


def bucket_size(batch: int, bucket: int | None = None) -> int:
    if batch < 1:
        raise ValueError("a batch has at least one row")
    return max(batch, bucket or batch * 8)


def length_batches(rows: DataFrame, position: str, length: str, batch: int, bucket: int | None = None, budget: int | None = None) -> DataFrame:
    """(position, length, bucket_no, batch_no, place) of each row; position counts from 0.

    A bucket is ``bucket`` rows in arrival order; inside, by length, a batch is closed at
    ``batch`` rows or where one more row, padded to its own length, would pass the
    budget. A single row over the budget is a batch. A bucket is a bounded group: its
    fold runs in one row's array."""
    size = bucket_size(batch, bucket)
    tagged = rows.select(position, length).withColumn("bucket_no", F.floor(F.col(position) / size).cast("long"))
    if budget is None:
        rank = F.row_number().over(Window.partitionBy("bucket_no").orderBy(length, position)) - 1
        return tagged.withColumn("_r", rank).withColumn("batch_no", F.floor(F.col("_r") / batch).cast("int")).withColumn("place", F.pmod("_r", F.lit(batch)).cast("int")).drop("_r")
    item = F.struct(F.col(length).cast("long").alias("length"), F.col(position).alias("position"))
    grouped = tagged.groupBy("bucket_no").agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most `bucket` rows
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).alias("n"), F.array().cast("array<struct<length:bigint,position:bigint,batch_no:int,place:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        close = (acc["batch"] < 0) | (acc["n"] >= batch) | ((acc["n"] > 0) & ((acc["n"] + 1) * x["length"] > budget))
        number, place = F.when(close, acc["batch"] + 1).otherwise(acc["batch"]), F.when(close, F.lit(0)).otherwise(acc["n"])
        return F.struct(number.alias("batch"), (place + 1).alias("n"), F.array_append(acc["out"], F.struct(x["length"].alias("length"), x["position"].cast("long").alias("position"), number.alias("batch_no"), place.alias("place"))).alias("out"))

    done = grouped.select("bucket_no", F.explode(F.aggregate("items", start, step)["out"]).alias("x"))
    return done.select(F.col("x.position").alias(position), F.col("x.length").alias(length), "bucket_no", "x.batch_no", "x.place")


def batch_stats(batches: DataFrame, length: str) -> DataFrame:
    """One row: n_rows, n_batches, samples, padded, efficiency (1 when nothing is padded)."""
    per = batches.groupBy("bucket_no", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("s"), (F.max(length) * F.count(F.lit(1))).alias("p"))
    total = F.coalesce(F.sum("p"), F.lit(0))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_batches"), F.coalesce(F.sum("s"), F.lit(0)).alias("samples"), total.alias("padded"), F.when(total > 0, F.sum("s") / total).otherwise(1.0).alias("efficiency"))


def collated(rows: DataFrame, batch: list[str], ids: str, pad: int, labels: str | None = None) -> DataFrame:
    """Rows padded to the longest of their batch: ids, attention_mask, labels (ids by
    default, ignored where padded). The longest is found by a pre-aggregated maximum."""
    most = rows.groupBy(*batch).agg(F.max(F.size(ids)).alias("_most"))
    joined = rows.join(most, batch)
    n = F.col("_most")
    ones = F.transform(F.col(ids), lambda _: F.lit(1))
    return joined.withColumns({
        "attention_mask": padded(ones, n, 0), "labels": padded(F.col(labels or ids), n, IGNORED_LABEL), ids: padded(F.col(ids), n, pad),
    }).drop("_most")


def left_padded(rows: DataFrame, batch: list[str], ids: str, pad: int) -> DataFrame:
    most = rows.groupBy(*batch).agg(F.max(F.size(ids)).alias("_most"))
    return rows.join(most, batch).withColumn(ids, padded(F.col(ids), F.col("_most"), pad, left=True)).drop("_most")


def upload_batches(ledger: DataFrame, order: str, size: str, most_files: int, most_bytes: int, group: str) -> DataFrame:
    """(order, size, batch_no) of files in a ledger: a batch is closed when it has
    ``most_files`` files or ``most_bytes`` bytes, and before a file that would pass the
    bytes. The fold is sequential in each ``group``: a writer's own files, bounded by
    what it staged."""
    keys = [group]
    src = ledger.select(*keys, F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")).alias("x"))
    grouped = src.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("items"))
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("b"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        close = (acc["batch"] < 0) | (acc["n"] >= most_files) | (acc["b"] >= most_bytes) | (acc["b"] + x["s"] > most_bytes)
        number = F.when(close, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(number.alias("batch"), F.when(close, F.lit(1)).otherwise(acc["n"] + 1).alias("n"), F.when(close, x["s"]).otherwise(acc["b"] + x["s"]).alias("b"), F.array_append(acc["out"], number).alias("out"))

    numbers = F.aggregate("items", start, step)["out"]
    out = grouped.select(*keys, F.explode(F.arrays_zip(F.col("items"), numbers.alias("batch_no"))).alias("z"))
    return out.select(*keys, F.col("z.items.o").alias(order), F.col("z.items.s").alias(size), F.col("z.batch_no").alias("batch_no"))
