"""Resumable ingestion of shards by Structured Streaming.

The file source lists new shards and bounds a micro-batch; the checkpoint remembers
what was done; a run state beside the output refuses to go on when a setting that
changes the output has changed; a ledger of outputs is verified before a source may
be retired. There is no watermark: rows are never dropped for being late. All state
lies beside the output, by the Hadoop file API, so any shared file system will do.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.text import stable_path
from voxloom.plans.scale import file_system, subfolders
from voxloom.sources.shared import clear_stale, exclusive, exists, inside, moved, read_text, write_text

LEDGER = "source string, path string, n_rows long, bytes long, batch_id long"
FAILED = "source string, error string, batch_id long"
STATE_VERSION = 1


class Drift(ValueError):
    """A setting that changes the output differs from that of the run so far."""


class FailedShards(RuntimeError):
    """Some shards could not be transformed; the others were."""


def changed(before: Mapping, after: Mapping) -> list[str]:
    """Keys in which two settings differ, those of one side only included."""
    return sorted(k for k in {*before, *after} if before.get(k) != after.get(k) or (k in before) != (k in after))


def guard(spark: SparkSession, folder: str, identity: Mapping) -> dict:
    """Start or continue a run: the state is written once and must stay the same."""
    path = f"{folder}/_run_state.json"
    if exists(spark, path):
        state = json.loads(read_text(spark, path))
        if state.get("version") != STATE_VERSION:
            raise Drift(f"run state of version {state.get('version')}")
        if names := changed(state["identity"], dict(identity)):
            raise Drift("settings changed: " + ", ".join(names))
        return state
    state = {"version": STATE_VERSION, "identity": dict(identity)}
    write_text(spark, path, json.dumps(state, ensure_ascii=False, sort_keys=True, indent=2))
    return state


def retried(f: Callable, times: int = 5, first: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """Call until it works, waiting 1, 2, 4 ... seconds, 30 at most."""
    for k in range(times):
        try:
            return f()
        except OSError:
            if k == times - 1:
                raise
            sleep(min(most, first * 2**k))


def shards(files: DataFrame, root: str = "data", legacy_root: str | None = None) -> DataFrame:
    """``files`` (source, ...) with output_path and, for runs of older layout, legacy_path."""
    name = F.element_at(F.split("source", "/"), -1)
    out = files.withColumn("output_path", stable_path(F.col("source"), root))
    return out.withColumn("legacy_path", F.concat_ws("/", F.lit(legacy_root or root), name))


def work_plan(files: DataFrame, done: DataFrame, local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to_encode, backlog) of :func:`shards`: those whose output is neither complete
    (``done``: path) nor local, and those that only wait for upload. An output counts
    under its new or its old path."""
    cand = files.select("source", F.explode(F.array("output_path", "legacy_path")).alias("path"))
    complete = cand.join(done.select("path").distinct(), "path", "left_semi").select("source").distinct()
    here = cand.join(local.select("path").distinct(), "path", "left_semi").select("source").distinct()
    open_ = files.join(complete, "source", "left_anti")
    return open_.join(here, "source", "left_anti"), open_.join(here, "source", "left_semi")


def ingest(spark: SparkSession, source: str, target: str, schema: str, transform: Callable[[DataFrame], DataFrame], identity: Mapping | None = None, files_per_trigger: int = 64, bytes_per_trigger: str | None = None, every: str | None = None, isolate: bool = False) -> dict:
    """Read all new Parquet shards of ``source``, transform them and write to
    ``target/data``; returns the run's totals.

    Each micro-batch writes its own folder, named by its number and overwritten when
    the batch is repeated after a failure, so that nothing is written twice; then the
    ledger gets a row a shard. A shard path twice in a run is an error. A batch is closed
    by ``files_per_trigger`` or ``bytes_per_trigger``; with ``every`` (say, 30 seconds) the
    run goes on, and a batch is closed at the latest after that time.

    With ``isolate`` a shard whose rows can't be transformed does not stop the others of
    its batch: it is listed under ``target/failed``, and :class:`FailedShards` is raised
    when all others are done."""
    options = {"maxFilesPerTrigger": str(files_per_trigger)} if bytes_per_trigger is None else {"maxBytesPerTrigger": bytes_per_trigger}
    with exclusive(spark, target):
        guard(spark, target, dict(identity or {}) | {"schema": schema})
        clear_stale(spark, target)
        stream = spark.readStream.schema(schema).options(**options).parquet(source).select("*", F.col("_metadata.file_path").alias("_source"), F.col("_metadata.file_size").alias("_bytes"))

        def write(batch: DataFrame, number: int) -> None:
            name = f"batch={number:08d}"
            good = batch
            out = lambda x: transform(x.drop("_source", "_bytes"))
            try:
                out(batch).write.mode("overwrite").parquet(f"{target}/data/{name}")
            except Exception:
                if not isolate:
                    raise
                bad = []
                for r in batch.select("_source").distinct().collect():  # the shards of one batch
                    try:
                        out(batch.filter(F.col("_source") == r["_source"])).write.format("noop").mode("overwrite").save()
                    except Exception as e:
                        bad.append((r["_source"], str(e).splitlines()[0], number))
                spark.createDataFrame(bad, FAILED).write.mode("overwrite").parquet(f"{target}/failed/{name}")
                good = batch.filter(~F.col("_source").isin([x[0] for x in bad])) if bad else batch
                out(good).write.mode("overwrite").parquet(f"{target}/data/{name}")
            rows = good.groupBy(F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("_bytes").alias("bytes"))
            rows = rows.select("source", F.lit(name).alias("path"), "n_rows", "bytes", F.lit(number).cast("long").alias("batch_id"))
            rows.write.mode("overwrite").parquet(f"{target}/ledger/{name}")

        writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/_checkpoint")
        query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
        query.awaitTermination()
    done = totals(spark, target)
    if done["failed"]:
        raise FailedShards(f"{done['failed']} shards failed; they are listed in {target}/failed")
    return {k: v for k, v in done.items() if k != "failed"}


def ledger(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(f"{target}/ledger/batch=*")


def totals(spark: SparkSession, target: str) -> dict:
    failed = spark.read.schema(FAILED).parquet(f"{target}/failed/batch=*").count() if subfolders(spark, f"{target}/failed") else 0
    if not subfolders(spark, f"{target}/ledger"):
        return {"shards": 0, "rows": 0, "failed": failed}
    r = ledger(spark, target).agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"), F.countDistinct("source").alias("d")).first()
    if r["d"] != r["k"]:
        raise ValueError("a shard is in the ledger twice")
    return {"shards": r["k"], "rows": r["n"], "failed": failed}


def verified(spark: SparkSession, target: str) -> DataFrame:
    """(batch_id, expected, written, ok): rows by the ledger against rows that are there;
    only sources of batches that are ok may be retired."""
    have = spark.read.parquet(f"{target}/data").groupBy(F.col("batch").cast("long").alias("batch_id")).agg(F.count(F.lit(1)).alias("written"))
    want = ledger(spark, target).groupBy("batch_id").agg(F.sum("n_rows").alias("expected"))
    return want.join(have, "batch_id", "left").select("batch_id", "expected", F.coalesce("written", F.lit(0)).alias("written"), (F.col("expected") == F.coalesce("written", F.lit(0))).alias("ok"))


def retire(spark: SparkSession, target: str) -> int:
    """Delete the source shards of verified batches, each only if its size is still that
    of the ledger; how many were deleted. Shards of other batches stay."""
    ok = ledger(spark, target).join(verified(spark, target).filter("ok").select("batch_id"), "batch_id")
    n = 0
    for r in ok.select("source", "bytes").toLocalIterator():  # one shard at a time: a delete each, no data
        fs, p = file_system(spark, r["source"])
        if fs.exists(p) and fs.getFileStatus(p).getLen() == r["bytes"]:
            n += bool(fs.delete(p, False))
    return n


def publish(spark: SparkSession, source: str, target: str, most_files: int = 64, most_bytes: int = 8 << 30, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Move the files below ``source`` to the same places below ``target`` in batches of
    at most ``most_files`` files and ``most_bytes`` bytes: (path, size, batch_no). A file is
    deleted only when the copy has its size; a copy that fails is tried again with
    growing pauses. One file at a time is in flight, so nothing piles up."""
    fs, root = file_system(spark, source)
    base = fs.resolvePath(root).toUri().getPath().rstrip("/")
    files, listed = fs.listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        listed.append((f.getPath().toUri().getPath()[len(base) + 1 :], f.getLen()))
    out, batch, n, size = [], 0, 0, 0
    for path, length in sorted(listed):
        if n and (n >= most_files or size + length > most_bytes):
            batch, n, size = batch + 1, 0, 0
        place = inside(target, path)
        retried(lambda path=path, place=place: moved(spark, f"{source.rstrip('/')}/{path}", place), sleep=sleep)
        n, size = n + 1, size + length
        out.append((path, length, batch))
    return spark.createDataFrame(out, "path string, size long, batch_no int")


def event_rates(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "7 days") -> DataFrame:
    """(event_type, start, n_events, total) by event time, for batch or stream; on a
    stream, events later than ``late`` may be dropped, which batch never does."""
    src = events.withColumn("_ts", F.col("ts").cast("timestamp"))
    src = src.withWatermark("_ts", late) if events.isStreaming else src
    w = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    return src.groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n_events", "total")
