"""Files in and out: JSON lines, reports, audio shards, token shards, configuration."""

from __future__ import annotations

import io
import json
import os
import tempfile
import wave
from collections.abc import Mapping
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions.signal import resample
from voxloom.functions.tokens import frame_count

MANIFEST = "id string, audio string, text string, speaker string, language string, license string"
REPORT = "id string, text string, hard_case boolean, winner struct<audio_path:string,score:double,accepted:boolean,verification:struct<cer:double>>"


def read_jsonl(spark: SparkSession, path: str, schema: str = MANIFEST, strict: bool = True, rest: str | None = None) -> DataFrame:
    """JSON lines with a declared schema, plus ``_file`` and ``_line`` (from 1, over all
    lines). Blank lines are skipped. A line that is no JSON object is an error that
    names file and line; without ``strict`` such lines are left out. ``rest`` names a
    VARIANT column for the whole object, so that unknown fields aren't lost."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))
    # a file is read in blocks: a line's number is its place in the block after the lines of earlier blocks
    blocks = lines.groupBy("_file", "_block").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    lines = lines.join(blocks, ["_file", "_block"]).withColumn("_line", F.col("_before") + F.col("_n") - F.col("_first") + 1).drop("_before", "_first", "_n", "_block")
    full = lines.filter(F.length(F.trim(F.regexp_replace("value", r"\s+", " "))) > 0)
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    if strict:
        stop = F.raise_error(F.concat(F.col("_file"), F.lit(":"), F.col("_line").cast("string"), F.lit(": not a JSON object"))).cast("string")
        full = full.withColumn("value", F.when(good, F.col("value")).otherwise(stop))
    else:
        full = full.filter(good)
    out = full.select(F.from_json("value", schema).alias("_r"), *([F.parse_json("value").alias(rest)] if rest else []), "_file", "_line")
    return out.select("_r.*", *([rest] if rest else []), "_file", "_line")


def sorted_json(df: DataFrame) -> Column:
    """Each row as JSON with its keys in order; nulls are left out."""
    return F.to_json(F.struct(*[F.col(f"`{k}`") for k in sorted(df.columns)]))


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines with sorted keys; Spark's commit makes the folder appear as a whole."""
    df.select(sorted_json(df).alias("value")).write.mode(mode).text(path)


def write_small_json(value, path: str) -> None:
    """A report of a few rows as one file: written beside its place, then renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, sort_keys=True, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def append_hard_cases(df: DataFrame, path: str) -> None:
    """Append rows to the store of hard cases; each append is a commit of its own."""
    df.select(sorted_json(df).alias("value")).write.mode("append").text(path)


def report_paths(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Files of the patterns, sorted, each once: ``**`` searches folders at any depth; a
    pattern that matches nothing but names a file stands for it; one that is neither
    is an error."""
    import fnmatch

    from voxloom.plans.scale import file_system

    out: set[str] = set()
    for pattern in patterns:
        head = pattern.split("*", 1)[0].split("?", 1)[0].split("[", 1)[0]
        fs, root = file_system(spark, head.rpartition("/")[0] or "/")
        _, literal = file_system(spark, pattern.replace("*", "_")) if "*" in pattern else file_system(spark, pattern)
        found: set[str] = set()
        if pattern != head and fs.exists(root):
            files_ = fs.listFiles(root, "**" in pattern or "/" in pattern[len(head.rpartition("/")[0]) + 1 :])
            plain = pattern.split(":", 1)[1].replace("///", "/") if pattern.startswith("file:") else pattern
            depth = None if "**" in plain else plain.count("/")
            while files_.hasNext():
                p = files_.next().getPath()
                path = p.toUri().getPath() if pattern.startswith(("/", "file:")) else p.toString()
                if fnmatch.fnmatchcase(path, plain.replace("**/", "*")) and (depth is None or path.count("/") == depth):
                    found.add(p.toString())
        elif pattern == head and fs.exists(literal):
            found.add(pattern)
        if not found:
            raise FileNotFoundError(pattern)
        out |= found
    return sorted(out)


def read_reports(spark: SparkSession, paths: list[str], schema: str = REPORT) -> DataFrame:
    """Generation reports of :func:`report_paths`, one JSON document a file; without an id
    the file's stem is it."""
    paths = report_paths(spark, paths)
    raw = spark.read.option("multiLine", True).schema(schema).json(sorted(paths)).select("*", F.col("_metadata.file_name").alias("_name"))
    stem = F.regexp_replace("_name", r"\.[^.]*$", "")
    return raw.withColumn("id", F.coalesce("id", stem)).withColumn("winner", F.struct("winner.audio_path", "winner.score", "winner.accepted", F.col("winner.verification.cer").alias("cer"))).drop("_name")


def audio_path(df: DataFrame, keys: tuple[str, ...] = ("audio", "audio_path", "path"), root: str = "") -> Column:
    """First non-empty of the columns; a struct gives its path; a relative one is put under ``root``."""
    kinds = dict(df.dtypes)
    have = [F.col(f"{k}.path") if kinds[k].startswith("struct") else F.col(k) for k in keys if k in kinds]
    found = F.coalesce(*[F.when(F.length(c) > 0, c) for c in have]) if have else F.lit(None).cast("string")
    return F.when(found.startswith("/") | F.lit(not root), found).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), found))


def decode_wav(data: bytes | None) -> tuple[list[float], int] | None:
    """Samples (mean of the channels, -1 to 1) and rate of PCM WAV bytes; null if they can't be read."""
    if not data:
        return None
    try:
        with wave.open(io.BytesIO(data)) as w:
            width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
        if width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2**23
        else:
            kind = {1: np.uint8, 2: np.int16, 4: np.int32}[width]
            x = np.frombuffer(raw, kind).astype(np.float64)
            x = (x - 128) / 128 if width == 1 else x / 2 ** (8 * width - 1)
        return x.reshape(-1, channels).mean(1).astype(np.float32).tolist(), rate
    except (wave.Error, EOFError, ValueError, KeyError, ZeroDivisionError):
        return None


def encode_wav(samples, rate: int) -> bytes | None:
    """16-bit mono PCM WAV of samples, cut to -1 and 1; null for null."""
    if samples is None:
        return None
    x = np.nan_to_num(np.asarray(samples, dtype=np.float64))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(int(rate))
        w.writeframes(np.rint(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def encoded_wav(samples: Column, rate: Column) -> Column:
    """:func:`encode_wav` of each row."""

    @F.pandas_udf("binary")
    def run(xs: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([encode_wav(x, r) for x, r in zip(xs, rates)])

    return run(samples, rate)


def write_wavs(df: DataFrame, samples: str, path: str, root: str, rate: int = 24000) -> DataFrame:
    """A WAV file for each row, below ``root`` at its ``path``, written where the row is by
    the executor that holds it, whole or not at all: ``df`` with ``bytes_written``. ``root``
    is a folder that all executors mount; rows are written once a row, so ``path`` must be unique."""

    @F.pandas_udf("long")
    def run(xs: pd.Series, paths: pd.Series) -> pd.Series:
        sizes = []
        for x, p in zip(xs, paths):
            data = encode_wav(x, rate)
            if data is None or p is None:
                sizes.append(None)
                continue
            target = Path(root) / p
            target.parent.mkdir(parents=True, exist_ok=True)
            handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
            with os.fdopen(handle, "wb") as f:
                f.write(data)
            os.replace(name, target)
            sizes.append(len(data))
        return pd.Series(sizes, dtype="Int64")

    return df.withColumn("bytes_written", run.asNondeterministic()(F.col(samples), F.col(path)))


def decoded(shards: DataFrame, audio: str = "audio", text: str = "text", least: float = 0.2, most: float = 30.0, rate: int = 24000) -> DataFrame:
    """Shard rows (audio: struct<bytes, path>, text) with samples, sample_rate, n_frames
    and ``dropped`` (null, or why: missing, decode, duration). The length is read from
    the header in the JVM before any byte goes to Python; signals of another rate are
    resampled to ``rate``."""
    base = shards.withColumn("_bytes", F.col(f"{audio}.bytes")).withColumn("_missing", F.col("_bytes").isNull() | (F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0))
    seconds = wav_seconds(F.col("_bytes"))
    base = base.withColumn("_bad", F.when(F.col("_missing"), "missing").when(seconds.isNotNull() & ~seconds.between(least, most), "duration"))

    @F.pandas_udf("struct<samples:array<float>,sample_rate:int>")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = [decode_wav(d) or (None, None) for d in data]
        return pd.DataFrame({"samples": [x if x is None or r == rate else resample(x, r, rate) for x, r in rows], "sample_rate": pd.array([None if x is None else rate for x, _ in rows], dtype="Int32")})

    made = base.withColumn("_d", run.asNondeterministic()(F.when(F.col("_bad").isNull(), F.col("_bytes"))))
    took = F.size("_d.samples") / F.col("_d.sample_rate")
    why = F.coalesce("_bad", F.when(F.col("_d.samples").isNull(), "decode"), F.when(~took.between(least, most), "duration"))
    return made.withColumns({"samples": F.when(why.isNull(), F.col("_d.samples")), "sample_rate": F.col("_d.sample_rate"), "n_frames": frame_count(F.ceil(took * rate), rate), "dropped": why}).drop("_bytes", "_missing", "_bad", "_d")


def wav_seconds(data: Column) -> Column:
    """Seconds by the header of a canonical PCM WAV; null for anything else."""
    number = lambda at, n: F.conv(F.concat(*[F.hex(F.substring(data, at + i, 1)) for i in range(n - 1, -1, -1)]), 16, 10).cast("double")
    canonical = (F.substring(data, 1, 4) == F.encode(F.lit("RIFF"), "UTF-8")) & (F.substring(data, 37, 4) == F.encode(F.lit("data"), "UTF-8"))
    return F.when(canonical & (number(29, 4) > 0), number(41, 4) / number(29, 4))


def _row_groups(rows: int) -> dict[str, str]:
    """Options for row groups of about ``rows`` rows: the size is looked at as often as that."""
    return {"parquet.block.row.count.limit": str(rows), "parquet.page.row.count.limit": str(rows)}


def write_tokens(df: DataFrame, path: str, mode: str = "error", group_rows: int = 256) -> None:
    """Token sequences alone: snappy, no dictionary, no statistics of the ids; an empty table
    is a valid one."""
    plain = {"compression": "snappy", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}
    df.select(F.col("input_ids").cast("array<int>")).write.mode(mode).options(**plain, **_row_groups(group_rows)).parquet(path)


def write_expressive(df: DataFrame, path: str, mode: str = "error", group_rows: int = 256) -> None:
    df.write.mode(mode).options(compression="zstd", **_row_groups(group_rows)).parquet(path)


def merged(base: Mapping, over: Mapping) -> dict:
    """Configuration with overrides: mappings are merged, other values replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def read_config(path: str) -> dict:
    """A YAML (if that library is there) or JSON mapping."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        value = yaml.safe_load(text)
    except ImportError:
        value = json.loads(text)
    if value is None:
        return {}
    if not isinstance(value, Mapping):
        raise TypeError(f"{path}: a configuration is a mapping")
    return dict(value)


def read_lexicon(path: str) -> dict[str, str]:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict) or not all(isinstance(v, str) for v in value.values()):
        raise TypeError(f"{path}: a lexicon maps words to words")
    return value
