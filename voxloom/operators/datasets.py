"""Training datasets: column mapping, modes, adapt-or-drop, sampling, oversampling, mixing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.forms import squeezed
from voxloom.functions.text import strip_markup
from voxloom.functions.tokens import TokenLayout, code_points, text_of_code_points
from voxloom.plans.scale import mixed

MODES = ("tts_tokens", "text", "prompt_ids", "voice_clone_tokens")
_REQUIRED = {"tts_tokens": ("input_ids",), "text": ("text",), "prompt_ids": ("prompt_ids", "text"), "voice_clone_tokens": ("text", "ref_text", "ref_ids")}


def prune(df: DataFrame, mapping: Mapping[str, str], required: Sequence[str] = ()) -> DataFrame:
    """Only the mapped columns that are there, under their logical names; a missing
    required one is an error on the driver, before any task runs."""
    if absent := [mapping.get(k, k) for k in required if mapping.get(k, k) not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(sorted(absent))}")
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in mapping.items() if v in df.columns])


def column_or(df: DataFrame, name: str, default) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(default)


def examples(df: DataFrame, mode: str, layout: TokenLayout, tokenize: Callable[[Column], Column] = code_points, detokenize: Callable[[Column], Column] = text_of_code_points, frame_rate: float = 12.5, most_prompt: int | None = None) -> DataFrame:
    """``df`` with prompt, target_text, reference_audio_ids, reference_text,
    target_duration_seconds and ``error`` (null for a good row), by mode:

    tts_tokens splits ``input_ids``; text makes a prompt of ``text``; prompt_ids takes
    ``prompt_ids`` as they are; voice_clone_tokens puts the reference's text and audio
    into the prompt. Unknown durations are -1. Rows are never dropped here."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if absent := [k for k in _REQUIRED[mode] if k not in df.columns]:
        raise ValueError(f"mode {mode} needs columns: {', '.join(absent)}")
    none_ids, none = F.array().cast("array<int>"), F.lit(None).cast("string")
    text = squeezed(F.col("text")) if "text" in df.columns else none
    blank = F.coalesce(F.length(text), F.lit(0)) == 0
    if mode == "tts_tokens":
        p = layout.parts(F.col("input_ids"), frame_rate)
        said = squeezed(strip_markup(detokenize(p["text_ids"])))
        error = F.coalesce(p["error"], F.when(F.length(said) == 0, F.lit("empty_text")))
        out = (p["prompt"], said, p["audio_ids"], said, p["seconds"], error)
    elif mode == "text":
        out = (layout.prompt(tokenize(text)), text, none_ids, F.lit(""), F.lit(-1.0), F.when(blank, F.lit("empty_text")))
    elif mode == "prompt_ids":
        ids = F.col("prompt_ids")
        end = F.element_at(ids, -1) == layout.special(1)
        out = (ids, text, none_ids, F.lit(""), F.lit(-1.0), F.when(blank, F.lit("empty_text")).when(F.coalesce(F.size(ids), F.lit(0)) < 1, "empty_prompt").when(~end, "prompt_end"))
    else:
        ref, audio = squeezed(F.col("ref_text")), layout.reference_audio(F.col("ref_ids"))
        error = F.when(blank, F.lit("empty_text")).when(F.coalesce(F.length(ref), F.lit(0)) == 0, "empty_reference").when(audio.isNull(), "reference_audio")
        out = (layout.clone_prompt(tokenize(ref), tokenize(text), audio), text, audio, ref, F.lit(-1.0), error)
    names = ("prompt", "target_text", "reference_audio_ids", "reference_text", "target_duration_seconds", "error")
    made = df.withColumns(dict(zip(names, out)))
    if most_prompt is not None:
        made = made.withColumn("error", F.coalesce("error", F.when(F.size("prompt") > most_prompt, "long_prompt")))
    return made


def kept(adapted: DataFrame, strict: bool = False) -> DataFrame:
    """Good rows only; ``strict`` fails on the first bad one instead."""
    if strict:
        stop = F.raise_error(F.concat(F.lit("bad row: "), F.col("error"))).cast("string")
        return adapted.withColumn("error", F.when(F.col("error").isNotNull(), stop)).filter("error is null").drop("error")
    return adapted.filter("error is null").drop("error")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A repeatable random order; equal keys stay together."""
    return df.withColumn("_place", mixed(F.col(key), seed=seed)).orderBy("_place", key).drop("_place")


def taken(df: DataFrame, key: str, most: int | None, seed: int | None = None) -> DataFrame:
    """The first ``most`` rows by key, or by repeatable random order with a seed: a top-k,
    never a full sort."""
    if most is None:
        return df
    if seed is None:
        return df.orderBy(key).limit(most)
    return df.withColumn("_place", mixed(F.col(key), seed=seed)).orderBy("_place", key).limit(most).drop("_place")


def oversampled(df: DataFrame, hard: str = "hard_case", multiplier: int = 3) -> DataFrame:
    """Hard rows ``multiplier`` times, others once, with ``copy_no`` from 1; refused for
    streams, where the number of rows isn't known."""
    if multiplier < 1:
        raise ValueError("the multiplier must be at least 1")
    if df.isStreaming:
        raise ValueError("hard cases can't be repeated in a stream")
    times = F.when(F.coalesce(F.col(hard), F.lit(False)), F.lit(multiplier)).otherwise(F.lit(1))
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), times)))


def strided(position: Column, world: int, rank: int) -> Column:
    """Whether a row at a position (from 0) belongs to a rank: no shuffle, tails uneven."""
    if not 0 <= rank < world:
        raise ValueError("0 <= rank < world")
    return F.pmod(position, F.lit(world)) == rank


@dataclass(frozen=True)
class Interleave:
    """Text batches per speech batch, decaying from ``initial`` to ``final``."""

    batch: int
    initial: int
    final: int
    steps: int

    def ratio(self, step: Column) -> Column:
        """Interpolated by progress and rounded half to even, at least ``final``."""
        if not self.steps:
            return F.lit(self.initial)
        now = self.initial - (self.initial - self.final) * F.least(step / self.steps, F.lit(1.0))
        return F.greatest(F.bround(now, 0), F.lit(self.final)).cast("int")

    def length(self, texts: int, speeches: int) -> int:
        """Rows that the largest ratio can be served; a largest ratio of 0 is speech only."""
        most = max(self.initial, self.final)
        cycles = speeches // self.batch if not most else min(texts // (self.batch * most), speeches // self.batch)
        return cycles * (self.initial + 1) * self.batch

    def slots(self, index: Column, step: Column, texts: int, speeches: int) -> Column:
        """struct(is_text, at): which row of which source stands at an index."""
        r = self.ratio(step)
        cycle, pos = F.floor(index / ((r + 1) * self.batch)), F.pmod(index, ((r + 1) * self.batch).cast("long"))
        is_text = pos < r * self.batch
        at = F.when(is_text, F.pmod((cycle * r * self.batch + pos).cast("long"), F.lit(max(texts, 1)))).otherwise(F.pmod((cycle * self.batch + pos - r * self.batch).cast("long"), F.lit(max(speeches, 1))))
        return F.struct(is_text.alias("is_text"), at.cast("long").alias("at"))


def is_text_step(step: Column, ratio: int) -> Column:
    """Whether the loss of a step counts as text."""
    return F.pmod(step, F.lit(ratio + 1)) < ratio


def numbered(df: DataFrame, key: str, out: str = "position") -> DataFrame:
    """Positions from 0 by the order of ``key`` without a global sort in one task: rows
    are range-partitioned, partitions counted, and positions are offset + place."""
    from pyspark.sql import Window

    from voxloom.plans.scale import written

    ranged = written(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_part")
