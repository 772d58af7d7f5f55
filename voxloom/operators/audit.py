"""Manifest audit: reasons for rejection, duplicates by first occurrence, routing.

First-seen semantics need the position of a row; it is an explicit column. Duplicate
keys are reduced to their first row by a pre-aggregated minimum and joined back, so
that a key held by a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.forms import squeezed
from voxloom.functions.text import duplicate_key
from voxloom.plans.scale import skew_join, written

#: Reasons in the order in which they are checked.
REASONS = (
    "text_length", "missing_license", "duplicate_audio", "duration", "clipping", "silence", "dc_offset", "level", "text_audio_ratio",
    "audio_error", "duplicate_speaker_text",
)


@dataclass(frozen=True)
class Thresholds:
    minimum_seconds: float = 0.4
    maximum_seconds: float = 30.0
    minimum_characters: int = 2
    maximum_characters: int = 1000
    maximum_clipping_ratio: float = 0.001
    maximum_silence_ratio: float = 0.75
    maximum_dc_offset: float = 0.05
    minimum_rms_dbfs: float = -45.0
    maximum_rms_dbfs: float = -3.0
    minimum_characters_per_second: float = 1.0
    maximum_characters_per_second: float = 35.0
    require_license: bool = False

    def __post_init__(self) -> None:
        for low, high in (("minimum_seconds", "maximum_seconds"), ("minimum_characters", "maximum_characters"), ("minimum_rms_dbfs", "maximum_rms_dbfs"), ("minimum_characters_per_second", "maximum_characters_per_second")):
            if getattr(self, low) > getattr(self, high):
                raise ValueError(f"{low} is above {high}")
        if self.minimum_seconds < 0 or self.minimum_characters < 0 or not 0 <= self.maximum_clipping_ratio <= 1 or not 0 <= self.maximum_silence_ratio <= 1:
            raise ValueError("a threshold is out of range")


def _outside(c: Column, low: float, high: float) -> Column:
    return ~c.between(low, high)


def text_reasons(text: Column, license: Column, t: Thresholds = Thresholds()) -> list[Column]:
    """Reasons that text and license give; null text counts as empty."""
    n = F.length(squeezed_ends(F.coalesce(text, F.lit(""))))
    out = [F.when(_outside(n, t.minimum_characters, t.maximum_characters), F.lit("text_length"))]
    if t.require_license:
        out.append(F.when(F.coalesce(F.length(license), F.lit(0)) == 0, F.lit("missing_license")))
    return out


def squeezed_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def signal_reasons(metrics: Column, text: Column, t: Thresholds = Thresholds()) -> list[Column]:
    """Reasons that a metrics struct gives; a null struct is ``audio_error``."""
    n = F.length(squeezed_ends(F.coalesce(text, F.lit(""))))
    rate = F.when(metrics["duration_seconds"].isNotNull(), n / F.greatest(metrics["duration_seconds"], F.lit(1e-6)))
    rules = [
        ("duration", _outside(metrics["duration_seconds"], t.minimum_seconds, t.maximum_seconds)),
        ("clipping", metrics["clipping_ratio"] > t.maximum_clipping_ratio),
        ("silence", metrics["silence_ratio"] > t.maximum_silence_ratio),
        ("dc_offset", F.abs(metrics["dc_offset"]) > t.maximum_dc_offset),
        ("level", _outside(metrics["rms_dbfs"], t.minimum_rms_dbfs, t.maximum_rms_dbfs)),
        ("text_audio_ratio", _outside(rate, t.minimum_characters_per_second, t.maximum_characters_per_second)),
        ("audio_error", metrics.isNull()),
    ]
    return [F.when(bad, F.lit(name)) for name, bad in rules]


def first_seen(rows: DataFrame, keys: Mapping[str, tuple[list[Column], Column | None]], position: str, id: str) -> DataFrame:
    """(position, a column a kind): for rows of which a key occurred at an earlier position
    the id of the first, by kind of key. ``keys``: kind to (columns, usable). A first row
    counts even if it is rejected itself; rows that are not usable, or with a null in
    their key, neither count nor are duplicates. All kinds are stacked as 128-bit
    digests in one pass; the first row of each key is found before the shuffle."""

    def digest(kind: str, key: list[Column], usable: Column | None) -> Column:
        ok = F.lit(True) if usable is None else usable
        for k in key:
            ok = ok & k.isNotNull()
        parts = [F.concat(F.length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")) for k in key]
        return F.when(ok, F.unhex(F.md5(F.concat(F.lit(kind + "|"), *parts))))

    each = F.array(*[F.struct(F.lit(i).alias("kind"), digest(kind, *spec).alias("key")) for i, (kind, spec) in enumerate(keys.items())])
    keyed = rows.select(F.col(position).alias("_at"), F.col(id).cast("string").alias("_id"), F.explode(each).alias("_k"))
    keyed = written(keyed.select("_at", "_id", F.col("_k.kind").alias("_kind"), F.col("_k.key").alias("_key")).filter("_key is not null"), "keys")
    firsts = keyed.groupBy("_key").agg(F.min(F.struct("_at", "_id")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    again = skew_join(keyed, written(firsts, "firsts"), ["_key"], "_at", "inner").filter(F.col("_at") > F.col("_first._at"))
    return again.groupBy(F.col("_at").alias(position)).agg(*[F.max(F.when(F.col("_kind") == i, F.col("_first._id"))).alias(kind) for i, kind in enumerate(keys)])


def audit(manifest: DataFrame, position: str = "row_no", id: str = "id", digest: Column | None = None, metrics: Column | None = None, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """All rows and columns of ``manifest`` with ``rejection_reasons`` (sorted, distinct,
    empty if accepted) and ``duplicate_of``.

    ``digest`` stands for the content of the audio (null: it could not be read),
    ``metrics`` is a struct of signal metrics; without them the rules that need them
    are left out. Speaker and text must both be non-blank to be duplicates; a
    duplicate of the audio keeps that reference."""
    text, speaker = squeezed_ends(F.coalesce(F.col("text"), F.lit(""))), squeezed_ends(F.coalesce(F.col("speaker"), F.lit("")))
    reasons = text_reasons(F.col("text"), F.col("license"), thresholds)
    if metrics is not None:
        reasons += signal_reasons(metrics, F.col("text"), thresholds)
    base = manifest.withColumn("_own", F.array_compact(F.array(*reasons)))
    keys = {"_same": ([speaker, duplicate_key(text)], (F.length(speaker) > 0) & (F.length(text) > 0))}
    if digest is not None:
        keys["_heard"] = ([digest], None)
    base = base.join(first_seen(manifest, keys, position, id), position, "left")
    if digest is None:
        base = base.withColumn("_heard", F.lit(None).cast("string"))
    more = F.array(F.when(F.col("_heard").isNotNull(), F.lit("duplicate_audio")), F.when(F.col("_same").isNotNull(), F.lit("duplicate_speaker_text")))
    all_ = F.array_sort(F.array_distinct(F.concat(F.col("_own"), F.array_compact(more))))
    return base.withColumn("rejection_reasons", all_).withColumn("duplicate_of", F.coalesce("_heard", "_same")).drop("_own", "_same", "_heard")


def accepted(audited: DataFrame) -> DataFrame:
    return audited.filter(F.size("rejection_reasons") == 0).drop("rejection_reasons", "duplicate_of")


def rejected(audited: DataFrame) -> DataFrame:
    return audited.filter(F.size("rejection_reasons") > 0)


def reason_counts(audited: DataFrame) -> DataFrame:
    """(reason, n_rows); a row counts once for each of its reasons."""
    return audited.select(F.explode("rejection_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def totals(audited: DataFrame) -> DataFrame:
    """One row: n_input, n_accepted, n_rejected."""
    good = F.size("rejection_reasons") == 0
    return audited.agg(F.count(F.lit(1)).alias("n_input"), F.count_if(good).alias("n_accepted"), F.count_if(~good).alias("n_rejected"))


__all__ = ["REASONS", "Thresholds", "accepted", "audit", "first_seen", "reason_counts", "rejected", "signal_reasons", "squeezed", "text_reasons", "totals"]
