"""Candidates of a request: quality gate, score, best of N, second round, distillation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.rewards import duration_score, weighted_mean

#: Default weights of the score.
SCORE_WEIGHTS = {"intelligibility": 0.50, "technical": 0.20, "duration": 0.10, "speaker": 0.10, "emotion": 0.05, "event": 0.05}


@dataclass(frozen=True)
class Gate:
    maximum_cer: float = 0.12
    minimum_technical_quality: float = 0.55
    maximum_repetition_similarity: float = 0.995
    minimum_duration_ratio: float = 0.55
    maximum_duration_ratio: float = 1.80
    minimum_speaker_similarity: float = 0.45
    minimum_emotion_confidence: float = 0.35
    minimum_event_f1: float = 0.50
    require_asr: bool = True
    require_speaker: bool = False
    require_emotion: bool = False
    require_events: bool = False
    weights: Mapping[str, float] = field(default_factory=lambda: dict(SCORE_WEIGHTS))

    def __post_init__(self) -> None:
        if unknown := set(self.weights) - set(SCORE_WEIGHTS):
            raise ValueError(f"unknown weights: {', '.join(sorted(unknown))}")
        if min(self.weights.values()) < 0 or max(self.weights.values()) <= 0:
            raise ValueError("weights are at least 0 and one of them is positive")
        unit = (self.minimum_technical_quality, self.maximum_repetition_similarity, self.minimum_emotion_confidence, self.minimum_event_f1)
        if self.maximum_cer < 0 or not all(0 <= x <= 1 for x in unit) or not -1 <= self.minimum_speaker_similarity <= 1:
            raise ValueError("a limit is out of range")
        if not 0 < self.minimum_duration_ratio <= self.maximum_duration_ratio:
            raise ValueError("duration ratios must be positive and in order")


def gated(candidates: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """``candidates`` with duration_ratio, rejection_reasons, score and accepted.

    Columns used: valid, duration_seconds, expected_seconds, technical_quality,
    repetition_similarity, cer, speaker_similarity, emotion_confidence, event_f1,
    emotion (the control's), n_events. A candidate that isn't valid scores 0 for the
    single reason ``invalid_audio_tokens``. Missing values are reasons only where the
    gate requires them: for emotion if the control asks for one, for events if it has
    any. The speaker's part of the score is not clamped and may be negative."""
    c = F.col
    ratio = F.when(c("expected_seconds") > 0, c("duration_seconds") / c("expected_seconds"))
    wants = F.coalesce(c("emotion"), F.lit("neutral")) != "neutral"
    rules: list[tuple[str, Column]] = []
    if gate.require_asr:
        rules.append(("asr_missing", c("cer").isNull()))
    if gate.require_speaker:
        rules.append(("speaker_missing", c("speaker_similarity").isNull()))
    if gate.require_emotion:
        rules.append(("emotion_missing", wants & c("emotion_confidence").isNull()))
    if gate.require_events:
        rules.append(("event_missing", (c("n_events") > 0) & c("event_f1").isNull()))
    rules += [
        ("cer", c("cer") > gate.maximum_cer),
        ("technical_quality", c("technical_quality") < gate.minimum_technical_quality),
        ("repetition", c("repetition_similarity") > gate.maximum_repetition_similarity),
        ("duration", ~ratio.between(gate.minimum_duration_ratio, gate.maximum_duration_ratio)),
        ("speaker", c("speaker_similarity") < gate.minimum_speaker_similarity),
        ("emotion", c("emotion_confidence") < gate.minimum_emotion_confidence),
        ("event", c("event_f1") < gate.minimum_event_f1),
    ]
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    parts = {
        "intelligibility": F.greatest(F.lit(0.0), 1 - c("cer")),
        "technical": c("technical_quality"), "duration": duration_score(ratio), "speaker": c("speaker_similarity"),
        "emotion": c("emotion_confidence"), "event": c("event_f1"),
    }
    parts["intelligibility"] = F.when(c("cer").isNotNull(), parts["intelligibility"])
    valid = F.coalesce(c("valid"), F.lit(False))
    return candidates.withColumns({
        "duration_ratio": F.when(valid, ratio),
        "rejection_reasons": F.when(valid, reasons).otherwise(F.array(F.lit("invalid_audio_tokens"))),
        "score": F.when(valid, F.coalesce(weighted_mean(parts, gate.weights), F.lit(0.0))).otherwise(0.0),
        "accepted": valid & (F.size(reasons) == 0),
    })


def winners(candidates: DataFrame, request: list[str], candidate: str, requests: DataFrame | None = None) -> DataFrame:
    """One row a request: accepted candidates come first, then the highest score, then
    the first listed. With ``requests`` those without any candidate have nulls.

    The best is kept by a running maximum before the shuffle, so that a request with
    very many candidates is no large group."""
    rest = [x for x in candidates.columns if x not in request]
    # of equals the smallest candidate wins: its order is turned round
    order = F.struct(F.col("accepted").cast("int").alias("a"), F.coalesce("score", F.lit(float("-inf"))).alias("s"), (-F.col(candidate)).alias("c"))
    best = candidates.groupBy(*request).agg(F.max_by(F.struct(*rest), order).alias("_w")).select(*request, *[F.col("_w")[x].alias(x) for x in rest])
    return requests.select(*request).join(best, request, "left") if requests is not None else best


def retry_set(requests: DataFrame, won: DataFrame, request: list[str], initial: int, maximum: int) -> DataFrame:
    """(request, candidate) still to be made: for requests whose winner is missing or
    not accepted, numbers ``initial`` to ``maximum - 1``."""
    if not 1 <= initial <= maximum:
        raise ValueError("candidates: 1 <= initial <= maximum")
    open_ = requests.select(*request).join(won.filter("accepted").select(*request), request, "left_anti")
    if initial == maximum:
        return open_.withColumn("candidate", F.lit(0)).filter("false")
    return open_.withColumn("candidate", F.explode(F.sequence(F.lit(initial), F.lit(maximum - 1))))


def distilled(reports: DataFrame, least_score: float = 0.75, most_cer: float = 0.10) -> DataFrame:
    """Reports whose winner has an audio path, is literally accepted and is good enough:
    (id, text, audio, score, cer, hard_case). Reports without a winner are left out."""
    w = F.col("winner")
    good = (F.length(w["audio_path"]) > 0) & w["accepted"].eqNullSafe(F.lit(True)) & (w["score"] >= least_score) & (w["cer"] <= most_cer)
    return reports.filter(good).select("id", "text", w["audio_path"].alias("audio"), w["score"].alias("score"), w["cer"].alias("cer"), F.coalesce("hard_case", F.lit(False)).alias("hard_case"))


def group_advantages(rewards: DataFrame, group: list[str], components: Mapping[str, float], least: float = 1e-4) -> DataFrame:
    """``advantage``: each component normalised within its prompt group (mean and
    population deviation), then summed by weight. A group is one prompt's generations."""
    w = Window.partitionBy(*group)
    parts = [wt * (F.col(k) - F.avg(k).over(w)) / (F.stddev_pop(k).over(w) + F.lit(least)) for k, wt in components.items()]
    return rewards.withColumn("advantage", sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))
