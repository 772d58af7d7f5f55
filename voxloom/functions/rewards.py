"""Scores and rewards as row expressions; weights apply to present components only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default weights of the reward components.
REWARD_WEIGHTS = {
    "intelligibility": 1.0, "speaker": 0.0, "duration": 0.0, "speed": 0.0, "format": 0.0,
    "naturalness": 0.0, "prosody": 0.0, "emotion": 0.0, "event": 0.0, "speaker_drift": 0.0,
}


def error_reward(rate: Column, alpha: float = 3.0) -> Column:
    return F.when(rate.isNotNull(), 1 - F.tanh(alpha * F.greatest(F.lit(0.0), rate)))  # greatest() passes over nulls


def nll_reward(nll: Column, alpha: float = 3.0) -> Column:
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    return F.when(nll.isNotNull(), F.exp(-F.greatest(F.lit(0.0), nll) / alpha))


def duration_reward(generated: Column, target: Column, mode: str = "binary", tolerance: tuple[float, float] = (0.75, 1.25), scale: float = 0.35) -> Column:
    """1 or 0 within the tolerance, or a decay with the log ratio; null unless both are positive."""
    low, high = tolerance
    if not 0 < low <= high or scale <= 0 or mode not in ("binary", "smooth_log"):
        raise ValueError("bad duration reward")
    ratio = generated / target
    value = ratio.between(low, high).cast("double") if mode == "binary" else F.exp(-F.abs(F.ln(ratio)) / scale)
    return F.when((generated > 0) & (target > 0), value)


def duration_score(ratio: Column) -> Column:
    return F.when(ratio > 0, F.exp(-F.abs(F.ln(ratio)) / 0.45))


def speed_reward(seconds: Column, most: float = 12.0, fast: bool = True) -> Column:
    part = F.when(seconds.isNotNull(), F.least(seconds / max(most, 1e-6), F.lit(1.0)))
    return 1 - part if fast else part


def weighted_mean(values: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Mean over components that are not null, by their positive weights; null if none is."""
    used = {k: w for k, w in weights.items() if w > 0 and k in values}
    if not used:
        return F.lit(None).cast("double")
    top = sum((F.coalesce(values[k] * w, F.lit(0.0)) for k, w in used.items()), F.lit(0.0))
    low = sum((F.when(values[k].isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for k, w in used.items()), F.lit(0.0))
    return F.when(low > 0, top / low)


def weighted_harmonic_mean(values: list[Column], weights: list[float], least: float = 1e-8) -> Column:
    """Harmonic mean over components that are not null and weigh something; 0 if none is."""
    pairs = [(v, float(w)) for v, w in zip(values, weights) if w > 0]
    top = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in pairs), F.lit(0.0))
    low = sum((F.when(v.isNotNull(), w / F.greatest(v, F.lit(least))).otherwise(F.lit(0.0)) for v, w in pairs), F.lit(0.0))
    return F.when(top > 0, top / low).otherwise(0.0)


def intelligibility(error: Column, nll: Column, error_weight: float = 0.6, nll_weight: float = 0.4, error_alpha: float = 3.0, nll_alpha: float = 3.0) -> Column:
    score = error_reward(error, error_alpha) if error_weight > 0 else F.lit(None).cast("double")
    return weighted_harmonic_mean([score, nll_reward(nll, nll_alpha)], [error_weight, nll_weight])


def class_score(scores: Column, target: Column) -> Column:
    """Probability that a classifier's map label -> score gives the target; 0 without it."""
    return F.coalesce(F.try_element_at(F.map_from_entries(F.transform(F.map_entries(scores), lambda e: F.struct(F.lower(e["key"]), e["value"]))), F.lower(target)), F.lit(0.0))


def top_label(scores: Column) -> Column:
    """Label of the highest score in an array of (label, score); the first listed of equals."""
    best = F.array_max(F.transform(scores, lambda s: s["score"]))
    return F.get(F.filter(scores, lambda s: s["score"] == best), F.lit(0))["label"]


def first_over(scores: Column, threshold: float) -> Column:
    """First listed label at or over the threshold; null if none is."""
    return F.get(F.filter(scores, lambda s: s["score"] >= threshold), F.lit(0))["label"]


def component_or_invalid(value: Column, valid: Column, invalid: float = -1.0) -> Column:
    """A component as a reward of its own: invalid rows get ``invalid``, a missing component stays null."""
    return F.when(valid, value).otherwise(F.lit(invalid))


def fused_reward(values: Mapping[str, Column], valid: Column, weights: Mapping[str, float] = REWARD_WEIGHTS, invalid: float = -1.0) -> Column:
    return F.when(valid, F.coalesce(weighted_mean(values, weights), F.lit(invalid))).otherwise(F.lit(invalid))


def rewarded(df: DataFrame, values: Mapping[str, Column], valid: Column, weights: Mapping[str, float] = REWARD_WEIGHTS, invalid: float = -1.0) -> DataFrame:
    """``df`` with a column for each component and ``reward``. Components are columns of
    their own first: under the condition of :func:`fused_reward` each would be computed
    wherever it is named."""
    made = df.withColumns({f"{k}": v for k, v in values.items()} | {"_valid": valid})
    return made.withColumn("reward", fused_reward({k: F.col(k) for k in values}, F.col("_valid"), weights, invalid)).drop("_valid")
