"""Signal metrics over ``array<float>`` columns.

Levels, silence, distortion and joining are expressions in the JVM; only what needs
a Fourier transform (pitch, spectral distance) or all pairs of windows is numpy in
Arrow batches.
"""

from __future__ import annotations

import math
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.tokens import let, upto

METRICS = (
    "duration_seconds", "peak", "rms_dbfs", "dc_offset", "clipping_ratio", "silence_ratio", "voiced_ratio", "pitch_median_hz",
    "pitch_std_semitones", "energy_std_db", "repetition_similarity", "technical_quality",
)
METRICS_TYPE = "struct<" + ",".join(f"{m}:double" for m in METRICS) + ">"
#: Silence threshold, clipping level, voicing confidence, pitch range.
SILENCE_DB, CLIPPED, VOICED, PITCH = -45.0, 0.999, 0.30, (60, 500)


def _d(wave: Column) -> Column:
    return wave.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def decibels(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-10)))


def peak(wave: Column) -> Column:
    return F.array_max(F.transform(_d(wave), F.abs))


def rms(wave: Column) -> Column:
    return F.sqrt(mean(F.transform(_d(wave), lambda v: v * v)))


def dc_offset(wave: Column) -> Column:
    return mean(_d(wave))


def clipping_ratio(wave: Column) -> Column:
    return F.size(F.filter(_d(wave), lambda v: F.abs(v) >= CLIPPED)) / F.size(wave)


def mono(channels: Column) -> Column:
    """Mean over the channels of time-major frames."""
    return F.transform(channels, lambda frame: mean(_d(frame)))


def frames(wave: Column, size: int, hop: int) -> Column:
    """Windows of ``size`` samples every ``hop``; a shorter signal is filled with
    zeros, a tail that fills no window is dropped."""
    short = F.concat(_d(wave), F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(wave), F.lit(0))))
    count = 1 + F.floor(F.greatest(F.size(wave) - size, F.lit(0)) / hop)
    return F.transform(upto(count.cast("int")), lambda i: F.slice(short, i * hop + 1, size))


def frame_levels(wave: Column, rate: int) -> Column:
    """Levels in dB of 25 ms windows every 10 ms."""
    size, hop = max(16, round(rate * 0.025)), max(8, round(rate * 0.010))
    return F.transform(frames(wave, size, hop), lambda w: decibels(F.sqrt(mean(F.transform(w, lambda v: v * v)) + 1e-12)))


def silence_ratio(wave: Column, rate: int) -> Column:
    return let(frame_levels(wave, rate), lambda x: F.size(F.filter(x, lambda v: v < SILENCE_DB)) / F.size(x))


def energy_deviation(wave: Column, rate: int) -> Column:
    """Population deviation of the levels of windows that aren't silent; 0 without any."""
    active = F.filter(frame_levels(wave, rate), lambda v: v >= SILENCE_DB)
    spread = lambda x: let(mean(x), lambda m: F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m)))))
    return let(active, lambda x: F.when(F.size(x) > 0, spread(x)).otherwise(0.0))


def technical_quality(clipping: Column, offset: Column, level_rms: Column, silence: Column, repetition: Column) -> Column:
    """Weighted sum of five exponential scores, in 0 to 1. The weights."""
    score = (
        0.30 * F.exp(-1500.0 * clipping) + 0.15 * F.exp(-40.0 * F.abs(offset)) + 0.20 * F.exp(-F.abs(decibels(level_rms) + 20.0) / 18.0)
        + 0.15 * F.exp(-5.0 * F.greatest(F.lit(0.0), silence - 0.65)) + 0.20 * F.exp(-80.0 * F.greatest(F.lit(0.0), repetition - 0.985))
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def prosody_similarity(a: Column, b: Column) -> Column:
    """Mean of three to five decaying distances between metrics structs; pitch terms
    count only where both have them."""
    gap = lambda k, scale: F.exp(-F.abs(a[k] - b[k]) / scale)
    both = (a["pitch_median_hz"] > 0) & (b["pitch_median_hz"] > 0)
    pitch = F.when(both, F.exp(-F.abs(12 * F.log2(a["pitch_median_hz"] / b["pitch_median_hz"])) / 8.0))
    terms = F.array_compact(F.array(gap("energy_std_db", 8.0), gap("voiced_ratio", 0.35), gap("silence_ratio", 0.30), pitch, gap("pitch_std_semitones", 4.0)))
    return mean(terms)


def si_sdr(reference: Column, estimate: Column) -> Column:
    """Scale-invariant signal-to-distortion ratio in dB over the common length; minus
    infinity for a silent reference, null for fewer than two samples."""
    n = F.least(F.size(reference), F.size(estimate))
    pairs = F.zip_with(F.slice(_d(reference), 1, n), F.slice(_d(estimate), 1, n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    middle = F.aggregate(pairs, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))

    def powers(m: Column) -> Column:  # of the signals about their means, in one more pass
        start = F.struct(*[F.lit(0.0).alias(k) for k in ("xx", "yy", "xy")])
        step = lambda s, x, y: F.struct((s["xx"] + x * x).alias("xx"), (s["yy"] + y * y).alias("yy"), (s["xy"] + x * y).alias("xy"))
        return F.aggregate(pairs, start, lambda s, p: step(s, p["x"] - m["x"] / n, p["y"] - m["y"] / n))

    def ratio(p: Column) -> Column:
        target = p["xy"] * p["xy"] / p["xx"]
        noise = F.greatest(p["yy"] - target, F.lit(0.0))
        return F.when(p["xx"] <= 1e-12, F.lit(float("-inf"))).otherwise(10 * F.log10((target + 1e-12) / (noise + 1e-12)))

    return F.when(n >= 2, let(let(middle, powers), ratio))


def crossfaded(waves: Column, rate: int, milliseconds: float = 40.0) -> Column:
    """Signals joined with a linear overlap of at most the given time; empty ones are
    left out."""
    asked = max(0, round(rate * milliseconds / 1000))

    def join(held: Column, wave: Column) -> Column:
        n = F.least(F.lit(asked), F.size(held), F.size(wave))
        tail = F.slice(held, F.size(held) - n + 1, n)
        mixed = F.zip_with(F.transform(tail, lambda v, i: F.struct(v.alias("v"), (i / n).alias("in"))), F.slice(wave, 1, n), lambda x, y: x["v"] * (1 - x["in"]) + y * x["in"])
        whole = F.concat(F.slice(held, 1, F.size(held) - n), mixed, F.slice(wave, n + 1, F.greatest(F.size(wave) - n, F.lit(0))))
        return F.when((F.size(held) == 0) | (n == 0), F.concat(held, wave)).otherwise(whole)

    return F.aggregate(F.transform(waves, _d), F.array().cast("array<double>"), join)


def window_starts(samples: Column, window: int, hop: int, tail: bool = True) -> Column:
    """Starts of overlapping windows; with ``tail`` one more that ends with the signal.
    A signal within one window has the single start 0."""
    count = F.floor(F.greatest(samples - window, F.lit(0)) / hop) + 1
    starts = F.transform(upto(count.cast("int")), lambda i: (i * hop).cast("int"))
    if not tail:
        return starts
    last = F.element_at(starts, -1)
    return F.when(last + window < samples, F.array_append(starts, (samples - window).cast("int"))).otherwise(starts)


# what needs numpy


def _windows(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    x = np.pad(x, (0, max(0, size - x.size)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def pitch_track(wave: np.ndarray, rate: int) -> np.ndarray:
    """Pitches in Hz of voiced 40 ms windows: the highest autocorrelation between the
    lags of 500 and 60 Hz, where it reaches the confidence."""
    size, hop = max(32, round(rate * 0.040)), max(16, round(rate * 0.010))
    low, high = max(1, rate // PITCH[1]), min(size - 2, rate // PITCH[0])
    n = 1 << (2 * size - 1).bit_length()
    shape = np.hanning(size).astype(np.float32)
    views, out = _windows(wave, size, hop), []
    for s in range(0, len(views), 512):
        x = views[s : s + 512]
        x = (x - x.mean(1, keepdims=True)) * shape
        x = x[np.sqrt((x * x).mean(1)) >= 10 ** (SILENCE_DB / 20)]
        if not len(x) or high < low:
            continue
        power = np.abs(np.fft.rfft(x, n, axis=1)) ** 2
        auto = np.fft.irfft(power, n, axis=1)[:, :size]
        lag = low + auto[:, low : high + 1].argmax(1)
        sure = auto[np.arange(len(x)), lag] / np.maximum(auto[:, 0], 1e-9) >= VOICED
        out.append(rate / lag[sure])
    return np.concatenate(out).astype(np.float32) if out else np.zeros(0, np.float32)


def repetition(wave: np.ndarray, rate: int) -> float:
    """Highest cosine of one-second windows at least 1.5 seconds apart; 0 for less
    than two seconds."""
    size = max(16, rate)
    hop = max(8, size // 2)
    if wave.size < 2 * size:
        return 0.0
    x = _windows(wave, size, hop)
    x = x - x.mean(1, keepdims=True)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    apart = max(2, math.ceil(1.5 * rate / hop))
    best = -np.inf
    for i in range(len(x) - apart):  # a row at a time: memory stays flat on long signals
        best = max(best, float((x[i + apart :] @ x[i]).max()))
    return best if best > -np.inf else 0.0


def analyze(wave, rate: int) -> tuple | None:
    """The values of ``METRICS``; null for an empty or non-finite signal or a bad rate."""
    if wave is None or rate is None or rate < 1:
        return None
    x = np.asarray(wave, dtype=np.float32)
    if not x.size or not np.isfinite(x).all():
        return None
    db = lambda v: 20 * math.log10(max(float(v), 1e-10))
    level = float(np.sqrt(np.mean(x * x)))
    views = _windows(x, max(16, round(rate * 0.025)), max(8, round(rate * 0.010)))
    levels = 20 * np.log10(np.maximum(np.sqrt((views * views).mean(1) + 1e-12), 1e-10))
    silent = levels < SILENCE_DB
    active = levels[~silent]
    pitch = pitch_track(x, rate)
    clip, dc, still, rep = float((np.abs(x) >= CLIPPED).mean()), float(x.mean()), float(silent.mean()), repetition(x, rate)
    quality = (
        0.30 * math.exp(-1500 * clip) + 0.15 * math.exp(-40 * abs(dc)) + 0.20 * math.exp(-abs(db(level) + 20) / 18)
        + 0.15 * math.exp(-5 * max(0.0, still - 0.65)) + 0.20 * math.exp(-80 * max(0.0, rep - 0.985))
    )
    middle = float(np.median(pitch)) if pitch.size else None
    spread = float(np.std(12 * np.log2(pitch / np.median(pitch)))) if pitch.size > 1 else None
    return (
        x.size / rate, float(np.abs(x).max()), db(level), dc, clip, still, pitch.size / max(1, len(views)), middle, spread,
        float(active.std()) if active.size else 0.0, rep, min(1.0, max(0.0, quality)),
    )


def analyzed(wave: Column, rate: Column) -> Column:
    """Metrics struct of a signal; not deterministic for the optimiser, so that a
    filter on it doesn't compute it twice."""

    @F.pandas_udf(METRICS_TYPE)
    def run(waves: pd.Series, rates: pd.Series) -> pd.DataFrame:
        rows = [analyze(w, None if pd.isna(r) else int(r)) or (None,) * len(METRICS) for w, r in zip(waves, rates)]
        return pd.DataFrame(rows, columns=METRICS, dtype="float64")

    return run.asNondeterministic()(wave, rate)


@lru_cache(maxsize=32)
def _sinc_kernels(up: int, down: int, crossings: int = 6, rolloff: float = 0.99) -> tuple[np.ndarray, np.ndarray]:
    """(taps, weights): weights of each of ``up`` phases over input samples at ``taps`` around
    the one before the output's time; a windowed sinc cut off below the lower rate."""
    cut = rolloff * min(1.0, up / down)
    half = int(np.ceil(crossings / cut))
    taps = np.arange(-half, half + 2)
    phase = (np.arange(up) * down % up) / up
    t = (taps[None, :] - phase[:, None]) * cut
    window = np.where(np.abs(t) < crossings, np.cos(np.pi * t / crossings / 2) ** 2, 0.0)
    return taps, cut * np.sinc(t) * window


def resample(x, rate: int, to: int) -> np.ndarray:
    """A signal at another rate, by windowed-sinc interpolation; its length is rounded up."""
    x = np.asarray(x, np.float64)
    if rate == to or not x.size:
        return x.astype(np.float32)
    if rate < 1 or to < 1:
        raise ValueError("rates must be positive")
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    taps, weights = _sinc_kernels(up, down)
    n = -(-x.size * up // down)
    edge = taps.size
    wide = np.pad(x, edge)
    out = np.empty(n, np.float32)
    for a in range(0, n, 65_536):  # memory stays bounded on long signals
        k = np.arange(a, min(n, a + 65_536))
        at = k * down // up + edge
        out[k] = (wide[np.clip(at[:, None] + taps, 0, wide.size - 1)] * weights[k % up]).sum(1)
    return out


def resampled(wave: Column, rate: Column, to: int) -> Column:
    """:func:`resample` of each row; null for a null signal or rate."""

    @F.pandas_udf("array<float>")
    def run(waves: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([None if w is None or pd.isna(r) else resample(w, int(r), to) for w, r in zip(waves, rates)])

    return run(wave, rate)


def spectral_distance(a, b, rate: int) -> float | None:
    """Mean over windows of the root mean square of log-magnitude differences in dB."""
    if a is None or b is None:
        return None
    a, b = np.asarray(a, np.float32), np.asarray(b, np.float32)
    n = min(a.size, b.size)
    size = 1 << (max(64, round(rate * 0.032)) - 1).bit_length()
    shape = np.hanning(size).astype(np.float32)
    logs = [np.log10(np.maximum(np.abs(np.fft.rfft(_windows(x[:n], size, size // 4) * shape, axis=1)), 1e-7)) for x in (a, b)]
    gap = 20 * (logs[0] - logs[1])
    return float(np.sqrt((gap * gap).mean(1)).mean())


def log_spectral_distance(a: Column, b: Column, rate: Column) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys, rs in batches:
            yield pd.Series([spectral_distance(x, y, int(r)) for x, y, r in zip(xs, ys, rs)], dtype="float64")

    return run(a, b, rate)
