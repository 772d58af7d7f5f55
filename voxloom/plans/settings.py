"""Validated settings of runs: checked on the driver before any task starts."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


class Invalid(ValueError):
    """A setting is missing, of the wrong kind or out of range."""


def _number(value, name: str, low: float | None = None, high: float | None = None, whole: bool = False):
    if isinstance(value, bool) or not isinstance(value, (int, float)) or whole and value != int(value) or not math.isfinite(value):
        raise Invalid(f"{name} must be a {'whole ' * whole}number")
    if low is not None and value < low or high is not None and value > high:
        raise Invalid(f"{name} must be from {low} to {high}")
    return int(value) if whole else float(value)


@dataclass(frozen=True)
class Encode:
    """Shard encoding; fixed values: the defaults."""

    batch_rows: int = 32
    bucket_rows: int = 256
    padded_seconds: float = 300.0
    read_rows: int = 2048
    least_seconds: float = 0.2
    most_seconds: float = 30.0
    upload_files: int = 64
    upload_bytes: int = 8 * 10**9
    flush_seconds: float = 30.0
    staged_bytes: int = 24 * 10**9
    prefix_chars: int = 2

    def __post_init__(self) -> None:
        for f in fields(self):
            _number(getattr(self, f.name), f.name, 0, None, f.type == "int")
        if self.batch_rows < 1 or self.bucket_rows < self.batch_rows or self.read_rows < 1:
            raise Invalid("a bucket holds at least a batch of at least one row")
        if self.most_seconds <= self.least_seconds:
            raise Invalid("most_seconds must be above least_seconds")
        if self.staged_bytes < self.upload_bytes:
            raise Invalid("staged_bytes must hold an upload batch")
        if self.prefix_chars > 64:
            raise Invalid("prefix_chars must be at most 64")

    @classmethod
    def of(cls, values: Mapping | None) -> Encode:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(values or {}) - known):
            raise Invalid("unknown settings: " + ", ".join(unknown))
        return cls(**dict(values or {}))

    def identity(self) -> dict:
        """The settings that change the output."""
        return {k: getattr(self, k) for k in ("least_seconds", "most_seconds", "prefix_chars")}


@dataclass(frozen=True)
class Scenario:
    """A preference-training scenario: what generation and batches follow from it."""

    least_seconds: float = 0.5
    most_seconds: float = 12.0
    frame_rate: float = 12.5
    codebooks: int = 32
    generations: int = 8
    processes: int = 8
    per_device: int = 4
    accumulation: int = 1
    streaming: bool = False
    max_steps: int = -1
    hard_multiplier: int = 1
    reward_asr: str = "a"
    evaluation_asr: str = "b"

    def __post_init__(self) -> None:
        _number(self.least_seconds, "least_seconds", 0)
        _number(self.most_seconds, "most_seconds", 0)
        if not 0 < self.frame_rate or self.most_seconds < self.least_seconds:
            raise Invalid("seconds and frame rate must be positive and in order")
        if min(self.generations, self.processes, self.per_device, self.accumulation, self.codebooks, self.hard_multiplier) < 1:
            raise Invalid("counts must be at least 1")
        if self.generations < 2 or self.effective_batch % self.generations:
            raise Invalid("the effective batch must hold whole groups of at least 2 generations")
        if self.streaming and self.max_steps < 1:
            raise Invalid("a stream needs a positive max_steps")
        if self.streaming and self.hard_multiplier > 1:
            raise Invalid("hard cases can't be repeated in a stream")
        if self.reward_asr == self.evaluation_asr:
            raise Invalid("evaluation must not use the recogniser of the reward")

    @property
    def frames(self) -> tuple[int, int]:
        return max(1, math.ceil(self.least_seconds * self.frame_rate)), math.ceil(self.most_seconds * self.frame_rate)

    @property
    def completion_length(self) -> int:
        return self.codebooks * self.frames[1] + 1

    @property
    def effective_batch(self) -> int:
        return self.processes * self.per_device * self.accumulation


#: Components of a reward, modes of a dataset with the columns that each needs, and choices.
COMPONENTS = ("intelligibility", "speaker", "speaker_drift", "emotion", "event", "naturalness", "prosody", "duration", "speed", "format")
MODES = {"tts_tokens": ("input_ids",), "text": ("text",), "prompt_ids": ("prompt_ids",), "voice_clone_tokens": ("input_ids", "reference_text", "reference_audio")}
CHOICES = {"on_invalid": ("error", "drop"), "metric": ("cer", "wer", "auto"), "nll_reduction": ("sum", "mean"), "duration_mode": ("binary", "smooth_log"), "speed_direction": ("fast", "slow")}
#: What a component needs to have a weight: the hooks that compute it and the columns it compares with.
NEEDS = {"intelligibility": (("asr",), ("target_text",)), "speaker": (("speaker",), ()), "speaker_drift": (("speaker", "speaker_drift"), ()), "emotion": (("emotion",), ("emotion",)), "event": (("event",), ("events",))}


@dataclass(frozen=True)
class Preferences:
    """Dataset and rewards of a preference-training run. ``columns`` are the logical columns
    that are mapped, ``hooks`` the models at hand by name (an empty name counts as none)."""

    mode: str = "tts_tokens"
    columns: tuple[str, ...] = ("input_ids", "target_text")
    weights: Mapping[str, float] = field(default_factory=lambda: {"intelligibility": 1.0})
    hooks: Mapping[str, str] = field(default_factory=dict)
    on_invalid: str = "error"
    metric: str = "cer"
    nll_reduction: str = "sum"
    duration_mode: str = "binary"
    speed_direction: str = "fast"
    error_terms: tuple[str, ...] = ("error_rate",)
    temperature: float = 1.0
    loader_workers: int | None = None
    most_prompt: int | None = None
    most_rows: int | None = None

    def __post_init__(self) -> None:
        for name, known in CHOICES.items():
            if getattr(self, name) not in known:
                raise Invalid(f"{name} must be one of {', '.join(known)}")
        if self.mode not in MODES:
            raise Invalid(f"unknown mode {self.mode}")
        if lacking := [c for c in MODES[self.mode] if c not in self.columns]:
            raise Invalid(f"{self.mode} needs columns: {', '.join(lacking)}")
        if unknown := sorted(set(self.weights) - set(COMPONENTS)):
            raise Invalid("unknown rewards: " + ", ".join(unknown))
        own = {k: _number(v, f"the weight of {k}", 0) for k, v in self.weights.items()}
        if not any(own.values()):
            raise Invalid("one weight must be positive")
        for k in (k for k, v in own.items() if v and k in NEEDS):
            hooks, columns = NEEDS[k]
            if lacking := [h for h in hooks if not self.hooks.get(h)] + [c for c in columns if c not in self.columns]:
                raise Invalid(f"{k} needs {', '.join(lacking)}")
        if own.get("intelligibility") and not set(self.error_terms) & {"error_rate", "nll"}:
            raise Invalid("intelligibility needs an error rate or a likelihood")
        if not _number(self.temperature, "temperature", 0):
            raise Invalid("temperature must be positive")
        for name, least in (("loader_workers", 0), ("most_prompt", 1), ("most_rows", 1)):
            if getattr(self, name) is not None:
                _number(getattr(self, name), name, least, whole=True)

    @classmethod
    def of(cls, values: Mapping) -> Preferences:
        if unknown := sorted(set(values) - {f.name for f in fields(cls)}):
            raise Invalid("unknown settings: " + ", ".join(unknown))
        return cls(**dict(values))


def accumulated(generations: int, processes: int, per_device: int, accumulation: int, batch: int) -> int:
    """Microbatches of a generation batch; it must hold whole groups of generations and
    whole microbatches of all processes."""
    for name, v in (("generations", generations), ("processes", processes), ("per_device", per_device), ("accumulation", accumulation), ("batch", batch)):
        _number(v, name, 1, whole=True)
    if batch % generations:
        raise Invalid("a generation batch must hold whole groups")
    if batch % (processes * per_device):
        raise Invalid("a generation batch must hold whole microbatches")
    return batch // (processes * per_device)


def extended(path: str, read) -> dict:
    """A configuration over the one that its ``extends`` names, and so on; a circle is an
    error. ``read`` gives the mapping at a path."""
    from voxloom.sources.files import merged

    chain: list[dict] = []
    seen: list[str] = []
    while path:
        if path in seen:
            raise Invalid("configurations extend each other: " + ", ".join(seen))
        seen.append(path)
        own = dict(read(path))
        path = own.pop("extends", None)
        chain.append(own)
    out: dict = {}
    for own in reversed(chain):
        out = merged(out, own)
    return out
