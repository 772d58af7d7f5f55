"""Hooks for models: functions over batches with fixed result types.

Recognition, speaker, emotion and event models, codecs and tokenizers are not part of
the engine; a hook is a function from a pandas frame to a pandas frame of one row a
row, run by ``mapInPandas``. A result of another length is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.plans.scale import skew_join, written

VERIFICATION = "transcript string, cer double, wer double, speaker_similarity double, emotion string, emotion_confidence double, event_f1 double"


@dataclass(frozen=True)
class Hook:
    """``run`` takes the ``inputs`` columns and gives those of the DDL ``gives``."""

    name: str
    inputs: tuple[str, ...]
    gives: str
    run: Callable[[pd.DataFrame], pd.DataFrame]


def halved(run: Callable[[pd.DataFrame], pd.DataFrame], x: pd.DataFrame) -> pd.DataFrame:
    """``run`` of a batch; where memory doesn't suffice, of its halves, and so on down to
    a row."""
    try:
        return run(x)
    except MemoryError:
        if len(x) < 2:
            raise
        half = len(x) // 2
        return pd.concat([halved(run, x.iloc[:half]), halved(run, x.iloc[half:])], ignore_index=True)


def applied(df: DataFrame, hook: Hook, key: list[str]) -> DataFrame:
    """(key, outputs) of a hook; only the key and its inputs travel to Python."""
    kinds = df.select(*key).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            y = halved(hook.run, x[list(hook.inputs)])
            if len(y) != len(x):
                raise ValueError(f"{hook.name} gave {len(y)} results for {len(x)} rows")
            yield pd.concat([x[key].reset_index(drop=True), y.reset_index(drop=True)], axis=1)

    return df.select(*dict.fromkeys([*key, *hook.inputs])).mapInPandas(run, f"{ddl}, {hook.gives}")


def verified(candidates: DataFrame, hooks: list[Hook], key: list[str]) -> DataFrame:
    """``candidates`` with the outputs of all hooks; only valid ones are verified, others
    have nulls."""
    out = candidates
    for h in hooks:
        out = out.join(applied(candidates.filter("valid"), h, key), key, "left")
    return out


def once(df: DataFrame, hook: Hook, spread: str | None = None) -> DataFrame:
    """``df`` with a hook's outputs, computed once for each distinct input (say, one
    reference clip of many requests) and joined back by a 128-bit digest of it."""
    digest = F.unhex(F.md5(F.to_json(F.struct(*hook.inputs))))
    keyed = df.withColumn("_key", digest)
    firsts = keyed.groupBy("_key").agg(*[F.first(c).alias(c) for c in hook.inputs])
    done = written(applied(firsts, hook, ["_key"]), hook.name)
    return skew_join(keyed, done, ["_key"], spread or keyed.columns[0], "left").drop("_key")


def independent(reward: Hook, evaluation: Hook) -> None:
    if reward.name == evaluation.name:
        raise ValueError("evaluation must not use the model of the reward")
