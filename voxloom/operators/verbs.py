"""Whole runs, put together from the operators around hooks for models.

``preprocess`` turns audio shards into token sequences, ``infer`` requests into the best
of several candidates, ``infer_long`` long texts into one signal each. A hook that
generates gives a row for each row it gets; everything around it is relational.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import frontend, signal
from voxloom.functions.text import character_error_rate, target_duration
from voxloom.functions.tokens import TokenLayout, code_points
from voxloom.operators import batching, measures, ranking, speech
from voxloom.plans.protocols import Hook, applied, once
from voxloom.plans.scale import written
from voxloom.plans.settings import Encode
from voxloom.sources import files


def requests(manifest: DataFrame, position: str = "request_id", out: str = "out") -> DataFrame:
    """Synthesis requests of a manifest: (position, id, text, reference_audio,
    reference_text, output_path, control, ok). The id defaults to the position, the path to
    ``out``/id.wav. ``control`` is the nested JSON of a control column if it is given, else it
    is made of flat columns where they exist; ok where text, reference text and reference
    audio are not empty. Missing columns count as null."""
    have = set(manifest.columns)
    col = lambda k, kind="string": F.col(k) if k in have else F.lit(None).cast(kind)
    full = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0
    id_ = F.coalesce(col("id"), F.col(position).cast("string"))
    flat = frontend.control(col("emotion"), col("intensity", "double"), col("delivery"), col("valence", "double"), col("arousal", "double"), frontend.events_of_json(col("events")))
    nested = F.from_json(col("control"), frontend.CONTROL_TYPE)
    given = frontend.control(*[nested[k] for k in ("emotion", "intensity", "delivery", "valence", "arousal", "events")])
    return manifest.select(
        position, id_.alias("id"), col("text").alias("text"), col("reference_audio").alias("reference_audio"), F.coalesce(col("reference_text"), F.lit("")).alias("reference_text"),
        F.concat(F.lit(out.rstrip("/") + "/"), F.coalesce(F.when(full(col("output_path")), col("output_path")), F.concat(id_, F.lit(".wav")))).alias("output_path"),
        F.when(nested.isNotNull(), given).otherwise(flat).alias("control"), (full(col("text")) & full(col("reference_text")) & full(col("reference_audio"))).alias("ok"),
    )


@dataclass(frozen=True)
class Preprocessed:
    """Sequences (position, bucket_no, batch_no, input_ids), one row of statistics, and
    what was dropped by reason."""

    sequences: DataFrame
    stats: DataFrame
    dropped: DataFrame


def preprocess(shards: DataFrame, layout: TokenLayout, codec: Hook, position: str = "position", settings: Encode = Encode(), rate: int = 24000, tokenize: Callable[[Column], Column] = code_points, target: str | None = None) -> Preprocessed:
    """Shard rows (position, audio struct<bytes, path>, text) as training sequences:
    decode, filter by duration, batch by length, encode, pack, and write to ``target`` if
    one is named. ``codec`` takes ``samples`` and gives ``codes array<array<int>>``; rows of a
    batch reach it together and in order. Rows whose audio can't be decoded, or that
    the codec gives nothing for, are dropped with a reason."""
    made = written(files.decoded(shards.select(position, "audio", "text"), least=settings.least_seconds, most=settings.most_seconds, rate=rate).drop("audio"), "decoded")
    good = made.filter("dropped is null")
    batches = batching.length_batches(good.withColumn("length", F.size("samples")), position, "length", settings.batch_rows, settings.bucket_rows, int(settings.padded_seconds * rate))
    placed = good.drop("length").join(batches, position)
    together = placed.repartition("bucket_no").sortWithinPartitions("bucket_no", "batch_no", "place")  # a bucket is bounded
    coded = written(applied(together, codec, [position, "bucket_no", "batch_no", "text"]), "codes")
    fine = coded.filter("size(codes) > 0")
    ids = layout.speech(tokenize(F.col("text")), layout.from_codes(F.col("codes")))
    sequences = fine.select(position, "bucket_no", "batch_no", ids.alias("input_ids"))
    if target:
        files.write_tokens(sequences.orderBy("bucket_no", "batch_no", position), target)
    why = made.filter("dropped is not null").select("dropped").unionByName(coded.filter("coalesce(size(codes), 0) = 0").select(F.lit("codec").alias("dropped")))
    stats = batching.batch_stats(batches, "length").withColumn("n_input", F.lit(made.count())).withColumn("n_dropped", F.col("n_input") - F.col("n_rows"))
    return Preprocessed(sequences, stats, why.groupBy("dropped").agg(F.count(F.lit(1)).alias("n_rows")))


@dataclass(frozen=True)
class Best:
    """Winners (a row a request), all candidates of both rounds, and whether all was accepted."""

    winners: DataFrame
    candidates: DataFrame

    def accepted(self) -> bool:
        return self.winners.filter("not coalesce(accepted, false)").isEmpty()


def prepared(asked: DataFrame, language: str = "tr", reference: Hook | None = None) -> DataFrame:
    """Requests with ``said`` (normalised), ``model_text`` (with its control rendered) and,
    by a hook that is run once for each distinct reference, what it gives of that."""
    out = asked.withColumn("said", frontend.normalized(F.col("text"), F.lit(language)))
    out = out.withColumn("model_text", frontend.rendered(F.col("said"), F.col("control")))
    return once(out, reference) if reference else out


def infer(asked: DataFrame, generate: Hook, verify: Hook | None = None, gate: ranking.Gate = ranking.Gate(), initial: int = 2, maximum: int = 4, rate: int = 24000, language: str = "tr", reference: Hook | None = None, position: str = "request_id") -> Best:
    """The best of ``initial`` candidates for each request that is ok, and of up to
    ``maximum`` where none of them is accepted.

    ``generate`` takes ``model_text``, ``candidate`` (its number: a seed) and whatever the
    reference hook gives, and returns ``samples array<float>``; ``verify`` takes ``samples``
    and gives ``transcript`` and others of the gate's columns. A request that is not ok,
    or without any candidate, has a winner of nulls."""
    ready = written(prepared(asked.filter("ok"), language, reference), "prepared")

    def scored(wanted: DataFrame) -> DataFrame:
        rows = ready.join(wanted, position)
        made = written(rows.drop("samples").join(applied(rows, generate, [position, "candidate"]), [position, "candidate"]), "generated")
        if verify:
            made = made.join(applied(made.filter("size(samples) > 0"), verify, [position, "candidate"]), [position, "candidate"], "left")
        have = set(made.columns)
        null = F.lit(None).cast("double")
        metrics = signal.analyzed(F.col("samples"), F.lit(rate))
        heard = F.col("transcript") if "transcript" in have else F.lit(None).cast("string")
        made = made.withColumn("_m", metrics).withColumns({
            "valid": F.coalesce(F.size("samples") > 1, F.lit(False)), "duration_seconds": F.size("samples") / F.lit(float(rate)),
            "expected_seconds": target_duration(F.col("target_duration_seconds") if "target_duration_seconds" in have else null, F.col("text"), F.col("reference_text"), F.col("reference_seconds") if "reference_seconds" in have else null),
            "technical_quality": F.col("_m.technical_quality"), "repetition_similarity": F.col("_m.repetition_similarity"),
            "cer": F.when(heard.isNotNull(), character_error_rate(F.col("said"), heard)), "emotion": F.col("control.emotion"), "n_events": F.size("control.events"),
            **{k: F.col(k).cast("double") if k in have else null for k in ("speaker_similarity", "emotion_confidence", "event_f1")},
        })
        return written(ranking.gated(made.drop("_m"), gate), "gated")

    first = scored(ready.select(position).withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(initial - 1)))))
    won = ranking.winners(first.select(position, "candidate", "score", "accepted"), [position], "candidate")
    more = scored(ranking.retry_set(ready.select(position), won, [position], initial, maximum))
    candidates = first.unionByName(more)
    best = ranking.winners(candidates.select(position, "candidate", "score", "accepted", "rejection_reasons", "cer", "duration_seconds", "samples", "output_path"), [position], "candidate", asked)
    return Best(written(best, "winners"), candidates)


#: What a chunk is continued from.
PAUSE_SECONDS, TAIL_SECONDS = 0.08, 4.0


def continued(original: Column, previous: Column, rate: int, pause: float = PAUSE_SECONDS, tail: float = TAIL_SECONDS) -> Column:
    """Reference of a chunk: the original, a pause and the end of the chunk before; the
    original alone where there is none."""
    n = int(tail * rate)
    end = F.slice(previous, F.greatest(F.lit(1), F.size(previous) - n + 1), n)
    silence = F.array_repeat(F.lit(0.0).cast("float"), int(pause * rate))
    return F.when(F.coalesce(F.size(previous), F.lit(0)) > 0, F.concat(original, silence, end)).otherwise(original)


def infer_long(asked: DataFrame, generate: Hook, gate: ranking.Gate = ranking.Gate(), most: int = 280, rate: int = 24000, language: str = "tr", initial: int = 1, maximum: int = 2, fade: float = 40.0, position: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """(results, chunks) of long texts (position, text, control, reference_text,
    reference_samples, ok): a text is split into chunks and its events go with them; each
    chunk is made by :func:`infer` with a reference that continues the winner of the one before, so
    there are as many rounds as the longest text has chunks; the winners are crossfaded.
    results: the roll-up of :func:`measures.long_form` with ``samples``. ``generate`` also
    takes ``reference_samples``."""
    parts = frontend.chunked(F.col("text"), most)
    src = asked.withColumn("_chunks", parts).withColumn("_events", speech.split_events(F.col("_chunks"), F.col("control.events")))
    each = written(src.select("*", F.posexplode(F.arrays_zip("_chunks", "_events")).alias("chunk_no", "_z")).withColumns({"text": F.col("_z._chunks"), "_own": F.col("_z._events")}).drop("_z", "_chunks", "_events"), "chunks")
    rounds = each.agg(F.max("chunk_no").alias("n")).first()["n"]
    done: DataFrame | None = None
    for k in range(-1 if rounds is None else rounds + 1):
        now = each.filter(F.col("chunk_no") == k).withColumn("control", F.col("control").withField("events", F.transform("_own", _as_event))).drop("_own")
        if done is not None:
            before = done.filter(F.col("chunk_no") == k - 1).select(position, F.col("samples").alias("_previous"))
            now = now.join(before, position, "left").withColumn("reference_samples", continued(F.col("reference_samples"), F.col("_previous"), rate)).drop("_previous")
        got = infer(now, generate, None, gate, initial, maximum, rate, language, None, position).winners.withColumn("chunk_no", F.lit(k))
        done = got if done is None else written(done.unionByName(got), "long")
    if done is None:
        raise ValueError("no text has a chunk")
    rolled = measures.long_form(done.withColumns({"audio_seconds": F.col("duration_seconds"), "total_seconds": F.col("duration_seconds")}), position).drop("real_time_factor")
    waves = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "samples"))), lambda x: x["samples"])  # the chunks of one text
    joined = done.filter("size(samples) > 0").groupBy(position).agg(signal.crossfaded(waves, rate, fade).alias("samples"))
    return rolled.join(joined, position, "left"), done


def _as_event(e: Column) -> Column:
    names = ("type", "after_word", "at_seconds", "duration", "count")
    own = {n: e[n].alias(n) for n in names} | {"duration_seconds": F.lit(None).cast("double").alias("duration_seconds")}
    return F.struct(*[own[n] for n in ("type", "after_word", "at_seconds", "duration", "duration_seconds", "count")])
