"""Composite verbs over clips: expressive encoding, evaluation, codec check, chunked control."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import frontend, signal
from voxloom.functions.text import character_error_rate, word_error_rate, word_runs
from voxloom.functions.tokens import TokenLayout, code_points, let
from voxloom.operators.measures import aggregate_numeric

#: Metadata columns that are carried along if present; nested ones become JSON.
METADATA = ("id", "speaker", "source", "license", "split", "style_reference", "pronunciation_references", "hard_case", "teacher_score", "teacher_cer", "source_report")


def carried(df: DataFrame, names: Sequence[str] = METADATA) -> list[Column]:
    kinds = dict(df.dtypes)
    return [F.to_json(k).alias(k) if kinds[k].startswith(("struct", "array", "map")) else F.col(k) for k in names if k in kinds]


def expressive(df: DataFrame, layout: TokenLayout, control: Column, codes: Column, tokenize: Callable[[Column], Column] = code_points, language: Column | None = None, normalize: Callable[[Column, Column], Column] = frontend.normalized, strict: bool = False) -> DataFrame:
    """Rows encoded for expressive speech: input_ids, text, lexical_text, model_text,
    language and the control's fields, with metadata carried along. Rows with an empty
    text are an error with ``strict`` and are left out otherwise. The codec's codes come
    as a column; events are stored as JSON with sorted keys."""
    lang = F.coalesce(F.when(F.length(language) > 0, language), F.lit("tr")) if language is not None else F.lit("tr")
    base = df.withColumns({"_lang": lang, "_control": control, "_codes": codes})
    base = base.withColumn("lexical_text", normalize(F.col("text"), F.col("_lang")))
    base = base.withColumn("model_text", frontend.rendered(F.col("lexical_text"), F.col("_control")))
    empty = F.coalesce(F.length("lexical_text"), F.lit(0)) == 0
    if strict:
        base = base.withColumn("model_text", F.when(empty, F.raise_error(F.lit("empty text")).cast("string")).otherwise(F.col("model_text")))
    else:
        base = base.filter(~empty)
    c = F.col("_control")
    events = F.to_json(F.transform(c["events"], lambda e: F.struct(e["after_word"].alias("after_word"), e["at_seconds"].alias("at_seconds"), e["count"].alias("count"), e["duration"].alias("duration"), e["type"].alias("type"))))
    ids = layout.speech(tokenize(F.col("model_text")), layout.from_codes(F.col("_codes")))
    return base.select(ids.alias("input_ids"), "text", "lexical_text", "model_text", F.col("_lang").alias("language"), *[c[k].alias(k) for k in ("emotion", "intensity", "delivery", "valence", "arousal")], events.alias("events"), *carried(df))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """(key, n_rows) by the keys joined with a colon."""
    return df.groupBy(F.concat_ws(":", *keys).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))


def evaluated(df: DataFrame, reference: str = "text", hypothesis: str = "hypothesis", optional: Sequence[str] = ("speaker_similarity", "emotion_accuracy", "event_f1", "speaker_drift")) -> DataFrame:
    """``df`` with cer and wer (null unless both texts are non-empty) and the optional
    metrics as doubles."""
    both = (F.length(reference) > 0) & (F.length(hypothesis) > 0)
    out = df.withColumns({"cer": F.when(both, character_error_rate(F.col(reference), F.col(hypothesis))), "wer": F.when(both, word_error_rate(F.col(reference), F.col(hypothesis)))})
    return out.withColumns({k: F.col(k).cast("double") for k in optional if k in df.columns})


def summary(df: DataFrame) -> DataFrame:
    return aggregate_numeric(df)


def listening_sheet(df: DataFrame, ratings: Sequence[str] = ("naturalness", "similarity", "emotion", "comment")) -> DataFrame:
    """(id, audio, text) with empty rating columns."""
    return df.select("id", "audio", "text", *[F.lit(None).cast("string" if r == "comment" else "double").alias(r) for r in ratings])


def codec_check(pairs: DataFrame, reference: str, estimate: str, rate: int) -> DataFrame:
    """``pairs`` with si_sdr_db, log_spectral_distance_db, pitch_error_hz (null unless both
    have a pitch) and technical quality before and after."""
    r = F.lit(rate)
    made = pairs.withColumns({"_a": signal.analyzed(F.col(reference), r), "_b": signal.analyzed(F.col(estimate), r)})
    return made.withColumns({
        "si_sdr_db": signal.si_sdr(F.col(reference), F.col(estimate)),
        "log_spectral_distance_db": signal.log_spectral_distance(F.col(reference), F.col(estimate), r),
        "pitch_error_hz": F.abs(F.col("_a.pitch_median_hz") - F.col("_b.pitch_median_hz")),
        "quality_before": F.col("_a.technical_quality"), "quality_after": F.col("_b.technical_quality"),
    }).drop("_a", "_b")


def split_events(chunks: Column, events: Column) -> Column:
    """array<array<event>>, one list a chunk: an event goes to the first chunk whose
    words reach its position, else to the last, with its position counted from there;
    one without a word position goes to the first chunk as it is."""
    counts = F.transform(chunks, word_runs)
    spans = F.aggregate(counts, F.array().cast("array<struct<first:int,last:int>>"), _append_span)

    def placed(s: Column) -> Column:
        def place(e: Column) -> Column:
            at = F.array_position(F.transform(s, lambda x: x["last"] >= e["after_word"]), F.lit(True)).cast("int")
            chunk = F.when(e["after_word"].isNull(), F.lit(0)).otherwise(F.when(at > 0, at - 1).otherwise(F.size(s) - 1))
            rebased = F.when(e["after_word"].isNotNull(), F.greatest(F.lit(0), e["after_word"] - F.get(s, chunk)["first"]))
            return F.struct(chunk.alias("chunk"), e["type"].alias("type"), rebased.alias("after_word"), F.when(e["after_word"].isNull(), e["at_seconds"]).alias("at_seconds"), e["duration"].alias("duration"), e["count"].alias("count"))

        return F.transform(events, place)

    return let(let(spans, placed), lambda p: F.transform(chunks, lambda _, i: F.filter(p, lambda e: e["chunk"] == i)))


def _append_span(acc: Column, n: Column) -> Column:
    last = F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)["last"]).otherwise(F.lit(0))
    return F.array_append(acc, F.struct(last.alias("first"), (last + n).alias("last")))
