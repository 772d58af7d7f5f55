"""Token sequences of speech: a layout of ids that builds Column expressions.

All functions work on ``array<int>`` columns inside the JVM; none needs Python rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offsets of the special ids from the base and of the first audio id.
SOS, EOS_SPEECH, SOH, EOH, SOA, AUDIO = 1, 2, 3, 4, 5, 10
IGNORED_LABEL = -100


def upto(n: Column) -> Column:
    """0 .. n - 1, empty for n < 1 (a bare ``sequence`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row: inside the lambdas of array
    functions a repeated expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class TokenLayout:
    """Ids of a vocabulary with speech tokens: ``base`` is the first added id, ``eot``
    ends text, audio ids follow at ``base + 10`` codebook by codebook."""

    base: int
    eot: int
    codebooks: int = 32
    size: int = 2048

    def __post_init__(self) -> None:
        if self.base < 0 or self.codebooks < 1 or self.size < 1:
            raise ValueError("a layout needs a base of at least 0, a codebook and a code")

    @classmethod
    def from_vocabulary(cls, vocabulary: Mapping[str, int], size: int, eos: int, pad: int | None = None, saved_eos: int | None = None, codebooks: int = 32, codes: int = 2048) -> TokenLayout:
        """Layout of a tokenizer: the base is the id of the first custom token, or the
        vocabulary's size if there is none; text ends with the saved text end, else
        with the tokenizer's end token, or its pad token if that end is a speech id."""
        base = vocabulary.get("<custom_token_0>", size)
        eot = saved_eos if saved_eos is not None else eos
        if saved_eos is None and eot >= base and pad is not None:
            eot = pad
        return cls(base, eot, codebooks, codes)

    @property
    def added(self) -> int:
        return AUDIO + self.codebooks * self.size

    def special(self, offset: int) -> int:
        return self.base + offset

    def token_strings(self) -> list[str]:
        return [f"<custom_token_{i}>" for i in range(self.added + 1)]

    def bounds(self, codebook: Column) -> tuple[Column, Column]:
        """Ids of a codebook: from, and up to but without."""
        low = F.lit(self.base + AUDIO) + codebook * self.size
        return low, low + self.size

    # building

    def from_codes(self, codes: Column, frames: Column | None = None) -> Column:
        """Ids of a codebook-major matrix ``array<array<int>>``, frame by frame; at
        most ``frames`` frames, clamped to what is there."""
        there = F.size(F.get(codes, F.lit(0)))
        n = there if frames is None else F.greatest(F.lit(0), F.least(frames, there))
        one = lambda t: F.transform(codes, lambda row, c: F.lit(self.base + AUDIO) + c * self.size + F.get(row, t))
        return F.flatten(F.transform(upto(n), one)).cast("array<int>")

    def from_frames(self, flat: Column) -> Column:
        """Ids of frame-major codes in one flat array."""
        return F.transform(flat, lambda x, i: (F.lit(self.base + AUDIO) + F.pmod(i, F.lit(self.codebooks)) * self.size + x).cast("int"))

    def _ids(self, *offsets: int) -> Column:
        return F.array(*[F.lit(self.base + o) for o in offsets])

    def speech(self, text: Column, audio: Column) -> Column:
        """A training sequence for speech: header, text, audio, end."""
        return F.concat(self.prompt(text), audio, self._ids(EOS_SPEECH))

    def prompt(self, text: Column) -> Column:
        return F.concat(self._ids(SOH), text, F.array(F.lit(self.eot)), self._ids(EOH, SOA, SOS))

    def clone_prompt(self, reference: Column, text: Column, audio: Column) -> Column:
        """Prompt of the reference's text and the target, then the reference's audio."""
        return F.concat(self.prompt(F.concat(reference, text)), audio)

    def answer(self, question: Column, reply: Column) -> Column:
        """A training sequence for question and answer."""
        return F.concat(self._ids(SOH), question, F.array(F.lit(self.eot)), self._ids(EOH, SOA), reply, F.array(F.lit(self.eot)))

    # reading

    def valid_prefix(self, ids: Column) -> Column:
        """How many leading ids belong to the codebook of their position."""
        def fits(x: Column, i: Column) -> Column:
            book = i.bitwiseAND(self.codebooks - 1) if not self.codebooks & (self.codebooks - 1) else F.pmod(i, F.lit(self.codebooks))
            code = x - (self.base + AUDIO) - book * self.size
            # for a power of two one mask says whether 0 <= code < size
            return code.bitwiseAND(-self.size) == 0 if not self.size & (self.size - 1) else (code >= 0) & (code < self.size)

        ok = F.transform(ids, fits)
        bad = F.array_position(ok, F.lit(False))
        return F.when(bad > 0, bad - 1).otherwise(F.size(ids)).cast("int")

    def to_codes(self, ids: Column) -> Column:
        """Codebook-major codes of the whole frames before the first invalid id; null
        if there is not one."""
        row = lambda c, n: F.transform(upto(n), lambda t: (F.get(ids, t * self.codebooks + c) - self.base - AUDIO - c * self.size).cast("int"))
        return let(F.floor(self.valid_prefix(ids) / self.codebooks).cast("int"), lambda n: F.when(n > 0, F.transform(upto(F.lit(self.codebooks)), lambda c: row(c, n))))

    def completion(self, ids: Column) -> Column:
        """struct(payload, terminated, valid, frames): ids up to the first end of
        speech; valid if that end is there and all before it are whole frames of ids
        in their codebooks, at least one."""
        end = F.array_position(ids, F.lit(self.base + EOS_SPEECH)).cast("int")
        payload = F.when(end > 0, F.slice(ids, 1, F.greatest(end - 1, F.lit(0)))).otherwise(ids)

        def judged(x: Column) -> Column:
            good, n = x["good"], F.size(x["payload"])
            frames = F.floor(good / self.codebooks).cast("int")
            valid = x["terminated"] & (frames > 0) & (good == n) & (F.pmod(n, F.lit(self.codebooks)) == 0)
            return F.struct(x["payload"].alias("payload"), x["terminated"].alias("terminated"), valid.alias("valid"), frames.alias("frames"))

        return let(F.struct(payload.alias("payload"), (end > 0).alias("terminated")), lambda x: let(F.struct(x["payload"].alias("payload"), x["terminated"].alias("terminated"), self.valid_prefix(x["payload"]).alias("good")), judged))

    def reference_audio(self, ids: Column) -> Column:
        """Reference ids without a trailing end of speech; null unless they are whole frames."""
        body = F.when(F.element_at(ids, -1) == self.base + EOS_SPEECH, F.slice(ids, 1, F.size(ids) - 1)).otherwise(ids)
        n = F.size(body)
        return F.when((n > 0) & (self.valid_prefix(body) == n) & (F.pmod(n, F.lit(self.codebooks)) == 0), body)

    def _places(self, ids: Column) -> Column:
        """struct(sos, eot, payload, terminated, good, ordered, headed) of a training sequence:
        places of its markers (from 1, 0 without), length of what follows up to the end
        of speech, whether that end is there, how many ids of it fit their codebooks,
        whether the markers between are right and the first id is. One pass over the flat
        values of a batch; arrays of ids are never made."""
        base, eot, books, size = self.base, self.eot, self.codebooks, self.size

        @F.arrow_udf("struct<sos:int,eot:int,payload:int,terminated:boolean,good:int,ordered:boolean,headed:boolean>")
        def run(lists: pa.Array) -> pa.Array:
            n = len(lists)
            offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            v = lists.values.fill_null(-1).to_numpy(zero_copy_only=False)
            start, end = offsets[:-1], offsets[1:]
            first, last = (int(start[0]), int(end[-1])) if n else (0, 0)
            v = v[first:last]
            start, end = start - first, end - first
            row = np.repeat(np.arange(n), end - start)

            def first_of(hits: np.ndarray, missing: np.ndarray) -> np.ndarray:
                """Place of the first hit of each row in the values."""
                out = missing.copy()
                at, where = np.unique(row[hits], return_index=True)
                out[at] = hits[where]
                return out

            sos = first_of(np.flatnonzero(v == base + SOS), end)
            turn = np.flatnonzero(v == eot)
            turn = first_of(turn[turn < sos[row[turn]]], end)
            stop = np.flatnonzero(v == base + EOS_SPEECH)
            stop = first_of(stop[stop > sos[row[stop]]], end)
            at = np.arange(v.size)
            k = at - sos[row] - 1
            code = v - (base + AUDIO) - np.maximum(k, 0) % books * size
            bad = np.flatnonzero((k >= 0) & (at < stop[row]) & ((code < 0) | (code >= size)))
            begin = np.minimum(sos + 1, end)
            good = first_of(bad, np.maximum(stop, begin)) - begin
            ordered = (sos < end) & (turn < end) & (sos == turn + 3)
            look = np.flatnonzero(ordered)
            ordered[look] = (v[turn[look] + 1] == base + EOH) & (v[turn[look] + 2] == base + SOA)
            headed = end > start
            headed[headed] = v[start[headed]] == base + SOH
            place = lambda x: np.where(x < end, x - start + 1, 0).astype(np.int32)
            columns = (place(sos), place(turn), (stop - begin).clip(0).astype(np.int32), stop < end, good.astype(np.int32), ordered, headed)
            return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["sos", "eot", "payload", "terminated", "good", "ordered", "headed"])

        return run(F.coalesce(ids, F.array().cast("array<int>")))

    def parts(self, ids: Column, frame_rate: float = 12.5, places: bool = False) -> Column:
        """struct(prompt, text_ids, audio_ids, seconds, error) of a training sequence;
        error names the first rule that it breaks, the others are null then. With
        ``places`` the lengths prompt_len, text_len and audio_len take the place of the arrays."""

        def told(x: Column) -> Column:
            frames = F.floor(x["good"] / self.codebooks)
            valid = x["terminated"] & (frames > 0) & (x["good"] == x["payload"]) & (F.pmod(x["payload"], F.lit(self.codebooks)) == 0)
            error = (
                F.when(ids.isNull() | (F.size(ids) < 1), "empty")
                .when((x["sos"] < 1) | (x["eot"] < 1), "markers")
                .when(~x["headed"], "start")
                .when(~x["ordered"], "order")
                .when(~valid, "audio")
            )
            keep = lambda c: F.when(error.isNull(), c)
            if places:
                made = [keep(x["sos"]).alias("prompt_len"), keep(x["eot"] - 2).alias("text_len"), keep(x["payload"]).alias("audio_len")]
            else:
                made = [
                    keep(F.slice(ids, 1, F.greatest(x["sos"], F.lit(0)))).alias("prompt"),
                    keep(F.slice(ids, 2, F.greatest(x["eot"] - 2, F.lit(0)))).alias("text_ids"),
                    keep(F.slice(ids, F.greatest(x["sos"] + 1, F.lit(1)), x["payload"])).alias("audio_ids"),
                ]
            return F.struct(*made, keep(frames / F.lit(float(frame_rate))).alias("seconds"), error.alias("error"))

        return let(self._places(ids), told)

    def legal(self, position: Column, least: Column, most: Column) -> Column:
        """struct(low, high, may_end, must_end) for the id at a position after the
        prompt: the range of its codebook, and whether speech may or must end there
        (at a frame boundary from ``least`` frames on; at ``most`` frames)."""
        low, high = self.bounds(F.pmod(position, F.lit(self.codebooks)))
        frame = F.floor(position / self.codebooks)
        edge = F.pmod(position, F.lit(self.codebooks)) == 0
        return F.struct(low.alias("low"), high.alias("high"), (edge & (frame >= least)).alias("may_end"), (edge & (frame >= most)).alias("must_end"))


def restricted_log_probabilities(scores: Column, low: Column, high: Column, end: Column | None = None) -> Column:
    """Log probabilities of the ids ``low`` to ``high - 1`` of a vocabulary's ``scores``, and
    of ``end`` behind them where it is not null: a softmax over these alone."""
    own = F.slice(scores, low + 1, high - low)
    if end is not None:
        own = F.concat(own, F.when(end.isNotNull(), F.array(F.get(scores, end))).otherwise(F.slice(scores, 1, 0)))

    def normal(x: Column) -> Column:
        def less(top: Column) -> Column:
            return let(top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))), lambda total: F.transform(x, lambda v: v - total))

        return let(F.array_max(x), less)

    return let(F.transform(own, lambda v: v.cast("double")), normal)


def entropy(log_probabilities: Column) -> Column:
    """In nats, of log probabilities that sum to one."""
    return -F.aggregate(log_probabilities, F.lit(0.0), lambda a, v: a + F.when(v > float("-inf"), v * F.exp(v)).otherwise(0.0))


def code_points(text: Column) -> Column:
    """The code-point tokenizer: a stand-in for a vocabulary (null for null)."""
    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c))).otherwise(F.when(text.isNotNull(), F.array().cast("array<int>")))


def text_of_code_points(ids: Column) -> Column:
    return F.concat_ws("", F.transform(ids, lambda i: F.decode(F.unhex(F.lpad(F.hex(i), 8, "0")), "UTF-32")))


def frame_count(samples: Column, rate: int = 24000, frames_a_second: float = 12.5) -> Column:
    return F.ceil(samples / F.lit(rate / frames_a_second)).cast("int")


def frame_limits(least_seconds: Column, most_seconds: Column, frames_a_second: float = 12.5) -> Column:
    return F.struct(F.greatest(F.lit(1), F.ceil(least_seconds * frames_a_second)).cast("int").alias("least"), F.ceil(most_seconds * frames_a_second).cast("int").alias("most"))


def equal_prefix(a: Column, b: Column) -> Column:
    """How many leading ids two sequences share."""
    n = F.least(F.size(a), F.size(b))
    differs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x != y)
    at = F.array_position(differs, F.lit(True))
    return F.when(at > 0, at - 1).otherwise(n).cast("int")


def padded(ids: Column, length: Column, value: int, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)
