"""Scalar functions over texts: native expressions, with Arrow functions only where
Unicode normalisation or word-level edit distance has no built-in."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.forms import NAMES, folded, squeezed

#: The markup of controls.
CONTROL_TAG, EVENT_TAG = r"(?i)<nar_control\b[^>]*>", r"(?i)<nar_event\b[^>]*>"
_CONTROL, _EVENT = re.compile(CONTROL_TAG), re.compile(EVENT_TAG)


def per_row(f: Callable, returns: str) -> Callable[..., Column]:
    """An Arrow-batched function of one or more columns, called once a row."""

    def call(*cols: Column) -> Column:
        @F.pandas_udf(returns)
        def batch(*xs: pd.Series) -> pd.Series:
            return pd.Series([f(*v) for v in zip(*xs)], dtype=object)

        return batch(*cols)

    return call


def strip_markup(c: Column) -> Column:
    """Control tags out, white space collapsed; HTML entities are left to
    :func:`strip_markup_exact`."""
    return squeezed(F.regexp_replace(F.regexp_replace(c, CONTROL_TAG, " "), EVENT_TAG, " "))


def plain_text(t: str | None) -> str | None:
    if t is None:
        return None
    return html.unescape(" ".join(_EVENT.sub(" ", _CONTROL.sub(" ", t)).split()))


def strip_markup_exact(c: Column) -> Column:
    """:func:`strip_markup` and HTML entities decoded; Python only for texts with &."""
    return F.when(c.contains("&"), per_row(plain_text, "string")(c)).otherwise(strip_markup(c))


def transcript_form(t: str | None, characters: bool = False) -> str | None:
    """Text as compared in error rates: compatibility form, markup out, case folded,
    punctuation, symbols and separators blank; with ``characters`` no blank at all."""
    if t is None:
        return None
    t = plain_text(unicodedata.normalize("NFKC", t)).casefold()
    parts = "".join(" " if unicodedata.category(c)[0] in "PSZ" else c for c in t).split()
    return ("" if characters else " ").join(parts)


def transcript(c: Column, characters: bool = False) -> Column:
    """:func:`transcript_form`; plain ASCII text never leaves the JVM."""
    exact = per_row(lambda t: transcript_form(t, characters), "string")(c)
    native = squeezed(F.regexp_replace(F.lower(strip_markup(c)), r"[\p{P}\p{S}\p{Z}]", " "))
    native = F.regexp_replace(native, r"\s+", "") if characters else native
    return F.when(c.rlike(r"^[\x00-\x7F&&[^&]]*$"), native).otherwise(exact)


def _rate(distance: Column, reference: Column, hypothesis: Column) -> Column:
    return F.when(reference > 0, distance / reference).otherwise(F.when(hypothesis > 0, 1.0).otherwise(0.0))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length, on :func:`transcript` forms; may
    exceed 1. An empty reference gives 0 with an empty hypothesis, else 1."""
    a, b = transcript(reference, True), transcript(hypothesis, True)
    return _rate(F.levenshtein(a, b).cast("double"), F.length(a), F.length(b))


def word_distance(a: list[str], b: list[str]) -> int:
    """Edit distance of sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def spelled(a: str | None, b: str | None) -> tuple[str, str, int, int, int | None]:
    """Words of two transcripts as single characters of a dictionary of their own, their
    numbers, and the distance itself where there are more words than private characters."""
    x, y = (transcript_form(a) or "").split(), (transcript_form(b) or "").split()
    known: dict[str, int] = {}
    for w in (*x, *y):
        known.setdefault(w, len(known))
    if len(known) > 6400 + 131_000:
        return "", "", len(x), len(y), word_distance(x, y)
    sign = lambda w: chr(0xE000 + known[w] if known[w] < 6400 else 0xF0000 + known[w] - 6400)
    return "".join(map(sign, x)), "".join(map(sign, y)), len(x), len(y), None


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """As :func:`character_error_rate`, by words: each word becomes one character, so
    that the quadratic part is the JVM's edit distance of strings."""

    @F.pandas_udf("struct<a:string,b:string,na:int,nb:int,far:int>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([spelled(x, y) for x, y in zip(xs, ys)], columns=["a", "b", "na", "nb", "far"])
        return out.astype({"far": "Int32"})

    r = run(reference, hypothesis)
    return _rate(F.coalesce(r["far"], F.levenshtein(r["a"], r["b"])).cast("double"), r["na"], r["nb"])


def split_words(c: Column) -> Column:
    """How many runs of non-white-space a text has."""
    return F.when(F.length(squeezed(c)) > 0, F.size(F.split(squeezed(c), " "))).otherwise(0)


def word_runs(c: Column) -> Column:
    """How many runs of letters, digits and underscores a text has."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(r"(?U)(\w+)"))), F.lit(0))


def duplicate_key(c: Column) -> Column:
    """Case folded and white space collapsed."""
    return squeezed(folded(c))


def spoken_units(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\s+", ""))


def target_duration(explicit: Column, text: Column, reference: Column, reference_seconds: Column) -> Column:
    """Seconds that a text should take: the given ones if positive, else those of the
    reference times the ratio of non-blank characters; null if unknown."""
    a, b = spoken_units(text), spoken_units(reference)
    guess = F.when((reference_seconds > 0) & (a > 0) & (b > 0), reference_seconds * a / b)
    return F.when(explicit > 0, explicit.cast("double")).otherwise(guess)


def reward_duration(explicit: Column, text: Column, reference: Column, reference_ids: Column, codebooks: int = 32, frame_rate: float = 12.5) -> Column:
    """As :func:`target_duration`, by characters of :func:`transcript` forms and the
    reference's audio ids; -1 if unknown."""
    seconds = F.size(reference_ids) / F.lit(float(codebooks)) / F.lit(float(frame_rate))
    a, b = F.length(transcript(text, True)), F.length(transcript(reference, True))
    able = (F.size(reference_ids) > 0) & (F.length(reference) > 0) & (a > 0) & (b > 0)
    return F.when(explicit > 0, explicit.cast("double")).otherwise(F.coalesce(F.when(able, seconds * a / b), F.lit(-1.0)))


def metric_name(language: Column) -> Column:
    return F.when(F.lower(F.coalesce(language, F.lit(""))).startswith("en"), "wer").otherwise("cer")


def language_name(c: Column, strict: bool = False) -> Column:
    """English name of a language label (code, code with region, or name); null, or
    with ``strict`` an error, for one that is not known."""
    from voxloom.functions.forms import LANGUAGES, language_code

    table = F.create_map(*[F.lit(x) for k, v in LANGUAGES.items() for x in (k, v.capitalize())])
    name = F.try_element_at(table, language_code(c))
    return F.coalesce(name, F.raise_error(F.concat(F.lit("unknown language: "), F.coalesce(c, F.lit("null"))))) if strict else name


def mapped_label(c: Column, table: dict[str, str]) -> Column:
    """``table`` by lower-case label; a label that is not in it stands for itself."""
    if not table:
        return c
    lookup = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(lookup, F.lower(c)), c)


def safe_path(key: Column) -> Column:
    """A relative path without backslashes and empty or ``.`` steps; an error if it is
    absolute or climbs up."""
    steps = F.filter(F.split(F.regexp_replace(key, r"\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    bad = key.startswith("/") | F.exists(steps, lambda s: s == "..") | (F.size(steps) == 0)
    return F.when(bad, F.raise_error(F.concat(F.lit("unsafe path: "), key)).cast("string")).otherwise(F.array_join(steps, "/"))


def stable_path(key: Column, root: str = "data", prefix: int = 2, basename: Column | None = None) -> Column:
    """``root/<prefix hex>/<sha256>-<name>``: spreads outputs over folders and stays the
    same from run to run; the name is cleaned and cut to its last 120 characters."""
    if not 0 <= prefix <= 64:
        raise ValueError("the prefix has 0 to 64 characters")
    path = safe_path(key)
    digest = F.sha2(path, 256)
    name = F.element_at(F.split(path, "/"), -1) if basename is None else basename
    name = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")
    name = F.right(F.when(F.length(name) > 0, name).otherwise(F.lit("shard.parquet")), F.lit(120))
    folder = [F.substring(digest, 1, prefix)] if prefix else []
    return F.concat_ws("/", F.lit(root), *folder, F.concat_ws("-", digest, name))


def known_languages() -> dict[str, str]:
    return dict(NAMES)


def content_digest(c: Column) -> Column:
    """BLAKE2b of 160 bits of bytes, in hex; null for null."""
    import hashlib

    @F.pandas_udf("string")
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else hashlib.blake2b(bytes(x), digest_size=20).hexdigest() for x in xs])

    return run(c)
