"""Canonical forms of short strings: bare text, labels and language names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes and English names of languages that labels use.
LANGUAGES = {
    "ar": "arabic", "bg": "bulgarian", "ca": "catalan", "cs": "czech", "da": "danish", "de": "german", "el": "greek",
    "en": "english", "es": "spanish", "et": "estonian", "fa": "persian", "fi": "finnish", "fr": "french", "he": "hebrew",
    "hi": "hindi", "hr": "croatian", "hu": "hungarian", "id": "indonesian", "it": "italian", "ja": "japanese",
    "ko": "korean", "lt": "lithuanian", "lv": "latvian", "nl": "dutch", "no": "norwegian", "pl": "polish",
    "pt": "portuguese", "ro": "romanian", "ru": "russian", "sk": "slovak", "sl": "slovenian", "sv": "swedish",
    "th": "thai", "tr": "turkish", "uk": "ukrainian", "vi": "vietnamese", "zh": "chinese",
}
#: Three-letter codes of the languages that occur in the tables.
LONG_CODES = {
    "eng": "en", "tur": "tr", "deu": "de", "ger": "de", "nld": "nl", "dut": "nl", "fra": "fr", "fre": "fr",
    "spa": "es", "por": "pt", "rus": "ru", "jpn": "ja",
}
NAMES = {name: code for code, name in LANGUAGES.items()} | {code: code for code in LANGUAGES} | LONG_CODES

_NOT_BARE = r"[^\p{L}\p{M}\p{Nd}]+"


#: Characters whose full case folding isn't their lower case (ß, ς and i are done apart).
_FOLDS = {chr(c): chr(c).casefold() for c in range(0x80, 0x110000) if chr(c).casefold() != chr(c).lower() and chr(c) not in "İßẞς"}


def _ranges(chars: list[int]) -> str:
    """A regular-expression class of a few ranges that cover ``chars``: gaps under 16 are
    filled, since a class of hundreds of single characters is slow to match."""
    out: list[list[int]] = []
    for c in sorted(chars):
        if out and c - out[-1][1] < 16:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


_RARE = _ranges([ord(c) for c in _FOLDS])


def folded(c: Column) -> Column:
    """Letter case ignored in full: ß equals ss, ligatures their letters, final sigma
    sigma, and dotted and dotless i are one letter."""
    swap = lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))
    x = swap(swap(swap(swap(c, "İ", "i"), "ı", "i"), "ß", "ss"), "ẞ", "ss")
    table = F.create_map(*[F.lit(v) for pair in _FOLDS.items() for v in pair])
    spelled = F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    x = F.when(x.rlike(_RARE), spelled).otherwise(x)
    return swap(swap(F.lower(x), "ς", "σ"), "i̇", "i")


def bare(c: Column) -> Column:
    """Case folded in full and nothing but letters, digits and combining marks left.

    Null stays null, text without any letter or digit becomes empty."""
    return F.regexp_replace(folded(c), _NOT_BARE, "")


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def squeezed(c: Column) -> Column:
    """Unicode white space at the ends removed, inner runs made one blank."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def label(c: Column, default: str = "neutral") -> Column:
    """Trimmed lower-case label; null or blank is ``default``."""
    return F.coalesce(blank_to_null(F.lower(squeezed(c))), F.lit(default))


def language_code(c: Column) -> Column:
    """Two-letter code that a label names (code, code with region, English name); else null."""
    head = F.regexp_extract(F.lower(squeezed(c)), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    table = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.try_element_at(table, head)


def language_of_label(x: str | None) -> str | None:
    """:func:`language_code` for a Python string."""
    m = re.fullmatch(r"([a-z]+)(?:[-_][a-z0-9]+)*", (x or "").strip().lower())
    return NAMES.get(m[1]) if m else None
