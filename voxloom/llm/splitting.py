"""Splitting of long texts at natural boundaries.

A text is parsed into a tree: sections by the depth of their headings, markup elements
by their nesting, blocks between empty lines, list items by their indentation; below
them lines, sentences, phrases, words and marks. Sibling subtrees are merged bottom-up
while they fit, siblings of one parent only, and only oversized nodes are opened. Pieces
of a plain stretch of text (lines and below) are merged across its sentences.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 260, 40
#: Abbreviations after which no sentence ends.
ABBREVIATIONS = frozenset("dr prof mr mrs ms st vb vs bzw ca nr usw bijv dhr mevr m mme sr sra srta dra etc e.g i.e z.b d.h т.е т.д г ул av cad no tel".split())
#: Elements and lists nested deeper than this are one level: it bounds the recursion.
DEEPEST = 64

_BLANK = r"\s\p{Z}\x1c-\x1f"
_TAG = regex.compile(r"<[^<>\n]+>")
_ELEMENT = regex.compile(r"<(/?)(\p{L}[\w:.-]*)(?:\s[^<>\n]*)?(?<!/)>")
_HEADING = regex.compile(r"^(#{1,6})[^\S\n]", regex.MULTILINE)
_ITEM = regex.compile(r"^([^\S\n]*)(?:[-*+•–]|\(?\p{N}{1,9}[.)])[^\S\n]", regex.MULTILINE)
_GAP = regex.compile(r"\n[^\S\n]*\n\s*")
_TEXT_LEVELS: tuple[tuple[str, regex.Pattern], ...] = (
    ("line", regex.compile(r"\n(?!\n)")),
    ("sentence", regex.compile(r"(?:[.!?…]+[\p{Pe}\p{Pf}\"'”’]*\s+)|(?:[。！？]+[\p{Pe}\p{Pf}]*)")),
    ("phrase", regex.compile(r"[,;:][\p{Pe}\p{Pf}\"'”’]*\s+|(?<!\s)\s++(?=[—–(«„“])|[—–]\s+|[、，；：]|(?<=\p{L}[.!?])(?=\p{Lu})")),
    ("word", regex.compile(rf"[{_BLANK}]+")),
    ("mark", regex.compile(r"(?<=\p{P})|(?=\p{P})")),
)
#: Rank of the first text level; those of the structure are pairs below it.
_TEXT = 4
_LAST_WORD = regex.compile(r"(\S+?)[.]\s*$")
_JOINED = regex.compile(r"[\p{M}‍]")


def _structure(text: str) -> Iterator[tuple[tuple[int, int], str, int]]:
    """(rank, kind, position) of the cuts between nodes of a text's structure, in order
    within a kind; a lower rank is nearer to the root."""
    for m in _HEADING.finditer(text):
        yield (0, len(m[1])), "heading", m.start()
    if "</" in text:
        stack, held = [], Counter()
        for m in _ELEMENT.finditer(text):
            name = m[2].lower()
            if not m[1]:
                stack.append((name, m.start()))
                held[name] += 1
            elif held[name]:
                while True:  # what was opened in between and never closed is no element
                    own, start = stack.pop()
                    held[own] -= 1
                    if own == name:
                        break
                rank = (1, min(len(stack), DEEPEST))
                yield rank, "element", start
                yield rank, "element", m.end()
    items = {m.start(): len(m[1].expandtabs(4)) for m in _ITEM.finditer(text)}
    gaps = {m.end(): text.rfind("\n", m.start(), m.end()) + 1 for m in _GAP.finditer(text)}
    above: list[int] = []  # indentations of the items around
    for at in sorted({*items, *gaps}):
        if at in gaps:
            line = gaps[at]
            if above and (line in items or at > line):
                continue  # the next item of a list, or a paragraph of this one
            above = []
            yield (2, 0), "block", at
        if at in items:
            while above and above[-1] >= items[at]:
                above.pop()
            above.append(items[at])
            yield (3, min(len(above), DEEPEST)), "item", at


class _Tree:
    """Cuts of a text by rank; those of a text level are found when it is first needed."""

    def __init__(self, text: str, longest_tag: int) -> None:
        self.text = text
        tags = [m.span() for m in _TAG.finditer(text)] if "<" in text else []
        # a tag stays whole unless it is too long itself
        self.starts, self.ends = [a for a, b in tags if b - a <= longest_tag], [b for a, b in tags if b - a <= longest_tag]
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        self.kinds: dict[tuple[int, int], str] = {}
        for rank, kind, at in _structure(text):
            found[rank].add(at)
            self.kinds[rank] = kind
        self.cuts = {rank: sorted(at) for rank, at in found.items()}
        for i, (kind, _) in enumerate(_TEXT_LEVELS):
            self.kinds[_TEXT + i, 0] = kind
        self.ranks = sorted(self.kinds)

    def tag_at(self, at: int) -> int | None:
        """Number of the protected tag that a cut at ``at`` would break."""
        i = bisect_left(self.starts, at) - 1
        return i if i >= 0 and at < self.ends[i] else None

    def _found(self, level: int) -> list[int]:
        kind, pattern = _TEXT_LEVELS[level]
        out = []
        for m in pattern.finditer(self.text):
            at = m.end()
            if kind == "sentence" and m[0].lstrip()[:1] == "." and (w := _LAST_WORD.search(self.text, max(0, m.start() - 20), m.start() + 1)):
                word = w[1].lstrip("(«„“\"'").lower()
                if word in ABBREVIATIONS or len(word) == 1 and word.isalpha():
                    continue
            if self.tag_at(at) is None:
                out.append(at)
        return sorted({*out, *self.starts, *self.ends}) if kind == "mark" else out

    def between(self, rank: tuple[int, int], a: int, b: int) -> list[int]:
        cuts = self.cuts.get(rank)
        if cuts is None:
            cuts = self.cuts[rank] = self._found(rank[0] - _TEXT)
        return cuts[bisect_right(cuts, a) : bisect_left(cuts, b)]


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pieces: they follow on each other and cover the
    text. kind says what ends the piece: one of the levels, ``hard`` (within a run of
    more than ``limit`` characters without white space and punctuation, which had to be
    cut) or ``end``. Tags that fit a piece are whole, and a run that touches one may be
    cut at its edges."""
    return _spans(text, limit, overlap)[0]


@lru_cache
def _long_run(limit: int) -> regex.Pattern:
    """Runs of more than ``limit`` characters without white space and punctuation, looked for
    where a run begins."""
    return regex.compile(rf"(?<![^{_BLANK}\p{{P}}])[^{_BLANK}\p{{P}}]{{{limit + 1},}}+")


def _spans(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, str]], _Tree | None]:
    if not text:
        return [], None
    if len(text) <= limit:
        return [(0, len(text), "end")], None
    body = max(1, limit - overlap)
    tree = _Tree(text, body)
    last = len(tree.ranks)

    def stretch(a: int, b: int) -> list[tuple[int, int, str]]:
        """A run that no level cuts, with the white space after it."""
        core = a + len(text[a:b].rstrip())
        out, s = [], a
        if 0 < core - a <= limit:
            out.append((s, core, "word"))
            s = core
        while core - s > body:
            e = s + body
            while e > s + 1 and (_JOINED.match(text[e]) or text[e - 1] == "‍"):
                e -= 1
            e = e if e > s + 1 or body == 1 else s + body  # nothing but joined characters
            out.append((s, e, "hard"))
            s = e
        if s < core:
            out.append((s, core, "word"))
            s = core
        if out:  # the last piece takes what white space it can
            e = min(b, max(out[-1][0] + body, core))
            out[-1], s = (out[-1][0], e, "word"), e
        out += [(x, min(b, x + body), "word") for x in range(s, b, body)]
        return out

    def opened(a: int, b: int, level: int) -> list[tuple[int, int, str]]:
        if b - a <= body:
            return [(a, b, "")]
        while level < last and not (cuts := tree.between(tree.ranks[level], a, b)):
            level += 1
        if level == last:
            return stretch(a, b)
        kind, plain = tree.kinds[tree.ranks[level]], tree.ranks[level][0] >= _TEXT
        out: list[tuple[int, int, str]] = []
        whole = False  # whether the last piece is made of whole siblings
        for s, e in zip([a, *cuts], [*cuts, b]):
            own = opened(s, e, level + 1)
            alone = len(own) == 1
            if out and (plain or whole and alone) and own[0][1] - out[-1][0] <= body:
                out[-1] = (out[-1][0], *own[0][1:])
                own = own[1:]
            out += own
            out[-1] = (*out[-1][:2], kind)
            whole = alone
        return out

    got = opened(0, len(text), 0)
    got[-1] = (*got[-1][:2], "end")
    runs = [m.span() for m in _long_run(limit).finditer(text)]
    begins = [a for a, _ in runs]

    def named(e: int, kind: str) -> str:
        i = bisect_left(begins, e) - 1
        return "hard" if i >= 0 and e < runs[i][1] else kind

    return [(s, e, named(e, kind)) for s, e, kind in got], tree


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str, str]]:
    """(begin, start, end, kind, text) of the pieces in order: text[start:end] is
    new in a piece, text[begin:start] repeats the end of the one before: at most
    ``overlap`` characters, from the beginning of a word if one begins there, not from
    within a tag, and less where the piece would pass the limit."""
    out = []
    got, tree = _spans(text or "", limit, overlap)
    for s, e, kind in got:
        begin = s
        if s and overlap:
            least = max(0, s - overlap, e - limit)
            starts = (i for i in range(least, s) if not text[i].isspace() and (i == 0 or text[i - 1].isspace()) and tree.tag_at(i) is None)
            begin = next(starts, None)
            if begin is None:
                begin = least if (tag := tree.tag_at(least)) is None else min(s, tree.ends[tag])
                while begin < s and _JOINED.match(text[begin]):
                    begin += 1
        out.append((begin, s, e, kind, text[begin:e]))
    return out


def split(requests: DataFrame, key: str = "request_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(request_id, piece_no, begin, start, end, cut, piece), piece_no from 1.

    A text within the limit is one piece; a null or empty text has none. No piece is
    longer than ``limit`` code points. A run without white space and punctuation is
    cut (cut = ``hard``) if it is longer than the limit; a shorter one only where a
    tag begins or ends. A row is split by itself, so repeated rows and ties change
    nothing; other columns are ignored."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(k, i, *p) for k, t in zip(x["k"], x["t"]) if t for i, p in enumerate(pieces(t, limit, overlap), 1)]
            yield pd.DataFrame(rows, columns=["k", "piece_no", "begin", "start", "end", "cut", "piece"])

    src = requests.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    out = src.mapInPandas(run, f"k {kind}, piece_no int, begin int, start int, end int, cut string, piece string")
    return out.withColumnRenamed("k", key)


def found(split_rows: DataFrame, key: str = "request_id") -> DataFrame:
    """(request_id) of texts with a run that had to be cut."""
    return split_rows.filter("cut = 'hard'").select(key).distinct()
