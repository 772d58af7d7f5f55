"""Languages of documents and of the passages in mixed documents.

Character n-gram models, trained here on a bounded sample of labelled rows, give each
sentence-like unit a likelihood in each language. Expectation-maximisation estimates
the proportions of the languages in a document; the set of languages is selected by
penalised likelihood, adding a language only where it gains more than the penalty. A
background model, single letters by script, competes with the same penalty: a passage
that it explains better than any language is in none of them (``und``).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.forms import language_code
from voxloom.plans.scale import mixed

ORDER = 4
#: Labelled rows a language that are used for training, at most, and the longest
#: text used: these bound the sample whatever the size of the table.
ROWS_A_LANGUAGE, LONGEST = 60, 20_000
#: Log likelihood that a further language must gain.
PENALTY = 10.0
#: Log likelihood that cutting a unit in two languages must gain.
CUT = 14.0
#: A unit whose languages differ by less, or of a single word, goes with its neighbours.
WEAK = 4.0
#: Most that a word can tell two languages apart: one that the training sample knows,
#: and one that it doesn't; all that it can where that leaves the languages nearly equal. Capitalised words that it doesn't know are taken for names
#: and tell nothing, nor do katakana.
KNOWN, UNKNOWN = 8.0, 2.0
#: Labelled texts up to this length make a stratum of their own in the training sample.
SHORT = 40
#: A letter that the training sample doesn't hold has, within its script, the probability
#: of one of twice as many as it holds of that script, or of twice this number.
ALPHABET = 50
UNKNOWN_LANGUAGE = "und"

_TAG = re.compile(r"<[^<>\n]+>")
_UNIT = re.compile(r"[^.!?…。！？\n\r()\[\]{}«»“”„‟‹›「」『』\"|—–]+[.!?…。！？]*")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_KATAKANA = re.compile(r"[ァ-ヿㇰ-ㇿ]")
_PIECE = re.compile(r"[ァ-ヿㇰ-ㇿ]+|[぀-ゟ]+|[㐀-鿿豈-﫿々]+|[^\W\d_぀-ヿ㐀-鿿豈-﫿]+")


def _folded(t: str) -> str:
    return t.replace("İ", "i").lower()


def _script(c: str) -> str:
    """Latin, Cyrillic, kana, Han or another block of 256 letters."""
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if _WIDE.match(c):
        return "kana" if 0x3040 <= o < 0x3100 else "han"
    return str(o >> 8)


class Model:
    """Log probability of a character after up to three others, in each language."""

    def __init__(self, languages: list[str], grams: dict[str, int], table: np.ndarray, floor: float, lexicon: frozenset[str], letters: dict[str, float]) -> None:
        self.languages, self.grams, self.table, self.floor, self.lexicon, self.letters = languages, grams, table, floor, lexicon, letters
        self._words: dict[str, int] = {}
        self._rows = np.zeros((1024, len(languages)))
        self._fits = np.zeros((1024, len(languages)))

    @classmethod
    def train(cls, rows: Iterable[tuple[str, str]]) -> Model:
        """Witten-Bell interpolation of n-grams up to ``ORDER``, of (language, text), over
        words that are seen in lower case at least as often as with a capital."""
        texts = [(lang, _TAG.sub(" ", text)) for lang, text in rows]
        low, high, spread = Counter(), Counter(), Counter()
        for _, text in texts:
            words = Counter(_PIECE.findall(text))
            for w, k in words.items():
                (high if w[0].isupper() else low)[_folded(w)] += k
            spread.update({_folded(w) for w in words})
        plain = {w for w, k in low.items() if k >= high[w] and not _KATAKANA.match(w)}
        lexicon = frozenset(w for w in plain if spread[w] >= 2)
        counts: dict[str, list[Counter]] = defaultdict(lambda: [Counter() for _ in range(ORDER + 1)])
        for lang, text in texts:
            c = counts[lang]
            for w, k in Counter(_PIECE.findall(_folded(text))).items():
                if w not in plain:
                    continue
                w = f" {w} "
                for n in range(1, ORDER + 1):
                    for i in range(len(w) - n + 1):
                        c[n][w[i : i + n]] += k
        languages = sorted(counts)
        letters = sorted({g for c in counts.values() for g in c[1]})
        base = 1.0 / (len(letters) + 1000)  # of a character that no text has
        every = [sorted({g for c in counts.values() for g in c[n]}) for n in range(ORDER + 1)]
        grams = {g: i for i, g in enumerate(g for n in range(1, ORDER + 1) for g in every[n])}
        table = np.full((len(grams), len(languages)), math.log(base))
        for j, lang in enumerate(languages):
            c = counts[lang]
            total, kinds = [Counter() for _ in range(ORDER + 1)], [Counter() for _ in range(ORDER + 1)]
            for n in range(1, ORDER + 1):
                for g, k in c[n].items():
                    total[n][g[:-1]] += k
                    kinds[n][g[:-1]] += 1
            p: dict[str, float] = {}
            for n in range(1, ORDER + 1):
                for g in every[n]:
                    h, lower = g[:-1], p.get(g[1:], base) if n > 1 else base
                    t, k = total[n][h], kinds[n][h]
                    p[g] = (c[n][g] + k * lower) / (t + k) if t else lower
            for g, i in grams.items():
                table[i, j] = math.log(p[g])
        single: Counter = Counter()
        for c in counts.values():
            single.update(c[1])
        scripts: Counter = Counter()
        for g, k in single.items():
            scripts[_script(g)] += k
        own = {g: math.log(k / scripts[_script(g)]) if g != " " else math.log(k / single.total()) for g, k in single.items()}
        kinds_ = Counter(_script(g) for g in single)
        own |= {x: -math.log(2 * max(ALPHABET, k)) for x, k in kinds_.items()}  # names of scripts are longer than a letter
        return cls(languages, grams, table.astype(np.float32), math.log(base), lexicon, own)

    def __getstate__(self):
        return self.languages, self.grams, self.table, self.floor, self.lexicon, self.letters

    def __setstate__(self, state):
        self.__init__(*state)

    def _word(self, w: str) -> int:
        padded = f" {w} "
        rows = []
        ground = 0.0  # what the background gives, less what no language knows
        for i in range(1, len(padded)):
            ground += own if (own := self.letters.get(padded[i])) is not None else self.letters.get(_script(padded[i]), -math.log(2 * ALPHABET))
            for n in range(min(ORDER, i + 1), 0, -1):
                if (at := self.grams.get(padded[i + 1 - n : i + 1])) is not None:
                    rows.append(at)
                    break
            else:
                ground -= self.floor
        if len(self._words) >= 200_000:  # memory stays bounded; no result depends on it
            self._words.clear()
        at = self._words[w] = len(self._words)
        if at >= len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
            self._fits = np.concatenate([self._fits, np.zeros_like(self._fits)])
        likely = self.table[rows].sum(0)
        self._rows[at] = likely - likely.max() if rows else 0
        self._fits[at] = likely - ground
        return at

    def _told(self, words: list[str], folded: list[str], cased: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihoods of the words against that of their best language: capped, and
        in full; and against the background."""
        at = [self._words[w] if w in self._words else self._word(w) for w in folded]
        if len(self._words) < len(set(folded)):  # emptied on the way
            at = [self._words[w] if w in self._words else self._word(w) for w in folded]
        most = np.array([KNOWN if f in self.lexicon else UNKNOWN for f in folded])
        full, fits = self._rows[at], self._fits[at]
        rows = np.maximum(full, -most[:, None])
        names = [i for i, (w, f) in enumerate(zip(words, folded)) if f not in self.lexicon and (cased and w[0].isupper() or _KATAKANA.match(w))]
        if names:
            rows[names] = full[names] = fits[names] = 0
        return rows, full, fits

    def units(self, text: str) -> tuple[list[tuple[int, int, int, bool]], np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, letters, single) of the units of a text and their log
        likelihoods: of capped words, in full, against the background. Units are
        sentences, cut where two languages explain the words before and after better
        than one does; single: no more than a word."""
        if "<" in text:
            text = _TAG.sub(lambda m: " " * len(m[0]), text)
        spans, likely, whole, fit = [], [], [], []
        cased = any(map(str.islower, text))
        for m in _UNIT.finditer(text):
            words = list(_PIECE.finditer(m[0]))
            if not words:
                continue
            folded = [_folded(w[0]) for w in words]
            rows, full, fits = self._told([w[0] for w in words], folded, cased)
            marks = [0, *self._switches(rows, 0, len(rows)), len(rows)]
            for a, b in zip(marks, marks[1:]):
                letters = sum(map(len, folded[a:b]))
                wide = any(_WIDE.match(w) for w in folded[a:b])
                start = m.start() + (words[a].start() if a else 0)
                end = m.start() + words[b].start() if b < len(words) else m.end()
                spans.append((start, end, letters, letters < 6 if wide else b - a < 2))
                likely.append(rows[a:b].sum(0))
                whole.append(full[a:b].sum(0))
                fit.append(fits[a:b].sum(0))
        shape = len(likely), len(self.languages)
        return spans, *(np.array(x).reshape(shape) for x in (likely, whole, fit))

    def _switches(self, rows: np.ndarray, a: int, b: int) -> list[int]:
        """Words at which the language of a unit changes: the best cut, if it gains
        more than ``CUT`` and leaves three words on either side, and so on."""
        if b - a < 6:
            return []
        head = rows[a:b].cumsum(0)
        whole = head[-1]
        gain = head[2:-3].max(1) + (whole - head[2:-3]).max(1) - whole.max()
        k = int(gain.argmax())
        if gain[k] <= CUT:
            return []
        at = a + k + 3
        return [*self._switches(rows, a, at), at, *self._switches(rows, at, b)]


def proportions(likely: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation: (proportions, log likelihood, posteriors) of units."""
    top = likely.max(1, keepdims=True)
    rel = np.exp(likely - top)
    pi, before = np.full(likely.shape[1], 1.0 / likely.shape[1]), -np.inf
    for _ in range(steps):
        post = rel * pi
        norm = post.sum(1, keepdims=True)
        post /= norm
        total = float((np.log(norm) + top).sum())
        if total - before < 1e-4:
            break
        before, pi = total, np.maximum(post.mean(0), 1e-9)
    return pi, total, post


def select(likely: np.ndarray, penalty: float = PENALTY) -> list[int]:
    """Languages of a document: greedily the one that raises the penalised
    likelihood of the mixture most, until none does."""
    sums = likely.sum(0)
    chosen = [int(sums.argmax())]
    if len(likely) == 1:
        return chosen
    score = float(sums[chosen[0]])
    while True:
        now = likely[:, chosen].max(1)
        # no mixture gains more than the units' best languages do: skip those that can't pay
        most = np.maximum(likely - now[:, None], 0).sum(0)
        able = [j for j in np.argsort(-most) if j not in chosen and most[j] > penalty]
        tried = [(proportions(likely[:, [*chosen, int(j)]])[1] - penalty * len(chosen), int(j)) for j in able]
        if not tried or max(tried)[0] <= score:
            return chosen
        score, best = max(tried)
        chosen.append(best)


def passages(model: Model, text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the passages of a text, in order.

    Neighbouring passages differ in language and together they cover the text. A text
    without a letter, empty or null has one passage in ``und`` with confidence 0; a
    passage that the background explains better than its language by more than
    ``PENALTY`` is in ``und`` too: in a language that the model doesn't know."""
    if not text or not model.languages:
        return [(0, len(text or ""), UNKNOWN_LANGUAGE, 0.0)]
    spans, likely, full, fit = model.units(text)
    if not spans:
        return [(0, len(text), UNKNOWN_LANGUAGE, 0.0)]
    many = np.array([not x[3] for x in spans])
    chosen = select(likely[many]) if many.any() else [int(likely.sum(0).argmax())]
    if len(chosen) == 1:
        sums = likely.sum(0)
        order = np.sort(sums)
        if len(order) > 1 and order[-1] - order[-2] < WEAK:  # the words may say all they can
            sums = full.sum(0)
            chosen = [int(sums.argmax())]
        own, known = chosen[0], float(fit[:, chosen[0]].sum())
        if known < -PENALTY:
            return [(0, len(text), UNKNOWN_LANGUAGE, _share([known, 0.0], 1))]
        return [(0, len(text), model.languages[own], _share([*(sums - sums[own]), -known - PENALTY], own))]
    pi, _, post = proportions(likely[:, chosen])
    own = likely[:, chosen] + np.log(pi)
    best = own.argmax(1)
    ordered = np.sort(own, axis=1)
    strong = (ordered[:, -1] - ordered[:, -2] >= WEAK) & ~np.array([x[3] for x in spans])
    if not strong.any():
        strong[int((ordered[:, -1] - ordered[:, -2]).argmax())] = True
    # a weak unit goes with the strong neighbour that explains it better, the one before in a tie
    sure = np.flatnonzero(strong)
    for u in np.flatnonzero(~strong):
        around = [best[i] for i in (sure[sure < u][-1:].tolist() + sure[sure > u][:1].tolist())]
        best[u] = max(around, key=lambda k: own[u, k])
    runs: list[list] = []  # start, end, language, probability, letters, fit
    for (a, b, n, _), k, row, f in zip(spans, best, post, fit[:, chosen]):
        if not (runs and runs[-1][2] == k):
            runs.append([a, b, k, 0.0, 0, 0.0])
        runs[-1][1] = b
        for i, x in ((3, n * float(row[k])), (4, n), (5, float(f[k]))):
            runs[-1][i] += x
    out: list[list] = []
    for a, b, k, p, n, f in runs:
        lang, sure_ = (UNKNOWN_LANGUAGE, _share([f, 0.0], 1)) if f < -PENALTY else (model.languages[chosen[k]], p / n)
        if out and out[-1][2] == lang:
            m = out[-1][4]
            out[-1][1:] = [b, lang, (out[-1][3] * m + sure_ * n) / (m + n), m + n]
        else:
            out.append([a, b, lang, sure_, n])
    out[0][0] = 0
    for x, y in zip(out, out[1:]):
        x[1] = y[0]
    out[-1][1] = len(text)
    return [(a, b, lang, p) for a, b, lang, p, _ in out]


def _share(logs: list[float], at: int) -> float:
    """Share of one of several likelihoods in their sum."""
    top = max(logs)
    return math.exp(logs[at] - top) / sum(math.exp(x - top) for x in logs)


def _drawn(src: DataFrame, rows: int) -> list[tuple[str, str]]:
    """About ``rows`` (at most 1.5 times that) labelled texts a language, and as many
    short ones, by a repeatable random place."""
    src = src.filter("l is not null and t is not null").filter(F.length("t") <= LONGEST).withColumn("s", F.length("t") <= SHORT)
    sizes = {(r["l"], r["s"]): r["n"] for r in src.groupBy("l", "s").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows a language
    if not sizes:
        return []
    edge = F.create_map(*[F.lit(x) for (k, s), n in sizes.items() for x in (f"{k} {s}".lower(), int(min(1.0, rows / n) * (1 << 62)))])
    picked = src.filter(F.col("place") < F.try_element_at(edge, F.concat_ws(" ", "l", F.col("s").cast("string"))))
    return sorted((r["l"], r["t"]) for r in picked.select("l", "t").limit(int(1.5 * rows * len(sizes)) + 10).collect())


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS_A_LANGUAGE, noisy: DataFrame | None = None) -> Model:
    """A model from labelled rows: about ``rows`` a language, drawn by a repeatable
    random place; labels that name no language and texts longer than ``LONGEST`` are
    not used for training. Without a labelled row the model knows no language: all
    texts are ``und``.

    noisy: (key, text, lang) with labels of which some are wrong. Those of a sample
    that a first model doesn't contradict are added, so that short utterances are
    known too."""
    pick = lambda d: d.select(F.col(text).alias("t"), language_code(F.col(lang)).alias("l"), mixed(F.col(key), seed=7).alias("place"))
    sample = _drawn(pick(labelled), rows)
    model = Model.train(sample)
    if noisy is None or not sample:
        return model
    named: dict[str, Counter] = defaultdict(Counter)
    for lang_, t in _drawn(pick(noisy), 3 * rows):
        named[t][lang_] += 1
    for t, votes in sorted(named.items()):
        lang_ = max(votes, key=lambda k: (votes[k], k))  # a text labelled in several ways counts for most
        if lang_ not in model.languages:
            continue
        spans, likely, full, _ = model.units(t)
        agreed = votes[lang_] >= 2 and 2 * votes[lang_] > sum(votes.values())
        if len(t) <= SHORT and agreed or len(spans) == 1 and full.max() - full[0, model.languages.index(lang_)] < 6:
            sample += [(lang_, t)] * min(votes[lang_], 5)
    return Model.train(sample)


def segments(rows: DataFrame, model: Model, key: str = "example_id", text: str = "target_text", label: str = "language") -> DataFrame:
    """(example_id, seg_no, lang, confidence, start, end, n_segs, label): one row a
    passage, numbered from 1; ``label`` is the code that the row's own label names,
    null if none. See :func:`passages` for texts without letters. Repeated rows give
    repeated results; other columns are ignored."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        for x in batches:
            out = []
            for k, t, named in zip(x["k"], x["t"], x["named"]):
                parts = passages(own, t)
                out += [(k, i, lang, conf, a, b, len(parts), named) for i, (a, b, lang, conf) in enumerate(parts, 1)]
            yield pd.DataFrame(out, columns=["k", "seg_no", "lang", "confidence", "start", "end", "n_segs", "label"])

    src = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), language_code(F.col(label)).alias("named"))
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInPandas(run, f"k {kind}, seg_no int, lang string, confidence double, start int, end int, n_segs int, label string").withColumnRenamed("k", key)


def found(segs: DataFrame, key: str = "example_id") -> DataFrame:
    """(example_id, seg_no, lang) of rows with no label, a wrong one, or more than one language."""
    return segs.filter("label is null or n_segs > 1 or label <> lang").select(key, "seg_no", "lang")
