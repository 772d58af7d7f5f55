"""Evaluation texts that leak into training text.

Texts are made bare; a window of 48 five-character shingles gets a 64-bit SimHash.
Windows of evaluation items are taken at every position, those of documents at every
sixth, so that each common passage of ``RUN`` characters holds a window of a document
that is, character for character, a window of the item. Fingerprints are looked up by
blocks of their bits: two that differ in at most ``radius`` bits agree in one of
``radius + 1`` blocks, so none within the radius is missed. Near windows often differ
in more bits; they are found by their rarest shingles, again without a miss. Weighted
shingle similarity verifies candidates, then the common run is measured exactly.

Windows have the size of the shortest passage to be reported, not of a whole item:
an item may leak in part. The items are the query set. As long as they fit one block of a
bounded number of characters, each task holds them and documents are read once, without
a shuffle. Of more items exact leaks are found by joins: windows of documents and items
are written with their fingerprints, equal fingerprints collapsed to classes, the classes
joined by the blocks of their bits, and the survivors verified text by text.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.plans.scale import free, skew_join, written

RUN = 60
_STEP, _BLOCKS, _GRAM = 6, 8, 5
_GRAMS = _STEP * _BLOCKS
WINDOW = _GRAMS + _GRAM - 1  # 52 characters: with a step of 6 at most 57 are needed
#: Characters of items that a task holds at once; of more, exact leaks are found by joins, and
#: near ones in as many passes as there are blocks.
BLOCK_CHARS = 4_000_000
#: Ends within its text: texts are joined by 0.
_TAG = re.compile(r"<nar_(?:control|event)\b[^>\0]*>", re.IGNORECASE)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def kept_characters() -> np.ndarray:
    """Whether a code point stays in bare text; 0, the separator of texts, does."""
    keep = np.fromiter((unicodedata.category(chr(c))[0] in "LM" or unicodedata.category(chr(c)) == "Nd" for c in range(0x110000)), dtype=bool, count=0x110000)
    keep[0] = True
    return keep


def bare_codes(texts: list[str | None], keep: np.ndarray) -> np.ndarray:
    """Code points of all texts made bare, each text followed by 0."""
    joined = "\0".join("" if t is None else t.replace("\0", " ") if "\0" in t else t for t in texts) + "\0"
    if "<nar_" in joined.lower() if "<" in joined else False:
        joined = _TAG.sub("", joined)
    joined = joined.replace("İ", "i").replace("ı", "i").casefold()
    if "̇" in joined:
        joined = joined.replace("i̇", "i")
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes[keep[codes]]


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each shingle of five characters."""
    n = max(0, len(codes) - _GRAM + 1)
    wide = codes.astype(np.uint64)
    h = wide[:n] * _ODD[0]
    for i in range(1, _GRAM):
        h += wide[i : n + i] * _ODD[i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _plus(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two counters whose binary digits are planes of 64 lanes."""
    out, carry = [], None
    for x, y in zip(a, b):
        half = x ^ y
        if carry is None:
            out.append(half)
            carry = x & y
        else:
            out.append(half ^ carry)
            carry = (x & y) | (half & carry)
    return [*out, carry]


def simhashes(grams: np.ndarray) -> np.ndarray:
    """SimHash of the windows that begin at every sixth shingle: a bit is set if at
    least half of the window's 48 shingles have it. All 64 counters of a window are
    added at once, digit by digit."""
    n = len(grams) // _STEP
    if n < _BLOCKS:
        return np.zeros(0, dtype=np.uint64)
    six = np.ascontiguousarray(grams[: n * _STEP].reshape(n, _STEP).T)

    def three(x, y, z):  # a full adder: three one-digit numbers
        half = x ^ y
        return [half ^ z, (x & y) | (half & z)]

    count = _plus(three(six[0], six[1], six[2]), three(six[3], six[4], six[5]))  # 3 digits a block
    for far in (1, 2, 4):
        count = _plus([p[:-far] for p in count], [p[far:] for p in count])
    # 6 digits: at least 24 of 48
    return count[5] | (count[4] & count[3])


class ItemIndex:
    """Windows of the items at all positions, by blocks of their fingerprints' bits."""

    def __init__(self, ids: list[int], texts: list[str | None], keep: np.ndarray, radius: int = 1) -> None:
        self.radius, self.codes = radius, bare_codes(texts, keep)
        ends = np.flatnonzero(self.codes == 0)
        self.owners = np.asarray(ids, dtype=np.int64)
        grams = gram_hashes(self.codes)
        self.grams = grams
        prints, places = [], []
        for phase in range(_STEP):
            h = simhashes(grams[phase:])
            prints.append(h)
            places.append(phase + _STEP * np.arange(len(h), dtype=np.int64))
        prints, places = np.concatenate(prints), np.concatenate(places)
        owner = np.searchsorted(ends, places)
        whole = (owner < len(ends)) & (places + WINDOW <= ends[np.minimum(owner, len(ends) - 1)]) if len(ends) else np.zeros(len(places), dtype=bool)
        self.prints, self.places, self.owner = prints[whole], places[whole], owner[whole]
        width = 64 // (radius + 1)
        self.blocks = []
        for b in range(radius + 1):
            shift, bits = np.uint64(b * width), width if b < radius else 64 - b * width
            mask = np.uint64((1 << bits) - 1)
            key = (self.prints >> shift) & mask
            order = np.argsort(key, kind="stable")
            small = min(22, bits)
            seen = np.zeros(1 << small, dtype=bool)
            seen[(key & np.uint64((1 << small) - 1)).astype(np.int64)] = True
            self.blocks.append((shift, mask, key[order], order, np.uint64((1 << small) - 1), seen))
        found, back, times = np.unique(grams, return_inverse=True, return_counts=True)
        self.known, self.weights = found, 1.0 / times
        #: Each shingle's number in ``known``, where each number occurs, and a table of the shingles' low bits.
        self.numbers, self.times = back.astype(np.int32), times
        self.at, self.first = np.argsort(back, kind="stable"), np.concatenate(([0], np.cumsum(times)))
        self.window_at = np.full(len(grams) + 1, -1, dtype=np.int64)
        self.window_at[self.places] = np.arange(len(self.places))
        self.low = np.zeros(1 << 22, dtype=bool)
        self.low[(found & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window): all pairs whose fingerprints are within the radius."""
        left, right = [], []
        for shift, mask, keys, order, low, seen in self.blocks:
            key = (prints >> shift) & mask
            at = np.flatnonzero(seen[(key & low).astype(np.int64)])
            a = np.searchsorted(keys, key[at], "left")
            n = np.searchsorted(keys, key[at], "right") - a
            w = np.repeat(at, n)
            i = order[np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if n.sum() else np.zeros(0, dtype=np.int64)
            near = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
            left.append(w[near])
            right.append(i[near])
        w, i = np.concatenate(left), np.concatenate(right)
        pair = np.unique(w.astype(np.int64) * max(1, len(self.prints)) + i)
        return pair // max(1, len(self.prints)), pair % max(1, len(self.prints))

    def number(self, grams: np.ndarray) -> np.ndarray:
        """Numbers of shingles in ``known``, -1 for those that no item holds."""
        out = np.full(len(grams), -1, dtype=np.int32)
        at = np.flatnonzero(self.low[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)
        same = self.known[i] == grams[at]
        out[at[same]] = i[same]
        return out

    def near(self, grams: np.ndarray, least: float, skip) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item window) in portions: at least all pairs of a weighted shingle
        similarity of ``least``, whatever their fingerprints. ``skip`` tells of arrays
        (window, item) which pairs need no look.

        A window of weight W shares at least ``least * W`` with such an item window, so
        it lacks less than the rest, and of any of its shingles that weigh more than the
        rest the item window holds one: the rarest are looked up."""
        n = len(grams) // _STEP
        if n < _BLOCKS or not len(self.prints):
            return
        grams = grams[: n * _STEP]
        number = self.number(grams)
        weight = np.where(number >= 0, self.weights[number], 1.0)
        again = np.zeros(len(grams), dtype=bool)  # a shingle met twice in a window weighs once
        for k in range(1, _GRAMS):
            again[k:] |= grams[k:] == grams[:-k]

        def windows(x):
            s = np.concatenate(([0], np.cumsum(x.reshape(n, _STEP).sum(1))))
            return s[_BLOCKS:] - s[:-_BLOCKS]

        known = windows(np.where(number >= 0, weight, 0.0))
        look = np.flatnonzero((known > 0) & ((windows(again) > 0) | (known >= least * windows(weight) - 1e-6)))
        for s in range(0, len(look), 50_000):
            w = look[s : s + 50_000]
            at = w[:, None] * _STEP + np.arange(_GRAMS)
            order = np.argsort(grams[at], axis=1)
            h = np.take_along_axis(grams[at], order, 1)
            num, own = np.take_along_axis(number[at], order, 1), np.take_along_axis(weight[at], order, 1)
            own[:, 1:][h[:, 1:] == h[:, :-1]] = 0.0
            num[own == 0] = -1
            total = own.sum(1)
            ok = np.where(num >= 0, own, 0.0).sum(1) >= least * total - 1e-9
            w, num, own, total = w[ok], num[ok], own[ok], total[ok]
            # heaviest first, those that no item holds before all others
            order = np.argsort(np.where(num < 0, -2.0, -own), axis=1, kind="stable")
            num, own = np.take_along_axis(num, order, 1), np.take_along_axis(own, order, 1)
            before = np.cumsum(own, axis=1) - own
            row, col = np.nonzero((num >= 0) & (before <= (1 - least) * total[:, None] + 1e-9))
            pick = num[row, col]
            times = self.times[pick]
            bounds = np.concatenate(([0], np.cumsum(times)))
            a = 0
            while a < len(row):  # about 20,000 places of items at once
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + 20_000, "right")) - 1)
                k = np.repeat(np.arange(a, b), times[a:b])
                place = self.at[self.first[pick[k]] + np.arange(len(k)) - (bounds[k] - bounds[a])]
                r, a = row[k], b
                keep = ~skip(w[r], place)
                r, place = r[keep], place[keep]
                span = place[:, None] + np.arange(1 - _GRAMS, _GRAMS)
                inside = (span >= 0) & (span < len(self.numbers))
                span = np.clip(span, 0, len(self.numbers) - 1)
                theirs = np.where(inside, self.numbers[span], -2)
                held = np.zeros(theirs.shape, dtype=bool)
                for j in range(_GRAMS):
                    held |= theirs == num[r, j][:, None]
                sums = np.concatenate((np.zeros((len(r), 1)), np.cumsum(np.where(held, self.weights[np.maximum(theirs, 0)], 0.0), axis=1)), axis=1)
                x, q = np.nonzero(sums[:, _GRAMS:] - sums[:, :-_GRAMS] >= least * total[r][:, None] - 1e-9)
                start = place[x] + 1 - _GRAMS + q
                i = np.where(start >= 0, self.window_at[np.maximum(start, 0)], -1)
                x, i = x[i >= 0], i[i >= 0]
                pair = np.unique(w[r[x]].astype(np.int64) * len(self.prints) + i)
                yield pair // len(self.prints), pair % len(self.prints)

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of rows of shingle hashes; a shingle weighs
        less the more often the items hold it."""

        def once(x):
            x = np.sort(x, axis=1)
            fresh = np.ones(x.shape, dtype=bool)
            fresh[:, 1:] = x[:, 1:] != x[:, :-1]
            return x, fresh

        def weight(x):
            i = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
            return np.where(self.known[i] == x, self.weights[i], 1.0)

        (a, fa), (b, fb) = once(a), once(b)
        own = (weight(a) * fa).sum(1) + (weight(b) * fb).sum(1)
        both = np.concatenate([a, b], axis=1)
        fresh = np.concatenate([fa, fb], axis=1)
        both = np.where(fresh, both, np.uint64(0))
        both.sort(axis=1)
        twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != 0)
        shared = (weight(both[:, 1:]) * twice).sum(1)
        return shared / np.maximum(own - shared, 1e-12)

    def leaks(self, codes: np.ndarray, run: int = RUN, least: float = 0.8, near: bool = True) -> Iterator[tuple[int, int, bool, float]]:
        """(text, item, exact, similarity) for texts of ``codes`` (each ended by 0):
        exact if ``run`` characters in a row are common, else near; without ``near``
        only windows whose fingerprints are within the radius are looked at."""
        ends = np.flatnonzero(codes == 0)
        chunk, edge = 3_000_000 // _STEP * _STEP, WINDOW + _STEP
        best: dict[tuple[int, int], tuple[bool, float]] = {}
        more = run - WINDOW
        item_ends = np.flatnonzero(self.codes == 0)
        for c in range(0, len(codes), chunk):
            part = codes[c : c + chunk + edge]
            grams = gram_hashes(part)
            sure = set()

            def skip(w, place):
                if not sure:
                    return np.zeros(len(w), dtype=bool)
                pair = np.searchsorted(ends, c + w * _STEP) * (len(self.owners) + 1) + np.searchsorted(item_ends, place)
                return np.isin(pair, np.fromiter(sure, dtype=np.int64, count=len(sure)))

            # equal windows first: pairs that hold one need no search for near ones
            for w, i in itertools.chain([self.candidates(simhashes(grams))], self.near(grams, least, skip) if near else ()):
                if not len(w):
                    continue
                p, q = c + w * _STEP, self.places[i]
                text, ok = np.searchsorted(ends, p), np.ones(len(p), dtype=bool)
                ok &= p + WINDOW <= ends[text]
                p, q, i, text = p[ok], q[ok], i[ok], text[ok]
                for s in range(0, len(p), 100_000):
                    pp, qq, ii, tt = (x[s : s + 100_000] for x in (p, q, i, text))
                    span = np.arange(_GRAMS)
                    sim = self.similarity(grams[(pp - c)[:, None] + span], self.grams[qq[:, None] + span])
                    good = sim >= least
                    pp, qq, ii, tt, sim = pp[good], qq[good], ii[good], tt[good], sim[good]
                    same = (codes[pp[:, None] + np.arange(WINDOW)] == self.codes[qq[:, None] + np.arange(WINDOW)]).all(1)
                    reach = np.arange(1, more + 1)
                    before_a, before_b = pp[:, None] - reach, qq[:, None] - reach
                    x, y = codes[np.maximum(before_a, 0)], self.codes[np.maximum(before_b, 0)]
                    back = ((x == y) & (x != 0) & (before_a >= 0) & (before_b >= 0)).cumprod(1).sum(1)
                    after_a = np.minimum(pp[:, None] + WINDOW - 1 + reach, len(codes) - 1)
                    after_b = np.minimum(qq[:, None] + WINDOW - 1 + reach, len(self.codes) - 1)
                    x, y = codes[after_a], self.codes[after_b]
                    ahead = ((x == y) & (x != 0)).cumprod(1).sum(1)
                    exact = same & (back + ahead >= more)
                    for t, o, e, v in zip(tt.tolist(), self.owner[ii].tolist(), exact.tolist(), sim.tolist()):
                        old = best.get((t, o), (False, 0.0))
                        best[t, o] = (old[0] or e, max(old[1], v))
                sure = {t * (len(self.owners) + 1) + o for (t, o), (e, v) in best.items() if v >= 1 - 1e-12}
        for (t, o), (e, v) in best.items():
            yield t, int(self.owners[o]), e, v


def _bit_blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``radius + 1`` blocks of 64 bits: fingerprints within the radius agree in one."""
    width = 64 // (radius + 1)
    return [(b * width, width if b < radius else 64 - b * width) for b in range(radius + 1)]


def fingerprints(texts: DataFrame, key: str, step: int = _STEP) -> DataFrame:
    """(key, print): fingerprints of the windows of each text at every ``step``-th place (a
    divisor of six), each once a batch. Null and short texts have none."""
    bits = np.packbits(kept_characters())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(bits, count=0x110000).astype(bool)
        for x in batches:
            ids, codes = x.column(0).to_numpy(zero_copy_only=False), bare_codes(x.column(1).to_pylist(), keep)
            ends = np.flatnonzero(codes == 0)
            grams, out = gram_hashes(codes), []
            for phase in range(0, _STEP, step):
                h = simhashes(grams[phase:])
                at = phase + _STEP * np.arange(len(h), dtype=np.int64)
                text = np.searchsorted(ends, at)
                whole = at + WINDOW <= ends[np.minimum(text, len(ends) - 1)]
                out.append(np.stack([text[whole].astype(np.int64), h[whole].view(np.int64)], axis=1))
            made = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[made[:, 0]], pa.int64()), pa.array(made[:, 1], pa.int64())], [key, "print"])

    return texts.select(F.col(key).cast("long").alias(key), "text").filter("text is not null").mapInArrow(run, f"{key} long, print long")


def near_classes(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """(left, right): all pairs of different fingerprints (one column each, each value
    once) within ``radius`` bits, by an equi-join for each block of bits."""
    blocks = F.array(*[F.struct(F.lit(b).alias("b"), F.shiftrightunsigned("print", at).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1)).alias("k")) for b, (at, bits) in enumerate(_bit_blocks(radius))])
    keyed = lambda d, name: d.select(F.col("print").alias(name), F.explode(blocks).alias("x")).select(name, "x.*")
    pairs = skew_join(written(keyed(left, "left"), "left_blocks"), written(keyed(right, "right"), "right_blocks"), ["b", "k"], "left", "inner")
    return pairs.filter(F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= radius).select("left", "right").distinct()


def common_run(a: str, b: str, run: int = RUN) -> bool:
    """Whether two bare texts have ``run`` characters in a row in common: each such run
    holds a piece of half its length that begins at a multiple of that half in ``b``."""
    half = run // 2
    for p in range(0, len(b) - half + 1, half):
        seed, at = b[p : p + half], a.find(b[p : p + half])
        while at >= 0:
            back = ahead = 0
            while back < run - half and at > back and p > back and a[at - back - 1] == b[p - back - 1]:
                back += 1
            while back + half + ahead < run and at + half + ahead < len(a) and p + half + ahead < len(b) and a[at + half + ahead] == b[p + half + ahead]:
                ahead += 1
            if back + half + ahead >= run:
                return True
            at = a.find(seed, at + 1)
    return False


def exact_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, radius: int = 1) -> DataFrame:
    """(doc_id, item_id) of exact leaks, for suites of any size: documents are read for
    their fingerprints and once more for the survivors, whatever the number of items."""
    held = written(fingerprints(documents, "doc_id"), "document_prints")
    asked = written(fingerprints(items, "item_id", 1), "item_prints")
    classes = written(near_classes(held.select("print").distinct(), asked.select("print").distinct(), radius), "classes")
    sources = skew_join(held, classes.select(F.col("left").alias("print"), "right"), ["print"], "doc_id", "inner").select("doc_id", F.col("right").alias("print")).distinct()
    pairs = skew_join(written(sources, "sources"), asked, ["print"], "doc_id", "inner").select("doc_id", "item_id").distinct()
    pairs = written(pairs, "pairs")
    free(held, asked, classes)
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("_item")).filter("_item is not null")
    texts = skew_join(pairs, own, ["item_id"], "doc_id", "inner")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_doc"))
    both = skew_join(written(texts, "asked_texts"), docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), ["doc_id"], "item_id", "inner")
    bits = np.packbits(kept_characters())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(bits, count=0x110000).astype(bool)
        bare = lambda t: bare_codes([t], keep)[:-1].tobytes().decode("utf-32-le", "surrogatepass")
        for x in batches:
            d, i, a, b = (x.column(k).to_pylist() for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((d, pa.int64()), (i, pa.int64()), ([common_run(bare(s), bare(t), run) for s, t in zip(a, b)], pa.bool_()))], ["doc_id", "item_id", "exact"])

    checked = both.select("doc_id", "item_id", "_doc", "_item").mapInArrow(verify, "doc_id long, item_id long, exact boolean")
    return checked.filter("exact").select("doc_id", "item_id").distinct()


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, radius: int = 1, near: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, exact, similarity): documents that hold a passage of an item.

    exact: ``run`` (60 or more) consecutive characters of the bare item occur in the
    bare document; otherwise (only with ``near``) one of the document's windows, at
    every sixth position, has a weighted shingle similarity of 0.8 or more with a
    window of it, whatever the distance of their fingerprints. Items shorter than
    a window when bare, null and empty texts leak nowhere. Repeated items are
    reported by each id, repeated documents too."""
    if run < WINDOW + _STEP - 1:
        raise ValueError(f"a run of less than {WINDOW + _STEP - 1} characters can miss every window")
    spark = documents.sparkSession
    listed = items.select("item_id", "text").filter("item_id is not null and text is not null")
    total = listed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-total // block_chars))
    if passes > 1 and not near:
        return exact_leaks(documents, listed, run, radius).select("*", F.lit(True).alias("exact"), F.lit(1.0).alias("similarity"))
    keep = np.packbits(kept_characters())
    out = None
    for k in range(passes):
        own = listed if passes == 1 else listed.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        block = own.collect()  # about BLOCK_CHARS characters of the query set
        held = spark.sparkContext.broadcast(([r["item_id"] for r in block], [r["text"] for r in block], keep))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, texts, bits = held.value
            mask = np.unpackbits(bits, count=0x110000).astype(bool)
            index = ItemIndex(ids, texts, mask, radius) if ids else None
            for x in batches:
                docs, rows = x.column(0).to_pylist(), []
                if index is not None and len(index.prints):
                    rows = [(docs[t], o, e, v) for t, o, e, v in index.leaks(bare_codes(x.column(1).to_pylist(), mask), run, near=near) if near or e]
                columns = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.float64()))], ["doc_id", "item_id", "exact", "similarity"])

        part = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, "doc_id long, item_id long, exact boolean, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def found(leaked: DataFrame) -> DataFrame:
    """(doc_id, item_id) of exact leaks."""
    return leaked.filter("exact").select("doc_id", "item_id").distinct()
