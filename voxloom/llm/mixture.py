"""Mixtures of sources by target weights, laid out as a training curriculum.

Each source has a weight that may change over the course of training. The weights
are integrated to the tokens that a source must have delivered at each time; this
demand is inverted at each document's running total to give its time, and
documents are range-sorted by time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.plans.scale import bits_for, mixed, running, skew_join, written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pattern that splits text before byte-pair merges: fixed, as public byte-level vocabularies are used.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text under the vocabulary file ``path`` (a tiktoken rank file);
    null or empty text has 0. Whole texts are counted, long ones in parts cut where the
    tokenizer splits in any case, so that the count is that of the whole. The driver
    sends the file to all executors."""
    from pyspark import SparkFiles

    sc = SparkSession.active().sparkContext
    name = path.rpartition("/")[2]
    if not any(x.rpartition("/")[2] == name for x in sc.listFiles):
        sc.addFile(path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for x in batches:
            yield pd.Series([0 if not t else sum(len(encode(p)) for p in _parts(t)) for t in x], dtype="int64")

    return count(text)


#: Between a single line end and what follows no token of :data:`SPLIT` reaches.
_BREAK = re.compile(r"(?<=\S)\n(?=[^\s'])")


def _parts(t: str, at: int = 200_000) -> Iterator[str]:
    """A text in parts of about ``at`` characters, cut only where no token goes across;
    one without such a place is one part."""
    start = 0
    while len(t) - start > at and (m := _BREAK.search(t, start + at)):
        yield t[start : m.end()]
        start = m.end()
    yield t[start:]


def _schedule(points: Sequence[float]) -> tuple[list[float], list[float]]:
    """Normalised piecewise-linear weights at equal distances over [0, 1] and
    their integral at these points, 1 at the end. One point is a constant."""
    w = [float(x) for x in points]
    if not w or min(w) < 0 or sum(w) <= 0:
        raise ValueError("a schedule needs weights of at least 0, one of them positive")
    w = w if len(w) > 1 else w * 2
    h = 1 / (len(w) - 1)
    area = [0.0]
    for a, b in zip(w, w[1:]):
        area.append(area[-1] + h * (a + b) / 2)
    return [x / area[-1] for x in w], [x / area[-1] for x in area]


def time_of(share: Column, weights: Column, areas: Column) -> Column:
    """Time in [0, 1] at which the integral of the weights reaches ``share``."""
    n = F.size(weights) - 1
    h = 1 / n
    # the last piece that begins below the share
    i = F.greatest(F.lit(0), F.least(n - 1, F.size(F.filter(areas, lambda a: a < share)) - 1))
    w0, w1, rest = F.get(weights, i), F.get(weights, i + 1), share - F.get(areas, i)
    slope = (w1 - w0) / h
    root = F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest))
    within = F.when(w0 + root > 0, 2 * rest / (w0 + root)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), i * h + F.least(F.greatest(within, F.lit(0.0)), F.lit(1.0) * h))


def plan(sizes: DataFrame, weights: DataFrame, schedules: Mapping[str, Sequence[float]] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(report, plan, T) from documents (doc_id, source, size).

    report: (source, docs, size, target_bp, max_repeat, wanted, given, reached_bp,
    runs_out_at, short): ``wanted`` is the source's share of T, the size of all documents;
    ``given`` what it gives when its documents are used at most max_repeat times;
    ``reached_bp`` its share of all that is given; ``runs_out_at`` the time in [0, 1] at
    which its demand reaches its supply, short if that is before the end. A source that is
    not found gives nothing. Sources that are not in ``weights``, and documents without
    one, count in T and give nothing. Null weights count as 0; a source named twice is an
    error. Documents are summed by source first; the tables of sources are joined."""
    wanted = weights.filter("source is not null").select("source", F.coalesce("target_bp", F.lit(0)).cast("long").alias("target_bp"), F.coalesce("max_repeat", F.lit(0)).cast("long").alias("max_repeat"))
    wanted = written(wanted, "weights")
    if not wanted.groupBy("source").count().filter("count > 1").isEmpty():
        raise ValueError("a source has two weights")
    per = written(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size")), "sources")
    total = per.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    made = {k: _schedule(v) for k, v in (schedules or {}).items()}
    constant = _schedule([1.0])
    array = lambda v: F.array(*[F.lit(float(x)) for x in v])
    own = wanted.join(per, "source", "left").fillna(0, ["docs", "size"])
    if made:
        courses = sizes.sparkSession.createDataFrame([(k, w, a) for k, (w, a) in made.items()], "source string, _w array<double>, _a array<double>")
        own = own.join(courses, "source", "left")
    else:
        own = own.withColumns({"_w": F.lit(None).cast("array<double>"), "_a": F.lit(None).cast("array<double>")})
    own = own.withColumns({"_w": F.coalesce("_w", array(constant[0])), "_a": F.coalesce("_a", array(constant[1]))})
    supply = F.col("size") * F.col("max_repeat")
    want = F.col("target_bp") * F.lit(total) / 10000
    # whole documents are used, so a run may overshoot by part of one document
    own = own.withColumns({"wanted": want.cast("double"), "given": F.least(want.cast("double"), supply.cast("double"))})
    # products of whole numbers, so that a source that just suffices has exactly the share 1
    exact = lambda c: c.cast("decimal(38,0)")
    left, right = exact(supply) * 10000, exact(F.col("target_bp")) * F.lit(total)
    below = F.when(left < right, F.lit(1 - 2.0**-53)).otherwise(1.0)  # not 1 by rounding
    share = F.when(right > 0, F.least(below, left.cast("double") / right.cast("double"))).otherwise(1.0)
    own = own.withColumn("runs_out_at", time_of(share, F.col("_w"), F.col("_a")))
    own = own.withColumn("short", left < right)
    own = written(own, "plan")
    given = own.agg(F.sum("given").alias("g")).first()["g"] or 1.0
    report = own.select("source", "docs", "size", "target_bp", "max_repeat", "wanted", "given", (10000 * F.col("given") / F.lit(given)).alias("reached_bp"), "runs_out_at", "short")
    return report, own.select("source", F.col("size").cast("double").alias("_size"), F.col("wanted").alias("_want"), F.col("given").alias("_give"), "_w", "_a"), total


def mix(documents: DataFrame, weights: DataFrame, size: Column, schedules: Mapping[str, Sequence[float]] | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). report: as of :func:`plan`, but ``given`` and ``reached_bp`` are
    the sizes of the copies in the mixture. mixture: (position, doc_id, copy_no, source, size), range-
    sorted by position, the time in [0, 1] at which the source's demand reaches the
    middle of the document's copy. Each pass over a source is whole before the next
    begins; the last pass ends with the document in which the demand ends, if more
    than half of it is wanted. Null or negative sizes count as 0; documents of size 0
    go where they fall in the order."""
    rows = documents.select("doc_id", "source", F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"))
    rows = written(rows, "sizes")
    report, todo, _ = plan(rows, weights, schedules)
    n = rows.count()
    used = skew_join(rows, todo, ["source"], "doc_id", "inner")
    used = used.withColumn("_place", mixed(F.col("doc_id"), seed=seed))
    laid = running(used, ["source"], "_place", ["doc_id"], bits_for(n), "size", "_end")
    middle = F.col("_end") - F.col("size") / 2
    copies = F.when(F.col("_size") > 0, F.ceil((F.col("_give") - middle) / F.col("_size"))).otherwise(F.lit(0)).cast("int")
    each = laid.filter(copies > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(1), copies)))
    at = middle + (F.col("copy_no") - 1) * F.col("_size")
    # a source that falls short is stretched over the whole course
    position = time_of(at / F.col("_give"), F.col("_w"), F.col("_a"))
    out = each.select(position.alias("position"), "doc_id", "copy_no", "source", "size")
    dealt = laid.filter(copies > 0).groupBy("source").agg(F.sum(F.col("size") * copies).alias("_dealt"))
    return out.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id", "copy_no"), reached(report, dealt)


def reached(report: DataFrame, dealt: DataFrame) -> DataFrame:
    """The report of :func:`plan` with ``given`` and ``reached_bp`` of the copies that
    were really dealt: (source, _dealt), one row a source."""
    dealt = written(dealt, "dealt")
    total = dealt.agg(F.sum("_dealt").alias("t")).first()["t"] or 0
    own = report.join(dealt, "source", "left").withColumn("given", F.coalesce("_dealt", F.lit(0)).cast("double"))
    share = 10000 * F.col("given") / F.lit(float(total)) if total else F.lit(0.0)
    return own.withColumn("reached_bp", share).select(*report.columns)


def found(report: DataFrame) -> DataFrame:
    """(source) of sources whose supply, repeated most often, runs out before the end of
    their demand; the comparison in whole numbers is the exact check."""
    return report.filter("runs_out_at < 1 and short").select("source")
