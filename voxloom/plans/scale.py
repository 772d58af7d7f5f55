"""Building blocks that keep plans even under skew and safe when executors are lost.

Nothing here collects data that grows with the input. Written tables go to the
folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows, so at most
#: ``1 / HOT_SHARE`` keys can be hot: the proven bound of every broadcast of hot keys.
HOT_SHARE = 1 / 500
#: Parts into which a hot key is dealt.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a
    folder of our own on a local master; elsewhere that is an error, since executors
    would write to disks that others don't see."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="voxloom-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop API, for any scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    fs, p = file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


_live: dict[str, SparkSession] = {}


def _forget(path: str) -> None:
    spark = _live.pop(path, None)
    try:
        fs, p = file_system(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may be gone; the folder is the cluster's to clean
        pass


@atexit.register
def _forget_all() -> None:
    for path in list(_live):
        _forget(path)


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes at the end of a
    :func:`scratch`, or at exit."""
    folder = f"{shared_dir(spark)}/voxloom-{uuid.uuid4().hex}"
    _live[folder] = spark
    return f"{folder}/{name}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    a lost executor costs nothing but a re-read. The table goes with :func:`free`, at
    the end of a :func:`scratch`, or at exit."""
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxloom_path = path.rpartition("/")[0]
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_voxloom_path", None):
            _forget(path)


@contextmanager
def scratch():
    """Deletes at its end the tables that were :func:`written` within: put the query and
    the action on its result inside."""
    before = set(_live)
    try:
        yield
    finally:
        for path in set(_live) - before:
            _forget(path)


def hot_keys(counts: DataFrame, total: int, n: str = "n", share: float = HOT_SHARE, least: int = 10_000) -> DataFrame:
    """Keys of ``counts`` that hold more than ``share`` of ``total`` rows (at most
    ``1/share`` of them). Below ``least`` rows no key is worth splitting."""
    return counts.filter(F.col(n) > F.lit(max(least, total * share)))


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], hot: DataFrame, spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join in which rows of ``big`` with a hot key are dealt over ``salts``
    parts by ``spread`` (a column that varies within a key) and the matching rows
    of ``small`` are repeated once a part. ``hot`` comes from :func:`hot_keys`."""
    on = list(on)
    mark = F.broadcast(hot.select(*on).withColumn("_vx_hot", F.lit(True)))
    parts = F.when(F.col("_vx_hot"), F.lit(salts - 1)).otherwise(F.lit(0))
    left = big.withColumn("_vx_spread", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(mark, on, "left")
    left = left.withColumn("_vx_salt", F.when(F.col("_vx_hot"), F.col("_vx_spread")).otherwise(F.lit(0))).drop("_vx_hot", "_vx_spread")
    right = small.join(mark, on, "left").withColumn("_vx_salt", F.explode(F.sequence(F.lit(0), parts))).drop("_vx_hot")
    return left.join(right, [*on, "_vx_salt"], how).drop("_vx_salt")


def mixed(*cols: Column, seed: int = 0) -> Column:
    """A repeatable random place of a row: 62 bits, not negative."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 62) - 1))


def bits_for(rows: int, rows_per_bucket: int = 50_000) -> int:
    """Bits of a bucket number so that a bucket holds about ``rows_per_bucket`` rows."""
    return max(1, min(24, (max(rows, 1) // rows_per_bucket).bit_length()))


def bucket_of(place: Column, bits: int) -> Column:
    return F.shiftright(place, 62 - bits).cast("int")


def running(df: DataFrame, keys: Sequence[str], place: str, ties: Sequence[str], bits: int, size: str | None = None, out: str = "rank") -> DataFrame:
    """Rank (or running sum of ``size``) of each row within ``keys`` by
    (``place``, ``ties``) without sorting a key in one task.

    ``place`` comes from :func:`mixed`; its leading ``bits`` make buckets whose
    totals are summed first (at most ``2**bits`` rows a key); within a bucket a
    window over about 50,000 rows does the rest. The rank starts at 1, a running
    sum includes the row itself. Only the bucket totals are joined back.
    """
    keys = list(keys)
    df = df.withColumn("_vx_bucket", bucket_of(F.col(place), bits))
    what = F.sum(size) if size else F.count(F.lit(1))
    totals = df.groupBy(*keys, "_vx_bucket").agg(what.cast("long").alias("_vx_total"))
    before = Window.partitionBy(*keys).orderBy("_vx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_vx_before", F.coalesce(F.sum("_vx_total").over(before), F.lit(0))).drop("_vx_total")
    within = Window.partitionBy(*keys, "_vx_bucket").orderBy(place, *ties)
    own = F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)) if size else F.row_number().over(within)
    back = df.withColumn("_vx_own", own.cast("long")).join(totals, [*keys, "_vx_bucket"], "left")
    return back.withColumn(out, F.col("_vx_before") + F.col("_vx_own")).drop("_vx_bucket", "_vx_own", "_vx_before")


def skew_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: str, how: str = "left", most: int | None = None) -> DataFrame:
    """:func:`salted_join` that first counts the keys of ``big`` (partial sums
    before the shuffle). ``big`` should be a table or cheap to compute twice;
    the pass that counts reads the key columns only. ``most``: a bound of the rows of
    ``big`` where one is known, so that small ones need not be counted."""
    if most is not None and most <= 10_000:
        return big.join(small, list(on), how)
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 10_000)
    total = big.count()
    if total <= 10_000:
        return big.join(small, list(on), how)
    return salted_join(big, small, on, hot_keys(counts, total), F.col(spread), how)
