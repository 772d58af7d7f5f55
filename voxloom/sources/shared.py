"""Small files and locks in a shared folder, by the Hadoop file API: any scheme works."""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

from voxloom.plans.scale import file_system


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A whole file or none: written beside its place, then renamed. Without
    ``overwrite`` a file that is there is an error."""
    fs, p = file_system(spark, path)
    _, beside = file_system(spark, f"{posixpath.dirname(path)}/.{posixpath.basename(path)}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(p.getParent())
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    if overwrite and fs.exists(p):
        fs.delete(p, False)
    elif fs.exists(p):
        fs.delete(beside, False)
        raise FileExistsError(path)
    if not fs.rename(beside, p):
        fs.delete(beside, False)
        raise OSError(f"{path} could not be put in its place")


@contextmanager
def exclusive(spark: SparkSession, folder: str, lease: float = 86_400):
    """One run at a time in a folder; a second one fails at once. A lock that is older
    than ``lease`` seconds was left by a run that died, and is taken over."""
    fs, p = file_system(spark, f"{folder}/_lock")
    fs.mkdirs(p.getParent())
    if fs.exists(p) and time.time() - json.loads(read_text(spark, f"{folder}/_lock") or '{"at": 0}')["at"] > lease:
        fs.delete(p, False)
    own = uuid.uuid4().hex
    try:
        stream = fs.create(p, False)  # fails where the file is there
    except Exception as e:
        raise RuntimeError(f"another run holds {folder}") from e
    stream.write(bytearray(json.dumps({"at": time.time(), "run": own}).encode()))
    stream.close()
    try:
        yield
    finally:
        fs.delete(p, False)


def clear_stale(spark: SparkSession, root: str, suffix: str = ".tmp") -> int:
    """Remove the files that an aborted run left; folders are searched, links not followed."""
    fs, p = file_system(spark, root)
    if not fs.exists(p):
        return 0
    files, n = fs.listFiles(p, True), 0
    while files.hasNext():
        f = files.next()
        if f.getPath().getName().endswith(suffix):
            n += bool(fs.delete(f.getPath(), False))
    return n


def inside(root: str, path: str) -> str:
    """``path`` under ``root``; one that leaves it is an error."""
    scheme, sep, base = root.rpartition("://") if "://" in root else ("", "", root)
    base = posixpath.normpath(base)
    full = posixpath.normpath(posixpath.join(base, path))
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{path} leaves {root}")
    return scheme + sep + full


def moved(spark: SparkSession, source: str, target: str) -> int:
    """Copy a file, compare sizes, then delete the source; its bytes. A copy of another
    size is deleted, and the source stays."""
    a, pa = file_system(spark, source)
    b, pb = file_system(spark, target)
    size = a.getFileStatus(pa).getLen()
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(a, pa, b, pb, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    if b.getFileStatus(pb).getLen() != size:
        b.delete(pb, False)
        raise OSError(f"{target} has another size than {source}")
    a.delete(pa, False)
    return size
