"""Make the package importable in Python workers of any executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def shipped(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once a context. The driver serves
    the file itself; where the package was installed as an archive nothing is done."""
    sc = spark.sparkContext
    if getattr(sc, "_voxloom_shipped", False) or not _ROOT.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="voxloom-src-")
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder) / "voxloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    sc.addPyFile(str(archive))
    sc._voxloom_shipped = True
