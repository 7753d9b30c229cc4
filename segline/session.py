"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def on_workers(spark: SparkSession) -> None:
    """Ship the package as a zip once an application.

    With a local master, workers that find it by PYTHONPATH or their working folder need no zip; on a cluster the
    driver's own folders say nothing about theirs, so it is always shipped.
    """
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app, local = spark.sparkContext.applicationId, spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    if app in _SHIPPED or (local and any(p and Path(p).resolve() == ROOT for p in places)):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-segline-"), "segline.zip")
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted((ROOT / "segline").rglob("*.py")):
            out.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which all machines share; where that is unset and the master local, in a temporary one."""
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root:
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: files must lie in a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-segline-")
        root = _OWN[app]
    return f"{root.rstrip('/')}/segline-{name}-{uuid.uuid4().hex}"
