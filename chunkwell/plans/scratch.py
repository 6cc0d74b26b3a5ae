"""Where queries that write put their files."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from chunkwell.sources import storage

_ROOT: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder all executors share (``spark.checkpoint.dir``), deleted when the process ends.

    A temporary folder is taken only where that is unset and the master is local.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _ROOT:
            _ROOT.append(tempfile.mkdtemp(prefix="chunkwell-"))
            atexit.register(storage.remove, _ROOT[0])
        folder = _ROOT[0]
    path = f"{folder.rstrip('/')}/chunkwell-{tag}-{uuid.uuid4().hex}"
    atexit.register(storage.remove, path)
    return path
