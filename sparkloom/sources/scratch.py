"""A folder for files of one call, which the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; on a local master, where that may be unset, below one of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not getattr(sc, "_sparkloom_scratch", None):
            folder = tempfile.mkdtemp(prefix="sparkloom-files-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            sc._sparkloom_scratch = f"file://{folder}"
        root = sc._sparkloom_scratch
    return f"{root.rstrip('/')}/sparkloom/{name}-{uuid.uuid4().hex[:12]}"
