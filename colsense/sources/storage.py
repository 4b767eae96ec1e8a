"""Shared storage for lineage cuts and written tables.

On a cluster the checkpoint folder is the shared one the cluster names in
``spark.checkpoint.dir``; it is read from the session and never replaced.
Only a local session without that setting (tests, a laptop) gets a fresh
folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running colsense jobs")
    local = tempfile.mkdtemp(prefix="colsense-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/colsense/{name}-{uuid.uuid4().hex}"
