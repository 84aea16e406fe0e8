"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``; under a temporary folder in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="foliant-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/foliant-{uuid.uuid4().hex}/{label}"
