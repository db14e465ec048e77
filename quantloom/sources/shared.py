"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local master may lack the setting and gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="quantloom-")
        _own[context.applicationId] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
