"""Session defaults shared by tests, bench and the driver entry."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that all executors share, from spark.checkpoint.dir; in a temporary one, removed at exit, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="vexarium-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return os.path.join(at, f"vexarium-{name}-{uuid.uuid4().hex}")


def get_session(master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with AQE on and UTC timestamps; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName("vexarium")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
