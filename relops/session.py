"""Spark session and the shared scratch folder."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# The folders handed out inside the innermost :func:`scratch_owner`.
_owned: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owned", default=None)


def get_spark(app_name: str = "relops", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on: UTC, ANSI, AQE with skew-join splitting."""

    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    The setting must point at storage every executor can reach. A local temporary folder is only ever
    chosen for a local master that has none set.
    """

    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="relops-")
        spark.conf.set(CHECKPOINT_CONF, root)
    path = f"{root.rstrip('/')}/relops/{purpose}-{uuid.uuid4().hex}"
    owned = _owned.get()
    if owned is not None:
        owned.append(path)
    return path


@contextlib.contextmanager
def scratch_owner(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end, also after a failure, every scratch folder that was handed out inside it.

    What the operators return reads those folders, so use the result inside: write it, or collect it. Folders handed
    out to other threads, and to an owner further in, are not this one's.
    """

    folders: list[str] = []
    token = _owned.set(folders)
    try:
        yield folders
    finally:
        _owned.reset(token)
        for path in folders:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
