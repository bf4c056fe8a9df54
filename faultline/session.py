"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # A 171-column stage fused into one method outgrows the JIT compiler's 8,000
    # bytecodes and is interpreted; above this limit Spark compiles it in pieces.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

_LOCAL_ROOTS: dict[str, str] = {}
_SCOPES = threading.local()


def build_session(app: str = "faultline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings wide sensor tables want.

    ``conf`` keys use ``__`` for dots, e.g. ``spark__sql__shuffle__partitions=8``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in _SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def compile_in_pieces(spark: SparkSession) -> SparkSession:
    """Give a session that was built elsewhere the limit that wide stages need."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) != _SETTINGS[key]:
        spark.conf.set(key, _SETTINGS[key])
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine: on a cluster
    the executors could not read what the driver or each other wrote there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="run-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root; nothing is created yet.

    Inside ``scratch_scope`` the path is deleted when the scope ends.
    """
    path = os.path.join(scratch_root(spark), "faultline", f"{name}-{uuid.uuid4().hex}")
    scopes = getattr(_SCOPES, "open", [])
    if scopes:
        scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete every stage made inside when the block ends, also by an error.

    Frames that read those stages have to be written or collected inside the block.
    """
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for path in _SCOPES.open.pop():
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it names; a missing one is fine."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give MLlib's own checkpointing (boosting lineage) the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(spark))
