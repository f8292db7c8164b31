"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # pages and bodies are large: keep the batches sent to Python small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # posts are nested as deep as they are, in any number
    "spark.sql.cteRecursionLevelLimit": "-1",
    "spark.sql.cteRecursionRowLimit": "-1",
    # of a repeated name in a JSON object the last one counts, as with most readers
    "spark.sql.variant.allowDuplicateKeys": "true",
    # the JVM never compiles a method above 8,000 bytes: steps that generate longer ones run as many small methods instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # split a hot join key even when that costs an extra exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # shuffle files go when the action that made them ends, not when the driver happens to collect its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def build_session(app: str = "hearthline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder shared by all executors. Local sessions without one get a fresh temporary folder."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    current = context.getCheckpointDir()
    if configured:
        if not current:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="hearthline-ckpt-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder, computed once, and go on from its files, which survive the loss of executors."""
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    for folders in getattr(_scopes, "open", [])[-1:]:
        folders.append(folder)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_scopes = threading.local()


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut_lineage`` writes inside, in this thread, are deleted at the end; nothing may read them later."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    folders: list[str] = []
    _scopes.open.append(folders)
    try:
        yield
    finally:
        _scopes.open.pop()
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
