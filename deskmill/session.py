"""Session set-up and durable intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "deskmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    AQE coalesces small shuffle partitions and splits skewed ones; the forced
    skew handling also applies where the split costs one more exchange, which is
    the right trade when one calendar holds a third of the rows.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a temporary folder, as in tests. On a
    cluster that is an error: executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if shared:
        if not context.getCheckpointDir():
            context.setCheckpointDir(shared)
        return shared
    if not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="deskmill-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the checkpoint folder and go on from it.

    Cuts the lineage, survives lost executors, and, unlike recomputation, shows
    every reader the same rows. Readers still prune columns and see the size.
    """
    path = fresh_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def brief_plans(spark: SparkSession, fields: int = 4) -> Iterator[None]:
    """Inside the block, plans are described with at most ``fields`` columns or expressions per operator.

    For steps with a large literal among the later ones: Spark writes literals out in full, and the driver keeps
    the description of every plan that it ran.
    """
    brief = {"spark.sql.debug.maxToStringFields": str(fields), "spark.sql.ui.explainMode": "simple"}
    before = {name: spark.conf.get(name) for name in brief}
    for name, value in brief.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


_RUN: ContextVar[str | None] = ContextVar("run", default=None)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """One folder for all steps that are written inside the block, removed at its end.

    Consume the result inside: it may still read from there.
    """
    folder = fresh_dir(spark, "run")
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused path for a written step, a sink or a stream checkpoint."""
    return os.path.join(_RUN.get() or checkpoint_root(spark), f"{purpose}-{uuid.uuid4().hex}")
