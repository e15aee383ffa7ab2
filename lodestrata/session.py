"""Session helpers: table access, checkpoint folder, size-checked broadcasts."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so that their Python workers can import it wherever they were started."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestrata_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="lodestrata-"), "lodestrata.zip")  # on the driver, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("lodestrata", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    sc._lodestrata_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a local one only where none is set and the master is local."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"lodestrata-checkpoint-{os.getuid()}")
    sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A broadcast hint for df if it has at most max_rows rows, else df as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable]:
    """Gives a function that writes a frame to the shared checkpoint folder and reads it back; the tables are deleted at the end.

    With metrics (name=aggregate) it gives (frame, {name: value}): they are observed while the frame is written, without another job.

    For iterative work: unlike a checkpoint, a table that is read back carries no constraints and no
    output partitioning of the plan that made it, which would grow from round to round.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    number = itertools.count()

    def keep(df: DataFrame, **metrics: Column) -> DataFrame | tuple[DataFrame, dict]:
        path = f"{folder}/{next(number)}"
        seen = Observation()
        (df.observe(seen, *[v.alias(k) for k, v in metrics.items()]) if metrics else df).write.parquet(path)
        kept = spark.read.schema(df.schema).parquet(path)
        return (kept, seen.get) if metrics else kept

    try:
        yield keep
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
