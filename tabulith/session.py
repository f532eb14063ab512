"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    A cluster names it in spark.checkpoint.dir, which is used as it stands. Only where
    that setting is missing (tests, one machine) a folder of this process is made; a
    cluster without it is refused, as machines would write to their own disks.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "tabulith-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder; later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_tabulith_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tabulith-")
    archive = os.path.join(folder, "tabulith.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.join("tabulith", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._tabulith_shipped = True
