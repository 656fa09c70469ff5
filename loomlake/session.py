"""Session helpers: durable cut points and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent


def is_local(spark: SparkSession) -> bool:
    """True for ``local[...]``: driver and executors share one process and its folders."""
    return spark.sparkContext.master.split("[")[0] == "local"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut points.

    The session's own setting (``spark.checkpoint.dir``) always wins.  Only in
    local mode, where it is unset, a folder of our own is created; on a cluster
    an unset folder is an error, since a machine-local folder would not survive
    the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="loomlake-checkpoints-")
        atexit.register(shutil.rmtree, wanted, ignore_errors=True)
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` into the shared checkpoint folder and read it from there.

    Used where a result is read more than once, or where a second computation
    must see exactly the same partitioning (positions, partition ids).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers on other machines."""
    sc = spark.sparkContext
    if is_local(spark) or getattr(sc, "_loomlake_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="loomlake-ship-"), "loomlake.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE_ROOT.rglob("*.py")):
            z.write(p, Path("loomlake") / p.relative_to(PACKAGE_ROOT))
    sc.addPyFile(target)
    sc._loomlake_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
