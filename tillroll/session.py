"""Sessions, and what a session must know before workers import this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT, PACKAGE = str(Path(__file__).resolve().parent.parent), Path(__file__).resolve().parent.name
#: The context that has the archive.
_shipped: dict[str, object] = {}

#: Settings that suit any size; partition counts and memory belong to the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Keeps a layout by doc_id for joins on (doc_id, word_idx), instead of a second exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: as an archive that Spark sends to every executor, once for a session.

    With a local master the workers are on this machine and read it where the driver does.
    """
    context = spark.sparkContext
    if context.master == "local" or context.master.startswith("local["):
        paths = context.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
        if ROOT not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    elif _shipped.get("to") is not context:
        folder = tempfile.mkdtemp(prefix=f"{PACKAGE}-")  # the driver serves the archive from here to executors
        atexit.register(shutil.rmtree, folder, True)
        context.addPyFile(shutil.make_archive(f"{folder}/{PACKAGE}", "zip", _copied(folder)))
        _shipped["to"] = context
    return spark


def _copied(folder: str) -> str:
    """A folder with the package's sources alone."""
    target = f"{folder}/sources"
    shutil.copytree(f"{ROOT}/{PACKAGE}", f"{target}/{PACKAGE}", ignore=shutil.ignore_patterns("__pycache__"))
    return target


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tillroll")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "8g"} | conf
    return ship(builder.config(map=settings).getOrCreate())


def table(spark: SparkSession, sf_dir: str, name: str):
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
