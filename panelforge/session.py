"""Session builder with the settings that the operators expect."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "panelforge", **conf: str) -> SparkSession:
    """A session; `master` is left to the cluster where it is None and spark-submit sets one."""
    builder = SparkSession.builder.appName(app).config(map={**SETTINGS, **conf})
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return build_session(f"local[{n}]", **{"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "12g", **conf})


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, so they needn't have it installed or on their path."""
    context = spark.sparkContext
    if getattr(context, "_panelforge_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="panelforge-code-"), "panelforge_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("panelforge", os.path.relpath(full, package)))
    context.addPyFile(path)
    context._panelforge_shipped = True
