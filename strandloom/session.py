"""Session factory and the shared work folder.

Intermediate tables are written to the folder named by ``spark.checkpoint.dir`` so that a lost executor never loses
them. Only where that setting is absent (unit tests, a laptop) is a local folder made.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def get_spark(app: str = "strandloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a machine-local one only if the session names none and runs locally."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="strandloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL[app] = "file://" + path
    return _LOCAL[app]


def run_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are: one folder, to be deleted when it has ended."""
    return f"{shared_dir(spark)}/strandloom/{spark.sparkContext.applicationId}"


def ship(spark: SparkSession) -> str:
    """Send this package to the executors of a session on which it is not installed; the path of the archive."""
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="strandloom-")) / "strandloom.zip"
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    return str(path)


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if path.startswith("file://"):
        atexit.register(shutil.rmtree, path[len("file://") :], ignore_errors=True)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(directory, f"{name}.parquet"))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or it with underscores, so that it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
