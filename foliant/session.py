"""Session helpers: local defaults for tests, and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
_tables: dict[int, tuple[weakref.ref, str]] = {}

# Runtime settings that are safe on any cluster; a cluster's own value wins.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: int = 8, app: str = "foliant") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own: a
    machine-local folder would be lost together with its executor.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        current = tempfile.mkdtemp(prefix="foliant-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder, deleted when the session ends.

    For loops: a checkpoint keeps the planner's size estimate, and estimates of joins multiply
    from round to round, while a table's size is that of its files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/foliant-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (weakref.ref(out), path)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more; others are left alone."""
    for table in tables:
        ref, path = _tables.get(id(table), (lambda: None, ""))
        if ref() is table:
            del _tables[id(table)]
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root, name = os.path.split(_PACKAGE)
        archive = os.path.join(tempfile.mkdtemp(prefix="foliant-"), name)
        spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", root, name))
        _shipped.add(app)
