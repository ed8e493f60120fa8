"""Session helpers shared by batch jobs and tests."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: below ``spark.checkpoint.dir``, or else below the warehouse.

    Both are shared by all executors of a cluster. The context keeps a folder of
    its own there, which `clear_stages` removes.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages")
    return context.getCheckpointDir().rstrip("/")


def clear_stages(spark: SparkSession) -> None:
    """Remove every intermediate table of this session; call it when no result is read any more."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder as parquet and read it back.

    Cuts the lineage where several statistics and outputs need the same
    expensive rows, and keeps column pruning and filter pushdown for them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, where it is not installed on them: tasks import it from the session's files."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="catalens-")) / "catalens.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, path.relative_to(root.parent))
    # The driver serves the archive to every executor, also to one that joins later.
    context.addPyFile(str(archive))
    _SENT.add(context.applicationId)


def local_session(cores: str = "8", app: str = "catalens", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="catalens-"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
