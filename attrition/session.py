"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "attrition") -> SparkSession:
    """A local session for tests and the benchmark (no UI, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # AQE merges shuffle partitions up to max(total / cores, this floor);
        # the 1 MB default folds a small test shuffle into one task. Large
        # shuffles are sized by the advisory partition size as usual.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("ATTRITION_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting must name shared storage; without it this raises. Only
    a local session, whose driver and executors are one machine, gets a scratch folder."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="attrition-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def run_dir(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A folder for one run: ``folder`` if the caller passes one in (and so cleans it),
    else a new one under the shared checkpoint folder, which belongs to whoever
    manages that folder; nothing in it is needed after the application has ended."""
    shared = checkpoint_dir(spark)
    return folder.rstrip("/") if folder else f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if they
    see that folder (else it is installed on them, or sent with --py-files)."""
    root, env = str(Path(__file__).parent.parent), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def local_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table that the driver has, as a local relation; as Python objects, its rows
    would be read by a Python worker that starts for them."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.rsplit(" ", 1) for c in ddl.split(", "))])
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema))


class Storage:
    """Folders and files of the storage that holds a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if it doesn't exist."""
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(path))) if self.exists(path) else []

    def written(self, path: str) -> bool:
        """Whether Spark has written the table there to its end."""
        return self.exists(f"{path}/_SUCCESS")

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} can't be renamed to {new}")

    def make(self, path: str) -> str:
        """Makes a folder; its full URI."""
        self.fs.mkdirs(self.path(path))
        return self.fs.makeQualified(self.path(path)).toUri().toString()

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)
