"""Session helpers: tables, the shared folder and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local session that names none, as in tests, gets a temporary folder of its machine. On a cluster each
    executor would write to a disk of its own there and rows would be missing without an error, so that is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no lineage.

    ``put`` writes a DataFrame and returns it as read back; ``drop`` deletes a table that no later step reads.
    What is left goes when the application's JVM exits.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._fs(self.root).deleteOnExit(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = f"{self.root}/{name}"
        self._fs(path).delete(self._path(path), True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspan_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillspan-")) / "quillspan.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._quillspan_shipped = True


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Runs what is in it under a tag; ``spark.interruptTag(tag)`` from another thread cancels it."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)
