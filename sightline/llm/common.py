"""Shared helpers: the work folder, materialised tables and word splitting."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Everything that is not part of a word once A-Z is lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WHITE_SPACE = r"[\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset (as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/") if "://" in folder else "file://" + folder.rstrip("/")


#: Rows of a batch that goes to Python, where the session has Spark's own default: documents may be long.
BATCH_ROWS = "1000"


class Workspace:
    """A folder of intermediate tables under the shared folder.

    Writing a table cuts the lineage, so a lost executor costs a re-read and no recomputation.
    Tables that a lazy result still needs stay until the session ends; others can be dropped early.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        atexit.register(self.clear)

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")

    def clear(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # the session may be gone when the interpreter ends
            pass

    def _delete(self, at: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(at)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them as long as a column has that name in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Text of ASCII only takes the much faster lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def split_words(text: Column, separators: str = SEPARATORS) -> Column:
    """Lower-cased words of the whole text; null and empty text have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), separators, -1), "")
