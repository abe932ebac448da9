"""Media container files: a Spark data source, and reading and writing of folders of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import container


def read(spark: SparkSession, path: str) -> DataFrame:
    """path and the parts of every container file below ``path``; a broken file gives its error in place of parts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.withColumn("doc", container.parsed("content")).select("path", "doc.*")


def write(df: DataFrame, folder: str, name: str = "asset_uuid", content: str = "content") -> None:
    """One file per row in a folder that all executors share; a row that is written twice leaves one whole file."""
    def put(rows) -> None:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for row in rows:
            with store.open_output_stream(hidden := f"{root}/_{uuid.uuid4().hex}") as out:
                out.write(bytes(row[content]))
            store.move(hidden, f"{root}/{row[name]}.bin")

    df.select(name, content).foreachPartition(put)


class ContainerSource(DataSource):
    """``spark.read.format("mediacontainer").load(glob of local files)``: one partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "mediacontainer"

    def schema(self) -> str:
        return "path string, " + container.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition):
        names = [x.split()[0] for x in container._fields(container.SCHEMA)]
        with open(partition.value, "rb") as f:
            doc = container.unpack(f.read())
        yield (partition.value, *[doc.get(n) if n != "custody" or doc.get(n) is None else [tuple(e.values()) for e in doc[n]] for n in names])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)


def images(df: DataFrame, *carry: str) -> DataFrame:
    """The image of each container, where its hash agrees; with the ``carry`` columns."""
    return df.where("image_valid").select(*carry, "path", "asset_uuid", F.col("image"))
