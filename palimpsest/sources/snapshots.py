"""State as immutable Parquet versions: every change is written as a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import TABLES


class Store:
    """Versions of the graph tables below one folder.

    A version is complete once its folder has Spark's _SUCCESS mark; readers take
    the newest complete one, so a writer that fails leaves the state as it was."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self, name: str) -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.root}/{name}")
        if not fs.exists(at):
            return []
        found = []
        for s in fs.listStatus(at):
            label = s.getPath().getName()
            if label.startswith("v") and label[1:].isdigit() and fs.exists(path(s.getPath(), "_SUCCESS")):
                found.append(int(label[1:]))
        return sorted(found)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        have = self.versions(name)
        if not have:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/v{have[-1] if version is None else version:09d}")

    def write(self, name: str, rows: DataFrame) -> int:
        have = self.versions(name)
        new = (have[-1] if have else 0) + 1
        rows.select(*(rows[f.name].cast(f.dataType).alias(f.name) for f in TABLES[name].fields)).write.mode("overwrite").parquet(
            f"{self.root}/{name}/v{new:09d}"
        )
        return new

    def create(self) -> list[str]:
        """Writes an empty first version of each table that has none; returns their names.
        Doing it again changes nothing."""
        missing = [name for name in TABLES if not self.versions(name)]
        for name in missing:
            self.write(name, self.spark.createDataFrame([], TABLES[name]))
        return missing

    def register(self) -> None:
        """Views named as the tables, for spark.sql."""
        for name in TABLES:
            self.read(name).createOrReplaceTempView(name)
