"""Writers: snapshots with a pointer, upserts by key, timelines by date, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.lifecycle import latest


class Store:
    """Tables under one folder. A snapshot is written beside the last one and becomes current when a pointer row names it, so
    a reader never sees half a snapshot and a failed writer leaves the last one current. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _pointer(self) -> tuple[int, dict[str, int]]:
        """The current version, and for each table the version whose files it is."""
        path = f"{self.root}/_pointer"
        if not self._exists(path):
            return 0, {}
        last = self.spark.read.schema("version long, tables map<string,long>").json(path).orderBy(F.desc("version")).first()
        return (last["version"], last["tables"] or {}) if last else (0, {})

    def version(self) -> int:
        return self._pointer()[0]

    def commit(self, **tables: DataFrame) -> int:
        """Writes the tables of the next snapshot, then the pointer; tables that are not given stay as they are."""
        version, known = self._pointer()
        version += 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/snapshot={version}/{name}")
        known = known | dict.fromkeys(tables, version)
        row = self.spark.createDataFrame([(version, known)], "version long, tables map<string,long>")
        row.coalesce(1).write.mode("append").json(f"{self.root}/_pointer")
        return version

    def has(self, name: str) -> bool:
        return name in self._pointer()[1]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/snapshot={self._pointer()[1][name]}/{name}")

    def upsert(self, name: str, rows: DataFrame, key: str, order: list[str] | None = None) -> int:
        """A snapshot in which the given rows replace those of one table with their keys; by an ``order``, only where they
        are not older than these. Other tables stay."""
        if self.has(name):
            held = self.read(name)
            both = held.unionByName(rows)
            rows = latest(both, key, order) if order else held.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)
        return self.commit(**{name: rows})

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")


def write_timeline(events: DataFrame, folder: str) -> None:
    """One folder of lines for each date and document (sha256); what a document stages again replaces its own folders alone."""
    rows = events.withColumns({"day": F.col("date"), "document": F.col("sha256")})
    rows.repartition("day", "document").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "document").json(folder)


def latest_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return latest(rows, key, order)
