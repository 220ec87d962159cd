"""Session and shared-storage helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "recordloom", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings every query assumes (UTC, AQE, no UI)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; ``sf_dir`` may be any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, bytes_a_core: int = 64 << 20) -> DataFrame:
    """``df`` for a Python stage. A scan of fewer files than cores, each of one row group at worst, would leave cores idle; where
    it is small as well (``bytes_a_core`` a core by the plan's statistics) its rows are dealt over all cores. A larger one has splits
    of its own, and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > cores * bytes_a_core:
        return df
    return df.repartition(2 * cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and the master is a single
    process (tests) a local temporary folder takes its place.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    sc = spark.sparkContext
    held = sc.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="recordloom-"))
    return sc.getCheckpointDir().rstrip("/")


class Workspace:
    """Tables written to the shared folder by one run of an operator, so that a lost executor costs a
    re-read and not a recomputation. The folder goes when the driver's Python ends, as results that are
    still lazy may read it until then; ``drop`` frees a table that no later step reads."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes and rereads. Tasks are those of the plan, so a task's size never grows with the table; small shuffled
        tables become few files by adaptive execution."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_small(self, df: DataFrame, name: str, files_a_core: int = 4) -> DataFrame:
        """The same for a table out of a shuffle that is small beside the documents (edges, labels, lists of keys): it is written by a few
        tasks a core at most, so that rounds over such tables do not make thousands of files. Never of a scan or of Python stages."""
        return self.keep(df.coalesce(max(32, files_a_core * self.spark.sparkContext.defaultParallelism)), name)

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
