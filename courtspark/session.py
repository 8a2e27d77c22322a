"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "courtspark", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only on a local master without that setting (tests).

    A cluster without the setting is an error: executors share no machine-local folder. A local folder is removed when
    the process ends.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="courtspark-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor, and its lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def folder(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of the JVM for a path of any kind."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = folder(spark, path)
    fs.delete(at, True)


class Rounds:
    """Cuts the lineage of an iteration by tables written in the shared folder.

    What is read back has the size it has: a checkpoint keeps the estimate of the plan it came from, and estimates of
    joins multiply from round to round. Of each name the newest two tables stay, older ones are removed.
    """

    def __init__(self) -> None:
        self.paths: dict[str, list[str]] = {}

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        spark, kept = df.sparkSession, self.paths.setdefault(name, [])
        kept.append(scratch(spark))
        df.write.parquet(kept[-1])
        if len(kept) > 2:
            remove(spark, kept.pop(0))
        return spark.read.schema(df.schema).parquet(kept[-1])

    def drop(self, *names: str) -> None:
        """Remove the tables of these names, once nothing reads them any more."""
        for name in names:
            for path in self.paths.pop(name, []):
                remove(SparkSession.active(), path)


def tidy(spark: SparkSession) -> None:
    """Free what ended rounds of a loop have left: broadcasts, shuffle files and map statuses go when the driver's garbage is collected.

    A driver with heap to spare collects late, so they add up over the rounds; after a full collection it also gives
    heap back.
    """
    gc.collect()  # Python's handles on the JVM's objects
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: later reads take only the columns they need."""
    return Rounds()("table", df)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give Python workers this package, once per application, so executors need no copy of the repository."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="courtspark-")) / "courtspark.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
    return spark
