"""Where intermediate results go: only to folders that all executors share; and how
the package reaches the Python workers."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
ROW = "_row"
LEAST_PARTITIONS = "spark.sql.files.minPartitionNum"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, as in tests.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="monthweave-shared-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, as ``--py-files`` would."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if getattr(context, "_monthweave_shipped", False) or not package.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="monthweave-code-")) / "monthweave.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
    context._monthweave_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which Spark's cleaner may remove.

    For results of a few columns; wide ones go to ``keep``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the written rows.

    The folder stays until ``discard`` is called with the path, which the rows'
    ``inputFiles()`` name, or the cluster empties its checkpoint folder.
    """
    path = f"{shared_folder(df.sparkSession)}/monthweave-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder written by ``keep``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard_kept(*frames: DataFrame) -> None:
    """Remove the folders of frames that ``keep`` returned and nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            discard(df.sparkSession, file.rsplit("/", 1)[0])


def hold_splits(spark: SparkSession) -> None:
    """Let the same files be split alike for the rest of the session.

    Spark cuts files by the number of cores that are registered when they are read, unless a least number
    of partitions is set. If none is, the present number is; executors that come or
    go between two reads of a table then change nothing.
    """
    if spark.conf.get(LEAST_PARTITIONS, None) is None:
        spark.conf.set(LEAST_PARTITIONS, str(spark.sparkContext.defaultParallelism))


def with_row(df: DataFrame) -> DataFrame:
    """Number the rows in ``_row``, so that null or repeated ids stay apart.

    The number is made of the input partition and the place in it. Reading the same
    files again in the session gives the same numbers, since ``hold_splits`` makes partitions
    independent of the executors that are there; rows from a shuffle must be written first.
    """
    ship_code(df.sparkSession)
    hold_splits(df.sparkSession)
    return df.withColumn(ROW, F.monotonically_increasing_id())


def hash_below(mark: Column, wanted: int, total: int) -> Column:
    """Whether a 64-bit hash is among about the 1.5 x ``wanted`` smallest of ``total``.

    A bounded sample by the smallest hashes filters by this first, so that its sort gets
    few rows from any number of tasks.
    """
    share = min(1.0, (1.5 * wanted + 100) / max(total, 1))
    return mark <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))


def largest(df: DataFrame, column: str, wanted: int, steps: float = 256.0) -> DataFrame:
    """At most ``wanted`` rows: all with a positive ``column`` from some bound on.

    The bound comes from a histogram on a logarithmic scale, so no task sorts or gathers the
    whole; rows of the one step that would exceed ``wanted`` are left out.
    """
    step = F.floor(F.log(column) * steps)
    found = df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, bound = 0, None
    for row in sorted(found, reverse=True):
        total += row.n
        if total > wanted:
            break
        bound = row.step
    return df.filter(F.lit(False) if bound is None else step >= bound)


def without_rows(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``df`` whose number (see ``with_row``) is not in ``dropped``.

    The rows to drop are the smaller side, which Spark broadcasts if its size allows. A column
    of ``df`` that has the number's name is kept as it is.
    """
    whole = df.select(F.struct("*").alias("_whole"))
    return with_row(whole).join(dropped.select(ROW), ROW, "left_anti").select("_whole.*")
