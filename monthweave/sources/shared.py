"""The folder that driver and executors share, for tables that a question stores on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


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


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; what is stored there stays until that is emptied."""
    return f"{shared_folder(spark)}/monthweave-{label}-{uuid.uuid4().hex}"
