"""Session defaults for local runs; on a cluster the submitted configuration wins."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "monthweave",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with UTC dates and adaptive execution (coalescing and skew splits) on.

    ``shuffle_partitions`` is the initial number before AQE coalesces; leave it
    out on a cluster that already sets it.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Sums of whole cents fail on overflow.
        .config("spark.sql.ansi.enabled", "true")
        # Minima and maxima of stored tables come from file footers where the reader can.
        .config("spark.sql.parquet.aggregatePushdown", "true")
        # Room for the generated code of many queries, so repeats need not compile.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # Recording the Python call site of each expression takes longer than
        # planning a small query.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
