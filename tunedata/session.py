"""Session set-up and the shared folder used for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(app: str = "tunedata", master: str | None = None, **conf) -> SparkSession:
    """Create a session; keyword arguments are Spark settings with ``_`` for ``.``.

    Only correctness settings are fixed here. Memory, executors and the number of
    shuffle partitions belong to the cluster that runs the job.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing a temporary folder is used, but only for a local
    master; on a cluster a machine-local folder would lose data with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[sc.applicationId] = tempfile.TemporaryDirectory(prefix="tunedata-")
    return _LOCAL_SCRATCH[sc.applicationId].name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What follows starts from files every executor can reach, so a lost executor repeats no
    earlier work, and repeated reads scan only the columns they need. A given ``path`` is
    overwritten; it must not be one that ``df`` itself reads.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "table")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
