"""Session factory and the few session-wide rules every operator relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that change results or plans.  Memory and master stay with the caller.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # a checkpoint goes away with the last DataFrame that reads it
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "heronry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and all runs on
    one machine, as in tests, a temporary folder takes its place; a cluster without it is refused.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: the executors of a cluster need a shared folder")
        named = tempfile.mkdtemp(prefix="heronry-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    Unlike ``localCheckpoint`` it outlives the executors that wrote it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that is read more than once."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; a larger one is left to a shuffle.  For tables, not for long plans: it counts."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def parallelism(spark: SparkSession) -> int:
    """Number of partitions a sort or shard step should use."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
