"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings the jobs are written for. Broadcasts are left to the size checks
# of adaptive execution; skewed join partitions are split even when that costs a shuffle.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(app_name: str = "seqloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``RECOMMENDED_CONF``; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or a scratch one in local mode."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="seqloom-")
    return _local_roots[app]


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from the files.

    ``partition_by`` names columns whose values get folders of their own, for filters to skip.

    Unlike executor-held blocks, the written table survives the loss of any executor and
    keeps column pruning and size statistics for the plans built on it.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/seqloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def materialize_with(df: DataFrame, label: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``materialize`` plus aggregates of the written rows, gathered by the same job.

    The aggregates sit directly under the write, in its result stage, where Spark applies
    each task's contribution exactly once.
    """
    seen = Observation()
    table = materialize(df.observe(seen, *[col.alias(name) for name, col in metrics.items()]), label)
    return table, seen.get


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to four tasks a core, for work that is large beside the bytes of its rows.

    Adaptive execution puts rows together by their bytes: a million narrow queries would be left to a few tasks.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it when results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_root(spark)}/seqloom-{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give executors the library's modules, once per application, wherever Python was started.

    The archive is built on the driver; Spark hands it to every executor.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="seqloom-"), "seqloom-modules.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for package in ("seqloom", "catalog"):
            for folder, _, names in os.walk(os.path.join(top, package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, top))
        pipeline = os.path.join(top, "corpus_pipeline.py")
        if os.path.exists(pipeline):
            out.write(pipeline, "corpus_pipeline.py")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
