"""Session settings and the shared folder that checkpoints and intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
METHOD_LIMIT, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark. On a cluster the session comes from spark-submit."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compiled(spark: SparkSession) -> SparkSession:
    """The session, told to generate no method longer than HotSpot compiles, unless it was given a limit already.

    A wide projection fused into one method of over 8,000 bytes stays in the bytecode interpreter for the whole job. With this
    limit Spark does not fuse that part of the plan, and splits its expressions into methods that are compiled.
    """
    if spark.conf.get(METHOD_LIMIT, None) is None:
        spark.conf.set(METHOD_LIMIT, METHOD_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local[...] session may go without one; it then gets a temporary folder of its own, because there
    the driver and the executors are one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tallyline-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has written to yet."""
    return f"{shared_dir(spark)}/tallyline/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where a plan branches: the work is done once, the lineage is cut, and the files outlive an executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
