"""Session helpers.

Library code never creates or reconfigures a cluster session; it only reads settings from the
session it is given. ``local_session`` is for tests, the bench and the smoke entry.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the engine is tuned for (recommended for cluster sessions as well): UTC session zone,
# AQE for run-time coalescing, skew-join splitting and broadcast conversion of small sides, and
# a whole-stage codegen method limit at the JVM's JIT bound (8000 bytes of bytecode): a fused
# stage with a bigger method is otherwise never JIT-compiled and runs interpreted, several times
# slower; above the limit Spark runs that stage as compiled per-operator code instead.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sparkmarts",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benchmarks (UI off, no event server)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SPARKMARTS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**ENGINE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by the session's ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only when the session has none is ``fallback`` set
    (tests and local runs pass one); with neither, this raises instead of guessing a
    machine-local folder that other executors could not see.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        return current
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is not set; point it at shared storage")
    sc.setCheckpointDir(fallback)
    return sc.getCheckpointDir() or fallback


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: its rows stay as they are even
    if executors are lost. A local session without such a folder gets a temporary one."""
    spark = df.sparkSession
    local = spark.sparkContext.master.startswith("local[")
    fallback = tempfile.mkdtemp(prefix="checkpoint-") if local and not (
        spark.sparkContext.getCheckpointDir()) else None
    checkpoint_dir(spark, fallback)
    return df.checkpoint(eager=True)
