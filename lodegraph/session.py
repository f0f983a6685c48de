"""Session construction and the two things every job needs from it: tables and durable checkpoints."""

from __future__ import annotations

import os
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodegraph", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench. On a cluster the session is given; nothing here is required of it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for DataFrame.checkpoint(): the one the cluster names in spark.checkpoint.dir, which all executors
    share. Only where none is set and the master is a single local JVM, a folder of this machine is used."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "lodegraph-checkpoints")
    sc.setCheckpointDir(named)
    return named


def release(spark: SparkSession) -> None:
    """Gives back what planning leaves in the driver's heap, once that has grown to half of what it may have: little of it
    is in use, but a JVM lets it grow to its bound before it gives any back, beside what it needs outside of the heap."""
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        jvm.java.lang.System.gc()


def trim(spark: SparkSession) -> bool:
    """Gives back what compilers have freed outside of the driver's heap: the C library keeps it, hundreds of MB after many
    plans. False where the JVM has no such command (it is OpenJDK's, on Linux)."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        # by the interface: the server's own class is not open to callers
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    release(df.sparkSession)
    trim(df.sparkSession)
    return out
