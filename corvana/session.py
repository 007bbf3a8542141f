"""Session construction and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corvana")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one is set only where the setting is absent."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='corvana-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_MADE: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back: cuts lineage, survives executor loss.

    Results read from the table when they are computed, so it stays until `forget` or the end of the program."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvana-{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget() -> int:
    """Delete the tables that `stored` has written so far; call it once their results are no longer needed."""
    gone = 0
    while _MADE:
        spark, path = _MADE.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            gone += at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended; nothing more can be done from here
            continue
    return gone


atexit.register(forget)
