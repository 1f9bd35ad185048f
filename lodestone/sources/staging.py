"""Written tables for results that several later jobs read; they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. A session of one process may do without and gets a temporary one; any other is refused."""
    found = spark.conf.get(CHECKPOINT, None) or _own.get(app := spark.sparkContext.applicationId)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT} must name a folder that the driver and all executors share")
        found = _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
