"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, named by spark.checkpoint.dir. Where the session names none, a temporary folder is set if
    the master is local, as in tests; on a cluster it raises, since executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back, so a lost executor costs one re-read.

    The table goes with drop_materialized(), or else when the session's driver ends; what its query shuffled goes at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    shuffled = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(shuffled, None)
    spark.conf.set(shuffled, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(shuffled) if before is None else spark.conf.set(shuffled, before)
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    table.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(table)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(*dfs: DataFrame) -> None:
    """Removes tables written by materialize() once nothing reads them any more."""
    for df in dfs:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getName().startswith("cut-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
