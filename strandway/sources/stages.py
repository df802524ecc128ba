"""Intermediate tables of iterative operators, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session without it, as in tests, gets a fresh local folder; on a cluster
    that is an error, as executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="strandway-"))
    return _own[0]


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """The table written to the shared folder and read again: its lineage ends there, its size is known to the planner
    and a lost executor costs none of it."""
    path = f"{shared_root(df.sparkSession)}/strandway-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete tables that ``kept`` wrote and that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if "/strandway-" in path:
                folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(conf).delete(folder, True)
