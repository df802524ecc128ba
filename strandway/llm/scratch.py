"""Tables between the phases of a job, in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A fresh local folder stands in for it only where it is unset and the session is a local
    one, as in tests; a cluster without it is an error, as its executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="strandway-"))
    return _own[0]


@contextlib.contextmanager
def released(spark: SparkSession):
    """Shuffle files of the jobs inside go when the job ends, as its result is kept as a table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and later phases
    scan a few narrow columns instead of computing them again. A lost executor costs no finished phase."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/strandway-{uuid.uuid4().hex}/{name}"
    with released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(*tables: DataFrame) -> None:
    """Delete staged tables that no later phase reads. A table that is still part of a result must not be cleared."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if "/strandway-" in path:
                folder = jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(conf).delete(folder, True)
