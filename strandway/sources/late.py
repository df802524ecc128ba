"""Rows chosen on narrow columns first, their wide columns read afterwards, from the files that hold them.

A row's address is its file and its place in it, which Spark's readers give without reading anything else. So choosing
reads the narrow columns of all files, and the late read the wide ones of the chosen files only.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADDRESS = ["_file", "_row"]
#: Files that are listed to the reader one by one; of more than that, the whole folder is read.
FILES = 10_000


def _reader(spark: SparkSession, path: str):
    """A reader to which single files of a folder are still parts of the folder, with its partition columns."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return spark.read.option("basePath", path) if store.exists(place) and store.getFileStatus(place).isDirectory() else spark.read


def addressed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The given columns of the Parquet files below ``path``, and each row's address."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def late_read(chosen: DataFrame, path: str, columns: list[str], files: int = FILES) -> DataFrame:
    """``chosen`` (with addresses) and the given columns of each of its rows.

    The names of the chosen files, up to ``files`` of them, come to the driver, as any list of files to read does; past
    that all files are read and the join alone picks the rows. Rows may be chosen more than once, and each is given as
    often. An address that isn't there has no row.
    """
    spark = chosen.sparkSession
    found = [r[0] for r in chosen.select("_file").distinct().limit(files + 1).collect()]
    reader = _reader(spark, path)
    if not found:
        wide = addressed(spark, path, columns).limit(0)
    else:
        source = reader.parquet(*map(unquote, found)) if len(found) <= files else reader.parquet(path)
        wide = source.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return chosen.join(wide, ADDRESS)


def late_windows(chosen: DataFrame, path: str, keys: list[str], at: str, columns: list[str], before: int, after: int, files: int = FILES) -> DataFrame:
    """keys, at and frames, the given columns of the rows at - before .. at + after of the same key, in order.

    ``chosen`` are keys and at; rows are found by a narrow read of keys and places, then read late. Places outside the
    sequence are left out.
    """
    narrow = addressed(chosen.sparkSession, path, [*keys, at])
    near = chosen.select(*keys, F.col(at).alias("_at")).distinct().select("*", F.explode(F.sequence(F.col("_at") - before, F.col("_at") + after)).alias(at))
    rows = late_read(near.join(narrow, [*keys, at]), path, columns, files)
    return rows.groupBy(*keys, "_at").agg(F.sort_array(F.collect_list(F.struct(at, *columns))).alias("frames")).withColumnRenamed("_at", at)
