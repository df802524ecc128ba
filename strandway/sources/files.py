"""Inventories and tables of trajectory folders, shard manifests and keyword folders; writers that don't overwrite.

All reads go through Spark's readers, so any store that Spark knows will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length, modified of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def episode_number(path: Column) -> Column:
    """The number after the last underscore of the file's stem; null without one, which sorts last."""
    return F.regexp_extract(F.regexp_replace(path, r"\.[^./]*$", ""), r"(?:^|[_/])(\d+)$", 1).try_cast("long")


def round_robin(files: DataFrame) -> DataFrame:
    """``files`` with task (the folder) and turn: sorted by turn and task, tasks alternate episode by episode."""
    number = episode_number(F.col("path"))
    turn = F.row_number().over(W.partitionBy("task").orderBy(number.asc_nulls_last(), "path"))
    return files.withColumn("task", folder(F.col("path"))).withColumn("turn", turn)


def rotation_pools(files: DataFrame, pattern: str = r"rot(-?\d+)_\d+") -> DataFrame:
    """angle and folder of each pool folder whose name holds an angle; other files are left out."""
    found = files.select(folder(F.col("path")).alias("folder")).distinct()
    name = F.regexp_extract("folder", r"([^/]*)$", 1)
    return found.withColumn("angle", F.regexp_extract(name, pattern, 1).try_cast("int")).where("angle IS NOT NULL")


def keywords(spark: SparkSession, root: str) -> DataFrame:
    """word: the trimmed lines of all files of a folder, empty ones left out."""
    return spark.read.option("recursiveFileLookup", True).text(root).select(F.trim("value").alias("word")).where("word <> ''")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dimension table in JSON lines; the schema is given, so the file is read once."""
    return spark.read.schema(schema).json(path)


def chunked_trajectories(spark: SparkSession, root: str, episodes: DataFrame | None = None) -> DataFrame:
    """Rows of all trajectory files below ``root``, with episode_index from the file name; those of ``episodes`` only,
    where given."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    rows = rows.withColumn("episode_index", episode_number(F.col("_metadata.file_path")))
    return rows if episodes is None else rows.join(episodes.select("episode_index").distinct(), "episode_index", "left_semi")


def shards(spark: SparkSession, manifests: str) -> DataFrame:
    """root, shard, total_key_count, chunk_size: one row for each shard that the JSON manifests list."""
    read = spark.read.option("multiLine", True).schema("root string, data_list array<string>, total_key_count long, chunk_size long").json(manifests)
    return read.select("root", F.explode("data_list").alias("shard"), "total_key_count", "chunk_size")


def matches_of_ids(results: DataFrame, order: str) -> DataFrame:
    """suite, demo, t, place, match: ids 'suite/demo/t' taken apart and match lists unrolled; of repeated ids the row
    that comes last in ``order`` counts."""
    last = W.partitionBy("query_id").orderBy(F.desc(order))
    newest = results.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    part = F.split("query_id", "/")
    return newest.select(F.get(part, 0).alias("suite"), F.get(part, 1).alias("demo"), F.get(part, 2).try_cast("long").alias("t"), F.posexplode("match_ids").alias("place", "match"))


def write_once(df: DataFrame, path: str, digest: str) -> DataFrame:
    """``df`` as Parquet below ``path``, in a folder named by the digest of its settings, or what is there already.

    A finished folder has Spark's success mark; an unfinished one is written anew. Other settings go to another folder.
    """
    spark = df.sparkSession
    target = f"{path.rstrip('/')}/{digest}"
    try:
        spark.read.format("binaryFile").load(f"{target}/_SUCCESS")
    except AnalysisException:  # no such path
        df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def listed(files: DataFrame, manifest: DataFrame, episodes: str, least: int) -> DataFrame:
    """The files that a frozen manifest's array ``episodes`` names by path; under ``least`` of them raise a ValueError."""
    found = files.join(manifest.select(F.explode(episodes).alias("path")).distinct(), "path", "left_semi")
    if (n := found.count()) < least:
        raise ValueError(f"{n} of {least} episodes of the manifest found")
    return found


def sample_keys(spark: SparkSession, index: str) -> DataFrame:
    """key: the first column of an index file, without extension."""
    read = spark.read.parquet(index)
    return read.select(F.split_part(F.col(f"`{read.columns[0]}`").cast("string"), F.lit("."), F.lit(1)).alias("key"))


def table_of(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """A file or folder as a table: csv (with a header), jsonl, json (a document a file), txt (lines), parquet, or bytes
    (whole files, of any other kind). Spark's readers unpack .gz by themselves."""
    read = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return read.option("header", True).option("inferSchema", schema is None).csv(path)
    if kind in ("json", "jsonl"):
        return read.option("multiLine", kind == "json").json(path)
    if kind == "txt":
        return spark.read.text(path)
    if kind == "parquet":
        return read.parquet(path)
    if kind == "bytes":
        return spark.read.format("binaryFile").load(path)
    raise ValueError(kind)


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """``df`` as csv, json or parquet, in place of what is there; its success mark comes last."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def annotations(spark: SparkSession, folder_: str, schema: str) -> DataFrame:
    """The JSON documents of a folder, one row a file, with path."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder_).withColumn("path", F.col("_metadata.file_path"))


def camera_streams(shards_: DataFrame, keys: list[str], cameras: list[str], expanded: str = "videos") -> DataFrame:
    """One row for each shard and stream: ``expanded`` is one stream a camera, any other key is one itself."""
    each = F.flatten(F.array(*[F.array(*[F.lit(f"{k}/{c}") for c in cameras]) if k == expanded else F.array(F.lit(k)) for k in keys]))
    return shards_.withColumn("stream", F.explode(each))


def telemetry(df: DataFrame, values: list[str]) -> DataFrame:
    """metric, avg, max, min over all ranks' rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("_v")) for v in values])).alias("_x")).select("_x.*")
    return long.groupBy("metric").agg(F.avg("_v").alias("avg"), F.max("_v").alias("max"), F.min("_v").alias("min"))
