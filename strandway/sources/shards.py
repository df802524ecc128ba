"""Shards of grouped members as a Spark data source: tar files in which neighbours of one prefix are one sample.

``spark.read.format("shards")`` gives a row a sample, without a shuffle: key, shard, place (of the sample in its
shard), parts (suffix -> bytes) and fault. A partition is a shard, or one of ``pieces`` of it. Beside a shard lies an
index, ``<shard>.index``, with the key and the byte range of each sample; with it, pieces read only their ranges and a
read of some keys only what it asks for: those of the option ``keys``, and those of a filter on ``key`` where the
session's ``spark.sql.python.filterPushdown.enabled`` is set. A shard without an index is read from its start, by one
task.

A member's name is ``<key>.<suffix>``, split at the first dot after the last slash; suffixes are in lower case. Members
without a dot, folders and links are left out. The same prefix further on is a sample of its own.

What is broken has a row of its own. A sample with a suffix twice keeps the first and says so in ``fault``. Where a
header or a member can't be read, the sample has the parts before that and a ``fault``; with an index the other
samples are not touched by it, without one the shard ends there, as nothing says where the next member begins.

``df.write.format("shards")`` takes rows of key and parts and writes a shard and its index for every ``samples`` rows
of a task, under names that count only once the job has ended. Files are opened by pyarrow, so local folders that the
cluster shares and the object stores that pyarrow knows will do.
"""

from __future__ import annotations

import io
import json
import posixpath
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

PARTS = pa.map_(pa.string(), pa.binary())
SCHEMA = "key string, shard string, place long, parts map<string,binary>, fault string"
ARROW = pa.schema([("key", pa.string()), ("shard", pa.string()), ("place", pa.int64()), ("parts", PARTS), ("fault", pa.string())])
#: Rows and bytes of a batch that a task hands over at a time.
ROWS, BYTES = 256, 16 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def split_name(name: str) -> tuple[str, str] | None:
    """(key, suffix) of a member's name, or None where it has no dot."""
    folder, base = posixpath.split(name)
    stem, dot, suffix = base.partition(".")
    return (posixpath.join(folder, stem), suffix.lower()) if dot and stem else None


def grouped(file: io.BufferedIOBase) -> Iterator[tuple[str, dict[str, bytes], str | None]]:
    """(key, parts, fault) of the samples of a tar file."""
    key, parts, fault = None, {}, None
    try:
        with tarfile.open(fileobj=file, mode="r:") as tar:
            for member in tar:
                named = split_name(member.name) if member.isfile() else None
                if named is None:
                    continue
                if named[0] != key:
                    if key is not None:
                        yield key, parts, fault
                    key, parts, fault = named[0], {}, None
                if named[1] in parts:
                    fault = f"twice: {named[1]}"
                    continue
                data = tar.extractfile(member).read()
                if len(data) < member.size:
                    raise tarfile.ReadError("unexpected end of data")
                parts[named[1]] = data
                tar.members.clear()  # else all headers are kept
            file.seek(tar.offset)
            if file.read(512).strip(b"\0"):  # tarfile takes a header that it can't read for the end
                raise tarfile.ReadError("no header where a member should begin")
    except (tarfile.TarError, EOFError, OSError, ValueError) as e:
        if "empty file" in str(e) and key is None:
            return
        yield key, parts, f"broken: {e}"
        return
    if key is not None:
        yield key, parts, fault


@dataclass
class Piece(InputPartition):
    path: str
    at: int
    of: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix, self.pieces = options["path"], options.get("ending", ".tar"), int(options.get("pieces", 1))
        self.keys: list[str] | None = json.loads(options["keys"]) if "keys" in options else None

    def partitions(self) -> list[Piece]:
        store, root = opened(self.path)
        info = store.get_file_info(root)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in files if f.is_file and f.path.endswith(self.suffix) and not posixpath.basename(f.path).startswith((".", "_")))
        return [Piece(p, i, self.pieces) for p in paths for i in range(self.pieces)]

    def samples(self, piece: Piece) -> Iterator[tuple[int, str, dict[str, bytes], str | None]]:
        store = opened(self.path)[0]
        index = f"{piece.path}.index"
        if store.get_file_info(index).is_file:
            rows = pq.read_table(index, filesystem=store).to_pylist()
            own = list(enumerate(rows))[len(rows) * piece.at // piece.of : len(rows) * (piece.at + 1) // piece.of]
            wanted = None if self.keys is None else set(self.keys)
            with store.open_input_file(piece.path) as f:
                for place, row in own:
                    if wanted is not None and row["key"] not in wanted:
                        continue
                    f.seek(row["start"])
                    got = list(grouped(io.BytesIO(f.read(row["stop"] - row["start"]))))
                    if [g[0] for g in got] == [row["key"]]:
                        yield place, *got[0]
                    else:
                        yield place, row["key"], got[0][1] if got and got[0][0] == row["key"] else {}, (got[0][2] if got else None) or "broken: not what the index says"
        elif piece.at == 0:
            with store.open_input_file(piece.path) as f:
                for place, sample in enumerate(grouped(io.BufferedReader(f, 1 << 20))):
                    if self.keys is None or sample[0] in self.keys:
                        yield place, *sample

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        shard = posixpath.basename(partition.path)
        for place, key, parts, fault in self.samples(partition):
            rows.append((key, shard, place, list(parts.items()), fault))
            size += sum(map(len, parts.values()))
            if len(rows) >= ROWS or size >= BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class PushingReader(Reader):
    """A reader that takes filters on ``key`` over; Spark allows that only where the session has it set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",):
                found = [f.value]
            elif isinstance(f, In) and f.attribute == ("key",):
                found = list(f.value)
            else:
                yield f
                continue
            self.keys = found if self.keys is None else [k for k in self.keys if k in found]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceArrowWriter):
    """Shards are written as ``_<name>`` and renamed when the whole job has ended; those of lost tasks are never seen."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.most = options["path"], int(options.get("samples", 10_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        names, rows, out, tar = [], [], None, None

        def close() -> None:
            tar.close()
            out.close()
            pq.write_table(pa.Table.from_pylist(rows, pa.schema([("key", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])), f"{root}/_{names[-1]}.index", filesystem=store)
            rows.clear()

        for batch in iterator:
            for row in batch.to_pylist():
                if len(rows) >= self.most:
                    close()
                    tar = None
                if tar is None:
                    names.append(f"shard-{task.partitionId():05d}-{len(names):03d}-{task.taskAttemptId()}.tar")
                    out = store.open_output_stream(f"{root}/_{names[-1]}")
                    tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT)
                start = tar.offset
                for suffix, data in sorted(row["parts"]):
                    if data is not None:
                        info = tarfile.TarInfo(f"{row['key']}.{suffix}")
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
                rows.append({"key": row["key"], "start": start, "stop": tar.offset})
        if tar is not None:
            close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{root}/_{name}.index", f"{root}/{name}.index")
                store.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            for name in m.names if m else ():
                store.delete_file(f"{root}/_{name}")
                store.delete_file(f"{root}/_{name}.index")


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        options = dict(self.options)
        return (PushingReader if options.get("pushdown") == "true" else Reader)(options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def samples(spark: SparkSession, path: str, pieces: int = 1, keys: list[str] | None = None) -> DataFrame:
    """The samples of the shards below ``path``; those of ``keys`` only, where given."""
    spark.dataSource.register(ShardSource)
    reader = spark.read.format("shards").option("pieces", pieces).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader if keys is None else reader.option("keys", json.dumps(keys))).load(path)


def write(df: DataFrame, path: str, key: Column, parts: dict[str, Column], most: int = 10_000) -> None:
    """Write each row as a sample of the given parts (strings or bytes; null ones are left out) in shards below ``path``.

    A key has no dot. Rows stay in the tasks they are in; a sample without parts is only in the index.
    """
    df.sparkSession.dataSource.register(ShardSource)
    cells = F.create_map(*[x for name, c in parts.items() for x in (F.lit(name), c.cast("binary"))])
    df.select(key.cast("string").alias("key"), cells.alias("parts")).write.format("shards").option("samples", most).mode("append").save(path)


def members(df: DataFrame, suffixes: list[str]) -> DataFrame:
    """A column for each suffix, in that order whatever the order in the shard; null where a sample lacks it."""
    return df.select(*[c for c in df.columns if c != "parts"], *[F.col("parts")[s].alias(s) for s in suffixes])


