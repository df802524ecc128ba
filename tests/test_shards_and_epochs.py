"""Grouped shards, epochs that a restart takes up, late reads, the shuffle buffer, chains with quarantine, stalls."""

import io
import tarfile
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandway.operators import chains, shuffling
from strandway.sources import late, shards
from strandway.streaming import epochs, stalls


def tar(path: Path, members, cut: int | None = None) -> None:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    data = out.getvalue()
    path.write_bytes(data if cut is None else data[:cut])


def found(df):
    return sorted((r.shard, r.place, r.key, tuple(sorted((k, bytes(v)) for k, v in r.parts.items())), r.fault and r.fault.split(":")[0]) for r in df.collect())


def test_neighbours_of_a_prefix_are_a_sample(spark, tmp_path):
    tar(tmp_path / "a.tar", [("x/1.jpg", b"j"), ("x/1.TXT", b"t"), ("x/2.txt", b""), ("nodot", b"?"), (".hidden", b"?"), ("x/2.seg.png", b"s"), ("x/1.txt", b"again")])
    tar(tmp_path / "b.tar", [("k.a", b"1"), ("k.a", b"2"), ("k.b", b"3")])
    tar(tmp_path / "empty.tar", [])
    (tmp_path / "none.tar").write_bytes(b"")
    (tmp_path / "_left.tar").write_bytes(b"not one")
    got = found(shards.samples(spark, str(tmp_path)))
    assert got == [
        ("a.tar", 0, "x/1", (("jpg", b"j"), ("txt", b"t")), None),
        ("a.tar", 1, "x/2", (("seg.png", b"s"), ("txt", b"")), None),
        ("a.tar", 2, "x/1", (("txt", b"again"),), None),
        ("b.tar", 0, "k", (("a", b"1"), ("b", b"3")), "twice"),
    ]
    row = shards.members(shards.samples(spark, f"{tmp_path}/a.tar").where("place = 0"), ["txt", "cls", "jpg"]).first()
    assert row[-3:] == (bytearray(b"t"), None, bytearray(b"j"))


def test_broken_shards(spark, tmp_path):
    tar(tmp_path / "cut.tar", [("1.a", b"x" * 600), ("2.a", b"y" * 600), ("2.b", b"z" * 600), ("3.a", b"w")], cut=512 + 1024 + 512 + 1024 + 512 + 100)
    (tmp_path / "junk.tar").write_bytes(b"j" * 2000)
    got = found(shards.samples(spark, str(tmp_path)))
    assert [(g[0], g[2], [k for k, _ in g[3]], g[4]) for g in got] == [("cut.tar", "1", ["a"], None), ("cut.tar", "2", ["a"], "broken"), ("junk.tar", None, [], "broken")]


@pytest.mark.parametrize("pieces", [1, 3])
def test_written_and_read_back(spark, tmp_path, pieces):
    rows = [(i, None if i % 7 == 0 else f"text {i} é" * (i % 5), f"c{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "i int, text string, c string").repartition(3)
    folder = str(tmp_path / "out")
    shards.write(df, folder, F.col("i"), {"txt": F.col("text"), "cls": F.col("c")}, 30)
    names = [p.name for p in Path(folder).iterdir()]
    assert not [n for n in names if n.startswith("_")] and len([n for n in names if n.endswith(".tar")]) >= 7
    back = shards.samples(spark, folder, pieces)
    got = {int(r.key): (r.txt and r.txt.decode(), r.cls.decode()) for r in shards.members(back, ["txt", "cls"]).collect()}
    assert {i: (t or None, c) for i, t, c in rows} == {i: (t or None, c) for i, (t, c) in got.items()}
    assert {i for i, t, _ in rows if t is None} == {int(r.key) for r in back.where("NOT map_contains_key(parts, 'txt')").collect()}
    assert sorted(r.key for r in shards.samples(spark, folder, pieces, ["7", "8", "no"]).collect()) == ["7", "8"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        back = shards.samples(spark, folder, pieces)
        assert sorted(r.key for r in back.where("key IN ('7', '8', 'no')").collect()) == ["7", "8"] and back.where("key = '11' AND place >= 0").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_an_index_keeps_the_rest_of_a_broken_shard(spark, tmp_path):
    folder = str(tmp_path / "out")
    shards.write(spark.range(20).coalesce(1), folder, F.col("id"), {"a": F.lit("x" * 700), "b": F.lit("y")})
    shard = next(Path(folder).glob("*.tar"))
    data = bytearray(shard.read_bytes())
    at = data.find(b"7.b\0")
    data[at : at + 300] = b"#" * 300
    shard.write_bytes(bytes(data))
    got = {r.key: (sorted(r.parts), r.fault) for r in shards.samples(spark, folder).collect()}
    assert len(got) == 20 and got["7"][0] == ["a"] and got["7"][1].startswith("broken") and all(got[str(i)] == (["a", "b"], None) for i in range(20) if i != 7)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 100, 1000])
def test_each_epoch_is_a_permutation(n):
    orders = [epochs.permuted(np.arange(n), n, 5, e) for e in range(4)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert n < 7 or len({tuple(o) for o in orders}) == 4
    assert (epochs.permuted(np.arange(n)[n // 2 :], n, 5, 1) == orders[1][n // 2 :]).all()


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    assert q.exception() is None


def ran(stream, out, checkpoint, until):
    """Run by short triggers until so many rows are out, then stop; a batch may be cut anywhere."""
    import time

    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start(out)
    began = time.time()
    while q.isActive and time.time() - began < 60 and not (q.lastProgress and q.lastProgress.batchId >= until):
        time.sleep(0.05)
    q.stop()


def test_a_restart_takes_up_the_stream(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    make = lambda: epochs.epochs(spark, 50, seed=3, batch=17, tasks=2, until=3, start=(0, 4))
    ran(make(), out, checkpoint, 1)
    ran(make(), out, checkpoint, 5)
    ran(make(), out, checkpoint, 40)
    got = sorted((r.epoch, r["index"], r.place) for r in spark.read.parquet(out).collect())
    assert got == [(e, i, int(epochs.permuted(np.array([i]), 50, 3, e)[0])) for e in range(3) for i in range(50) if (e, i) >= (0, 4)]


def test_late_reads(spark, tmp_path):
    folder = str(tmp_path / "a b")
    for d in range(3):
        spark.range(d * 100, d * 100 + 100).select("id", (F.col("id") % 10).alias("n"), F.repeat(F.col("id").cast("string"), 3).alias("wide")).coalesce(1).write.parquet(f"{folder}/day={d}")
    narrow = late.addressed(spark, folder, ["id", "n"])
    chosen = narrow.where("id BETWEEN 105 AND 107 OR id = 199")
    got = late.late_read(chosen.unionByName(chosen.where("id = 199")), folder, ["wide", "day"])
    assert sorted((r.id, r.wide, r.day) for r in got.collect()) == [(105, "105105105", 1), (106, "106106106", 1), (107, "107107107", 1), (199, "199199199", 1), (199, "199199199", 1)]
    assert sorted(r.id for r in late.late_read(chosen, folder, ["wide"], files=0).collect()) == [105, 106, 107, 199]
    assert late.late_read(chosen.where("id < 0"), folder, ["wide"]).isEmpty()


def test_only_chosen_files_are_read(spark, tmp_path):
    """The files that are not chosen are gone by the time of the late read."""
    folder = tmp_path / "t"
    for d in range(3):
        spark.range(d * 10, d * 10 + 10).select("id", F.lit("w").alias("wide")).coalesce(1).write.parquet(f"{folder}/{d}")
    narrow = late.addressed(spark, f"{folder}/*", ["id"]).where("id IN (12, 15)")
    chosen = spark.createDataFrame(narrow.collect(), narrow.schema)
    for d in (0, 2):
        for f in (folder / str(d)).glob("*.parquet"):
            f.unlink()
    assert late.late_read(chosen, str(folder), ["wide"]).count() == 2


def test_windows_read_late(spark, tmp_path):
    folder = str(tmp_path / "w")
    spark.createDataFrame([(e, t, f"{e}{t}") for e in "ab" for t in range(20)], "e string, t int, wide string").repartition(4).write.parquet(folder)
    got = late.late_windows(spark.createDataFrame([("a", 0), ("b", 19), ("b", 7), ("c", 1)], "e string, t int"), folder, ["e"], "t", ["wide"], 1, 2)
    assert {(r.e, r.t): [f.wide for f in r.frames] for r in got.collect()} == {("a", 0): ["a0", "a1", "a2"], ("b", 19): ["b18", "b19"], ("b", 7): ["b6", "b7", "b8", "b9"]}


def plain_buffer(rows, size):
    held, out = [], []
    for row in rows:
        if len(held) < size:
            held.append(row)
        else:
            at = row[1] % (1 << 64) % size
            out.append(held[at][0])
            held[at] = row
    return out + [r[0] for r in sorted(held, key=lambda r: r[2])]


@pytest.mark.parametrize(("n", "size", "batch"), [(500, 16, 7), (500, 16, 1000), (10, 64, 3), (64, 64, 10), (40, 1, 6)])
def test_shuffle_buffer(spark, n, size, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.range(n).coalesce(1).select("id", F.concat(F.lit("v"), "id").alias("v"))
        draws = df.select("id", *[F.xxhash64(F.lit(9), F.lit(2), F.lit(t), "id") for t in (0, 1)]).collect()
        got = shuffling.shuffled(df, ["id"], size, 9, 2).collect()
        assert [r.id for r in got] == plain_buffer([tuple(r) for r in draws], size) and all(r.v == f"v{r.id}" for r in got)
        assert [r.id for r in shuffling.shuffled(df, ["id"], size, 9, 2).collect()] == [r.id for r in got]
        assert n < 40 or size < 2 or [r.id for r in shuffling.shuffled(df, ["id"], size, 9, 3).collect()] != [r.id for r in got]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert shuffling.shuffled(spark.range(5).limit(0), ["id"], 4).isEmpty()


def steps():
    """Steps made inside a function, as workers can't import a test."""

    def halved(b):
        if (b.v < 0).any():
            raise ValueError("below zero")
        return b.assign(v=b.v / 2)

    def repeated(b):
        if (b.k == "bad").any():
            raise KeyError("bad")
        return pd.concat([b, b[b.v > 10].assign(k=lambda x: x.k + "+")])

    return [("halved", halved), ("even", lambda b: b[b.v % 2 == 0]), ("repeated", repeated)]


@pytest.mark.parametrize("parts", [1, 4])
def test_failing_rows_leave_the_chain(spark, parts):
    rows = [(f"k{i}", float(i) if i % 9 else -1.0) for i in range(60)] + [("bad", 8.0), ("bad", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
    got = chains.chained(df, steps(), "k string, v double")
    want, lost = [], []
    for k, v in rows:
        if v is not None and v < 0:
            lost.append(("halved", k))
        elif v is not None and (v / 2) % 2 == 0:
            if k == "bad":
                lost.append(("repeated", k))
            else:
                want += [(k, v / 2)] + ([(k + "+", v / 2)] if v / 2 > 10 else [])
    assert sorted((r.k, r.v) for r in got.rows.collect()) == sorted(want)
    import json

    bad = got.quarantine.collect()
    assert sorted((r.step, json.loads(r.row)["k"]) for r in bad) == sorted(lost)
    assert {r.reason for r in bad} == {"ValueError: below zero", "KeyError: 'bad'"}
    assert got.counts == {"rows": len(want), "quarantined": len(lost), "failed_halved": 7, "failed_even": 0, "failed_repeated": 2, "failed_schema": 0}


def test_rows_that_do_not_fit_and_empty_chains(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    odd = chains.chained(df, [("mixed", lambda b: b.assign(v=[x if k == "a" else "text" for k, x in zip(b.k, b.v, strict=True)]))], "k string, v long")
    assert [tuple(r) for r in odd.rows.collect()] == [("a", 1)] and [r.step for r in odd.quarantine.collect()] == ["schema"]
    assert chains.chained(df, [("none", lambda b: b.iloc[:0])], "k string, v long").rows.isEmpty()
    assert chains.chained(df.limit(0), steps()[:1], "k string, v long").counts["rows"] == 0
    assert chains.chained(df, [("no batch", lambda b: None)], "k string, v long").quarantine.count() == 2


def test_stalls_late_ends_and_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = [
        [("a", "load", "start", 0), ("b", "load", "start", 1), ("c", "save", "update", 2)],
        [("a", "load", "update", 5), ("b", "load", "end", 6), ("b", "load", "update", 7)],
        [("z", "clock", "start", 14), (None, "load", "start", 14)],
        [("z", "clock", "update", 20)],
        [("a", "load", "end", 27), ("z", "clock", "update", 28)],
        [("z", "clock", "end", 33), ("y", "clock", "start", 33)],
        [("x", "clock", "start", 60)],
        [("x", "clock", "end", 61)],
    ]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    schema = "id string, name string, kind string, time timestamp"
    for n, rows in enumerate(seen):
        df = spark.createDataFrame([(i, m, k, s) for i, m, k, s in rows], "id string, name string, kind string, s long")
        df.select("id", "name", "kind", F.timestamp_seconds(F.col("s") + 1000).alias("time")).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        if n in (2, 4, 5, 7):  # stopped and started again in between
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
            run(stalls.stalls(stream, 8000), out, checkpoint)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.id, r.what, r.at - 1_000_000, r.running, r.idle, r.stalled) for r in spark.read.parquet(out).collect())
    assert got == [
        ("a", "ended", 27000, 27000, 22000, True),
        ("a", "stalled", 13000, 13000, 8000, True),
        ("b", "ended", 6000, 5000, 5000, False),
        ("x", "ended", 61000, 1000, 1000, False),
        ("y", "stalled", 41000, 8000, 8000, True),
        ("z", "ended", 33000, 19000, 5000, False),
    ]
