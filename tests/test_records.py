"""Record filters, relative poses, captions, sources and tracks on small fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandway.functions import normalise as nm
from strandway.functions import text as txt
from strandway.functions import vectors as vec
from strandway.operators import records as rec
from strandway.operators import windows as win
from strandway.sources import files
from strandway.streaming import tracks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_suites_need_the_whole_prefix(spark):
    d = spark.createDataFrame([("rot15_1", 1), ("rot15_2", 2), ("rot150_1", 3), ("rot15_x", 4), (None, 5)], "suite string, k int")
    assert rows(rec.suites_of_prefix(d, "suite", {"rot15": 1, "rot150": 0}, ["suite"])) == [("rot150_1", 3, "rot150"), ("rot15_1", 1, "rot15")]
    assert rec.suites_of_prefix(d.limit(0), "suite", {"rot15": 1}, ["suite"]).isEmpty()


def test_flags_and_versions(spark):
    d = spark.createDataFrame([(1, 1, "v3"), (2, None, "v3"), (3, 0, "v2"), (4, 2, None)], "k int, skip int, version string")
    assert [r[0] for r in rows(rec.not_skipped(d, ["skip"]).select("k"))] == [2, 3, 4]
    with pytest.raises(Exception, match="schema version v2"):
        rec.of_version(d.where("k < 4"), F.col("version"), "v3").collect()
    with pytest.raises(Exception, match="schema version none"):
        rec.of_version(d.where("k = 4"), F.col("version"), "v3").collect()
    meta = spark.createDataFrame([('{"e": {"is_eval": true}}',), ('{"e": {"is_eval": false}}',), ("{}",), (None,), ("no",)], "m string")
    assert [rec.of_metadata(meta, "m", "$.e.is_eval", w).count() for w in (True, False, None)] == [1, 1, 5]
    with pytest.raises(ValueError):
        rec.without_extensions(spark.range(1).toDF("a.jpg").withColumn("a.json", F.lit(1)))


def test_guards(spark):
    d = spark.createDataFrame([("t", 1, {"a": 0, "b": None}), ("u", 2, {"a": 3}), ("v", 3, {})], "task string, seed int, guards map<string,int>")
    assert sorted(map(str, rec.failed_guards(d, ["task", "seed"], "guards").collect())) == ["Row(task='t', seed=1, guard='b', value=None)", "Row(task='u', seed=2, guard='a', value=3)"]


def test_episode_facts(spark):
    inf = float("inf")
    d = spark.createDataFrame([("a", [1.0, 2.0], 1.0), ("a", [1.0, inf], 2.0), ("b", [1.0], 1.5), ("c", None, None), ("c", [1.0, 2.0], 1.0)], "e string, v array<double>, s double")
    got = {r.e: (r.frame_count, r.violations) for r in rec.episode_facts(d, "e", {"v": 2}, ["s"]).collect()}
    assert got == {"a": (2, ["v_finite"]), "b": (1, ["v_width", "s_integer", "too_short"]), "c": (2, ["v_width", "v_finite", "s_integer"])}


def rotation(angles):
    x, y, z = angles
    c, s = math.cos, math.sin
    turn = [np.array([[1, 0, 0], [0, c(x), -s(x)], [0, s(x), c(x)]]), np.array([[c(y), 0, s(y)], [0, 1, 0], [-s(y), 0, c(y)]]), np.array([[c(z), -s(z), 0], [s(z), c(z), 0], [0, 0, 1]])]
    return turn[2] @ turn[1] @ turn[0]


@pytest.mark.parametrize("rebase", [1, 4])
def test_relative_poses(spark, rebase):
    poses = np.random.default_rng(3).uniform(-1.2, 1.2, (11, 6))
    d = spark.createDataFrame([(0, i, 11, p.tolist()) for i, p in enumerate(poses)], "k int, pos long, n long, pose array<double>")
    got = {r.pos: r.relative for r in win.relative_poses(d, ["k"], ["pos"], "pose", rebase).collect()}
    assert sorted(got) == list(range(1, 11))
    for k in range(1, 11):
        b = (k - 1) // rebase * rebase
        base = rotation(poses[b, 3:])
        assert np.allclose(got[k][:3], base.T @ (poses[k, :3] - poses[b, :3])) and np.allclose(rotation(got[k][3:]), base.T @ rotation(poses[k, 3:]))


def test_strides_stay_in_the_band(spark):
    d = spark.range(400).select(F.col("id").alias("n"), (F.col("id") / 400).alias("u"))
    got = d.select("n", "u", win.sampled_stride(F.col("n"), F.lit(30), 10, 30, 16, F.col("u"), F.col("u")).alias("c")).collect()
    for r in got:
        some = [s for s in range(1, (r.n - 1) // 15 + 1) if 10 <= 30 / s <= 30] if r.n else []
        if not some:
            assert r.c is None
            continue
        assert r.c.stride == (some[-2] if r.u < 0.01 and len(some) > 1 else some[-1]) and 0 <= r.c.start and r.c.start + 15 * r.c.stride < r.n


def test_captions(spark):
    d = spark.createDataFrame([('{"m": {"a": "1", "b": "2"}}',), ('"m": {"a": "1"}',), ("{x",), (None,), ("",), ("{}",)], "t string")
    assert [r[0] for r in d.select(txt.caption_of_json(F.col("t"), "b")).collect()] == ["2", "1", "", "", "", ""]
    assert [r[0] for r in d.select(txt.caption_of_json(F.col("t"))).collect()] == ["1", "1", "", "", "", ""]
    r = spark.createDataFrame([('{"caption": {"prompt": "p"}}',), ("{}",), (None,)], "t string")
    assert [x[0] and tuple(x[0]) for x in r.select(txt.image_caption(F.col("t"), "prompts", [], F.lit(0.0))).collect()] == [("prompts", "p"), None, None]
    s = spark.createDataFrame([("",), (None,), ("a Bad! day",), ("two knives",), ("the exact w",), ("the exactt w",), ("fine é",)], "t string")
    got = [x[0] for x in s.select(txt.safety(F.col("t"), ["bad", "knife"], [], ["exactly", "exact"], {"knives": "knife"})["reason"]).collect()]
    assert got == ["empty", "empty", "blocked", "blocked base form", "exact word", "safe", "safe"]


def test_chain_of_rotations_comes_back(spark):
    d = spark.createDataFrame([([0.3, -0.4, 1.1],), ([0.0, 0.0, 3.0],)], "a array<double>")
    for form in ("six", "quaternion", "matrix", "euler"):
        for r in d.select("a", nm.rotation_restored(nm.rotation_normalised(F.col("a"), "euler", form), "euler", form).alias("b")).collect():
            assert np.allclose(r.a, r.b)
    with pytest.raises(ValueError):
        nm.rotation_normalised(F.col("a"), "euler", "six", relative=True)
    assert [r[0] for r in spark.createDataFrame([([[3.0, 3.0], [4.0, 4.0]],), ([[0.0], [0.0]],)], "l array<array<double>>").select(vec.pooled(F.col("l"))).collect()] == [[0.6, 0.8], None]


def test_manifests_and_tables(spark, tmp_path):
    f = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    m = spark.createDataFrame([(["a", "c", "x"],)], "episodes array<string>")
    assert rows(files.listed(f, m, "episodes", 2)) == [("a",), ("c",)]
    with pytest.raises(ValueError):
        files.listed(f, m, "episodes", 3)
    spark.createDataFrame([("k1.jpg", 1), ("k2.a.b", 2)], "name string, n int").coalesce(1).write.parquet(str(tmp_path / "index"))
    assert rows(files.sample_keys(spark, str(tmp_path / "index"))) == [("k1",), ("k2",)]
    d = spark.createDataFrame([(1, "x"), (2, None)], "n long, s string")
    for kind, out in (("csv", "csv"), ("json", "jsonl"), ("parquet", "parquet")):
        files.write_table(d, str(tmp_path / out), kind)
        assert sorted(files.table_of(spark, str(tmp_path / out), out, "n long, s string").collect(), key=str) == sorted(d.collect(), key=str)
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann/1.json").write_text(json.dumps({"t": [1, 2]}, indent=1))
    assert [r.t for r in files.annotations(spark, str(tmp_path / "ann"), "t array<int>").collect()] == [[1, 2]]
    assert files.table_of(spark, str(tmp_path / "ann"), "txt").count() > 1 and files.table_of(spark, str(tmp_path / "ann"), "bytes").count() == 1


def followed(cells, n, threshold, chunk, steps, d):
    """Tracks by the whole distance table, step by step."""
    now, out = [None] * n, []
    for s in range(steps):
        for rank in range(n):
            own = now[rank]
            nxt = own and (own[0], own[1] + chunk)
            if nxt and nxt in cells and d(s, *nxt) <= threshold:
                now[rank], go = nxt, True
            else:
                taken = {o[0] for i, o in enumerate(now) if i != rank and o}
                free = [c for c in cells if c[0] not in taken] or cells
                now[rank], go = min(free, key=lambda c: (d(s, *c), c)), False
            out.append((s, rank, *now[rank], go))
    return out


@pytest.mark.parametrize("n", [2, 4])
def test_tracks_of_a_stream(spark, tmp_path, n):
    """Three demos, so that four tracks run out of free ones; step 3 is sent twice."""
    cells = [(m, t) for m in ("a", "b", "c") for t in range(0, 10, 2)]
    d = lambda s, m, t: ((5 * s + 3 * t + 7 * ord(m)) % 13) / 10
    schema = "episode string, step long, demo string, t long, distance double"
    for i, s in enumerate([0, 1, 2, 3, 3, 4, 5]):
        spark.createDataFrame([("e", s, m, t, d(s, m, t)) for m, t in cells], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = tracks.consistent_tracks(stream, n, 0.7, 2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = spark.read.schema(tracks.TRACKS).parquet(str(tmp_path / "out")).orderBy("step", "rank").collect()
    assert [(r.step, r.rank, r.demo, r.t, r.followed) for r in got] == followed(cells, n, 0.7, 2, 6, d) and {r.followed for r in got} == {True, False}
