import json

from strandway.sources import files
from strandway.streaming import tracks


def test_scores_build_up_along_a_stream(spark, tmp_path):
    """Two episodes over two demos, a file a step, against the recursion in plain Python; step 2 is sent twice."""
    d = lambda e, s, m, t: ((7 * s + 3 * t + 5 * len(m) + (e == "y") * 2) % 11) / 10
    for n, s in enumerate([0, 1, 2, 2, 3]):
        rows = [(e, s, m, t, d(e, s, m, t)) for e in "xy" for m in ("a", "bb") for t in range(0, 12, 2)]
        spark.createDataFrame(rows, "episode string, step long, demo string, t long, distance double").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema("episode string, step long, demo string, t long, distance double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = tracks.cumulative_scores(stream, 0.8, 0.05, 4).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    got = spark.read.schema(tracks.SCORES).parquet(str(tmp_path / "out"))
    want = {}
    for e in "xy":
        for m in ("a", "bb"):
            for s in range(4):
                for t in range(0, 12, 2):
                    now, before = d(e, s, m, t), want.get((e, s - 1, m, t - 4), float("inf"))
                    want[e, s, m, t] = now if s == 0 else min(0.8 * before + 0.2 * now, now + 0.05)
    rows = got.collect()
    assert len(rows) == len(want) and all(abs(r.score - want[r.episode, r.step, r.demo, r.t]) < 1e-12 for r in rows)
    best = {(r.episode, r.step): r.demo for r in tracks.best_demos(got, 1).collect()}
    assert best == {(e, s): min((want[e, s, m, t], m) for m in ("a", "bb") for t in range(0, 12, 2))[1] for e in "xy" for s in range(4)}


def test_a_step_that_comes_in_pieces(spark, tmp_path):
    """Each step's rows over two files, some sent twice, with the next step's first rows in between; the last one is
    given out when nothing more comes."""
    import time

    d = lambda s, m, t: ((7 * s + 3 * t + 5 * len(m)) % 11) / 10
    every = [(s, m, t) for s in range(4) for m in ("a", "bb") for t in range(0, 12, 2)]
    files = [[x for x in every if (x[0], x[2] >= 6) in want] for want in ([(0, False)], [(0, True), (0, False)], [(1, True)], [(1, False), (2, True)], [(2, False)], [(3, False)], [(3, True), (1, True)])]
    for n, rows in enumerate(files):
        spark.createDataFrame([("x", s, m, t, d(s, m, t)) for s, m, t in rows], "episode string, step long, demo string, t long, distance double").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema("episode string, step long, demo string, t long, distance double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    scores = tracks.cumulative_scores_of_split_steps(stream, 0.8, 0.05, 4, 4000)
    query = scores.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(processingTime="0 seconds").start(str(tmp_path / "out"))
    began, got = time.time(), []
    while time.time() - began < 90 and len(got) < len(every):
        time.sleep(1)
        got = spark.read.schema(tracks.SCORES).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out/_spark_metadata").exists() else []
    query.stop()
    want = {}
    for s, m, t in every:
        now, before = d(s, m, t), want.get((s - 1, m, t - 4), float("inf"))
        want[s, m, t] = now if s == 0 else min(0.8 * before + 0.2 * now, now + 0.05)
    assert len(got) == len(want) and all(abs(r.score - want[r.step, r.demo, r.t]) < 1e-12 for r in got)


def test_tasks_alternate_in_episode_order(spark):
    paths = ["r/b/episode_2.h5", "r/b/episode_10.h5", "r/a/episode_1.h5", "r/b/episode_x.h5"]
    got = files.round_robin(spark.createDataFrame([(p,) for p in paths], "path string")).orderBy("turn", "task").collect()
    assert [r.path for r in got] == ["r/a/episode_1.h5", "r/b/episode_2.h5", "r/b/episode_10.h5", "r/b/episode_x.h5"]


def test_folders_of_files(spark, tmp_path):
    (tmp_path / "words/sub").mkdir(parents=True)
    (tmp_path / "words/one.txt").write_text(" bad \n\nworse\n")
    (tmp_path / "words/sub/two.txt").write_text("worst")
    assert sorted(r.word for r in files.keywords(spark, str(tmp_path / "words")).collect()) == ["bad", "worse", "worst"]
    assert files.inventory(spark, str(tmp_path / "words"), "*.txt").count() == 2
    (tmp_path / "wd.json").write_text(json.dumps({"root": "s", "data_list": ["0.tar", "1.tar"], "total_key_count": 9, "chunk_size": 5}, indent=1))
    assert [(r.root, r.shard, r.chunk_size) for r in files.shards(spark, str(tmp_path / "wd.json")).collect()] == [("s", "0.tar", 5), ("s", "1.tar", 5)]
    pools = spark.createDataFrame([("d/rot-15_1/a",), ("d/rot30_2/a",), ("d/rot30_2/b",), ("d/other/a",)], "path string")
    assert sorted((r.angle, r.folder) for r in files.rotation_pools(pools).collect()) == [(-15, "d/rot-15_1"), (30, "d/rot30_2")]


def test_trajectory_files_and_match_lists(spark, tmp_path):
    for e in (0, 7):
        spark.createDataFrame([(e * 10 + i,) for i in range(2)], "v int").toPandas().to_parquet(tmp_path / f"episode_{e:06d}.parquet")
    only = spark.createDataFrame([(7,)], "episode_index long")
    assert sorted(r.v for r in files.chunked_trajectories(spark, str(tmp_path), only).collect()) == [70, 71]
    res = spark.createDataFrame([("s/d/3", ["a"], 1), ("s/d/3", ["b", "c"], 2)], "query_id string, match_ids array<string>, f int")
    assert sorted(tuple(r) for r in files.matches_of_ids(res, "f").collect()) == [("s", "d", 3, 0, "b"), ("s", "d", 3, 1, "c")]


def test_write_once_keeps_what_is_there(spark, tmp_path):
    first, second = spark.range(3), spark.range(5)
    assert files.write_once(first, str(tmp_path / "o"), "k").count() == 3
    assert files.write_once(second, str(tmp_path / "o"), "k").count() == 3 and files.write_once(second, str(tmp_path / "o"), "l").count() == 5
