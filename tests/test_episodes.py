"""Episode rules, graphs, frozen artifacts, clips, frame corruption and merges against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandway.operators import contracts, graphs, joins
from strandway.operators import validation as val
from strandway.operators import windows as win
from strandway.sources.stages import kept

LIMITS = val.Limits(low=(-1.0, -1.0, -1.0), high=(1.0, 1.0, 1.0))
POSE = [0.1, 0.2, 0.3, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0]
FRAME = "e string, i long, step long, timestamp long, source_index long, segment_id long, gap_mask boolean, robot array<double>, state array<double>, raw array<double>"


def frame(e, i, step=None, robot=POSE, state="robot", raw=(1.0,), segment=0, gap=False, index=None, timestamp=None):
    return (e, i, i if step is None else step, i // 2 if timestamp is None else timestamp, i if index is None else index, segment, gap, robot, robot if state == "robot" else state, list(raw) if raw is not None else None)


def bent(at, x):
    return [*POSE[:at], x, *POSE[at + 1 :]]


def episodes():
    """Each episode's frames, and the names of the rules that it breaks by area."""
    fine = lambda e, n=4: [frame(e, i) for i in range(n)]
    put = lambda e, i, **x: [frame(e, k, **x) if k == i else frame(e, k) for k in range(4)]
    s, t = "structure", "time"
    return {
        "fine": (fine("fine"), {}),
        "short": (fine("short", 1), {s: ["frames: two at least"]}),
        "nine": (put("nine", 1, robot=POSE[:9]), {s: ["robot: ten numbers"]}),
        "nan": (put("nan", 1, robot=bent(0, math.nan)), {s: ["robot: finite"]}),
        "inf": (put("inf", 1, robot=bent(0, math.inf)), {s: ["robot: finite"]}),
        "hole": (put("hole", 1, robot=bent(0, None)), {s: ["robot: finite"]}),
        "none": (put("none", 1, robot=None), {s: ["robot: ten numbers", "robot: finite", "robot: first axis of length one", "robot: second axis of length one", "robot: axes at right angles", "robot: within the workspace", "robot: gripper in range"]}),
        "first": (put("first", 2, robot=bent(3, 1.001)), {s: ["robot: first axis of length one"]}),
        "second": (put("second", 2, robot=bent(7, 0.999)), {s: ["robot: second axis of length one"]}),
        "skew": (put("skew", 2, robot=[*POSE[:6], 0.001, math.sqrt(1 - 1e-6), 0.0, 1.0]), {s: ["robot: axes at right angles"]}),
        "close": (put("close", 2, robot=bent(3, 1.0001)), {}),
        "out": (put("out", 3, robot=bent(2, -1.01)), {s: ["robot: within the workspace"]}),
        "grip": (put("grip", 3, robot=bent(9, 1.1)), {s: ["robot: gripper in range"]}),
        "alias": (put("alias", 0, state=bent(0, 0.11)), {s: ["state: equals robot"]}),
        "raw": (put("raw", 0, raw=(math.nan,)), {s: ["raw: finite"]}),
        "back": ([frame("back", 0), frame("back", 1), frame("back", 2, index=1), frame("back", 3)], {t: ["source_index: rises", "source_index: is the place"]}),
        "place": ([frame("place", i, index=i + (i > 1)) for i in range(4)], {t: ["source_index: is the place"]}),
        "jump": ([frame("jump", i, step=i * 2 if i > 1 else i) for i in range(4)], {t: ["gap_mask: follows the gap rule", "segment_id: counts the gaps"]}),
        "gap": ([frame("gap", 0), frame("gap", 1), frame("gap", 2, step=5, gap=True, segment=1), frame("gap", 3, step=6, segment=1)], {}),
        "time": ([frame("time", 0, timestamp=9), *[frame("time", i, timestamp=3) for i in (1, 2, 3)]], {t: ["gap_mask: follows the gap rule", "segment_id: counts the gaps"]}),
    }


@pytest.fixture(scope="module")
def judged(spark):
    rows = [r for frames, _ in episodes().values() for r in frames]
    f = val.with_time_audit(spark.createDataFrame(rows, FRAME), ["e"], ["i"], LIMITS)
    f = val.with_motion(f, ["e"], ["i"], ["robot"])
    blank = spark.createDataFrame([(e,) for e in [*episodes(), "ghost"]], "e string").withColumn("attributes", F.create_map().cast("map<string,string>"))
    rules = [*val.frame_rules(["robot"], ["raw"], LIMITS, ("state", "robot")), val.episode_rules()[0]]
    return {r.e: r for r in val.validated(f, blank, ["e"], rules, val.pose_metrics(["robot"])).collect()}


@pytest.mark.parametrize("name", episodes())
def test_each_fault_is_named(judged, name):
    want = episodes()[name][1]
    row = judged[name]
    assert {a: row[f"{a}_errors"] for a in val.AREAS} == {a: want.get(a, []) for a in val.AREAS}
    assert row.status == ("failed" if want else "passed")


def test_facts_of_an_episode(judged):
    assert (judged["gap"].gaps, judged["gap"].segments, judged["gap"].timebase, judged["gap"].step_jumps) == (1, 2, "discontinuous", 1)
    assert judged["fine"].timebase == "coarse" and judged["fine"].timestamp_repeats == 2 and judged["time"].timestamp_rollbacks == 1
    assert judged["out"].robot_z_min == -1.01 and abs(judged["out"].robot_linear_step - 1.31) < 1e-9 and judged["gap"].robot_linear_step == 0
    assert judged["ghost"].status == "failed" and judged["ghost"].frames is None and "frames: two at least" in judged["ghost"].structure_errors


def test_attributes_and_copies(spark):
    contract = val.Contract(("task",), {"policy": "native"}, {"url": "https://"}, {"hash": 3}, {"split": ("a", "b")})
    good = {"task": "t", "policy": "native", "url": "https://x", "hash": "abc", "split": "a", **dict.fromkeys(val.COUNTS, "0"), "segments": "1", "timestamp_repeats": "1", "timebase": "coarse", "source_frames": "3", "canonical_frames": "3"}
    changes = {"good": {}, "task": {"task": None}, "policy": {"policy": "other"}, "url": {"url": "http://x"}, "hash": {"hash": "ab"}, "split": {"split": "c"}, "gaps": {"gaps": "1"}, "text": {"gaps": "x"}, "frames": {"source_frames": "4"}, "base": {"timebase": "trusted"}, "copy": {}, "longer": {}}
    rows = [frame(e, i) for e in changes for i in range(3)]
    f = val.with_time_audit(spark.createDataFrame(rows, FRAME), ["e"], ["i"], LIMITS)
    source = spark.createDataFrame([frame(e, i, step=7 if e == "copy" and i == 1 else None) for e in changes for i in range(4 if e == "longer" else 3)], FRAME)
    attributes = spark.createDataFrame([(e, {k: v for k, v in {**good, **c}.items() if v is not None}) for e, c in changes.items()], "e string, attributes map<string,string>")
    got = val.validated(f, attributes, ["e"], [*val.attribute_rules(contract), *val.episode_rules()], {}, source, "source_index", ["step", "robot"]).collect()
    found = {r.e: r.structure_errors + r.time_errors + r.evidence_errors for r in got}
    assert found == {
        "good": [], "task": ["task: present"], "policy": ["policy: native"], "url": ["url: begins https://"], "hash": ["hash: 3 long"], "split": ["split: allowed"], "gaps": ["gaps: as stored"],
        "text": ["gaps: as stored"], "frames": ["source_frames: the number of frames"], "base": ["timebase: as recomputed"], "copy": ["step: copied from the source"],
        "longer": ["source: as many frames", "step: copied from the source", "robot: copied from the source"],
    }


def graph_of(spark, edges, n):
    return spark.range(n).toDF("id"), spark.createDataFrame(edges, "parent long, child long")


def test_levels_by_rounds(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(c), c) for c in range(1, 60) for _ in range(rng.randrange(0, 3))] + [(3, 9), (3, 9)]
    level = {}
    for c in range(60):
        level[c] = max((level[p] + 1 for p, x in edges if x == c), default=0)
    assert {r.id: r.level for r in graphs.levels(*graph_of(spark, edges, 60), kept).collect()} == level


@pytest.mark.parametrize(("edges", "said"), [([(0, 1), (1, 2), (2, 1)], "cycle"), ([(0, 1), (2, 2)], "2 depends on itself"), ([(0, 1), (7, 2)], "unknown node 7")])
def test_unsound_graphs_are_refused(spark, edges, said):
    with pytest.raises(ValueError, match=said):
        graphs.levels(*graph_of(spark, edges, 4), kept)


def test_graphs_without_edges_or_nodes(spark):
    nodes, none = graph_of(spark, [], 3)
    assert sorted(tuple(r) for r in graphs.levels(nodes, none, kept).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert graphs.levels(nodes.limit(0), none, kept).isEmpty()
    loop = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "parent long, child long")
    assert sorted(tuple(r) for r in graphs.reached(nodes.where("id = 1"), loop, kept).collect()) == [(0, 2), (1, 0), (2, 1)]


def test_faults_are_passed_on(spark):
    now = spark.createDataFrame([(i, f"h{i}") for i in "abcdefg"], "id string, sha256 string")
    parents = spark.createDataFrame([("b", "a", "ha"), ("c", "b", "old"), ("d", "c", "hc"), ("e", "d", "hd"), ("e", "b", "hb"), ("f", "gone", "x"), ("f", "a", None), ("g", "e", "he"), ("g", "f", "hf")], "id string, parent string, sha256 string")
    got = {r.id: (r.own, r.missing, r.steps, r.status) for r in contracts.frozen(now, parents, kept).collect()}
    assert got == {"a": (0, 0, None, "valid"), "b": (0, 0, None, "valid"), "c": (1, 0, 0, "broken"), "d": (0, 0, 1, "stale"), "e": (0, 0, 2, "stale"), "f": (1, 1, 0, "broken"), "g": (0, 0, 1, "stale")}


def test_checks_and_sorted_json(spark):
    row = spark.createDataFrame([(1, 2, "x", None)], "k int, a int, b string, c string")
    assert [tuple(r) for r in contracts.failed_checks(row, "k", {"two": F.col("a") == 2, "y": F.col("b") == "y", "unknown": F.col("c") == "z"}).collect()] == [(1, "y"), (1, "unknown")]
    import hashlib

    cells = {"b": F.col("b"), "a": F.col("a"), "c": F.col("c")}
    both = row.select(contracts.sorted_json_hash(cells).alias("x"), contracts.sorted_json_hash(dict(reversed(cells.items()))).alias("y")).first()
    assert both.x == both.y == hashlib.sha256(b'{"a":2,"b":"x","c":null}').hexdigest()


def placed(spark, values):
    rows = [(k, i, v, len(vs)) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "k string, pos long, v double, n long")


def test_clip_starts(spark):
    rng = random.Random(8)
    values = {f"s{n}": [float(rng.randrange(4)) for _ in range(n)] for n in (3, 8, 9, 10, 14, 40, 77)} | {"even": [1.0] * 40, "null": [None] * 20}
    want = {}
    for k, vs in values.items():
        starts = range(1, len(vs) - 8 + 1, 3) if len(vs) > 8 else []
        want[k] = max(((sum(vs[j] or 0 for j in range(s + 3, s + 8, 3)), s) for s in starts), default=(0, 0))[1]
    assert {r.k: r.first for r in win.clip_start(placed(spark, values), ["k"], ["pos"], ["v"], 8, 3).collect()} == want and want["even"] == 31


@pytest.mark.parametrize(("kind", "severity"), [("drop", 0.05), ("drop", 0.2), ("drop", 1.0), ("jitter", 5.0), ("jitter", 20.0), ("jitter", 500.0), ("pause", 0.2), ("pause", 0.5), ("pause", 0.05), ("jump", 1), ("jump", 5), ("jump", 20)])
@pytest.mark.parametrize("h", [1, 8, 12])
def test_frame_corruption(spark, kind, severity, h):
    rng = random.Random(6)
    values = {"a": [float(i) for i in range(3 * h + 2)], "b": [rng.random() for _ in range(h)], "c": [1.0] * (h - 1)}
    draws = {(k, i): (i * 37 % 101) / 101 for k, vs in values.items() for i in range(len(vs))}
    df = placed(spark, values).withColumn("u", F.col("pos") * 37 % 101 / 101)
    shown = win.shown_values(win.shown_rows(df, ["k"], ["pos"], h, kind, severity, F.col("u")), ["k"], ["pos"], "v")
    want = {}
    for k, vs in values.items():
        for w in range(len(vs) // h):
            own, draw = vs[w * h : w * h + h], [draws[k, w * h + j] for j in range(h)]
            if kind == "drop":
                lost = sorted(range(1, h), key=lambda j: (draw[j], j))[: min(h - 1, max(1, math.ceil(severity * h)))]
                out = []
                for j in range(h):
                    out.append(out[-1] if j in lost else own[j])
            elif kind == "jitter":
                out = []
                for j in range(h):
                    at = min(max(j + (draw[j] * 2 - 1) * severity * 30 / 1000, 0), h - 1)
                    a, b = math.floor(at), math.ceil(at)
                    out.append(own[a] * (1 - (at - a)) + own[b] * (at - a))
            elif kind == "pause":
                length = min(h - 1, max(1, round(severity * 30)))
                start = max(1, (h - length) // 2)
                out = [own[start - 1] if start <= j < start + length else own[j] for j in range(h)]
            else:
                out = [own[min(j + severity, h - 1)] if j >= max(1, h // 2) else own[j] for j in range(h)]
            want |= {(k, w * h + j): x for j, x in enumerate(out)}
    got = {(r.k, r.pos): r.shown for r in shown.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_first_of_a_key_in_stream_order(spark):
    a = spark.createDataFrame([(1, "z", 0), (1, "b", 1), (2, None, 3), (2, "x", 4), (None, "n", 0)], "k int, v string, o int")
    b = spark.createDataFrame([(1, "q", 5), (3, "r", 1)], "k int, v string, o int")
    got = {r.k: (r.a, r.b, r.missing) for r in joins.ordered_merge({"a": a, "b": b}, "k", "v", "o").collect()}
    assert got == {1: ("z", "q", []), 2: (None, None, ["b"]), 3: (None, "r", ["a"])}


def test_plans_are_played_out(spark):
    plans = {0: ["a0", "a1", "a2"], 1: ["x"], 2: ["y"], 3: None, 4: ["z"], 6: ["c0"], 7: ["w", "w"]}
    rows = spark.createDataFrame([("k", i, plans.get(i)) for i in range(8)], "k string, pos long, plan array<string>")
    got = win.open_loop_actions(rows, ["k"], ["pos"], "plan", 3).orderBy("pos").collect()
    assert [r.action for r in got] == ["a0", "a1", "a2", None, None, None, "c0", None] and [r.planned_at for r in got] == [0, 0, 0, 3, 3, 3, 6, 6]
