"""Queries of shards, late reads, validation, dependency graphs, clips, frame corruption and merges over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandway.functions.seeds import uniform, uniform_sql
from strandway.functions.vectors import stepped
from strandway.operators import contracts, graphs, joins, shuffling
from strandway.operators import validation as val
from strandway.operators import windows as win
from strandway.plans.catalog import query
from strandway.plans.queries_core import FRAMES, KEYS, ORDER, frames, rounded, table
from strandway.sources import late, shards
from strandway.sources.stages import kept, shared_root
from strandway.streaming import stalls


@query("c6_grouped_shards", "SELECT CAST(doc_id AS VARCHAR) AS key, text, lang, source, n_chars FROM documents")
def c6(spark, sf_dir):
    """Documents written as shards of a text and a JSON member each, and read back as samples."""
    folder = f"{shared_root(spark)}/strandway-{uuid.uuid4().hex}/shards"
    docs = table(spark, sf_dir, "documents")
    shards.write(docs, folder, F.col("doc_id"), {"txt": F.col("text"), "json": F.to_json(F.struct("lang", "source", "n_chars"))}, 500)
    read = shards.members(shards.samples(spark, folder, 2), ["txt", "json"])
    facts = F.from_json(F.decode("json", "UTF-8"), "lang string, source string, n_chars long")
    return read.select("key", F.decode("txt", "UTF-8").alias("text"), facts.alias("f")).select("key", "text", "f.*")


@query("a7_late_rows", "SELECT doc_id, lang, source, n_chars, text FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) <= 2")
def a7(spark, sf_dir):
    """The two longest documents of each source and language, chosen without reading texts."""
    path = f"{sf_dir}/documents.parquet"
    narrow = late.addressed(spark, path, ["doc_id", "lang", "source", "n_chars"])
    from strandway.operators.selection import top_k

    chosen = top_k(narrow, ["lang", "source"], [F.desc("n_chars"), F.col("doc_id")], 2)
    return late.late_read(chosen, path, ["text"]).select("doc_id", "lang", "source", "n_chars", "text")


@query(
    "a15_late_windows",
    """WITH p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, max(value) OVER (PARTITION BY user_id) AS top FROM events),
    c AS (SELECT user_id, min(event_id) AS event_id FROM p WHERE value = top GROUP BY user_id)
    SELECT c.user_id, c.event_id, count(*) AS frames, string_agg(e.event_id || ':' || e.event_type || ':' || coalesce(e.props, ''), ',' ORDER BY e.event_id) AS content
    FROM c JOIN events e ON e.user_id = c.user_id AND e.event_id BETWEEN c.event_id - 40 AND c.event_id + 40 GROUP BY ALL""",
)
def a15(spark, sf_dir):
    """The frames around each user's largest value, chosen on three columns, their content read late."""
    path = f"{sf_dir}/events.parquet"
    top = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(-F.col("value"), F.col("event_id"))).alias("event_id"))
    found = late.late_windows(top, path, ["user_id"], "event_id", ["event_type", "props"], 40, 40)
    text = F.array_join(F.transform("frames", lambda f: F.concat_ws(":", f["event_id"].cast("string"), f["event_type"], F.coalesce(f["props"], F.lit("")))), ",")
    return found.select("user_id", "event_id", F.size("frames").cast("long").alias("frames"), text.alias("content"))


@query("j14_shuffled_rows", "SELECT event_id, user_id FROM events")
def j14(spark, sf_dir):
    """Events in the order in which a buffer of 1000 rows lets them go; as a set of rows, all of them."""
    return shuffling.shuffled(table(spark, sf_dir, "events").select("event_id", "user_id"), ["event_id"], 1000, seed=7, epoch=1)


@query(
    "d32_operation_statistics",
    "SELECT event_type AS name, count(value) AS count, round(sum(value), 4) AS total_time, max(value) AS max_time, arg_max(value, (ts, event_id)) AS last_time, round(avg(value), 6) AS avg_time FROM events GROUP BY event_type",
)
def d32(spark, sf_dir):
    s = stalls.operation_statistics(table(spark, sf_dir, "events").withColumnRenamed("event_type", "name"), "name", "value", ["ts", "event_id"])
    return s.withColumns({"total_time": rounded("total_time", 4), "avg_time": rounded("avg_time")})


_GRAPH = "e AS (SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey > 1 UNION SELECT p_partkey - 3, p_partkey FROM part WHERE p_partkey % 5 = 0 AND p_partkey > 3)"


def whole_graph(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    a = p.where("p_partkey > 1").select(F.expr("p_partkey div 2").alias("parent"), F.col("p_partkey").alias("child"))
    b = p.where("p_partkey % 5 = 0 AND p_partkey > 3").select((F.col("p_partkey") - 3).alias("parent"), F.col("p_partkey").alias("child"))
    return p.select(F.col("p_partkey").alias("id")), a.unionByName(b).distinct()


@query("f9_levels_of_whole_table", f"WITH RECURSIVE {_GRAPH}, l AS (SELECT p_partkey AS id, 0 AS level FROM part UNION SELECT child, level + 1 FROM l JOIN e ON parent = id) SELECT id, max(level) AS level FROM l GROUP BY id")
def f9_whole(spark, sf_dir):
    return graphs.levels(*whole_graph(spark, sf_dir), kept)


@query("f10_ready_of_whole_table", f"WITH {_GRAPH}, d AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 1) SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE child = p_partkey AND parent % 3 = 1)")
def f10_whole(spark, sf_dir):
    nodes, edges = whole_graph(spark, sf_dir)
    return graphs.ready(nodes, edges, nodes.where("id % 3 <> 1"))


@query("f11_closure_of_whole_table", "WITH RECURSIVE c AS (SELECT p_partkey // 2 AS ancestor, p_partkey AS descendant FROM part WHERE p_partkey > 1 UNION SELECT ancestor // 2, descendant FROM c WHERE ancestor > 1) SELECT * FROM c")
def f11_whole(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey > 1")
    return graphs.closure(p.select(F.expr("p_partkey div 2").alias("parent"), F.col("p_partkey").alias("child")), kept)


_NOW = "sha256(p_name || '|' || p_brand || '|' || p_size)"


@query(
    "b24_frozen_artifacts",
    f"""WITH RECURSIVE {_GRAPH}, now AS (SELECT p_partkey AS id, {_NOW} AS h, sha256(p_name || '|' || p_brand || '|' || (p_size + 1)) AS old FROM part WHERE p_partkey % 211 <> 210),
    held AS (SELECT e.child AS id, n.h, CASE WHEN e.parent % 97 = 5 THEN p.old ELSE p.h END AS was FROM e JOIN (SELECT p_partkey AS id, {_NOW} AS h, sha256(p_name || '|' || p_brand || '|' || (p_size + 1)) AS old FROM part) p ON p.id = e.parent LEFT JOIN now n ON n.id = e.parent),
    facts AS (SELECT now.id, count(*) FILTER (held.id IS NOT NULL AND held.h IS NOT NULL AND held.h <> held.was) AS own, count(*) FILTER (held.id IS NOT NULL AND held.h IS NULL) AS missing FROM now LEFT JOIN held USING (id) GROUP BY now.id),
    spread AS (SELECT id, 0 AS steps FROM facts WHERE own + missing > 0 UNION SELECT child, steps + 1 FROM spread JOIN e ON parent = id WHERE steps < 64),
    near AS (SELECT id, min(steps) AS steps FROM spread GROUP BY id)
    SELECT facts.id, own, missing, CAST(steps AS INT) AS steps, CASE WHEN own + missing > 0 THEN 'broken' WHEN steps IS NOT NULL THEN 'stale' ELSE 'valid' END AS status FROM facts LEFT JOIN near USING (id)""",
)
def b24(spark, sf_dir):
    """Parts as artifacts that rest on others: some parents were frozen with another hash, some are gone."""
    p = table(spark, sf_dir, "part")
    text = lambda size: F.sha2(F.concat_ws("|", "p_name", "p_brand", size.cast("string")), 256)
    hashes = p.select(F.col("p_partkey").alias("parent"), text(F.col("p_size")).alias("h"), text(F.col("p_size") + 1).alias("old"))
    edges = whole_graph(spark, sf_dir)[1]
    parents = edges.join(hashes.hint("merge"), "parent").select(F.col("child").alias("id"), "parent", F.when(F.col("parent") % 97 == 5, F.col("old")).otherwise(F.col("h")).alias("sha256"))
    artifacts = hashes.where("parent % 211 <> 210").select(F.col("parent").alias("id"), F.col("h").alias("sha256"))
    return contracts.frozen(artifacts, parents, kept)


@query(
    "d30_sorted_hash",
    """SELECT p_partkey, sha256('{"a_size":' || coalesce(CAST(p_size AS VARCHAR), 'null') || ',"brand":"' || p_brand || '","none":null,"part":' || p_partkey || '}') AS sha256 FROM part""",
)
def d30_sorted(spark, sf_dir):
    cells = {"part": F.col("p_partkey"), "brand": F.col("p_brand"), "a_size": F.col("p_size"), "none": F.lit(None).cast("string")}
    return table(spark, sf_dir, "part").select("p_partkey", contracts.sorted_json_hash(cells).alias("sha256"))


@query(
    "c4_ordered_merge",
    """WITH a AS (SELECT l_orderkey AS k, arg_min(l_linenumber, (l_linenumber * 7 % 5, l_linenumber)) AS lines FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, o_orderpriority AS priority FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT coalesce(a.k, o.k) AS key, lines, priority, CASE WHEN a.k IS NULL THEN 'lines' WHEN o.k IS NULL THEN 'priority' ELSE '' END AS missing FROM a FULL JOIN o ON a.k = o.k""",
)
def c4_ordered(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("string").alias("v"), F.struct((F.col("l_linenumber") * 7 % 5).alias("a"), F.col("l_linenumber").alias("b")).alias("at"))
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("v"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")).alias("at"))
    return joins.ordered_merge({"lines": lines, "priority": orders}, "key", "v", "at").withColumns({"lines": F.col("lines").cast("int"), "missing": F.array_join("missing", ",")})


@query(
    "e24_clip_start",
    f"""WITH {FRAMES}, k AS (SELECT f.*, abs(value - lag(value) OVER w) AS human, abs(event_id % 13 - lag(event_id % 13) OVER w) AS robot FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    z AS (SELECT user_id, pos, n, sum(CAST(round(coalesce(human, 0) * 100) AS BIGINT) + 100 * coalesce(robot, 0)) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS e FROM k WHERE (pos - 1) % 5 = 0),
    b AS (SELECT user_id, arg_max(pos, (coalesce(e, 0), pos)) AS first FROM z WHERE pos + 16 <= n GROUP BY user_id)
    SELECT DISTINCT f.user_id, coalesce(first, 0) AS first FROM f LEFT JOIN b USING (user_id)""",
)
def e24_start(spark, sf_dir):
    """Clips of 16 events by the motion of two signals, to whole cents so that sums are the same in any order."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*KEYS).orderBy(*ORDER)
    moved = lambda c: F.abs(c - F.lag(c).over(w))
    f = frames(spark, sf_dir).withColumns({"human": F.round(moved(F.col("value")) * 100).cast("long"), "robot": moved(F.col("event_id") % 13) * 100})
    return win.clip_start(f, KEYS, ORDER, ["human", "robot"], 16, 5)


_WIDTH = 8
_DRAW = uniform_sql("'drop' || event_id")


@query(
    "e29_frame_corruption",
    f"""WITH {FRAMES}, w AS (SELECT *, pos // {_WIDTH} AS win, pos % {_WIDTH} AS place, {_DRAW} AS u FROM f WHERE pos // {_WIDTH} * {_WIDTH} + {_WIDTH} <= n),
    r AS (SELECT *, place > 0 AND row_number() OVER (PARTITION BY user_id, win ORDER BY CASE WHEN place > 0 THEN u END NULLS LAST, place) <= 2 AS lost, list(value) OVER (PARTITION BY user_id, win ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS vs,
           least(greatest(place + (u * 2 - 1) * 10.0 * 30.0 / 1000.0, 0.0), {_WIDTH - 1}.0) AS spot FROM w)
    SELECT event_id, vs[1 + max(CASE WHEN lost THEN NULL ELSE place END) OVER (PARTITION BY user_id, win ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)] AS dropped,
           round(vs[1 + CAST(floor(spot) AS INT)] * (1 - (spot - floor(spot))) + vs[1 + CAST(ceil(spot) AS INT)] * (spot - floor(spot)), 6) AS jittered,
           vs[1 + CASE WHEN place BETWEEN 1 AND 6 THEN 0 ELSE place END] AS paused, vs[1 + CASE WHEN place >= 4 THEN least(place + 1, {_WIDTH - 1}) ELSE place END] AS jumped
    FROM r""",
)
def e29_frames(spark, sf_dir):
    """Twenty percent of frames dropped, 10 ms of jitter, a pause of 0.2 s and a jump of one step, in windows of eight."""
    f, draw, out = frames(spark, sf_dir), uniform(F.concat(F.lit("drop"), F.col("event_id").cast("string"))), None
    for name, kind, severity in (("dropped", "drop", 0.2), ("jittered", "jitter", 10.0), ("paused", "pause", 0.2), ("jumped", "jump", 1)):
        base = f if out is None else out
        shown = win.shown_values(win.shown_rows(base, KEYS, ORDER, _WIDTH, kind, severity, draw), KEYS, ORDER, "value")
        out = shown.withColumn(name, F.col("shown")).drop("window", "place", "left", "right", "share", "shown")
    return out.select("event_id", "dropped", rounded("jittered").alias("jittered"), "paused", "jumped")


_LIMITS = val.Limits(low=(0.0, 0.0, 0.0), high=(0.3, 1.0, 1.0), step_gap=360, timestamp_gap=21600)
_CONTRACT = val.Contract(present=("task", "schema"), equal={"schema": "v3", "policy": "preserve_native"}, begins={"url": "https://"}, length={"manifest": 64}, one_of={"split": ("train", "heldout")})
_AUDIT = ", ".join(
    f"count(*) FILTER ({cond}) AS {name}"
    for name, cond in (
        ("step_repeats", "ds = 0"), ("step_jumps", "ds > 360"), ("step_rollbacks", "ds < 0"), ("timestamp_repeats", "dt2 = 0"), ("timestamp_jumps", "dt2 > 21600"), ("timestamp_rollbacks", "dt2 < 0"), ("gaps", "gap"),
    )
)
#: Whether an episode breaks a rule, in SQL, by the area and in the order of the rules.
_BROKEN = {
    "structure": {
        "robot: first axis of length one": "bool_or(event_id % 601 = 3)", "robot: within the workspace": "bool_or(value / 1000 > 0.3)", "robot: gripper in range": "bool_or(event_id % 701 = 7)",
        "raw: finite": "bool_or(event_id % 907 = 2)", "state: equals robot": "bool_or(event_id % 809 = 1)", "task: present": "user_id % 11 = 0", "frames: two at least": "count(*) < 2",
    },
    "time": {
        "source_index: is the place": "bool_or(user_id % 7 = 3 AND pos >= 2)", "gap_mask: follows the gap rule": "bool_or(event_id % 997 = 5)", "segment_id: counts the gaps": "user_id % 13 = 4",
        "timebase: as recomputed": "user_id % 31 = 5 AND (count(*) FILTER (gap) > 0 OR count(*) FILTER (dt2 <> 0) = 0)", "gaps: as stored": "user_id % 29 = 4", "source_frames: the number of frames": "user_id % 23 = 3",
    },
    "evidence": {"policy: preserve_native": "user_id % 17 = 1", "manifest: 64 long": "user_id % 19 = 2"},
}
_LISTS = {a: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in rules.items()) + "], lambda x: x IS NOT NULL), ';')" for a, rules in _BROKEN.items()}


@query(
    "b18_validated_episodes",
    f"""WITH {FRAMES}, a AS (SELECT *, t // 60000000 AS step, t // 1000000 AS sec FROM f),
    b AS (SELECT *, step - lag(step) OVER w AS ds, sec - lag(sec) OVER w AS dt2, value - lag(value) OVER w AS dv FROM a WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    c AS (SELECT *, coalesce(ds < 0 OR ds > 360 OR dt2 < 0 OR dt2 > 21600, false) AS gap FROM b),
    e AS (SELECT user_id, {", ".join(f"{x} AS {k}_errors" for k, x in _LISTS.items())}, count(*) AS frames, {_AUDIT},
        round(max(value) / 1000, 6) AS robot_x_max, round(coalesce(max(abs(dv) / 1000) FILTER (NOT gap), 0), 6) AS robot_linear_step, round(coalesce(max(acos(cos(dv))) FILTER (NOT gap), 0), 5) AS robot_angular_step FROM c GROUP BY user_id)
    SELECT user_id, CASE WHEN structure_errors || time_errors || evidence_errors = '' THEN 'passed' ELSE 'failed' END AS status, structure_errors, time_errors, evidence_errors, frames, step_repeats, step_jumps, step_rollbacks,
           timestamp_repeats, timestamp_jumps, timestamp_rollbacks, gaps, gaps + 1 AS segments, robot_x_max, robot_linear_step, robot_angular_step FROM e""",
)
def b18(spark, sf_dir):
    """Each user's events as a recorded episode with faults planted by id, and attributes that repeat its audit or not."""
    e, u = F.col("event_id"), F.col("user_id")
    f = frames(spark, sf_dir).drop("gap_mask", "segment_id")
    f = f.withColumns({"step": F.expr("t div 60000000"), "timestamp": F.expr("t div 1000000"), "source_index": F.col("pos") + F.when((u % 7 == 3) & (F.col("pos") >= 2), 1).otherwise(0)})
    f = val.with_time_audit(f, KEYS, ORDER, _LIMITS)
    v, bent = F.col("value"), F.when(e % 601 == 3, 1.01).otherwise(1.0)
    zero = F.lit(0.0)
    pose = F.array(v / 1000, F.lit(0.1), F.lit(0.2), F.cos(v) * bent, F.sin(v) * bent, zero, -F.sin(v), F.cos(v), zero, F.when(e % 701 == 7, 2.0).otherwise((e % 2).cast("double")))
    f = f.withColumns({"robot": pose, "gap_mask": F.col("_gap") != (e % 997 == 5), "segment_id": F.col("_segment") + F.when(u % 13 == 4, 1).otherwise(0), "raw": F.array(v, F.when(e % 907 != 2, e.cast("double")))})
    f = val.with_motion(f.withColumn("state", F.when(e % 809 != 1, F.col("robot"))), KEYS, ORDER, ["robot"])
    rules = [*val.frame_rules(["robot"], ["raw"], _LIMITS, ("state", "robot")), *val.attribute_rules(_CONTRACT), *val.episode_rules()]
    metrics = val.pose_metrics(["robot"])
    blank = f.select("user_id").distinct().withColumn("attributes", F.create_map().cast("map<string,string>"))
    audit = val.validated(f, blank, KEYS, [], {})
    cells = {c: F.col(c) + F.when(u % 29 == 4, 1).otherwise(0) if c == "gaps" else F.col(c) for c in val.COUNTS}
    cells |= {"source_frames": F.col("frames") + F.when(u % 23 == 3, 1).otherwise(0), "canonical_frames": F.col("frames"), "timebase": F.when(u % 31 == 5, "coarse").otherwise(F.col("timebase"))}
    cells |= {"schema": F.lit("v3"), "task": F.when(u % 11 != 0, "pour"), "policy": F.when(u % 17 == 1, "resampled").otherwise("preserve_native"), "url": F.lit("https://example.org")}
    cells |= {"manifest": F.when(u % 19 == 2, "short").otherwise(F.sha2(F.lit("m"), 256)), "split": F.when(u % 2 == 0, "train").otherwise("heldout")}
    attributes = audit.select("user_id", F.create_map(*[x for k, c in cells.items() for x in (F.lit(k), c.cast("string"))]).alias("attributes"))
    got = val.validated(f, attributes, KEYS, rules, metrics)
    text = [F.array_join(f"{a}_errors", ";").alias(f"{a}_errors") for a in val.AREAS]
    return got.select("user_id", "status", *text, "frames", *val.COUNTS, *[rounded(c, d).alias(c) for c, d in (("robot_x_max", 6), ("robot_linear_step", 6), ("robot_angular_step", 5))])


#: Poses that turn about the upright axis by an angle, so that errors of orientation are differences of angles.
_ERRORS = "sqrt((px - qx) ** 2 + (py - qy) ** 2) AS position, acos(greatest(-1.0, least(1.0, cos(pa - qa)))) AS orientation, abs(pg - qg) AS gripper, sqrt((px - qx) ** 2 + (py - qy) ** 2 + 2 * (cos(pa) - cos(qa)) ** 2 + 2 * (sin(pa) - sin(qa)) ** 2 + (pg - qg) ** 2) AS canonical"


def pose(x, y, angle, gripper):
    zero = F.lit(0.0)
    return F.array(x.cast("double"), y.cast("double"), F.lit(0.3), F.cos(angle), F.sin(angle), zero, -F.sin(angle), F.cos(angle), zero, gripper.cast("double"))


@query(
    "e32_view_comparison",
    f"""WITH {FRAMES}, v(view, k) AS (VALUES ('native', 1), ('camera_30hz', 1), ('stride_4', 4), ('stride_3', 3), ('policy_10hz', 3), ('phase', NULL)),
    b AS (SELECT *, least(sn, 8) AS bins FROM s), ph AS (SELECT DISTINCT user_id, segment_id, CAST(round_even(CASE WHEN bins > 1 THEN i * ((sn - 1) / (bins - 1)) ELSE 0 END, 0) AS BIGINT) AS spos FROM b, range(8) r(i) WHERE i < bins),
    rows AS (SELECT view, b.* FROM b, v WHERE k IS NOT NULL AND spos % k = 0 UNION ALL SELECT 'phase', b.* FROM b JOIN ph USING (user_id, segment_id, spos)),
    p AS (SELECT view, value / 100 AS px, event_id % 7 AS py, value AS pa, event_id % 2 AS pg, lead(value / 90) OVER w AS qx, lead(event_id % 5) OVER w AS qy, lead(value * 0.9) OVER w AS qa, lead((event_id + 1) % 2) OVER w AS qg FROM rows WINDOW w AS (PARTITION BY view, user_id, segment_id ORDER BY t, event_id)),
    m AS (SELECT view, sqrt(qx ** 2 + qy ** 2 + 0.09 + 2 + qg ** 2) AS absolute, {_ERRORS} FROM p WHERE qx IS NOT NULL)
    SELECT view, count(*) AS n, 0 AS crossings, round(median(canonical), 6) AS residual_median, round(median(absolute), 6) AS absolute_median, round(median(position), 6) AS position_median, round(median(orientation), 5) AS orientation_median, round(median(gripper), 6) AS gripper_median FROM m GROUP BY view""",
)
def e32_views(spark, sf_dir):
    from strandway.functions.vectors import norm
    from strandway.operators.evaluation import pose_errors
    from strandway.operators.quantiles import medians_of
    from strandway.plans.queries_core import in_segments

    e, v = F.col("event_id"), F.col("value")
    f = in_segments(spark, sf_dir).withColumns({"human": pose(v / 100, e % 7, v, e % 2), "robot": pose(v / 90, e % 5, v * 0.9, (e + 1) % 2)})
    pairs = win.view_pairs(f, KEYS, ORDER, "human", "robot", {"native": 1, "camera_30hz": 1, "stride_4": 4, "stride_3": 3, "policy_10hz": 3}, {"phase": 8})
    errors = pose_errors(F.col("pool"), F.col("target"))
    m = kept(pairs.select("view", "crosses", errors["canonical"].alias("residual"), norm(F.col("target")).alias("absolute"), *[errors[k].alias(k) for k in ("position", "orientation", "gripper")]))
    crossings = m.groupBy("view").agg(F.count_if("crosses").cast("int").alias("crossings"))
    names = ["residual", "absolute", "position", "orientation", "gripper"]
    return medians_of(m, ["view"], names).join(crossings, "view").select("view", "n", "crossings", *[rounded(f"{c}_median", 5 if c == "orientation" else 6).alias(f"{c}_median") for c in names])


_E = "CAST(embedding[{}] AS DOUBLE)"


@query(
    "h19_pose_window_metrics",
    f"""WITH p AS (SELECT vec_id // 8 AS win, vec_id % 8 AS step, {", ".join(f"{_E.format(i + 1)} AS {c}" for i, c in enumerate(("px", "py", "pa", "pg", "qx", "qy", "qa", "qg")))} FROM embeddings), m AS (SELECT win, step, {_ERRORS} FROM p)
    SELECT win, round(median(position), 6) AS position_median, round(median(orientation), 5) AS orientation_median, round(median(gripper), 6) AS gripper_median, round(median(canonical), 6) AS canonical_median,
           round(arg_max(position, step), 6) AS final_position, round(arg_max(orientation, step), 5) AS final_orientation FROM m GROUP BY win""",
)
def h19_poses(spark, sf_dir):
    from strandway.operators.evaluation import pose_window_metrics

    c = [F.col("embedding")[i].cast("double") for i in range(8)]
    steps = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("win"), (F.col("vec_id") % 8).alias("step"), pose(*c[:4]).alias("p"), pose(*c[4:]).alias("q"))
    m = pose_window_metrics(steps, ["win"], "step", "p", "q")
    return m.select("win", *[rounded(x, 5 if "orientation" in x else 6).alias(x) for x in m.columns[1:]])


@query(
    "d14_projected_mean",
    f"""WITH p AS (SELECT vec_id // 4 AS k, {", ".join(f"avg({x}) AS {c}" for c, x in (("x", _E.format(1)), ("y", _E.format(2)), ("c", f"cos({_E.format(3)} * 9)"), ("s", f"sin({_E.format(3)} * 9)"), ("g", _E.format(4))))} FROM embeddings GROUP BY 1)
    SELECT k, round(x, 6) AS x, round(y, 6) AS y, round(c / sqrt(c * c + s * s), 6) AS m00, round(-s / sqrt(c * c + s * s), 6) AS m01, round(greatest(0, least(1, g)), 6) AS gripper, false AS fell_back FROM p""",
)
def d14_projected(spark, sf_dir):
    """The mean pose of every four vectors, whose rotations about the upright axis are far apart."""
    from strandway.operators.evaluation import projected_mean

    c = [F.col("embedding")[i].cast("double") for i in range(4)]
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("k"), "vec_id", pose(c[0], c[1], c[2] * 9, c[3]).alias("p"))
    m, at = projected_mean(rows, ["k"], "vec_id", "p"), lambda i: rounded(F.col("pose")[i])
    return m.select("k", at(0).alias("x"), at(1).alias("y"), at(3).alias("m00"), at(6).alias("m01"), at(9).alias("gripper"), "fell_back")


_VECTOR = "CAST([embedding[1], embedding[2], embedding[3], embedding[4]] AS DOUBLE[])"


@query(
    "c12_nearest_of_whole_pool",
    f"""WITH v AS (SELECT vec_id, label, {_VECTOR} AS x FROM embeddings),
    p AS (SELECT a.label, a.vec_id AS query, b.vec_id AS match, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) ** 2))) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT label, query, match, CAST(row_number() OVER (PARTITION BY query ORDER BY d, match) AS INT) AS rank, round(d, 9) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, match) <= 3""",
)
def c12_dimensions(spark, sf_dir):
    """The three nearest vectors of its label to each vector, in four dimensions, by a grid instead of all pairs."""
    from strandway.operators.neighbours import nearest

    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 4).cast("array<double>").alias("x"))
    found = nearest(v.withColumnRenamed("vec_id", "query"), v.withColumnRenamed("vec_id", "match"), "label", "query", "match", "x", 3, own=True)
    return found.select("label", "query", "match", "rank", rounded("distance", 9).alias("distance"))


@query(
    "c14_gated_frames_of_whole_pool",
    f"""WITH {FRAMES}, e AS (SELECT user_id % 5 AS task, user_id, [min_by(value, pos), min_by(event_id % 97, pos)] AS s, max_by(value, pos) AS v1 FROM f GROUP BY user_id),
    near AS (SELECT a.user_id AS query, b.user_id AS demo, a.v1, sqrt((a.s[1] - b.s[1]) ** 2 + (a.s[2] - b.s[2]) ** 2) AS g FROM e a JOIN e b USING (task) WHERE a.user_id <> b.user_id QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY g, b.user_id) <= 3)
    SELECT query, demo, event_id, round(abs(v1 - value), 6) AS distance FROM near JOIN f ON f.user_id = demo QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(abs(v1 - value), 9), event_id) = 1""",
)
def c14_whole(spark, sf_dir):
    """Of the three episodes of its task that start nearest to an episode (in two dimensions), the frame nearest to its end."""
    from strandway.operators import retrieval as ret
    from strandway.operators.neighbours import nearest

    f = frames(spark, sf_dir)
    first = lambda c: F.min_by(c, "pos").cast("double")
    ends = kept(f.groupBy("user_id").agg(F.array(first("value"), F.min_by(F.col("event_id") % 97, "pos").cast("double")).alias("s"), F.max_by("value", "pos").alias("v1")).withColumn("task", F.col("user_id") % 5))
    gate = nearest(ends.withColumnRenamed("user_id", "query"), ends.withColumnRenamed("user_id", "demo"), "task", "query", "demo", "s", 3, own=True)
    gate = gate.select("query", "demo", F.col("distance").alias("gate_distance")).join(ends.select(F.col("user_id").alias("query"), "v1"), "query")
    rows = f.select(F.col("user_id").alias("demo"), "event_id", "value")
    found = ret.gated_nearest(gate, rows, "query", "demo", "event_id", stepped(F.abs(F.col("v1") - F.col("value")), 9), 3)
    return found.select("query", "demo", "event_id", rounded("distance").alias("distance"))


@query(
    "c13_retrieved_and_padded",
    """WITH n AS (SELECT vec_id AS query, label FROM embeddings), v AS (SELECT vec_id, label, CAST([embedding[1], embedding[2]] AS DOUBLE[]) AS x FROM embeddings),
    p AS (SELECT a.vec_id AS query, b.vec_id AS match, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((a.x[1] - b.x[1]) ** 2 + (a.x[2] - b.x[2]) ** 2), b.vec_id) AS rank FROM v a JOIN v b ON a.label = b.label AND b.vec_id % 40 = 0)
    SELECT n.query, CAST(k AS INT) AS rank, coalesce(match, -1) AS match, match IS NULL AS masked FROM n CROSS JOIN (SELECT unnest(range(1, 5)) AS k) LEFT JOIN p ON p.query = n.query AND p.rank = k""",
)
def c13_retrieved(spark, sf_dir):
    """Four places for every vector: the nearest pool vectors of its label, and masked places where there are fewer."""
    from strandway.operators import retrieval as ret
    from strandway.operators.neighbours import nearest

    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 2).cast("array<double>").alias("x"))
    queries = v.withColumnRenamed("vec_id", "query")
    found = nearest(queries, v.where("vec_id % 40 = 0").withColumnRenamed("vec_id", "match"), "label", "query", "match", "x", 4)
    return ret.padded(found, queries, "query", "match", 4).select("query", "rank", F.coalesce("match", F.lit(-1)).alias("match"), "masked")


@query(
    "i4_mixed_captions",
    f"""WITH d AS (SELECT doc_id, string_split(substr(text, 1, 200), '. ') AS truth, upper(lang) || ' ' || source AS machine, n_chars % 7 = 0 AS issue, {uniform_sql("'u' || doc_id")} AS u, {uniform_sql("'v' || doc_id")} AS v FROM documents),
    e AS (SELECT *, u < 0.4 AND machine IS NOT NULL AND NOT coalesce(issue, true) AS use FROM d)
    SELECT doc_id, CASE WHEN use THEN 'machine' ELSE 'truth' END AS source, CASE WHEN use THEN machine ELSE truth[1 + CAST(least(floor(v * len(truth)), len(truth) - 1) AS INT)] END AS text FROM e""",
)
def i4(spark, sf_dir):
    """A caption of the text's own sentences or a made one, at a share of 0.4, unless that had an issue."""
    from strandway.functions import text as txt

    name = F.col("doc_id").cast("string")
    d = table(spark, sf_dir, "documents").withColumns({"truth": F.split(F.substring("text", 1, 200), r"\. "), "machine": F.concat(F.upper("lang"), F.lit(" "), "source"), "issue": F.col("n_chars") % 7 == 0})
    picked = txt.mixed_caption(F.col("truth"), F.col("machine"), F.col("issue"), 0.4, uniform(F.concat(F.lit("u"), name)), uniform(F.concat(F.lit("v"), name)))
    return d.select("doc_id", picked.alias("c")).select("doc_id", "c.source", "c.text")


@query(
    "i5_padded_tokens",
    """SELECT vec_id, [CAST(embedding[1] AS DOUBLE), CASE WHEN vec_id % 6 > 0 THEN CAST(embedding[4] AS DOUBLE) ELSE 0 END, CASE WHEN vec_id % 6 > 1 THEN CAST(embedding[7] AS DOUBLE) ELSE 0 END][1 + CAST(vec_id % 3 AS INT)] AS picked, least(3, 1 + vec_id % 6) AS ones, 9 AS numbers FROM embeddings""",
)
def i5(spark, sf_dir):
    """One to six tokens of three numbers, cut or filled up to three tokens."""
    from strandway.functions import text as txt

    tokens = F.transform(F.sequence(F.lit(0), F.col("vec_id") % 6), lambda i: F.transform(F.slice("embedding", (i * 3 + 1).cast("int"), 3), lambda x: x.cast("double")))
    d = table(spark, sf_dir, "embeddings").withColumn("t", txt.padded_tokens(tokens, 3, 3))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select("vec_id", F.get("t.rows", (F.col("vec_id") % 3).cast("int"))[0].alias("picked"), total(F.col("t.mask")).alias("ones"), F.size(F.flatten("t.rows")).alias("numbers"))


@query(
    "l5_open_loop_actions",
    f"""WITH {FRAMES}, p AS (SELECT event_id, pos, pos % 5 AS place, first_value(value) OVER (PARTITION BY user_id, pos // 5 ORDER BY t, event_id) AS v, first_value(event_type) OVER (PARTITION BY user_id, pos // 5 ORDER BY t, event_id) AS kind FROM f)
    SELECT event_id, pos - place AS planned_at, CASE WHEN kind = 'error' OR kind = 'refund' AND place > 2 THEN NULL ELSE round(v + place / 2, 6) END AS action FROM p""",
)
def l5(spark, sf_dir):
    """Plans of five actions, three after a refund and none after an error, made every five events and played out."""
    plan = F.transform(F.sequence(F.lit(0), F.when(F.col("event_type") == "refund", 2).otherwise(4)), lambda i: F.col("value") + i / 2)
    f = frames(spark, sf_dir).withColumn("plan", F.when(F.col("event_type") != "error", plan))
    acted = win.open_loop_actions(f, KEYS, ORDER, "plan", 5)
    return acted.select("event_id", F.col("planned_at").cast("long").alias("planned_at"), rounded("action").alias("action"))
