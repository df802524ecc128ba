"""Queries of record filters, rule tables, requested rows, relative poses, frame choices, captions and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandway.functions import normalise as nm
from strandway.functions import text as txt
from strandway.functions import vectors as vec
from strandway.functions.seeds import uniform, uniform_sql
from strandway.operators import records as rec
from strandway.operators import retrieval as ret
from strandway.operators import selection as sel
from strandway.operators import windows as win
from strandway.operators.neighbours import nearest
from strandway.plans.catalog import query
from strandway.plans.queries_core import FRAMES, KEYS, ORDER, frames, rounded, table
from strandway.sources import files
from strandway.sources.stages import kept

_U = uniform_sql("CAST(o_orderkey AS VARCHAR)")
_V = uniform_sql("o_orderkey || '|v'")


def draws(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.withColumns({"u": uniform(F.col("o_orderkey").cast("string")), "v": uniform(F.concat(F.col("o_orderkey").cast("string"), F.lit("|v")))})


@query(
    "b7_prefix_suites",
    """WITH s AS (SELECT event_id, event_type || CASE WHEN user_id % 2 = 0 THEN '_' ELSE '0_' END || user_id AS suite FROM events), p AS (SELECT event_id, suite, split_part(suite, '_', 1) AS prefix FROM s WHERE regexp_full_match(suite, '(click|view|error)_[0-9]+'))
    SELECT event_id, suite, prefix FROM p QUALIFY prefix <> 'click' OR row_number() OVER (PARTITION BY prefix ORDER BY suite, event_id) <= 9""",
)
def b7(spark, sf_dir):
    suite = F.concat(F.col("event_type"), F.when(F.col("user_id") % 2 == 0, "_").otherwise("0_"), F.col("user_id").cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", suite.alias("suite"))
    return rec.suites_of_prefix(e, "suite", {"click": 9, "view": 0, "error": 0}, ["suite", "event_id"])


@query("b8_metadata_flag", "SELECT event_id FROM events WHERE event_id % 3 = 0")
def b8(spark, sf_dir):
    meta = F.to_json(F.struct(F.struct((F.col("event_id") % 3 == 0).alias("is_eval")).alias("episode_metadata")))
    return rec.of_metadata(table(spark, sf_dir, "events").withColumn("meta", meta), "meta", "$.episode_metadata.is_eval", True).select("event_id")


@query("b10_not_skipped", "SELECT event_id FROM events WHERE coalesce(CASE WHEN user_id % 3 = 0 THEN event_id % 2 END, 0) <> 1 AND event_type <> 'error'")
def b10(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"a": F.when(F.col("user_id") % 3 == 0, F.col("event_id") % 2), "b": (F.col("event_type") == "error").cast("int")})
    return rec.not_skipped(e, ["a", "b"]).select("event_id")


@query("b11_with_results", "SELECT doc_id, length(text) AS n, lang AS tag FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def b11(spark, sf_dir):
    return rec.with_results(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), {"n": F.length("text").cast("long"), "tag": F.col("lang")}).select("doc_id", "n", "tag")


@query("b14_merged_record", "SELECT event_id AS id, event_type AS kind, value FROM events")
def b14(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id.json"), F.struct(F.col("event_type").alias("t"), "value").alias("record.bin"))
    return rec.merged_record(rec.without_extensions(e), "record", {"t": "kind", "value": "value"})


@query("b15_schema_version", "SELECT region.r_regionkey, r_name FROM region")
def b15(spark, sf_dir):
    r = table(spark, sf_dir, "region").withColumn("version", F.lit("v3"))
    return rec.of_version(r, F.col("version"), "v3").select("r_regionkey", "r_name")


@query(
    "a8_rows_requested",
    "WITH q AS (SELECT user_id, unnest([max(event_id), min(event_id), max(event_id), -1]) AS event_id, unnest(range(4)) AS i FROM events GROUP BY user_id) SELECT user_id, string_agg(coalesce(event_type, '?'), ',' ORDER BY i) AS kinds FROM q LEFT JOIN (SELECT event_id, event_type FROM events) USING (event_id) GROUP BY user_id",
)
def a8(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    want = e.groupBy("user_id").agg(F.array(F.max("event_id"), F.min("event_id"), F.max("event_id"), F.lit(-1).cast("long")).alias("wanted"))
    got = rec.rows_requested(want, e, "user_id", "wanted", "event_id", "event_type")
    return got.select("user_id", F.array_join("values", ",", "?").alias("kinds"))


@query("a9_bound_to_split", "SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN CASE WHEN user_id % 5 = 1 THEN 'held_out' ELSE 'train' END END AS split, user_id % 5 <> 0 AS in_split FROM events")
def a9(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    split = e.where("user_id % 5 <> 0").select("user_id", F.when(F.col("user_id") % 5 == 1, "held_out").otherwise("train").alias("split")).distinct()
    return rec.bound_to_split(e, split, "user_id").select("event_id", "split", "in_split")


_FACTS = """x AS (SELECT vec_id % 50 AS episode, count(*) AS frame_count, count(*) FILTER (NOT coalesce(len(embedding) = 64, false)) AS w, count(*) FILTER (embedding IS NULL OR list_count(embedding) < len(embedding) OR list_bool_or(list_transform(embedding, lambda x: NOT isfinite(x)))) AS f, count(*) FILTER (NOT coalesce(vec_id % 7 <> 3, false)) AS i FROM embeddings GROUP BY 1),
    k AS (SELECT episode, frame_count, concat_ws(',', CASE WHEN w > 0 THEN 'embedding_width' END, CASE WHEN f > 0 THEN 'embedding_finite' END, CASE WHEN i > 0 THEN 'step_integer' END, CASE WHEN frame_count < 2 THEN 'too_short' END) AS violations FROM x)"""


def facts(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("episode"), "embedding", F.when(F.col("vec_id") % 7 == 3, 0.5).otherwise(F.col("vec_id")).alias("step"))
    return rec.episode_facts(v, "episode", {"embedding": 64}, ["step"])


@query("a5_episode_facts", f"WITH {_FACTS} SELECT * FROM k")
def a5(spark, sf_dir):
    return facts(spark, sf_dir).withColumn("violations", F.array_join("violations", ","))


@query(
    "b19_dataset_facts",
    f"""WITH {_FACTS}, b AS (SELECT k.episode AS e, l.episode AS l, violations, k.episode % 4 AS task FROM k FULL JOIN (SELECT unnest(range(3, 55)) AS episode) l ON k.episode = l.episode)
    SELECT count(e) AS episodes, count(DISTINCT task) AS tasks, count(*) FILTER (l IS NULL) AS unlisted, count(*) FILTER (e IS NULL) AS absent, count(*) FILTER (violations <> '') AS invalid, count(e) >= 10 AND count(DISTINCT task) >= 2 AND count(*) FILTER (l IS NULL OR e IS NULL OR violations <> '') = 0 AS valid FROM b""",
)
def b19(spark, sf_dir):
    e = facts(spark, sf_dir).withColumn("task", F.col("episode") % 4)
    return rec.dataset_facts(e, "task", "episode", spark.range(3, 55).toDF("episode"), 10, 2)


@query("a6_allowlisted", f"WITH {FRAMES} SELECT user_id, event_id, value FROM f WHERE user_id IN (SELECT user_id FROM f GROUP BY user_id, segment_id HAVING count(*) >= 4)")
def a6(spark, sf_dir):
    return rec.allowlisted(frames(spark, sf_dir), "user_id", ["event_id", "value"], "segment_id", 4)


@query(
    "b26_failed_guards",
    "WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, CASE WHEN user_id % 6 > 0 THEN count(*) FILTER (value > 99) END AS h FROM events GROUP BY user_id) SELECT user_id, 'errors' AS guard, e AS value FROM u WHERE e <> 0 UNION ALL SELECT user_id, 'high', h FROM u WHERE h IS NULL OR h <> 0",
)
def b26(spark, sf_dir):
    high = F.when(F.col("user_id") % 6 > 0, F.count_if(F.col("value") > 99))
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.create_map(F.lit("errors"), F.count_if(F.col("event_type") == "error"), F.lit("high"), high).alias("guards"))
    return rec.failed_guards(u, ["user_id"], "guards")


@query("c24_zipped", "SELECT c_custkey AS i, c_acctbal AS balance, p_size AS size FROM customer JOIN part ON p_partkey = c_custkey")
def c24(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), "c_acctbal")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), "p_size")
    return rec.zipped({"customer": c, "part": p}, "i").select("i", F.col("customer.c_acctbal").alias("balance"), F.col("part.p_size").alias("size"))


@query("i17_annotated", "SELECT event_id, r_name AS r_text FROM events LEFT JOIN region ON r_regionkey = user_id % 7")
def i17(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("a", (F.col("user_id") % 7).cast("int"))
    tasks = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("r_text"))
    return rec.annotated(e.withColumn("one", F.lit(1)), "event_id", [], "a", tasks, "r_regionkey", "r_text")


@query(
    "c14_two_stage_gate",
    f"""WITH {FRAMES}, q AS (SELECT user_id % 20 AS task, user_id, min_by(value, pos) AS v0, max_by(value, pos) AS v1 FROM f GROUP BY user_id),
    near AS (SELECT a.user_id AS query, b.user_id AS demo, a.v1 FROM q a JOIN q b USING (task) WHERE a.user_id <> b.user_id QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY round(abs(a.v0 - b.v0), 9), b.user_id) <= 2)
    SELECT query, demo, event_id, round(abs(v1 - value), 6) AS distance FROM near JOIN f ON f.user_id = demo QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(abs(v1 - value), 9), event_id) = 1""",
)
def c14(spark, sf_dir):
    f = frames(spark, sf_dir)
    ends = kept(f.groupBy("user_id").agg(F.array(F.min_by("value", "pos")).alias("s"), F.max_by("value", "pos").alias("v1")).withColumn("task", F.col("user_id") % 20))
    q = ends.select("task", F.col("user_id").alias("query"), "s", "v1")
    starts = ends.select("task", F.col("user_id").alias("demo"), "s")
    gate = nearest(q.select("task", "query", "s"), starts, "task", "query", "demo", "s", 2, axes=1, own=True, digits=9)
    gate = gate.select("query", "demo", F.col("distance").alias("gate_distance")).join(q.select("query", "v1"), "query")
    rows = f.select(F.col("user_id").alias("demo"), "event_id", "value")
    found = ret.gated_nearest(gate, rows, "query", "demo", "event_id", vec.stepped(F.abs(F.col("v1") - F.col("value")), 9), 2)
    return found.select("query", "demo", "event_id", rounded(F.col("distance")).alias("distance"))


@query(
    "c13_padded_whole_pool",
    "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events WHERE event_type = 'view') SELECT u.user_id, CAST(s AS INT) AS rank, event_id, event_id IS NULL AS masked FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest([1, 2, 3]) AS s) LEFT JOIN r ON r.user_id = u.user_id AND r.k = s",
)
def c13_whole(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    found = sel.top_k(e.where("event_type = 'view'"), ["user_id"], [F.col("value"), F.col("event_id")], 3)
    return ret.padded(found, e.select("user_id").distinct(), "user_id", "event_id", 3).select("user_id", "rank", "event_id", "masked")


@query(
    "e18_relative_poses",
    f"""WITH {FRAMES}, b AS (SELECT user_id, event_id, pos, value AS x, value / 50 AS a, lag(value, CAST((pos + 3) % 4 + 1 AS INT)) OVER {'(PARTITION BY user_id ORDER BY t, event_id)'} AS bx, pos - ((pos + 3) % 4 + 1) AS bp FROM f)
    SELECT event_id, round(cos(bx / 50) * (x - bx) + sin(bx / 50) * (pos - bp), 6) AS rx, round(-sin(bx / 50) * (x - bx) + cos(bx / 50) * (pos - bp), 6) AS ry, round(cos(a - bx / 50), 6) AS turn FROM b WHERE pos > 0""".replace("lag(value, CAST((pos + 3) % 4 + 1 AS INT)) OVER (PARTITION BY user_id ORDER BY t, event_id)", "CASE (pos + 3) % 4 " + " ".join(f"WHEN {k} THEN lag(value, {k + 1}) OVER (PARTITION BY user_id ORDER BY t, event_id)" for k in range(4)) + " END"),
)
def e18(spark, sf_dir):
    zero = F.lit(0.0)
    f = frames(spark, sf_dir).withColumn("pose", F.array("value", F.col("pos").cast("double"), zero, zero, zero, F.col("value") / 50))
    r = win.relative_poses(f, KEYS, ORDER, "pose", 4)
    return r.select("event_id", rounded(F.col("relative")[0]).alias("rx"), rounded(F.col("relative")[1]).alias("ry"), rounded(F.cos(F.col("relative")[5])).alias("turn"))


@query(
    "e27_sampled_stride",
    f"""WITH o AS (SELECT o_orderkey, 20 + o_orderkey % 300 AS n, 24 + o_orderkey % 37 AS fps, {_U} AS u, {_V} AS v FROM orders), s AS (SELECT *, list_filter(range(1, (n - 1) // 15 + 1), lambda s: fps / s BETWEEN 10 AND 30) AS ss FROM o),
    c AS (SELECT *, CASE WHEN len(ss) >= 2 AND u < 0.01 THEN ss[-2] ELSE ss[-1] END AS stride FROM s) SELECT o_orderkey, CAST(stride AS INT) AS stride, CAST(floor(v * (n - 15 * stride)) AS INT) AS start FROM c WHERE stride IS NOT NULL""",
)
def e27(spark, sf_dir):
    o, k = draws(spark, sf_dir), F.col("o_orderkey")
    c = o.withColumn("c", win.sampled_stride(20 + k % 300, 24 + k % 37, 10, 30, 16, F.col("u"), F.col("v")))
    return c.where("c IS NOT NULL").select("o_orderkey", "c.stride", "c.start")


@query(
    "e28_window_frames",
    f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 50 AS INT) AS a, CAST(o_orderkey % 50 + 10 + o_orderkey % 41 AS INT) AS b, {_U} AS u FROM orders), w AS (SELECT *, b - a AS total, (b - a) // 16 AS m FROM o)
    SELECT o_orderkey, CASE WHEN total >= 16 AND m IN (1, 2) THEN a + (total - 16 * m) // 2 END AS native_first, CASE WHEN total >= 16 AND m IN (1, 2) THEN a + (total - 16 * m) // 2 + 15 * m END AS native_last,
    CASE WHEN total >= 16 THEN a + (total - 16) // 2 END AS original_first, CASE WHEN total >= 16 THEN CAST(a + floor(u * (total - 15)) AS INT) END AS random_first, CASE WHEN total >= 16 THEN CAST(5 * (a + floor(u * (total - 15))) + 4 + 5 + 8 + 10 + 12 AS INT) END AS interleaved_sum FROM w""",
)
def e28(spark, sf_dir):
    k, u = F.col("o_orderkey"), F.col("u")
    a, b = (k % 50).cast("int"), (k % 50 + 10 + k % 41).cast("int")
    w = draws(spark, sf_dir).select("o_orderkey", win.window_frames(a, b, 16, "native", None, (1, 2)).alias("n"), win.window_frames(a, b, 16, "original").alias("o"), win.window_frames(a, b, 16, "consecutive", u).alias("c"), win.window_frames(a, b, 16, "interleaved", u).alias("i"))
    inner = F.when(F.col("i").isNotNull(), F.aggregate(F.slice("i", 2, 5), F.lit(0), lambda s, x: s + x))
    return w.select("o_orderkey", F.col("n")[0].alias("native_first"), F.col("n")[15].alias("native_last"), F.col("o")[0].alias("original_first"), F.col("c")[0].alias("random_first"), inner.alias("interleaved_sum"))


@query("e33_spaced_windows", f"WITH {FRAMES}, l AS (SELECT user_id, max(n) AS n FROM f GROUP BY 1), w AS (SELECT user_id, n, unnest(range(0, n, 2)) AS first FROM l) SELECT user_id, first, first + 9 AS last FROM w WHERE first + 9 <= n - 1")
def e33(spark, sf_dir):
    lengths = frames(spark, sf_dir).groupBy("user_id").agg(F.max("n").alias("n"))
    return win.spaced_windows(lengths, 2, 4, 3).select("user_id", "first", F.element_at("frames", -1).alias("last"))


@query("e35_consecutive", f"WITH l AS (SELECT l_orderkey AS o_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, q, {_U} AS u FROM l) SELECT o_orderkey, list_sum(q[CAST(floor(u * (len(q) - 2)) AS INT) + 1 : CAST(floor(u * (len(q) - 2)) AS INT) + 3]) AS total FROM o WHERE len(q) >= 3")
def e35(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("w"))
    cut = win.consecutive(F.transform("w", lambda x: x["l_quantity"]), 3, uniform(F.col("o_orderkey").cast("string")))
    return lines.withColumn("c", cut).where("c IS NOT NULL").select("o_orderkey", F.aggregate("c", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(
    "e32_view_metrics",
    f"WITH {FRAMES}, v AS (SELECT user_id, pos, value, unnest([1, 3, 4]) AS view FROM f), k AS (SELECT user_id, pos, value, view FROM v WHERE pos % view = 0), dd AS (SELECT view, abs(lead(value) OVER (PARTITION BY view, user_id ORDER BY pos) - value) AS d FROM k) SELECT view, count(*) AS frames, count(d) AS pairs, round(avg(d), 6) AS residual FROM dd GROUP BY view",
)
def e32(spark, sf_dir):
    return win.view_metrics(frames(spark, sf_dir), KEYS, "value", [1, 3, 4]).withColumn("residual", rounded("residual"))


@query("h5_pooled", "WITH m AS (SELECT vec_id, list_transform(range(8), lambda c: list_avg(list_transform(embedding[c * 8 + 1 : c * 8 + 8], lambda x: CAST(x AS DOUBLE)))) AS m FROM embeddings) SELECT vec_id, round(m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS first, round(m[8] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS last FROM m")
def h5(spark, sf_dir):
    latent = F.array(*[F.slice("embedding", 8 * c + 1, 8) for c in range(8)])
    p = table(spark, sf_dir, "embeddings").select("vec_id", vec.pooled(latent).alias("p"))
    return p.select("vec_id", rounded(F.col("p")[0]).alias("first"), rounded(F.col("p")[7]).alias("last"))


@query("h26_rotation_chain", "SELECT event_id, round(cos(value / 50), 6) AS c, round(sin(value / 50), 6) AS s FROM events WHERE value IS NOT NULL")
def h26(spark, sf_dir):
    six = nm.rotation_normalised(F.array(F.lit(0.0), F.lit(0.0), F.col("value") / 50), "euler", "six")
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", six.alias("r"))
    return e.select("event_id", rounded(F.col("r")[0]).alias("c"), rounded(F.col("r")[1]).alias("s"))


@query("i3_image_caption", f"SELECT o_orderkey, CASE WHEN {_U} < 0.5 THEN 'short' ELSE 'long' END AS style, CASE WHEN {_U} < 0.5 THEN o_orderstatus ELSE o_orderpriority END AS text, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE o_orderpriority END AS fallback FROM orders")
def i3(spark, sf_dir):
    two = F.struct(F.col("o_orderstatus").alias("short"), F.col("o_orderpriority").alias("long"))
    ai = F.struct((F.col("o_orderkey") % 4 == 0).alias("had_parse_issue"), F.struct(F.col("o_orderstatus").alias("kosmos_2"), F.col("o_orderpriority").alias("vfc")).alias("captions"))
    o = draws(spark, sf_dir).withColumns({"a": F.to_json(F.struct(two.alias("captions"))), "b": F.to_json(ai)})
    c = o.withColumns({"c": txt.image_caption(F.col("a"), "qwen2p5_7b_v4", ["short", "long"], F.col("u")), "d": txt.image_caption(F.col("b"), "ai_v3p1", [], F.col("u"))})
    return c.select("o_orderkey", "c.style", "c.text", F.col("d.text").alias("fallback"))


@query(
    "i10_prompt_safety",
    "WITH p AS (SELECT p_partkey, list_transform(string_split(lower(trim(regexp_replace(regexp_replace(p_name, '[^\\x00-\\x7F]', ' ', 'g'), '\\s+', ' ', 'g'))), ' '), lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) AS w, p_size FROM part) SELECT p_partkey, CASE WHEN list_contains(w, 'small') THEN 'blocked' WHEN list_contains(w, 'cold') THEN 'blocked base form' WHEN list_contains(w, 'ring') THEN 'exact word' ELSE 'safe' END AS reason FROM p",
)
def i10(spark, sf_dir):
    s = txt.safety(F.col("p_name"), ["small", "chill"], [], ["ring"], {"cold": "chill"})
    return table(spark, sf_dir, "part").select("p_partkey", s["reason"].alias("reason"))


@query("a29_caption_of_json", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN '' WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE o_orderpriority END AS caption FROM orders")
def a29(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    whole = F.concat(F.lit('{"m": {"a": "'), F.col("o_orderstatus"), F.lit('", "b": "'), F.col("o_orderpriority"), F.lit('"}, "n": {"b": "x"}}'))
    bare = F.concat(F.lit(' "m": {"a": "'), F.col("o_orderstatus"), F.lit('"}'))
    text = F.when(k == 0, whole).when(k == 1, bare).otherwise(F.lit("{no json"))
    return table(spark, sf_dir, "orders").select("o_orderkey", txt.caption_of_json(text, "b").alias("caption"))


@query("a41_camera_streams", "SELECT p_partkey, unnest(['metas', 'videos/left', 'videos/right']) AS stream FROM part")
def a41(spark, sf_dir):
    return files.camera_streams(table(spark, sf_dir, "part").select("p_partkey"), ["metas", "videos"], ["left", "right"])


@query("a39_telemetry", "SELECT 'quantity' AS metric, round(avg(l_quantity), 6) AS avg, max(l_quantity) AS max, min(l_quantity) AS min FROM lineitem UNION ALL SELECT 'tax', round(avg(l_tax), 6), max(l_tax), min(l_tax) FROM lineitem")
def a39(spark, sf_dir):
    t = files.telemetry(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax")), ["quantity", "tax"])
    return t.withColumn("avg", rounded("avg"))
