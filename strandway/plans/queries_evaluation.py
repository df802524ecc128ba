"""Queries of evaluation, normalisation and geometry. Events give units (event type as task, user mod 3 as seed),
embeddings predictions and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandway.functions import normalise as nrm
from strandway.functions import vectors as vec
from strandway.operators import evaluation as ev
from strandway.operators import statistics as st
from strandway.plans.catalog import query
from strandway.plans.queries_core import FRAMES, frames, rounded, table

_UNITS = "SELECT event_type AS task, CAST(user_id % 3 AS INT) AS seed, user_id % 2 = 0 AS treated, value FROM events"


def windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("task"), (F.col("user_id") % 3).cast("int").alias("seed"), (F.col("user_id") % 2 == 0).alias("treated"), "value", (F.col("value") > 90).cast("int").alias("over"))


def halves(spark, sf_dir):
    """The units of the treated and of the other windows."""
    w = windows(spark, sf_dir)
    return [ev.unit_rollup(w.where(c), ["task", "seed"], ["value"], ["over"]) for c in ("treated", "NOT treated AND NOT (task = 'view' AND seed = 0)")]


_PAIRS = f"""u AS ({_UNITS}), a AS (SELECT task, seed, median(value) AS v FROM u WHERE treated GROUP BY ALL),
    b AS (SELECT task, seed, median(value) AS v FROM u WHERE NOT treated AND NOT (task = 'view' AND seed = 0) GROUP BY ALL),
    p AS (SELECT coalesce(a.task, b.task) AS task, coalesce(a.seed, b.seed) AS seed, CASE WHEN a.task IS NULL THEN 'only_baseline' WHEN b.task IS NULL THEN 'only_treatment' ELSE 'paired' END AS status, a.v - b.v AS difference
          FROM a FULL JOIN b ON a.task = b.task AND a.seed = b.seed)"""


@query("d15_unit_rollup", f"SELECT task, seed, count(*) AS window_count, round(median(value), 6) AS value, count(*) FILTER (value > 90) AS over FROM ({_UNITS}) GROUP BY ALL")
def d15(spark, sf_dir):
    return ev.unit_rollup(windows(spark, sf_dir), ["task", "seed"], ["value"], ["over"]).withColumn("value", rounded("value"))


@query("c22_paired_units", f"WITH {_PAIRS} SELECT task, seed, status, round(difference, 6) AS difference FROM p")
def c22(spark, sf_dir):
    return ev.paired_units(*halves(spark, sf_dir), ["task", "seed"], "value").withColumn("difference", rounded("difference"))


_SUMMARY = f"""{_PAIRS}, t AS (SELECT task, median(difference) AS m FROM p WHERE status = 'paired' GROUP BY task),
    s AS (SELECT count(*) AS unit_count, median(difference) AS effect_median, quantile_cont(difference, 0.25) AS effect_q25, quantile_cont(difference, 0.75) AS effect_q75,
                 (SELECT count(*) FROM t WHERE m < 0) AS improved_tasks FROM p WHERE status = 'paired')"""


@query("d26_paired_summary", f"WITH {_SUMMARY} SELECT unit_count, round(effect_median, 6) AS effect_median, round(effect_q25, 6) AS effect_q25, round(effect_q75, 6) AS effect_q75, improved_tasks FROM s")
def d26(spark, sf_dir):
    s = ev.paired_summary(ev.paired_units(*halves(spark, sf_dir), ["task", "seed"], "value"), "task")
    return s.select("unit_count", *[rounded(c).alias(c) for c in ("effect_median", "effect_q25", "effect_q75")], "improved_tasks")


@query("d27_gate", f"WITH {_SUMMARY} SELECT unit_count >= 12 AS enough, effect_q75 < 0 AS clear, improved_tasks >= 3 AS broad, unit_count >= 12 AND effect_q75 < 0 AND improved_tasks >= 3 AS passed FROM s")
def d27(spark, sf_dir):
    s = ev.paired_summary(ev.paired_units(*halves(spark, sf_dir), ["task", "seed"], "value"), "task")
    return ev.gate(s, enough=F.col("unit_count") >= 12, clear=F.col("effect_q75") < 0, broad=F.col("improved_tasks") >= 3).select("enough", "clear", "broad", "passed")


@query(
    "d27_adjacent_worsening",
    "WITH m AS (SELECT event_type, user_id % 6 AS pool, median(value) AS v FROM events GROUP BY ALL), l AS (SELECT event_type, v > lag(v) OVER (PARTITION BY event_type ORDER BY pool) AS up FROM m) SELECT event_type, count(*) FILTER (up) AS worsened FROM l GROUP BY event_type",
)
def d27b(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 6).alias("pool")).agg(F.median("value").alias("v"))
    return ev.adjacent_worsening(m, ["event_type"], "pool", "v")


@query(
    "d36_paired_counts",
    """WITH a AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
    SELECT event_type, count(*) AS queries, round(avg(a.v), 6) AS reference_mean, round(avg(b.v), 6) AS candidate_mean, count(*) FILTER (b.v < a.v) AS improved, count(*) FILTER (b.v = a.v) AS unchanged,
           count(*) FILTER (b.v > a.v) AS worsened, round((avg(b.v) - avg(a.v)) / nullif(avg(a.v), 0), 6) AS relative_change, count(*) FILTER (b.v < a.v) >= count(*) // 2 + 1 AS majority
    FROM a JOIN b USING (user_id, event_type) GROUP BY event_type""",
)
def d36(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = (e.where(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.avg("value").alias("v")) for k in (0, 1))
    c = ev.comparison(a, b, "user_id", ["event_type"], "v")
    return c.withColumns({k: rounded(k) for k in ("reference_mean", "candidate_mean", "relative_change")})


@query(
    "d33_trend",
    """WITH m AS (SELECT event_type, CAST(user_id % 5 AS INT) AS it, median(value) AS v FROM events GROUP BY ALL), l AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY it) AS b FROM m),
    g AS (SELECT event_type, arg_min(it, (v, it)) AS best_iteration, arg_max(v, it) AS latest, arg_min(v, it) AS first, min(v) AS best, arg_max(b, it) AS previous, bool_and(coalesce(v <= b, true)) AS monotone FROM l GROUP BY event_type)
    SELECT event_type, best_iteration, round(latest, 6) AS latest, round((latest - first) / first, 6) AS against_first, round((latest - best) / best, 6) AS against_best, round((latest - previous) / previous, 6) AS against_previous,
           monotone, CASE WHEN monotone THEN 'improving' WHEN latest <= first THEN 'mixed' ELSE 'worse' END AS label FROM g""",
)
def d33(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).cast("int").alias("it")).agg(F.median("value").alias("v"))
    t = ev.trend(m, ["event_type"], "it", "v")
    return t.select("event_type", "best_iteration", *[rounded(c).alias(c) for c in ("latest", "against_first", "against_best", "against_previous")], "monotone", "label")


@query("d29_content_hash", "SELECT user_id, sha256(string_agg(sha256('=' || event_type || '|=' || event_id), '' ORDER BY event_id)) AS sha256 FROM events GROUP BY user_id")
def d29(spark, sf_dir):
    return ev.content_hash(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], ["event_type", "event_id"])


@query(
    "d21_jaccard",
    """WITH a AS (SELECT user_id, list(DISTINCT event_type) AS x FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT user_id, list(DISTINCT event_type) AS y FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
    SELECT user_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS overlap FROM a JOIN b USING (user_id)""",
)
def d21(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = (e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.collect_set("event_type").alias(c)) for k, c in ((0, "x"), (1, "y")))
    return a.join(b, "user_id").select("user_id", rounded(ev.jaccard(F.col("x"), F.col("y")), 9).alias("overlap"))


@query("d17_runtime_summary", "SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, median(value) AS median, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def d17(spark, sf_dir):
    return st.runtime_summary(table(spark, sf_dir, "events"), ["event_type"], "value").withColumns({"total": rounded("total", 4), "mean": rounded("mean"), "p95": rounded("p95")})


@query("d10_median", "SELECT r_regionkey, n, m FROM (SELECT r_regionkey, count(c_acctbal) AS n, median(c_acctbal) AS m FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900 GROUP BY r_regionkey)")
def d10(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9900").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return st.group_median(table(spark, sf_dir, "region").select("r_regionkey"), c.select(F.col("n_regionkey").alias("r_regionkey"), "c_acctbal"), "r_regionkey", "c_acctbal")


@query("d3_vector_summary", "WITH x AS (SELECT unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT CAST(dim AS INT) AS dim, count(*) AS n, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 0.000001), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high FROM x GROUP BY dim")
def d3(spark, sf_dir):
    s = st.vector_summary(table(spark, sf_dir, "embeddings"), "embedding", 1e-6)
    return s.select("dim", "n", *[rounded(c).alias(c) for c in ("mean", "std", "low", "high")])


@query(
    "d2_role_statistics",
    f"""WITH {FRAMES}, x AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'human' ELSE 'robot' END AS role, user_id, value, gap_mask, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS step FROM f WHERE user_id % 5 <> 0)
    SELECT role, count(*) AS rows, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high, median(value) AS median, round(quantile_cont(step, 0.99) FILTER (NOT gap_mask), 6) AS step_p99,
           round(max(step) FILTER (NOT gap_mask), 6) AS step_max, count(*) FILTER (gap_mask) AS gaps FROM x GROUP BY role""",
)
def d2(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("role", F.when(F.col("event_type").isin("click", "view"), "human").otherwise("robot")).where("user_id % 5 <> 0")
    s = st.role_statistics(f, "role", ["user_id"], ["t", "event_id"], "value")
    return s.withColumns({c: rounded(c) for c in ("mean", "std", "step_p99", "step_max")})


@query("d5_delta_statistics", "WITH c AS (SELECT label, [avg(CAST(embedding[1] AS DOUBLE)), avg(CAST(embedding[2] AS DOUBLE))] AS m FROM embeddings GROUP BY label) SELECT CAST(i AS INT) AS dim, round(min(embedding[i + 1] - m[i + 1]), 6) AS low, round(max(embedding[i + 1] - m[i + 1]), 6) AS high FROM embeddings JOIN c USING (label), range(2) r(i) GROUP BY i")
def d5(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 2).cast("array<double>").alias("v"))
    plan = e.groupBy("label").agg(F.array(F.avg(F.col("v")[0]), F.avg(F.col("v")[1])).alias("m"))
    return st.delta_statistics(e.join(plan, "label"), "v", "m").select("dim", rounded("low").alias("low"), rounded("high").alias("high"))


@query("d37_trajectory_mse", "WITH p AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings), x AS (SELECT label, unnest(embedding) AS a, unnest(p) AS b FROM p WHERE p IS NOT NULL) SELECT label, round(avg((CAST(a AS DOUBLE) - b) * (CAST(a AS DOUBLE) - b)), 6) AS mse FROM x GROUP BY label")
def d37(spark, sf_dir):
    from strandway.operators.windows import W

    p = table(spark, sf_dir, "embeddings").withColumn("p", F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id"))).where("p IS NOT NULL")
    return st.vector_mse(p, ["label"], "embedding", "p").withColumn("mse", rounded("mse"))


@query("d14_mean_prediction", "WITH x AS (SELECT label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL) SELECT label, i AS dim, round(CASE WHEN i = 63 THEN greatest(0, least(1, m)) ELSE m END, 6) AS mean FROM m")
def d14(spark, sf_dir):
    return ev.mean_prediction(table(spark, sf_dir, "embeddings"), ["label"], "embedding").select("label", F.posexplode("mean").alias("dim", "mean")).select("label", F.col("dim").cast("long").alias("dim"), rounded("mean").alias("mean"))


@query(
    "h19_window_metrics",
    """WITH p AS (SELECT label, vec_id, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
    d AS (SELECT label, vec_id, sqrt(list_sum(list_transform(range(1, 4), lambda i: pow(CAST(a[i] AS DOUBLE) - b[i], 2)))) AS p, abs(CAST(a[64] AS DOUBLE) - b[64]) AS g,
                 sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(a[i] AS DOUBLE) - b[i], 2)))) AS c FROM p WHERE b IS NOT NULL)
    SELECT label, round(median(p), 6) AS position_median, round(median(g), 6) AS gripper_median, round(arg_max(p, vec_id), 6) AS final_position, round(median(c), 6) AS canonical_median FROM d GROUP BY label""",
)
def h19(spark, sf_dir):
    from strandway.operators.windows import W

    p = table(spark, sf_dir, "embeddings").withColumn("p", F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id"))).where("p IS NOT NULL")
    m = ev.window_metrics(p, ["label"], "vec_id", "embedding", "p")
    return m.select("label", *[rounded(c).alias(c) for c in m.columns[1:]])


@query("h18_residual", "WITH p AS (SELECT vec_id, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT vec_id, round(CAST(a[1] AS DOUBLE) - b[1], 6) AS first, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(a[i] AS DOUBLE) - b[i], 2)))), 6) AS norm, true AS exact FROM p WHERE b IS NOT NULL")
def h18(spark, sf_dir):
    from strandway.operators.windows import W

    p = table(spark, sf_dir, "embeddings").withColumn("p", F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id"))).where("p IS NOT NULL")
    r = p.withColumn("r", ev.residual(F.col("embedding"), F.col("p")))
    back = F.forall(F.zip_with(ev.reconstructed(F.col("r"), F.col("p")), "embedding", lambda x, y: F.abs(x - y.cast("double")) < 1e-9), lambda x: x)
    return r.select("vec_id", rounded(F.col("r")[0]).alias("first"), rounded(vec.norm(F.col("r"))).alias("norm"), back.alias("exact"))


@query("b16_workspace_violations", "SELECT label, count(*) FILTER (embedding[1] < -0.1 OR embedding[1] > 0.1 OR embedding[2] < -0.1 OR embedding[2] > 0.1 OR embedding[3] < -0.1 OR embedding[3] > 0.1) AS violations FROM embeddings GROUP BY label")
def b16(spark, sf_dir):
    bound = lambda x: F.array(*[F.lit(x).cast("float")] * 3)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count_if(ev.outside(F.slice("embedding", 1, 3), bound(-0.1), bound(0.1))).alias("violations"))


_NORM = "WITH s AS (SELECT event_type, quantile_cont(value, 0.01) AS q1, quantile_cont(value, 0.99) AS q9, avg(value) AS m, stddev_pop(value) AS d, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type)"


@query(
    "h15_normaliser_modes",
    f"""{_NORM} SELECT event_id, round(greatest(-1, least(1, CASE WHEN q1 <> q9 THEN 2 * (value - q1) / (q9 - q1) - 1 ELSE value END)), 6) AS q99, round(CASE WHEN d <> 0 THEN (value - m) / d ELSE value END, 6) AS mean_std,
        round(CASE WHEN lo <> hi THEN 2 * (value - lo) / (hi - lo) - 1 ELSE 0 END, 6) AS min_max, round(value / greatest(abs(lo), abs(hi)), 6) AS scale, CASE WHEN value > 0.5 THEN 1.0 ELSE 0.0 END AS "binary",
        round(value, 6) AS restored FROM events JOIN s USING (event_type)""",
)
def h15(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    q = lambda p: F.percentile("value", F.lit(p))
    s = e.groupBy("event_type").agg(q(0.01).alias("q1"), q(0.99).alias("q9"), F.avg("value").alias("m"), F.stddev_pop("value").alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    j, x = e.join(s, "event_type"), F.col("value")
    c = {k: F.col(k) for k in ("q1", "q9", "m", "d", "lo", "hi")}
    minmax = nrm.normalised(x, "min_max", c["lo"], c["hi"])
    return j.select(
        "event_id",
        rounded(nrm.normalised(x, "q99", c["q1"], c["q9"])).alias("q99"),
        rounded(nrm.normalised(x, "mean_std", mean=c["m"], std=c["d"])).alias("mean_std"),
        rounded(minmax).alias("min_max"),
        rounded(nrm.normalised(x, "scale", c["lo"], c["hi"])).alias("scale"),
        nrm.normalised(x, "binary").alias("binary"),
        rounded(nrm.restored(minmax, "min_max", c["lo"], c["hi"])).alias("restored"),
    )


@query("h9_sin_cos", "SELECT vec_id, round(sin(CAST(embedding[1] AS DOUBLE)), 6) AS s, round(cos(CAST(embedding[64] AS DOUBLE)), 6) AS c, 128 AS width FROM embeddings")
def h9(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("v", nrm.sin_cos(F.col("embedding")))
    return v.select("vec_id", rounded(F.col("v")[0]).alias("s"), rounded(F.col("v")[127]).alias("c"), F.size("v").alias("width"))


@query("h17_continuous_action", "SELECT event_id, round((event_id % 256) / 255 * 2 - 1, 6) AS action FROM events")
def h17(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rounded(nrm.continuous_action(F.col("event_id") % 256, -1.0, 1.0, 256)).alias("action"))


@query("h24_position_embedding", "WITH i AS (SELECT n_nationkey AS place, unnest(range(4)) AS i FROM nation) SELECT place, CAST(i AS INT) AS dim, round(sin(place / pow(10000, i / 4)), 6) AS v FROM i UNION ALL SELECT place, CAST(i + 4 AS INT), round(cos(place / pow(10000, i / 4)), 6) FROM i")
def h24(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"))
    return n.select("place", F.posexplode(nrm.position_embedding(F.col("place"), 8)).alias("dim", "v")).withColumn("v", rounded("v"))


@query("h27_action_scaling", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 20, 6) AS a, round(CAST(embedding[2] AS DOUBLE) * 20, 6) AS b, round(CAST(embedding[3] AS DOUBLE), 6) AS g FROM embeddings")
def h27(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("v", nrm.multiplied(F.slice("embedding", 1, 3), [20, 20, 1]))
    return v.select("vec_id", *[rounded(F.col("v")[i]).alias(c) for i, c in enumerate("abg")])


@query("h22_phase_features", "SELECT vec_id, round(sum(x), 6) AS total, count(*) AS width FROM (SELECT vec_id, unnest(list_concat(list_concat(list_transform(embedding[1:2], lambda x: CAST(x AS DOUBLE)), [vec_id / 100.0, vec_id / 100.0 * (vec_id / 100.0)]), list_transform(embedding[3:4], lambda x: CAST(x AS DOUBLE)))) AS x FROM embeddings) GROUP BY vec_id")
def h22(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    part = lambda i: F.slice("embedding", i, 2).cast("array<double>")
    f = e.select("vec_id", nrm.phase_features(part(1), F.col("vec_id") / 100.0, part(3)).alias("f"))
    return f.select("vec_id", rounded(F.aggregate("f", F.lit(0.0), lambda s, x: s + x)).alias("total"), F.size("f").cast("long").alias("width"))


@query("h2_unit_vector", "WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings) SELECT vec_id, round(embedding[1] / n, 6) AS first, round(embedding[64] / n, 6) AS last FROM n")
def h2(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").withColumn("u", vec.unit(F.col("embedding")))
    return u.select("vec_id", rounded(F.col("u")[0]).alias("first"), rounded(F.col("u")[63]).alias("last"))


@query(
    "h4_relative_history",
    """WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) - 0.1 AS z0, CAST(embedding[2] AS DOUBLE) AS y0, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b, embedding AS e FROM embeddings),
    d AS (SELECT vec_id, [(CAST(b[1] AS DOUBLE) - e[1] - 0.1) / 2, (CAST(b[2] AS DOUBLE) - e[2] - 0.2) / 4, -0.1 / 2, -0.2 / 4] AS d FROM p WHERE b IS NOT NULL)
    SELECT vec_id, round(d[1] / sqrt(list_sum(list_transform(d, lambda x: x * x))), 6) AS first, round(d[4] / sqrt(list_sum(list_transform(d, lambda x: x * x))), 6) AS last FROM d""",
)
def h4(spark, sf_dir):
    from strandway.operators.windows import W

    p = table(spark, sf_dir, "embeddings").withColumn("p", F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id"))).where("p IS NOT NULL")
    two = lambda c: F.slice(c, 1, 2).cast("array<double>")
    lits = lambda *xs: F.array(*[F.lit(x) for x in xs])
    f = p.withColumn("f", nrm.relative_history(F.array(two("p"), two("embedding")), lits(0.1, 0.2), lits(2.0, 4.0)))
    return f.select("vec_id", rounded(F.col("f")[0]).alias("first"), rounded(F.col("f")[3]).alias("last"))


@query(
    "h21_ridge",
    """WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem), z AS (SELECT (l_quantity - m) / d AS z, l_extendedprice AS y FROM lineitem, s), t AS (SELECT sum(z * z) AS zz, sum(z) AS z1, count(*) AS n, sum(z * y) AS zy, sum(y) AS y1 FROM z)
    SELECT 'l_quantity' AS term, round((zy * n - z1 * y1) / ((zz + 2) * n - z1 * z1), 3) AS weight FROM t UNION ALL SELECT 'bias', round(((zz + 2) * y1 - z1 * zy) / ((zz + 2) * n - z1 * z1), 3) FROM t""",
)
def h21(spark, sf_dir):
    return ev.ridge(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", 2.0).withColumn("weight", rounded("weight", 3))


@query(
    "d19_ensemble_clipped",
    """WITH x AS (SELECT user_id, event_type, (value - 40) / 50 AS v FROM events), g AS (SELECT user_id, event_type, avg(v) AS a, coalesce(stddev_samp(v), 0) AS s, avg(CASE WHEN v > 0.05 THEN 1.0 ELSE 0.0 END) AS w, coalesce(avg(v) FILTER (v > 0.05), 0) AS m FROM x GROUP BY ALL)
    SELECT user_id, event_type, round(greatest(0, least(1, a)), 6) AS average, round(greatest(0, least(1, a - s)), 6) AS lcb, round(w, 6) AS success_vote, round(CASE WHEN w >= 0.5 THEN greatest(0, least(1, m)) ELSE 0 END, 6) AS majority_mean FROM g""",
)
def d19(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", (F.col("value") - 40) / 50)
    s = st.ensemble(e, ["user_id", "event_type"], "v")
    return s.select("user_id", "event_type", *[rounded(c).alias(c) for c in s.columns[2:]])


# Units of the whole table, at most twelve: event types as tasks, users by parity as seeds.
_TWELVE = "SELECT event_type AS task, user_id % 2 AS seed, median(value) FILTER (event_id % 2 = 0) - median(value) FILTER (event_id % 2 = 1) AS d FROM events GROUP BY ALL"


def twelve(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task"), (F.col("user_id") % 2).alias("seed")).agg((F.median(F.when(even, F.col("value"))) - F.median(F.when(~even, F.col("value")))).alias("d"))


@query(
    "d23_bootstrap_of_whole_table",
    f"""WITH u AS ({_TWELVE}), r AS (SELECT d, dense_rank() OVER (ORDER BY task) - 1 AS ti, row_number() OVER (PARTITION BY task ORDER BY seed) - 1 AS si FROM u),
    k AS (SELECT b, CAST('0x' || substr(sha256('20260711:' || b || ':' || i), 1, 7) AS BIGINT) % (SELECT count(DISTINCT task) FROM u) AS ti, CAST('0x' || substr(sha256('20260711:' || b || ':' || i || ':' || j), 1, 7) AS BIGINT) % 2 AS si FROM range(10000) x(b), (SELECT DISTINCT ti AS i FROM r) y, range(2) z(j)),
    m AS (SELECT b, median(d) AS m FROM k JOIN r USING (ti, si) GROUP BY b)
    SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
)
def d23(spark, sf_dir):
    from strandway.operators.inference import hierarchical_bootstrap

    out = hierarchical_bootstrap(twelve(spark, sf_dir), "task", "seed", "d", 10_000, "20260711")
    return out.select(rounded("low").alias("low"), rounded("high").alias("high"))


@query(
    "d24_sign_flip_of_whole_table",
    f"""WITH u AS ({_TWELVE}), r AS (SELECT round(d * 1000000) AS d, row_number() OVER (ORDER BY task, seed) - 1 AS i FROM u),
    m AS (SELECT bits, sum(CASE WHEN (bits >> i) & 1 = 1 THEN d ELSE -d END) AS s FROM range(4096) t(bits), r GROUP BY bits)
    SELECT avg(CASE WHEN s <= (SELECT sum(d) FROM r) THEN 1.0 ELSE 0.0 END) AS p FROM m""",
)
def d24(spark, sf_dir):
    from strandway.operators.inference import sign_flip_p

    u = twelve(spark, sf_dir).select(F.lit("all").alias("family"), F.concat_ws("|", "task", F.col("seed").cast("string")).alias("unit"), F.round(F.col("d") * 1_000_000).alias("d"))  # whole numbers, so ties are exact
    return sign_flip_p(u, ["family"], "unit", "d").select("p")
