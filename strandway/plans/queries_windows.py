"""Queries of windows, deltas, stress views and lag sweeps on the events of each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandway.functions.seeds import uniform_sql
from strandway.operators import timebase as tb
from strandway.operators import windows as win
from strandway.operators.statistics import correlation
from strandway.plans.catalog import query
from strandway.plans.queries_core import FRAMES, KEYS, ORDER, frames, in_segments, rounded, table

_W = "(PARTITION BY user_id ORDER BY t, event_id)"
_S = "(PARTITION BY user_id, segment_id ORDER BY t, event_id)"
SEG = [*KEYS, "segment_id"]


def lengths(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("user_id").agg(F.max("n").alias("n"))


@query("e5_resampled_rows", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), i AS (SELECT user_id, unnest(range(CAST(floor((n - 1) * 10 / 25) AS BIGINT) + 1)) AS i FROM c) SELECT user_id, CAST(round_even(i * 25 / 10, 0) AS BIGINT) AS pos FROM i")
def e5(spark, sf_dir):
    return win.resampled(lengths(spark, sf_dir), 25, 10).select("user_id", "pos")


@query(
    "e6_strict_future_windows",
    f"""WITH {FRAMES}, x AS (SELECT *, sum(value) OVER (PARTITION BY user_id, segment_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS pool,
        sum(value) OVER (PARTITION BY user_id, segment_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS query FROM s)
    SELECT user_id, segment_id, event_id, round(spos / greatest(1, sn - 1), 9) AS phase, round(pool, 6) AS pool, round(query, 6) AS query FROM x WHERE spos % 2 = 0 AND spos + 3 < sn""",
)
def e6(spark, sf_dir):
    w = win.W.partitionBy(*SEG).orderBy(*ORDER)
    x = in_segments(spark, sf_dir).withColumns({"pool": F.sum("value").over(w.rowsBetween(0, 2)), "query": F.sum("value").over(w.rowsBetween(1, 3))})
    return win.strict_future_windows(x, 3, 2).select("user_id", "segment_id", "event_id", rounded("phase", 9).alias("phase"), rounded("pool").alias("pool"), rounded("query").alias("query"))


@query("e8_lagged_window_count", f"WITH {FRAMES}, c AS (SELECT user_id, segment_id, max(sn) AS n FROM s GROUP BY ALL) SELECT user_id, CAST(sum(greatest(0, floor((n - 2 - 2 - 1) / 2) + 1)) AS BIGINT) AS windows FROM c GROUP BY user_id")
def e8(spark, sf_dir):
    n = in_segments(spark, sf_dir).groupBy("user_id", "segment_id").agg(F.max("n").alias("n"))
    return n.groupBy("user_id").agg(F.sum(win.lagged_window_count(F.col("n"), 2, 2, 2, 2)).alias("windows"))


@query("e10_velocity", f"WITH {FRAMES}, x AS (SELECT *, value - lag(value) OVER {_W} AS d FROM f) SELECT user_id, event_id, round(coalesce(avg(d) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 0), 6) AS velocity FROM x")
def e10(spark, sf_dir):
    return win.velocity(frames(spark, sf_dir), KEYS, ORDER, "value", 2).select("user_id", "event_id", rounded("velocity").alias("velocity"))


@query("e11_subframes", f"WITH {FRAMES} SELECT user_id, event_id FROM f WHERE pos < 7 OR (pos - 7) % 2 = 0")
def e11(spark, sf_dir):
    return win.subframes(frames(spark, sf_dir), 7, 2).select("user_id", "event_id")


@query(
    "e13_action_chunk",
    """WITH x AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, last_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin,
        lead(l_quantity, 1) OVER w AS a, lead(l_quantity, 2) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))
    SELECT l_orderkey, pos, l_quantity AS c0, coalesce(a, fin) AS c1, coalesce(b, fin) AS c2 FROM x""",
)
def e13(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    x = tb.clamped_chunk(tb.positions(table(spark, sf_dir, "lineitem").select("l_orderkey", *order), ["l_orderkey"], order), ["l_orderkey"], order, "l_quantity", 3)
    return x.select("l_orderkey", F.col("pos").cast("long").alias("pos"), *[F.col("chunk")[k].alias(f"c{k}") for k in range(3)])


@query("e14_context_window", f"WITH {FRAMES} SELECT user_id, event_id, greatest(0, pos - 4) AS first, least(n, greatest(0, pos - 4) + 12) AS stop FROM f")
def e14(spark, sf_dir):
    return win.context_window(frames(spark, sf_dir), 4, 3).select("user_id", "event_id", "first", "stop")


@query(
    "e16_delta_gather",
    f"""WITH {FRAMES}, x AS (SELECT *, first_value(value) OVER w AS lo, last_value(value) OVER w AS hi, lag(value, 2) OVER v AS a, lead(value, 3) OVER v AS b FROM f
        WINDOW v AS {_W}, w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT user_id, event_id, CASE WHEN pos < 2 THEN lo ELSE a END AS before, value AS now, CASE WHEN pos + 3 >= n THEN hi ELSE b END AS after, CASE WHEN pos + 3 >= n THEN 0 ELSE b END AS after_or_zero FROM x""",
)
def e16(spark, sf_dir):
    x = win.gathered(frames(spark, sf_dir), KEYS, ORDER, "value", [-2, 0, 3]).withColumnRenamed("gathered", "g")
    x = win.gathered(x, KEYS, ORDER, "value", [3], "zero")
    return x.select("user_id", "event_id", F.col("g")[0].alias("before"), F.col("g")[1].alias("now"), F.col("g")[2].alias("after"), F.col("gathered")[0].alias("after_or_zero"))


@query("e17_downsampled_windows", f"WITH {FRAMES} SELECT user_id, event_id, pos + 9 AS last_pos FROM f WHERE pos + 9 < n")
def e17(spark, sf_dir):
    return win.downsampled_windows(frames(spark, sf_dir), 4, 3).select("user_id", "event_id", "last_pos")


@query("e19_baselined_deltas", f"WITH {FRAMES}, x AS (SELECT *, lag(value) OVER v AS p, lead(value, 1) OVER v AS a, lead(value, 2) OVER v AS b FROM f WINDOW v AS {_W}) SELECT user_id, event_id, round(value - p, 6) AS d0, round(a - p, 6) AS d1, round(b - p, 6) AS d2 FROM x WHERE pos >= 1 AND pos + 3 <= n")
def e19(spark, sf_dir):
    x = win.baselined_deltas(frames(spark, sf_dir), KEYS, ORDER, "value", 3)
    return x.select("user_id", "event_id", *[rounded(F.col("deltas")[k]).alias(f"d{k}") for k in range(3)])


@query("e20_transitions", f"WITH {FRAMES} SELECT user_id, event_id, round(value - lag(value) OVER {_W}, 6) AS transition, round(value, 6) AS rebuilt FROM f")
def e20(spark, sf_dir):
    x = win.transitions(frames(spark, sf_dir), KEYS, ORDER, "value")
    return x.select("user_id", "event_id", rounded("transition").alias("transition"), rounded("rebuilt").alias("rebuilt"))


@query("e23_largest_step", f"WITH {FRAMES}, x AS (SELECT *, abs(value - lag(value) OVER {_W}) AS d FROM f) SELECT user_id, round(coalesce(max(d) FILTER (NOT gap_mask), 0), 6) AS largest_step FROM x GROUP BY user_id")
def e23(spark, sf_dir):
    return win.largest_step(frames(spark, sf_dir), KEYS, ORDER, "value").select("user_id", rounded("largest_step").alias("largest_step"))


@query("e25_global_step_index", f"WITH {FRAMES} SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, t, event_id) - 1 AS step FROM f")
def e25(spark, sf_dir):
    f = frames(spark, sf_dir)
    base = win.global_index(f.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", 7).select("user_id", "base")
    return f.join(base, "user_id").select("user_id", "event_id", (F.col("base") + F.col("pos")).cast("long").alias("step"))


@query("e26_repeated_groups", f"WITH {FRAMES}, x AS (SELECT *, CAST(coalesce(event_type <> lag(event_type) OVER {_W}, false) AS INT) AS new FROM f) SELECT user_id, event_id, CAST(sum(new) OVER {_W} AS BIGINT) AS grp FROM x")
def e26(spark, sf_dir):
    return win.repeated_groups(frames(spark, sf_dir), KEYS, ORDER, "event_type").select("user_id", "event_id", F.col("group").cast("long").alias("grp"))


@query(
    "e30_temporal_stress",
    f"""WITH {FRAMES}, k AS (SELECT unnest(['baseline', 'frame_drop', 'timestamp_jitter', 'pause', 'step_jump']) AS stress),
    r AS (SELECT k.stress, user_id, pos, pos / 30.0 + CASE WHEN stress = 'timestamp_jitter' THEN 0.008 * sqrt(-2 * ln(1 - {uniform_sql("event_id || '|r'")})) * cos(2 * pi() * {uniform_sql("event_id || '|a'")})
              WHEN stress = 'pause' AND pos >= n // 2 THEN 0.5 ELSE 0 END AS time, pos + CASE WHEN stress = 'step_jump' AND pos >= n // 2 THEN 20 ELSE 0 END AS step
          FROM f, k WHERE n >= 11 AND (stress <> 'frame_drop' OR (pos + 1) % 10 <> 0)),
    z AS (SELECT stress, pos - lag(pos) OVER w AS dr, time - lag(time) OVER w AS dt, step - lag(step) OVER w AS ds FROM r WINDOW w AS (PARTITION BY stress, user_id ORDER BY pos))
    SELECT stress, count(*) AS pair_count, count(*) FILTER (dr <> 1) AS row_jumps, count(*) FILTER (abs(dt - dr / 30.0) > 0.005) AS jitter_exceeds, count(*) FILTER (dt > 0.25) AS pauses,
           count(*) FILTER (ds <> dr) AS step_jumps, count(*) FILTER (dt <= 0) AS nonmonotonic FROM z WHERE dr IS NOT NULL GROUP BY stress""",
)
def e30(spark, sf_dir):
    return win.temporal_stress(frames(spark, sf_dir), KEYS, "event_id")


_SWEEP = f"""{FRAMES}, p AS ({" UNION ALL ".join(f"SELECT user_id, {k} AS lag, value, CASE WHEN lead(segment_id, {k}) OVER w = segment_id THEN lead(value, {k}) OVER w END AS later FROM f WINDOW w AS {_W}" for k in range(1, 5))}),
    m AS (SELECT user_id, lag, count(*) AS pairs, round(median(abs(later - value)), 6) AS error, round(CASE WHEN stddev_pop(value) > 0 AND stddev_pop(later) > 0 THEN corr(value, later) END, 6) AS r FROM p WHERE later IS NOT NULL GROUP BY ALL)"""


def swept(spark, sf_dir):
    p = win.lag_sweep(frames(spark, sf_dir), KEYS, ORDER, "value", [1, 2, 3, 4])
    r = correlation(F.col("value"), F.col("later"))
    return p.groupBy("user_id", "lag").agg(F.count("*").alias("pairs"), rounded(F.median(F.abs(F.col("later") - F.col("value")))).alias("error"), rounded(r).alias("r"))


@query("c8_lag_sweep", f"WITH {_SWEEP} SELECT * FROM m")
def c8(spark, sf_dir):
    return swept(spark, sf_dir)


@query("d13_best_lag", f"WITH {_SWEEP} SELECT user_id, arg_min(lag, (error, lag)) AS by_error, arg_min(lag, (-coalesce(r, 0), lag)) AS by_correlation FROM m GROUP BY user_id")
def d13(spark, sf_dir):
    return win.best_lag(swept(spark, sf_dir), ["user_id"])


@query(
    "d12_step_ratio",
    f"""WITH {FRAMES}, x AS (SELECT user_id, t, event_id, abs(value - lag(value) OVER {_W}) AS d FROM f), y AS (SELECT user_id, d, lead(d) OVER {_W} AS e FROM x)
    SELECT user_id, count(*) AS moving, round(median(e / d), 6) AS ratio FROM y WHERE d > 0.000001 AND e > 0.000001 GROUP BY user_id""",
)
def d12(spark, sf_dir):
    w = win.W.partitionBy(*KEYS).orderBy(*ORDER)
    x = frames(spark, sf_dir).withColumn("d", F.abs(F.col("value") - F.lag("value").over(w)))
    y = x.withColumn("e", F.lead("d").over(w)).where("d > 0.000001 AND e > 0.000001")
    return y.groupBy("user_id").agg(F.count("*").alias("moving"), rounded(F.median(F.col("e") / F.col("d"))).alias("ratio"))


@query("d31_monotonicity", "WITH x AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) SELECT user_id, min(d) AS least, max(d) AS most, coalesce(bool_and(d >= 0), true) AS monotone FROM x GROUP BY user_id")
def d31(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", tb.micros(F.col("ts")).alias("t"))
    d = e.withColumn("d", F.col("t") - F.lag("t").over(win.W.partitionBy("user_id").orderBy("event_id")))
    return d.groupBy("user_id").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.coalesce(F.every(F.col("d") >= 0), F.lit(True)).alias("monotone"))


@query(
    "e31_perturbed_pairs",
    f"""WITH {FRAMES}, x AS (SELECT user_id, value, lead(value) OVER {_W} AS a, lead(value, 3) OVER {_W} AS b FROM f),
    m AS (SELECT user_id, median(abs(a - value)) AS base, median(abs(b - value)) AS lag, median(abs(2 * a - value)) AS scale FROM x GROUP BY user_id)
    SELECT user_id, round(lag / base, 6) AS lag_ratio, round(scale / base, 6) AS scale_ratio, scale / base >= 1.5 AS scale_detected FROM m WHERE base > 0""",
)
def e31(spark, sf_dir):
    w = win.W.partitionBy(*KEYS).orderBy(*ORDER)
    x = frames(spark, sf_dir).withColumns({"a": F.lead("value").over(w), "b": F.lead("value", 3).over(w)})
    mid = lambda c: F.median(F.abs(c - F.col("value")))
    m = x.groupBy("user_id").agg(mid(F.col("a")).alias("base"), mid(F.col("b")).alias("lag"), mid(2 * F.col("a")).alias("scale")).where("base > 0")
    ratio = F.col("scale") / F.col("base")
    return m.select("user_id", rounded(F.col("lag") / F.col("base")).alias("lag_ratio"), rounded(ratio).alias("scale_ratio"), (ratio >= 1.5).alias("scale_detected"))
