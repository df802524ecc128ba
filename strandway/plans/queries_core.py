"""Queries on the driver's tables. Events are trajectories (user = sequence), embeddings vectors, documents captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandway.functions import text as txt
from strandway.functions import vectors as vec
from strandway.operators import selection as sel
from strandway.operators import statistics as st
from strandway.operators import timebase as tb
from strandway.plans.catalog import query

GAP = 6 * 3600 * 1_000_000
KEYS, ORDER = ["user_id"], ["t", "event_id"]
# The same frames in SQL: rows with place, length, gap and segment of each event.
FRAMES = f"""
    d AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS t, row_number() OVER w - 1 AS pos,
                 count(*) OVER (PARTITION BY user_id) AS n, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS dt
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, coalesce(dt > {GAP}, false) AS gap_mask FROM d),
    f AS (SELECT *, CAST(sum(CAST(gap_mask AS INT)) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS segment_id FROM g),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment_id ORDER BY t, event_id) - 1 AS spos,
                 count(*) OVER (PARTITION BY user_id, segment_id) AS sn FROM f)
"""
EVENT_TYPES = ["click", "error", "purchase", "refund", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", tb.micros(F.col("ts")).alias("t"))
    return tb.gap_segments(tb.positions(e, KEYS, ORDER), KEYS, ORDER, {"t": GAP})


def in_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.positions(frames(spark, sf_dir).drop("pos", "n"), [*KEYS, "segment_id"], ORDER)


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(x, digits)


@query("e1_gap_segments", f"WITH {FRAMES} SELECT user_id, event_id, pos AS row, gap_mask, segment_id FROM f")
def e1(spark, sf_dir):
    return frames(spark, sf_dir).select("user_id", "event_id", F.col("pos").cast("long").alias("row"), "gap_mask", "segment_id")


@query("e2_contiguous_runs", f"WITH {FRAMES} SELECT user_id, segment_id, min(pos) AS first_row, max(pos) AS last_row, count(*) AS rows FROM f GROUP BY ALL")
def e2(spark, sf_dir):
    return tb.contiguous_runs(frames(spark, sf_dir).withColumn("row", F.col("pos").cast("long")), KEYS)


@query("e3_strided_view", f"WITH {FRAMES} SELECT user_id, segment_id, event_id, spos AS pos FROM s WHERE spos % 3 = 0")
def e3(spark, sf_dir):
    return tb.strided_view(in_segments(spark, sf_dir), 3).select("user_id", "segment_id", "event_id", F.col("pos").cast("long").alias("pos"))


@query(
    "e4_phase_bins",
    """WITH l AS (SELECT user_id, count(*) AS n, least(count(*), 16) AS b FROM events GROUP BY user_id)
    SELECT DISTINCT user_id, CAST(round_even(i * CASE WHEN b > 1 THEN (n - 1) / (b - 1) ELSE 0 END, 0) AS BIGINT) AS pos
    FROM (SELECT *, unnest(range(b)) AS i FROM l)""",
)
def e4(spark, sf_dir):
    return tb.phase_bins(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")), 16).select("user_id", "pos")


@query(
    "e7_history_future_windows",
    f"WITH {FRAMES} SELECT user_id, segment_id, event_id, spos AS pos FROM s WHERE spos >= 3 AND (spos - 3) % 2 = 0 AND spos + 3 < sn",
)
def e7(spark, sf_dir):
    return tb.history_future_windows(in_segments(spark, sf_dir), 4, 3, 2).select("user_id", "segment_id", "event_id", F.col("pos").cast("long").alias("pos"))


@query("e9_phase", f"WITH {FRAMES} SELECT user_id, event_id, round(spos / greatest(1, sn - 1), 9) AS phase FROM s")
def e9(spark, sf_dir):
    return tb.phase(in_segments(spark, sf_dir)).select("user_id", "event_id", rounded("phase", 9).alias("phase"))


@query(
    "e12_future_chunk",
    f"""WITH {FRAMES}, v AS (SELECT user_id, list(event_id ORDER BY t, event_id) AS ids FROM f GROUP BY user_id)
    SELECT f.user_id, event_id, array_to_string(list_transform(range(4), lambda k: ids[least(pos + k, n - 1) + 1]), ',') AS chunk FROM f JOIN v USING (user_id)""",
)
def e12(spark, sf_dir):
    return tb.clamped_chunk(frames(spark, sf_dir), KEYS, ORDER, "event_id", 4).select("user_id", "event_id", F.array_join(F.col("chunk").cast("array<string>"), ",").alias("chunk"))


@query(
    "e15_history_indices",
    f"""WITH {FRAMES}, v AS (SELECT user_id, list(event_id ORDER BY t, event_id) AS ids FROM f GROUP BY user_id)
    SELECT f.user_id, event_id, array_to_string(list_transform(range(3), lambda k: ids[greatest(pos - 2 * k, 0) + 1]), ',') AS history FROM f JOIN v USING (user_id)""",
)
def e15(spark, sf_dir):
    return tb.spaced_history(frames(spark, sf_dir), KEYS, ORDER, "event_id", 3, 2).select("user_id", "event_id", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


@query("e21_monte_carlo_return", f"WITH {FRAMES} SELECT user_id, event_id, round(2 * pow(0.99, n - 1 - pos) - 1, 9) AS ret FROM f")
def e21(spark, sf_dir):
    return frames(spark, sf_dir).select("user_id", "event_id", rounded(2 * F.pow(F.lit(0.99), F.col("n") - 1 - F.col("pos")) - 1, 9).alias("ret"))


@query(
    "e22_run_detector",
    f"""WITH {FRAMES}, i AS (SELECT user_id, value > 60 AS hi, pos - row_number() OVER (PARTITION BY user_id, value > 60 ORDER BY t, event_id) AS island FROM f),
    r AS (SELECT user_id, hi, island, count(*) FILTER (hi) AS k FROM i GROUP BY ALL)
    SELECT user_id, max(k) AS longest, max(k) >= 5 AS detected FROM r GROUP BY user_id""",
)
def e22(spark, sf_dir):
    return tb.long_runs(frames(spark, sf_dir), KEYS, ORDER, F.col("value") > 60, 5)


@query(
    "c2_nearest_match",
    """WITH l AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
    r AS (SELECT user_id, event_id AS match, epoch_us(ts) AS match_at FROM events WHERE event_type = 'view'),
    p AS (SELECT l.*, match, match_at, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(match_at - t), match_at, match) AS k
          FROM l LEFT JOIN r ON l.user_id = r.user_id AND abs(match_at - t) <= 43200000000)
    SELECT user_id, event_id, t, coalesce(match, -1) AS match, coalesce(match_at, -1) AS match_at FROM p WHERE k = 1""",
)
def c2(spark, sf_dir):
    e = frames(spark, sf_dir).select("user_id", "event_id", "event_type", "t")
    left, right = (e.where(F.col("event_type") == k).drop("event_type") for k in ("purchase", "view"))
    found = tb.nearest_match(left, right.withColumnRenamed("event_id", "id"), "user_id", "t", 43_200_000_000, "id")
    return found.fillna(-1, ["match", "match_at"]).select("user_id", "event_id", "t", "match", "match_at")


@query(
    "c7_lag_pairs",
    f"""WITH {FRAMES}, p AS (SELECT *, lead(value, 3) OVER w AS later, lead(segment_id, 3) OVER w AS ls FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT user_id, event_id, value, later FROM p WHERE ls = segment_id""",
)
def c7(spark, sf_dir):
    return tb.lag_pairs(frames(spark, sf_dir), KEYS, ORDER, "value", 3).select("user_id", "event_id", "value", "later")


@query(
    "d1_dimension_statistics",
    """WITH x AS (SELECT unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    SELECT CAST(dim AS INT) AS dim, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
           round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.99), 6) AS q99 FROM x GROUP BY dim""",
)
def d1(spark, sf_dir):
    s = st.dimension_statistics(table(spark, sf_dir, "embeddings"), "embedding")
    return s.select("dim", *[rounded(c).alias(c) for c in s.columns[1:]])


@query("d7_count_per_key", "SELECT user_id, event_type, count(*) AS rows FROM events GROUP BY ALL")
def d7(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("rows"))


@query(
    "d8_conditional_counts",
    f"WITH {FRAMES} SELECT user_id, count(*) FILTER (gap_mask) AS gaps, max(segment_id) + 1 AS segments, count(*) FILTER (dt = 0) AS repeats FROM f GROUP BY user_id",
)
def d8(spark, sf_dir):
    w = W.partitionBy(*KEYS).orderBy(*ORDER)
    f = frames(spark, sf_dir).withColumn("dt", F.col("t") - F.lag("t").over(w))
    return f.groupBy("user_id").agg(F.count_if("gap_mask").alias("gaps"), (F.max("segment_id") + 1).alias("segments"), F.count_if(F.col("dt") == 0).alias("repeats"))


@query(
    "d9_status_histogram",
    f"SELECT status, count(event_id) AS rows FROM (SELECT unnest({EVENT_TYPES}) AS status) LEFT JOIN events ON event_type = status GROUP BY status",
)
def d9(spark, sf_dir):
    return st.histogram_with_zeros(table(spark, sf_dir, "events"), "event_type", EVENT_TYPES)


@query(
    "d11_motion_correlation",
    f"""WITH {FRAMES}, p AS (SELECT user_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS later FROM f)
    SELECT user_id, count(later) AS pairs, round(coalesce(CASE WHEN stddev_pop(value) FILTER (later IS NOT NULL) > 0 AND stddev_pop(later) > 0 THEN corr(value, later) END, 0), 6) AS r FROM p GROUP BY user_id""",
)
def d11(spark, sf_dir):
    p = frames(spark, sf_dir).withColumn("later", F.lead("value").over(W.partitionBy(*KEYS).orderBy(*ORDER)))
    r = st.correlation(F.col("value"), F.col("later"))
    return p.groupBy("user_id").agg(F.count("later").alias("pairs"), rounded(F.coalesce(r, F.lit(0.0))).alias("r"))


@query(
    "d16_nested_summary",
    "SELECT event_type, CAST(user_id % 4 AS INT) AS unit, round(avg(value), 6) AS mean, median(value) AS median, min(value) AS min, max(value) AS max FROM events GROUP BY GROUPING SETS ((event_type), (event_type, user_id % 4))",
)
def d16(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("unit", (F.col("user_id") % 4).cast("int"))
    return st.nested_summary(e, [["event_type"], ["event_type", "unit"]], "value").withColumn("mean", rounded("mean"))


@query("d18_success_rate", "SELECT user_id, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 9) AS rate, round(avg(value), 6) AS coverage FROM events GROUP BY user_id")
def d18(spark, sf_dir):
    ok = F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(rounded(F.avg(ok), 9).alias("rate"), rounded(F.avg("value")).alias("coverage"))


@query(
    "d19_ensemble",
    """SELECT user_id, round(avg(value), 6) AS average, round(avg(value) - coalesce(stddev_samp(value), 0), 6) AS lcb,
    round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 9) AS vote FROM events GROUP BY user_id""",
)
def d19(spark, sf_dir):
    vote = F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        rounded(F.avg("value")).alias("average"), rounded(st.lower_confidence(F.avg("value"), F.stddev_samp("value"))).alias("lcb"), rounded(vote, 9).alias("vote")
    )


@query("d22_linear_slope", f"WITH {FRAMES} SELECT user_id, round(regr_slope(value, pos), 6) AS slope FROM f GROUP BY user_id")
def d22(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("user_id").agg(rounded(F.regr_slope("value", "pos")).alias("slope"))


@query(
    "d25_holm_adjust",
    """WITH p AS (SELECT n_regionkey AS family, n_nationkey AS id, (n_nationkey + 1) / 500.0 AS p FROM nation),
    s AS (SELECT *, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p) + 1) AS k FROM p)
    SELECT family, id, round(least(1.0, max(k) OVER (PARTITION BY family ORDER BY p)), 9) AS p_holm FROM s""",
)
def d25(spark, sf_dir):
    p = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") + 1) / 500.0).alias("p"))
    return st.holm(p, "p", ["family"]).select("family", "id", rounded("p_holm", 9).alias("p_holm"))


@query(
    "d28_envelope",
    "SELECT l_returnflag, min(l_quantity) - 0.05 * (max(l_quantity) - min(l_quantity)) AS low, max(l_quantity) + 0.05 * (max(l_quantity) - min(l_quantity)) AS high FROM lineitem GROUP BY l_returnflag",
)
def d28(spark, sf_dir):
    low, high = F.min("l_quantity"), F.max("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((low - 0.05 * (high - low)).alias("low"), (high + 0.05 * (high - low)).alias("high"))


@query(
    "d34_filter_statistics",
    "SELECT source, count(*) AS total, count(*) FILTER (n_chars < 500) AS filtered, count(*) FILTER (NOT n_chars < 500) AS passed, round(100.0 * count(*) FILTER (n_chars < 500) / count(*), 6) AS rate FROM documents GROUP BY source",
)
def d34(spark, sf_dir):
    short = F.col("n_chars") < 500
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(short).alias("filtered"), F.count_if(~short).alias("passed"), rounded(100.0 * F.count_if(short) / F.count("*")).alias("rate")
    )


@query(
    "d35_best_and_worst",
    """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS hi, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS lo FROM events)
    SELECT user_id, event_id, 'best' AS side, CAST(hi AS INT) AS rank FROM r WHERE hi <= 3 UNION ALL SELECT user_id, event_id, 'worst', CAST(lo AS INT) FROM r WHERE lo <= 3""",
)
def d35(spark, sf_dir):
    return st.best_and_worst(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id", 3).select("user_id", "event_id", "side", "rank")


@query(
    "f2_diverse_top",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM a WHERE k = 1)
    SELECT user_id, event_id, event_type, CAST(r AS INT) AS rank FROM b WHERE r <= 3""",
)
def f2(spark, sf_dir):
    return sel.diverse_top(table(spark, sf_dir, "events"), ["user_id"], "event_type", [F.desc("value"), F.asc("event_id")], 3).select("user_id", "event_id", "event_type", "rank")


@query(
    "f3_seeded_order",
    "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('20260711:' || o_orderkey)) AS INT) AS rank FROM orders",
)
def f3(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(sel.hash_order("20260711", F.col("o_orderkey")))).alias("rank"))


@query("f8_tail_split", f"WITH {FRAMES} SELECT user_id, event_id, CASE WHEN pos + 1 > n - ceil(n / 20) THEN 'test' ELSE 'train' END AS split FROM f")
def f8(spark, sf_dir):
    return sel.tail_split(frames(spark, sf_dir), KEYS, ORDER, 20).select("user_id", "event_id", "split")


@query(
    "f12_evenly_spaced",
    f"""WITH {FRAMES} SELECT user_id, event_id FROM f WHERE list_contains(list_transform(range(5), lambda i: CAST(round_even(i * (n - 1) / 4, 0) AS BIGINT)), pos)""",
)
def f12(spark, sf_dir):
    return sel.evenly_spaced(frames(spark, sf_dir), KEYS, ORDER, 5).select("user_id", "event_id")


@query(
    "b4_held_out_split",
    "WITH k AS (SELECT DISTINCT p_brand FROM part), r AS (SELECT *, row_number() OVER (ORDER BY sha256('20260711:' || p_brand), p_brand) AS i FROM k) SELECT p_brand, i <= 5 AS held_out FROM r",
)
def b4(spark, sf_dir):
    return sel.held_out(table(spark, sf_dir, "part"), "p_brand", "20260711", 5)


@query(
    "g6_inventory_difference",
    """SELECT coalesce(c_custkey, o_custkey) AS custkey, CASE WHEN o_custkey IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unexpected' ELSE 'complete' END AS state
    FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey""",
)
def g6(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey").distinct()
    state = F.when(F.col("o_custkey").isNull(), "missing").when(F.col("c_custkey").isNull(), "unexpected").otherwise("complete")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full").select(F.coalesce("c_custkey", "o_custkey").alias("custkey"), state.alias("state"))


@query(
    "h1_vector_norms",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
    SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm FROM v""",
)
def h1(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(vec.norm(F.col("embedding"))).alias("norm"))


@query(
    "h7_circular_distance",
    "SELECT event_id, round(least(abs(value - event_id % 360) % 360, 360 - abs(value - event_id % 360) % 360), 6) AS degrees FROM events",
)
def h7(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rounded(vec.circular_degrees(F.col("value"), F.col("event_id") % 360)).alias("degrees"))


@query(
    "h14_min_max_modes",
    """WITH b AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id)
    SELECT event_id, round(CASE WHEN hi - lo = 0 THEN NULL ELSE 2 * (value - lo) / (hi - lo) - 1 END, 6) AS plain,
           round(greatest(-1.0, least(1.0, 2 * (value - lo) / (hi - lo + 1e-8) - 1)), 6) AS clipped,
           round(CASE WHEN hi - lo <= 1e-12 THEN 0.0 ELSE 2 * (value - lo) / (hi - lo) - 1 END, 6) AS constant_zero FROM events JOIN b USING (user_id)""",
)
def h14(spark, sf_dir):
    w = W.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumns({"lo": F.min("value").over(w), "hi": F.max("value").over(w)})
    return e.select("event_id", *[rounded(st.scaled(F.col("value"), F.col("lo"), F.col("hi"), m)).alias(m) for m in ("plain", "clipped", "constant_zero")])


@query("h20_deterministic_seed", "SELECT o_orderkey, CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 9, 8))::BIGINT & 2147483647 AS BIGINT) AS seed FROM orders")
def h20(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", vec.seed_of(F.col("o_orderkey").cast("string")).alias("seed"))


@query(
    "h23_relative_change",
    f"""WITH {FRAMES}, p AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM f)
    SELECT user_id, event_id, round(CASE WHEN before <> 0 THEN (value - before) / before END, 6) AS change FROM p""",
)
def h23(spark, sf_dir):
    before = F.lag("value").over(W.partitionBy(*KEYS).orderBy(*ORDER))
    return frames(spark, sf_dir).withColumn("before", before).select("user_id", "event_id", rounded(st.relative_change(F.col("value"), F.col("before"))).alias("change"))


@query(
    "i1_keyword_filter",
    "SELECT doc_id FROM documents WHERE text IS NULL OR text = '' OR (contains(lower(text), 'the') AND NOT contains(lower(text), 'password'))",
)
def i1(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(txt.keyword_pass(F.col("text"), ["the"], ["password"])).select("doc_id")


@query("i6_ascii_scrub", "SELECT doc_id, sha256(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')) AS digest FROM documents")
def i6(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(txt.ascii_only(F.col("text")), 256).alias("digest"))


@query("i14_json_attribute", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def i14(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e1(spark, sf_dir)
