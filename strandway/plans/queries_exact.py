"""Queries of run-length masks, exact quantiles and content hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandway.functions import runs
from strandway.operators import digests
from strandway.operators import quantiles as qt
from strandway.plans.catalog import query
from strandway.plans.queries_core import FRAMES, KEYS, ORDER, frames, rounded, table

_FLAGS = """d AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, coalesce(value > 20, false) AS f FROM events)"""


def masks(spark, sf_dir):
    """A mask of each user's events, whose value is over 20 or not, encoded and read back."""
    return runs.intervals(runs.masks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 20))


@query(
    "k6_run_decode",
    f"""WITH {_FLAGS}, s AS (SELECT *, n // 4 AS lo, n - n // 4 AS hi FROM d),
    r AS (SELECT user_id, pos - lo AS p, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM s WHERE f AND pos >= lo AND pos < hi),
    i AS (SELECT user_id, min(p) AS a, max(p) + 1 AS b FROM r GROUP BY user_id, g)
    SELECT z.user_id, z.n AS size, count(i.a) AS intervals, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS area, coalesce(string_agg(a || '-' || b, ',' ORDER BY a), '') AS ones
    FROM (SELECT DISTINCT user_id, n FROM d) z LEFT JOIN i USING (user_id) GROUP BY ALL""",
)
def k6(spark, sf_dir):
    quarter = F.expr("size div 4")
    part = masks(spark, sf_dir).withColumn("part", runs.clipped(F.col("ones"), quarter, F.col("size") - quarter))
    text = F.array_join(F.transform("part", lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return part.select("user_id", "size", F.size("part").cast("long").alias("intervals"), runs.area(F.col("part")).alias("area"), text.alias("ones"))


@query("k6_frame_areas", f"WITH {_FLAGS} SELECT user_id, pos // 16 AS frame, count(*) AS area FROM d WHERE f GROUP BY ALL")
def k6_frames(spark, sf_dir):
    return runs.frame_areas(masks(spark, sf_dir), ["user_id"], 16)


_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_STATS = "count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.99), 6) AS q99"


@query(
    "d4_column_statistics",
    f"""WITH x AS ({" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS column, 0 AS dim, CAST({c} AS DOUBLE) AS x FROM lineitem" for c in _NUMBERS)})
    SELECT l_returnflag, "column", CAST(dim AS INT) AS dim, {_STATS} FROM x WHERE x IS NOT NULL GROUP BY l_returnflag, "column", dim""",
)
def d4(spark, sf_dir):
    s = qt.column_statistics(table(spark, sf_dir, "lineitem"), _NUMBERS, ["l_returnflag"])
    return s.select("l_returnflag", "column", "dim", "n", *[rounded(c).alias(c) for c in s.columns[4:]])


@query(
    "d4_component_statistics",
    f"""WITH x AS (SELECT 'embedding' AS column, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings UNION ALL SELECT 'label', 0, CAST(label AS DOUBLE) FROM embeddings)
    SELECT "column", CAST(dim AS INT) AS dim, {_STATS} FROM x WHERE x IS NOT NULL GROUP BY "column", dim""",
)
def d4_components(spark, sf_dir):
    s = qt.column_statistics(table(spark, sf_dir, "embeddings"), ["embedding", "label"])
    return s.select("column", "dim", "n", *[rounded(c).alias(c) for c in s.columns[3:]])


def tree_sql(name: str, rows: str, cells: list[str], key: str = "user_id") -> str:
    """CTEs that end in ``name`` (key, rows, sha256), the hash tree of ``rows`` (key, pos and the cells' columns)."""
    text = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in cells)
    return f"""
    {name}_b AS (SELECT {key}, pos // 64 AS idx, count(*) AS rows, sha256(string_agg(sha256({text}), '' ORDER BY pos)) AS h FROM {rows} GROUP BY ALL),
    {name}_t AS (
        SELECT {key}, idx, CAST(rows AS BIGINT) AS rows, h, count(*) OVER (PARTITION BY {key}) AS n FROM {name}_b
        UNION ALL
        SELECT {key}, idx // 64, CAST(sum(rows) AS BIGINT), sha256(string_agg(h, '' ORDER BY idx)), (n + 63) // 64 FROM {name}_t WHERE n > 1 GROUP BY {key}, idx // 64, n),
    {name} AS (SELECT {key}, rows, sha256(rows || ':' || h) AS sha256 FROM {name}_t WHERE n = 1)"""


@query(
    "d29_hash_tree",
    f"""WITH RECURSIVE r AS (SELECT user_id, event_type, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
    {tree_sql("tree", "r", ["event_type", "event_id", "props"])} SELECT user_id, rows, sha256 FROM tree""",
)
def d29_tree(spark, sf_dir):
    return digests.content_hash(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], ["event_type", "event_id", "props"])


_SOURCE = ["event_id", "event_type", "t"]
_PASSED_ON = ["plan", "t", "segment_id", "gap_mask"]


@query(
    "a33_derived_episodes",
    f"""WITH RECURSIVE {FRAMES}, p AS (SELECT *, CAST(round(value * 1000) AS BIGINT) AS plan FROM f),
    {tree_sql("own", "p", _PASSED_ON)}, {tree_sql("source", "p", _SOURCE)}
    SELECT user_id, own.rows, own.sha256 AS content_sha256, source.sha256 AS source_sha256, 'converted' AS status FROM own JOIN source USING (user_id)""",
)
def a33(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("plan", F.round(F.col("value") * 1000).cast("long"))
    return digests.derived(f, KEYS, ORDER, _PASSED_ON, _SOURCE)[1]
