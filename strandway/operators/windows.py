"""Windows over time-ordered rows beyond the time base: resampling, gathers, deltas, stress views and lag sweeps.

All take rows with ``pos`` and ``n`` (place in the sequence and its length) and use one sort by key and order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandway.functions import rotations as rot
from strandway.functions.seeds import uniform


def resampled(lengths: DataFrame, source: float, target: float) -> DataFrame:
    """pos: rint(i * source / target) for every i that stays inside each sequence. Upsampling raises a ValueError."""
    if target > source:
        raise ValueError("a sequence can only be resampled to a lower rate")
    last = F.floor((F.col("n") - 1) * target / source)
    return lengths.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("pos", F.rint(F.col("i") * source / target).cast("long")).drop("i")


def strict_future_windows(df: DataFrame, horizon: int, stride: int) -> DataFrame:
    """Starts of windows of ``horizon`` rows that also have ``horizon`` strictly later rows, shifted by one."""
    return df.where((F.col("pos") % stride == 0) & (F.col("pos") + horizon < F.col("n"))).withColumn("phase", F.col("pos") / F.greatest(F.lit(1), F.col("n") - 1))


def lagged_window_count(n: Column, offset: int, history: int, future: int, stride: int) -> Column:
    """How many windows of ``history`` rows with ``future`` rows from ``offset`` on fit into n rows."""
    return F.greatest(F.lit(0), F.floor((n - offset - future - (history - 1)) / stride) + 1).cast("long")


def velocity(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """velocity: the mean of the last ``width`` first differences, 0 on the first row."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("velocity", F.coalesce(F.avg("_d").over(w.rowsBetween(1 - width, 0)), F.lit(0.0))).drop("_d")


def subframes(df: DataFrame, dense: int, stride: int) -> DataFrame:
    """The first ``dense`` rows, then every ``stride``-th."""
    return df.where((F.col("pos") < dense) | ((F.col("pos") - dense) % stride == 0))


def context_window(df: DataFrame, chunk: int, times: int) -> DataFrame:
    """first and stop (exclusive) of ``times`` chunks around a row, begun (times - 1) * chunk // 2 rows before it."""
    first = F.greatest(F.lit(0).cast("long"), F.col("pos").cast("long") - (times - 1) * chunk // 2)
    return df.withColumns({"first": first, "stop": F.least(F.col("n").cast("long"), first + times * chunk)})


def gathered(df: DataFrame, keys: list[str], order: list[str], value: str, offsets: list[int], padding: str = "first_last") -> DataFrame:
    """gathered: the values at pos + offset for each offset; past an end the first or last one, or 0 (``zero``)."""
    if padding not in ("first_last", "zero"):
        raise ValueError(padding)
    w = W.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    low, high = (F.lit(0.0), F.lit(0.0)) if padding == "zero" else (F.first(value).over(whole), F.last(value).over(whole))

    def at(d: int) -> Column:
        inner = F.lead(value, d).over(w) if d > 0 else F.lag(value, -d).over(w) if d < 0 else F.col(value)
        return F.when(F.col("pos") + d < 0, low).when(F.col("pos") + d >= F.col("n"), high).otherwise(inner)

    return df.withColumn("gathered", F.array(*[at(d) for d in offsets]))


def downsampled_windows(df: DataFrame, length: int, ratio: int) -> DataFrame:
    """Starts whose rows pos, pos + ratio, ... of the given number all exist, and the last of them."""
    last = F.col("pos") + (length - 1) * ratio
    return df.where(last < F.col("n")).withColumn("last_pos", last.cast("long"))


def baselined_deltas(df: DataFrame, keys: list[str], order: list[str], value: str, length: int) -> DataFrame:
    """deltas: the values of rows pos .. pos + length - 1 less the value before pos, where all of them exist."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    parts = [(F.lead(value, k).over(w) if k else F.col(value)) - before for k in range(length)]
    return df.withColumn("deltas", F.array(*parts)).where((F.col("pos") >= 1) & (F.col("pos") + length <= F.col("n")))


def transitions(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """transition (difference to the row before, null on the first) and rebuilt, the first value plus all of them."""
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("transition", F.col(value) - F.lag(value).over(w))
    return out.withColumn("rebuilt", F.first(value).over(w) + F.coalesce(F.sum("transition").over(w), F.lit(0.0)))


def largest_step(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """largest_step: the largest difference between neighbouring rows of a segment, 0 without any."""
    w = W.partitionBy(*keys).orderBy(*order)
    step = F.when(~F.col("gap_mask"), F.abs(F.col(value) - F.lag(value).over(w)))
    return df.withColumn("_s", step).groupBy(*keys).agg(F.coalesce(F.max("_s"), F.lit(0.0)).alias("largest_step"))


def global_index(lengths: DataFrame, key: str, block: int = 1000) -> DataFrame:
    """base: the rows of all sequences with a smaller numeric key. Sums run by blocks of keys, so that neither a task
    nor a window holds all sequences: one window over blocks, one within each."""
    blocks = lengths.withColumn("_b", F.floor(F.col(key) / block))
    totals = blocks.groupBy("_b").agg(F.sum("n").alias("_n")).withColumn("_g", F.floor(F.col("_b") / block))
    groups = totals.groupBy("_g").agg(F.sum("_n").alias("_m"))
    groups = groups.withColumn("_before", F.coalesce(F.sum("_m").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    earlier = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.join(groups, "_g").withColumn("_base", F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select("_b", "_base")
    own = W.partitionBy("_b").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return blocks.join(bases, "_b").withColumn("base", F.col("_base") + F.coalesce(F.sum("n").over(own), F.lit(0))).drop("_b", "_base")


def repeated_groups(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """group: numbers runs of equal values in a row, from 0."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(0))
    return df.withColumn("_new", F.when(F.row_number().over(w) == 1, 0).otherwise(new)).withColumn("group", F.sum("_new").over(w)).drop("_new")


STRESSES = ("baseline", "frame_drop", "timestamp_jitter", "pause", "step_jump")


def temporal_stress(df: DataFrame, keys: list[str], id_col: str, hz: float = 30.0, drop_every: int = 10, jitter: float = 0.008, exceed: float = 0.005, pause: float = 0.5, long_pause: float = 0.25, jump: int = 20) -> DataFrame:
    """stress and pair_count, row_jumps, jitter_exceeds, pauses, step_jumps, nonmonotonic: what each detector counts
    when rows of long enough sequences are dropped, their times jittered (normal numbers from a hash of ``id_col``),
    halted half-way, or their step numbers moved."""
    rows = df.where(F.col("n") >= max(4, drop_every + 1)).withColumn("stress", F.explode(F.array(*[F.lit(s) for s in STRESSES])))
    kind = lambda s: F.col("stress") == s
    rows = rows.where(~kind("frame_drop") | ((F.col("pos") + 1) % drop_every != 0))
    name = F.col(id_col).cast("string")
    noise = F.sqrt(-2 * F.log(1 - uniform(F.concat(name, F.lit("|r"))))) * F.cos(2 * math.pi * uniform(F.concat(name, F.lit("|a"))))
    late = F.col("pos") >= F.floor(F.col("n") / 2)
    time = F.col("pos") / hz + F.when(kind("timestamp_jitter"), noise * jitter).when(kind("pause") & late, pause).otherwise(0.0)
    step = F.col("pos") + F.when(kind("step_jump") & late, jump).otherwise(0)
    w = W.partitionBy("stress", *keys).orderBy("pos")
    diff = lambda c: F.col(c) - F.lag(c).over(w)
    d = rows.withColumns({"time": time, "step": step}).withColumns({"dr": diff("pos"), "dt": diff("time"), "ds": diff("step")}).where("dr IS NOT NULL")
    return d.groupBy("stress").agg(
        F.count("*").alias("pair_count"),
        F.count_if(F.col("dr") != 1).alias("row_jumps"),
        F.count_if(F.abs(F.col("dt") - F.col("dr") / hz) > exceed).alias("jitter_exceeds"),
        F.count_if(F.col("dt") > long_pause).alias("pauses"),
        F.count_if(F.col("ds") != F.col("dr")).alias("step_jumps"),
        F.count_if(F.col("dt") <= 0).alias("nonmonotonic"),
    )


def lag_sweep(df: DataFrame, keys: list[str], order: list[str], value: str, lags: list[int]) -> DataFrame:
    """lag and later: each row with the value ``lag`` rows on in its segment, for every lag; one sort, no join."""
    w = W.partitionBy(*keys).orderBy(*order)
    later = lambda k: F.when(F.lead("segment_id", k).over(w) == F.col("segment_id"), F.lead(value, k).over(w))
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), later(k).alias("later")) for k in lags])
    return df.withColumn("_p", pairs).select(*df.columns, F.inline("_p")).where("later IS NOT NULL")


def best_lag(errors: DataFrame, keys: list[str]) -> DataFrame:
    """by_error and by_correlation of rows with lag, error and r; the first lag wins a tie."""
    first = lambda score: F.min_by("lag", F.struct(score, F.col("lag")))
    return errors.groupBy(*keys).agg(first(F.col("error")).alias("by_error"), first(-F.coalesce("r", F.lit(0.0))).alias("by_correlation"))


def busiest_window(df: DataFrame, keys: list[str], order: list[str], energy: str, width: int) -> DataFrame:
    """first and total: the whole window of ``width`` rows with the most energy; the first of equal ones."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(0, width - 1)
    sums = df.withColumn("_e", F.sum(energy).over(w)).where(F.col("pos") + width <= F.col("n"))
    return sums.groupBy(*keys).agg(F.max_by("pos", F.struct(F.col("_e"), -F.col("pos"))).alias("first"), F.max("_e").alias("total"))


def clip_chunks(lengths: DataFrame, size: int) -> DataFrame:
    """chunk, first and stop: a sequence in chunks of ``size``; a rest of at least half a chunk is one of its own, a
    smaller one is left out."""
    chunks = F.floor(F.col("n") / size) + F.when(2 * (F.col("n") % size) >= size, 1).otherwise(0)
    rows = lengths.withColumn("_c", chunks.cast("int")).where("_c > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).drop("_c")
    return rows.withColumns({"first": (F.col("chunk") * size).cast("long"), "stop": F.least(F.col("n").cast("long"), (F.col("chunk") + 1) * size)})


def corrupted(df: DataFrame, width: int, kind: str) -> DataFrame:
    """source_pos: which row a window of ``width`` rows shows in this row's place when it is frozen on its first row,
    reversed, or shifted by one with the first repeated."""
    start = F.floor(F.col("pos") / width) * width
    stop = F.least(F.col("n"), start + width) - 1
    moved = {"frozen": start, "reversed": start + stop - F.col("pos"), "shifted": F.greatest(start, F.col("pos") - 1)}[kind]
    return df.withColumn("source_pos", moved.cast("long"))


def clip_start(df: DataFrame, keys: list[str], order: list[str], energy: list[str], width: int, stride: int) -> DataFrame:
    """first: where the clip of ``width`` rows begins that moves most; 0 in a sequence of ``width`` rows or fewer.

    Clips begin at rows 1, 1 + stride, ...; of each the energies (summed over the columns, null as 0) of every
    ``stride``-th row after its first count. Of equal clips the last one is taken.
    """
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in energy[1:]), F.coalesce(F.col(energy[0]).cast("double"), F.lit(0.0)))
    w = W.partitionBy(*keys).orderBy(*order)
    sampled = df.where((F.col("pos") - 1) % stride == 0).withColumn("_e", total)
    after = (width - 1) // stride
    scored = sampled.withColumn("_s", F.coalesce(F.sum("_e").over(w.rowsBetween(1, after)), F.lit(0.0)) if after else F.lit(0.0))
    best = scored.where(F.col("pos") + width <= F.col("n")).groupBy(*keys).agg(F.max(F.struct("_s", "pos"))["pos"].cast("long").alias("first"))
    every = df.groupBy(*keys).agg(F.lit(0).cast("long").alias("_zero"))
    return every.join(best, keys, "left").select(*keys, F.coalesce("first", "_zero").alias("first"))


def open_loop_actions(df: DataFrame, keys: list[str], order: list[str], chunk: str, horizon: int) -> DataFrame:
    """planned_at, place and action: what each step does when a plan is made every ``horizon`` steps and played out.

    Every row offers a plan, an array of actions; only those of the steps that divide by ``horizon`` are taken. Where a
    plan is null or shorter than the steps it has to last, the action is null.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    place = (F.col("pos") % horizon).cast("int")
    plan = F.last(F.when(place == 0, F.struct(F.col(chunk).alias("c"))), ignorenulls=True).over(w)
    return df.withColumns({"planned_at": F.col("pos") - place, "place": place, "action": F.get(plan["c"], place)})


def view_pairs(df: DataFrame, keys: list[str], order: list[str], pool: str, target: str, strides: dict[str, int], phases: dict[str, int]) -> DataFrame:
    """view, pool, target, crosses: for each time view, each of its rows with the target of its next row in the segment.

    A view takes every k-th row of a segment, or as many rows as it has ``phases`` at even phases. Rows have pos and n,
    their place in the segment and its length. ``crosses`` says whether the two rows' segments differ, which no view
    should do. Views of strides share one sort; a pair of a row is a lead by the stride.
    """
    w = W.partitionBy(*keys, "segment_id").orderBy(*order)
    pair = lambda view, on, k: F.when(on & F.lead("segment_id", k).over(w).isNotNull(), F.struct(F.lit(view).alias("view"), F.lead(target, k).over(w).alias("target"), (F.lead("segment_id", k).over(w) != F.col("segment_id")).alias("crosses")))
    base = df.select(*keys, *order, "segment_id", "pos", "n", F.col(pool).alias("pool"), F.col(target).alias(target))
    found = base.withColumn("_p", F.array_compact(F.array(*[pair(v, F.col("pos") % k == 0, k) for v, k in strides.items()]))).select(*keys, "pool", F.inline("_p"))
    for view, bins in phases.items():
        b = F.least(F.col("n"), F.lit(bins)).cast("long")
        step = F.when(b > 1, (F.col("n") - 1) / (b - 1)).otherwise(F.lit(0.0))
        # a row is at a phase where rounding some multiple of the step gives its place: the nearest one up or down
        near = F.floor(F.col("pos") / F.when(step > 0, step).otherwise(1.0))
        at = F.exists(F.array(near - 1, near, near + 1, near + 2), lambda i: (i >= 0) & (i < b) & (F.rint(i * step) == F.col("pos")))
        rows = base.where(at).withColumn("_p", F.array_compact(F.array(pair(view, F.lit(True), 1))))
        found = found.unionByName(rows.select(*keys, "pool", F.inline("_p")))
    return found


def shown_rows(df: DataFrame, keys: list[str], order: list[str], width: int, kind: str, severity: float, draw: Column, rate: float = 30.0) -> DataFrame:
    """window, place, left, right and share: of each whole window of ``width`` rows, which of its rows is shown in this
    row's place (``left``; where it lies between two, ``right`` by ``share`` and ``left`` by the rest).

    drop: a share ``severity`` of the places after the first, at least one, drawn by ``draw`` (the least go), shows the
    last row that wasn't dropped. jitter: each place moves by up to ``severity`` ms at ``rate`` rows a second, as
    ``draw`` says, within the window. pause: the row before the middle part of ``severity`` seconds is shown throughout
    it. jump: from the middle on, rows ``severity`` places on are shown, the last one in the end.
    """
    whole = df.where(F.floor(F.col("pos") / width) * width + width <= F.col("n")).withColumns({"window": F.floor(F.col("pos") / width), "place": (F.col("pos") % width).cast("int")})
    place, end = F.col("place"), width - 1
    flat = lambda x: {"left": x.cast("int"), "right": x.cast("int"), "share": F.lit(0.0)}
    if kind == "drop":
        count = min(end, max(1, math.ceil(severity * width)))
        by_draw = W.partitionBy(*keys, "window").orderBy(F.when(place > 0, draw).asc_nulls_last(), "place")
        lost = whole.withColumn("_lost", (place > 0) & (F.row_number().over(by_draw) <= count))
        running = W.partitionBy(*keys, "window").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return lost.withColumns(flat(F.max(F.when(~F.col("_lost"), place)).over(running))).drop("_lost")
    if kind == "jitter":
        at = F.least(F.greatest(place + (draw * 2 - 1) * severity * rate / 1000, F.lit(0.0)), F.lit(float(end)))
        return whole.withColumn("_at", at).withColumns({"left": F.floor("_at").cast("int"), "right": F.ceil("_at").cast("int"), "share": F.col("_at") - F.floor("_at")}).drop("_at")
    if kind == "pause":
        length = min(end, max(1, round(severity * rate)))
        start = max(1, (width - length) // 2)
        return whole.withColumns(flat(F.when((place >= start) & (place < start + length), start - 1).otherwise(place)))
    if kind == "jump":
        return whole.withColumns(flat(F.when(place >= max(1, width // 2), F.least(place + int(severity), F.lit(end))).otherwise(place)))
    raise ValueError(f"no such corruption: {kind}")


def shown_values(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``df``, rows of ``shown_rows``, with shown: the value that stands in each place, blended where it lies between two."""
    held = F.collect_list(F.struct(F.col(value).cast("double").alias("v"))).over(W.partitionBy(*keys, "window").orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    of = lambda i: F.get(F.col("_held"), F.col(i))["v"]
    shown = F.when(F.col("share") == 0, of("left")).otherwise(of("left") * (1 - F.col("share")) + of("right") * F.col("share"))
    return df.withColumn("_held", held).withColumn("shown", shown).drop("_held")


def relative_poses(df: DataFrame, keys: list[str], order: list[str], pose: str, rebase: int = 1) -> DataFrame:
    """relative: place and xyz angles of each row but the first, seen from a base row of its sequence. The base is the
    row before, or with ``rebase`` over 1 the last row before whose place in the sequence divides by it."""
    w = W.partitionBy(*keys).orderBy(*order)
    back = (F.col("pos") - 1) % rebase
    base = F.lag(pose, 1).over(w) if rebase == 1 else F.coalesce(*[F.when(back == d, F.lag(pose, d + 1).over(w)) for d in range(rebase)])
    rows = df.withColumn("_b", base).where("_b IS NOT NULL")
    angles = lambda p: F.slice(p, 4, 3)
    moved = F.zip_with(F.slice(pose, 1, 3), F.slice("_b", 1, 3), lambda a, b: a - b)
    rows = rows.withColumns({"_t": rot.transposed(rot.matrix_of_euler(angles(F.col("_b")))), "_d": moved, "_m": rot.matrix_of_euler(angles(F.col(pose)))})
    place = F.array(*[sum((F.col("_t")[3 * i + j] * F.col("_d")[j] for j in (1, 2)), F.col("_t")[3 * i] * F.col("_d")[0]) for i in range(3)])
    return rows.withColumn("relative", F.concat(place, rot.bound(rot.product(F.col("_t"), F.col("_m")), rot.euler_of_matrix))).drop("_b", "_t", "_d", "_m")


def sampled_stride(n: Column, fps: Column, low: float, high: float, length: int, u: Column, v: Column) -> Column:
    """stride, start and fps of ``length`` frames of ``n``: of the strides that keep the rate within [low, high] the
    largest, or for one draw ``u`` in a hundred the one below it; the start is drawn by ``v``. Null without any."""
    least = F.greatest(F.lit(1), F.ceil(fps / F.lit(high))).cast("int")
    most = F.least(F.floor((n - 1) / (length - 1)), F.floor(fps / F.lit(low))).cast("int")
    stride = F.when((u < 0.01) & (most > least), most - 1).otherwise(most)
    starts = n - (length - 1) * stride
    return F.when(most >= least, F.struct(stride.alias("stride"), F.floor(v * starts).cast("int").alias("start"), (fps / stride).alias("fps")))


def window_frames(start: Column, stop: Column, count: int, how: str, u: Column | None = None, allowed: tuple[int, ...] = (1,)) -> Column:
    """Frame numbers of a caption window [start, stop), null where it is too short: the middle ``count`` at the lowest
    rate whose step is ``allowed`` (native) or at the rate it has (original); ``count`` in a row from a start drawn by
    ``u`` (consecutive); or every fourth and every fifth of those, both but for the first and the last
    (interleaved)."""
    total = (stop - start).cast("int")
    if how in ("native", "original"):
        step = F.floor(total / count).cast("int") if how == "native" else F.lit(1)
        first = start.cast("int") + F.floor((total - count * step) / 2).cast("int")
        fits = (total >= count) & (step.isin(*allowed) if how == "native" else F.lit(True))
        return F.when(fits, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: first + i * step))
    first = start.cast("int") + F.floor(u * (total - count + 1)).cast("int")
    if how == "consecutive":
        return F.when(total >= count, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: first + i))
    if how == "interleaved":
        places = sorted([*range(0, count, 4), *range(0, count, 5)])[1:-1]
        return F.when(total >= count, F.transform(F.array(*[F.lit(p) for p in places]), lambda i: first + i))
    raise ValueError(how)


def spaced_windows(lengths: DataFrame, every: int, length: int, interval: int) -> DataFrame:
    """first and frames: whole windows of ``length`` frames ``interval`` apart that start ``every`` frames."""
    last = F.col("n") - 1 - (length - 1) * interval
    rows = lengths.where(last >= 0).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(every).cast("long"))))
    return rows.withColumn("frames", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.col("first") + i * interval))


def consecutive(values: Column, count: int, u: Column | None = None) -> Column:
    """``count`` neighbours of an array, from its start or from a place drawn by ``u``; null where it is shorter."""
    first = F.lit(0) if u is None else F.floor(u * (F.size(values) - count + 1)).cast("int")
    return F.when(F.size(values) >= count, F.slice(values, first + 1, F.lit(count)))


def view_metrics(df: DataFrame, keys: list[str], value: str, strides: list[int]) -> DataFrame:
    """view (a stride), frames, pairs and residual (mean absolute difference of neighbours) of each strided view."""
    rows = df.withColumn("view", F.explode(F.array(*[F.lit(s) for s in strides]))).where(F.col("pos") % F.col("view") == 0)
    later = F.lead(value).over(W.partitionBy("view", *keys).orderBy("pos"))
    return rows.withColumn("_d", F.abs(later - F.col(value))).groupBy("view").agg(F.count("*").alias("frames"), F.count("_d").alias("pairs"), F.avg("_d").alias("residual"))
