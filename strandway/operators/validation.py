"""Validation of recorded episodes: rules as a table, compiled to one aggregate over the frames.

A rule says of a frame, or of an episode's facts and attributes, what is broken about it. Rules of frames become
aggregates of one ``groupBy``; those of episodes are judged on its result and the episode's attributes. An episode
fails where any rule is broken, and the names of the broken rules are listed by area: structure, time, evidence. What
can't be judged because a value is missing counts as broken.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandway.functions import rotations as rot
from strandway.functions.vectors import dot, norm

AREAS = ("structure", "time", "evidence")
#: Counts of the time base that a stored audit has to repeat.
COUNTS = ("step_repeats", "step_jumps", "step_rollbacks", "timestamp_repeats", "timestamp_jumps", "timestamp_rollbacks", "gaps", "segments")


@dataclass(frozen=True)
class Rule:
    """``broken`` is judged for each frame where ``by_frame``, else once for an episode."""

    name: str
    area: str
    broken: Column
    by_frame: bool = False


@dataclass(frozen=True)
class Limits:
    """Box of places, range of the gripper, how far axes may be from unit length and right angles, and the gap rule."""

    low: tuple[float, float, float] = (-1.0, -1.0, -1.0)
    high: tuple[float, float, float] = (1.0, 1.0, 1.0)
    gripper: tuple[float, float] = (0.0, 1.0)
    axes: float = 2e-4
    step_gap: int = 1
    timestamp_gap: int = 1


@dataclass(frozen=True)
class Contract:
    """What an episode's attributes (a map of strings) have to be: present, equal, beginning, as long, one of."""

    present: tuple[str, ...] = ()
    equal: dict[str, str] = field(default_factory=dict)
    begins: dict[str, str] = field(default_factory=dict)
    length: dict[str, int] = field(default_factory=dict)
    one_of: dict[str, tuple[str, ...]] = field(default_factory=dict)


def with_time_audit(frames: DataFrame, keys: list[str], order: list[str], limits: Limits) -> DataFrame:
    """``frames`` (step, timestamp, source_index) with place, the differences to the frame before, and the gap and
    segment that the gap rule gives. One sort by key."""
    w = W.partitionBy(*keys).orderBy(*order)
    d = frames.withColumns({"_place": (F.row_number().over(w) - 1).cast("long"), "_dstep": F.col("step") - F.lag("step").over(w), "_dtime": F.col("timestamp") - F.lag("timestamp").over(w), "_dindex": F.col("source_index") - F.lag("source_index").over(w)})
    gap = (F.col("_dstep") < 0) | (F.col("_dstep") > limits.step_gap) | (F.col("_dtime") < 0) | (F.col("_dtime") > limits.timestamp_gap)
    d = d.withColumns({"_gap": F.coalesce(gap, F.lit(False)), "_jump_step": F.col("_dstep") > limits.step_gap, "_jump_time": F.col("_dtime") > limits.timestamp_gap})
    return d.withColumn("_segment", F.sum(F.col("_gap").cast("int")).over(w).cast("long"))


def with_motion(frames: DataFrame, keys: list[str], order: list[str], poses: list[str]) -> DataFrame:
    """_linear_<pose> and _angular_<pose>: how far each pose is from that of the frame before, null across a gap."""
    w = W.partitionBy(*keys).orderBy(*order)
    for p in poses:
        before = F.lag(p).over(w)
        frames = frames.withColumn("_before", F.when(~F.col("_gap") & (F.size(p) == 10) & (F.size(before) == 10), before))
        turn = lambda v: rot.matrix_of_6d(F.slice(v, 4, 6))
        moved = F.zip_with(F.slice(p, 1, 3), F.slice("_before", 1, 3), lambda a, b: a.cast("double") - b)
        known = F.col("_before").isNotNull()
        frames = frames.withColumns({f"_linear_{p}": F.when(known, norm(moved)), f"_angular_{p}": F.when(known, rot.geodesic(turn(F.col(p)), turn(F.col("_before"))))}).drop("_before")
    return frames


def frame_rules(poses: list[str], raw: list[str], limits: Limits, alias: tuple[str, str] | None = None) -> list[Rule]:
    """Rules of each frame's values: poses of ten finite numbers with proper axes within the limits, finite raw vectors,
    the time base as recomputed, and two poses that are one and the same."""
    out = []
    fine = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    for p in poses:
        first, second, grip = F.slice(p, 4, 3), F.slice(p, 7, 3), F.element_at(p, -1)
        whole = (F.size(p) == 10) & fine(p)
        only = lambda broken, whole=whole: whole & broken  # noqa: E731  what isn't a pose breaks the first two rules alone
        outside = lambda axis, p=p: (F.element_at(p, axis + 1) < limits.low[axis]) | (F.element_at(p, axis + 1) > limits.high[axis])
        out += [
            Rule(f"{p}: ten numbers", "structure", F.size(p) != 10, True),
            Rule(f"{p}: finite", "structure", ~fine(p), True),
            Rule(f"{p}: first axis of length one", "structure", only(F.abs(norm(first) - 1) > limits.axes + 1e-5), True),
            Rule(f"{p}: second axis of length one", "structure", only(F.abs(norm(second) - 1) > limits.axes + 1e-5), True),
            Rule(f"{p}: axes at right angles", "structure", only(F.abs(dot(first, second)) > limits.axes), True),
            Rule(f"{p}: within the workspace", "structure", only(outside(0) | outside(1) | outside(2)), True),
            Rule(f"{p}: gripper in range", "structure", only((grip < limits.gripper[0] - 1e-6) | (grip > limits.gripper[1] + 1e-6)), True),
        ]
    out += [Rule(f"{r}: finite", "structure", ~fine(r), True) for r in raw]
    if alias:
        out.append(Rule(f"{alias[0]}: equals {alias[1]}", "structure", ~F.col(alias[0]).eqNullSafe(F.col(alias[1])), True))
    return out + [
        Rule("source_index: rises", "time", F.when(F.col("_place") > 0, F.col("_dindex") <= 0).otherwise(F.lit(False)), True),
        Rule("source_index: is the place", "time", F.col("source_index") != F.col("_place"), True),
        Rule("gap_mask: follows the gap rule", "time", F.col("gap_mask") != F.col("_gap"), True),
        Rule("segment_id: counts the gaps", "time", F.col("segment_id") != F.col("_segment"), True),
    ]


def attribute_rules(contract: Contract, area: str = "evidence") -> list[Rule]:
    a = lambda name: F.col("attributes")[name]
    return (
        [Rule(f"{n}: present", "structure", a(n).isNull()) for n in contract.present]
        + [Rule(f"{n}: {v}", area, ~a(n).eqNullSafe(F.lit(v))) for n, v in contract.equal.items()]
        + [Rule(f"{n}: begins {v}", area, ~F.startswith(a(n), F.lit(v))) for n, v in contract.begins.items()]
        + [Rule(f"{n}: {v} long", area, F.length(a(n)) != v) for n, v in contract.length.items()]
        + [Rule(f"{n}: allowed", area, ~a(n).isin(*v)) for n, v in contract.one_of.items()]
    )


def episode_rules() -> list[Rule]:
    """Rules of an episode as a whole: its length, its stored counts and status against the recomputed ones."""
    a = lambda name: F.col("attributes")[name]
    counts = [Rule(f"{c}: as stored", "time", a(c).try_cast("long") != F.col(c)) for c in COUNTS]
    frames = [Rule(f"{c}: the number of frames", "time", a(c).try_cast("long") != F.col("frames")) for c in ("source_frames", "canonical_frames")]
    return [
        Rule("frames: two at least", "structure", F.coalesce("frames", F.lit(0)) < 2),
        Rule("timebase: as recomputed", "time", a("timebase") != F.col("timebase_found")),
        *counts,
        *frames,
    ]


def validated(frames: DataFrame, attributes: DataFrame, keys: list[str], rules: list[Rule], metrics: dict[str, Column], source: DataFrame | None = None, order: str = "source_index", copied: list[str] = ()) -> DataFrame:
    """keys, status, <area>_errors for each area, the time base's counts, and the metrics, for every episode.

    ``frames`` come from ``with_time_audit``; ``attributes`` has a map of strings a key. An episode that only one of
    them has is there too: without frames it has the rules of frames unjudged and fails as too short. With ``source``,
    the frames that they were copied from, the ``copied`` columns have to be equal by ``order``, frame by frame.
    """
    by_frame, by_episode = [r for r in rules if r.by_frame], [r for r in rules if not r.by_frame]
    count = lambda c: F.count_if(c).cast("long")
    facts = frames.groupBy(*keys).agg(
        F.count("*").alias("frames"),
        count(F.col("_dstep") == 0).alias("step_repeats"),
        count(F.col("_jump_step")).alias("step_jumps"),
        count(F.col("_dstep") < 0).alias("step_rollbacks"),
        count(F.col("_dtime") == 0).alias("timestamp_repeats"),
        count(F.col("_jump_time")).alias("timestamp_jumps"),
        count(F.col("_dtime") < 0).alias("timestamp_rollbacks"),
        count(F.col("_gap")).alias("gaps"),
        (F.max("_segment") + 1).alias("segments"),
        count(F.col("_dtime") != 0).alias("_moves"),
        *[F.bool_or(F.coalesce(r.broken, F.lit(True))).alias(f"_r{i}") for i, r in enumerate(by_frame)],
        *[m.alias(name) for name, m in metrics.items()],
    )
    timebase = F.when(F.col("gaps") > 0, "discontinuous").when(F.col("_moves") == 0, "unknown").when(F.col("gaps").isNotNull(), "coarse")
    both = facts.withColumn("timebase_found", timebase).join(attributes.select(*keys, "attributes"), keys, "full_outer")
    checks = [(r, F.col(f"_r{i}")) for i, r in enumerate(by_frame)] + [(r, F.coalesce(r.broken, F.lit(True))) for r in by_episode]
    if source is not None:
        both = both.join(_copied(frames, source, keys, order, list(copied)), keys, "left")
        checks += [(Rule("source: as many frames", "time", F.lit(True)), F.coalesce(~F.col("_lengths"), F.lit(True)))]
        checks += [(Rule(f"{c}: copied from the source", "time" if c in ("step", "timestamp") else "evidence", F.lit(True)), F.coalesce(~F.col(f"_c{i}"), F.lit(True))) for i, c in enumerate(copied)]
    errors = {a: F.array_compact(F.array(*[F.when(broken, F.lit(r.name)) for r, broken in checks if r.area == a]).cast("array<string>")) for a in AREAS}
    both = both.withColumns({f"{a}_errors": e for a, e in errors.items()})
    bad = F.size("structure_errors") + F.size("time_errors") + F.size("evidence_errors")
    return both.select(*keys, F.when(bad == 0, "passed").otherwise("failed").alias("status"), *[f"{a}_errors" for a in AREAS], "frames", *COUNTS, F.col("timebase_found").alias("timebase"), *metrics)


def _copied(frames: DataFrame, source: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """_lengths and _c<i>: whether an episode has as many frames as its source, and equal columns frame by frame."""
    a = frames.select(*keys, order, F.lit(True).alias("_a"), *[F.col(c).alias(f"_a{i}") for i, c in enumerate(columns)])
    b = source.select(*keys, order, F.lit(True).alias("_b"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(columns)])
    both = a.join(b, [*keys, order], "full_outer")
    return both.groupBy(*keys).agg((F.count("_a") == F.count("_b")).alias("_lengths"), *[F.bool_and(F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))).alias(f"_c{i}") for i in range(len(columns))])


def pose_metrics(poses: list[str]) -> dict[str, Column]:
    """Bounds of places and gripper and the largest motions of the poses (of ``with_motion``), by name."""
    out = {}
    for p in poses:
        at = lambda i, p=p: F.when(F.size(p) == 10, F.element_at(p, i).cast("double"))
        for axis, name in enumerate("xyz", 1):
            out |= {f"{p}_{name}_min": F.min(at(axis)), f"{p}_{name}_max": F.max(at(axis))}
        out |= {f"{p}_gripper_min": F.min(at(10)), f"{p}_gripper_max": F.max(at(10))}
        out |= {f"{p}_linear_step": F.coalesce(F.max(f"_linear_{p}"), F.lit(0.0)), f"{p}_angular_step": F.coalesce(F.max(f"_angular_{p}"), F.lit(0.0))}
    return out
