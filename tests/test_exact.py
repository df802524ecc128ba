"""Order-preserving images, exact quantiles, run-length masks and hash trees against plain Python."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandway.functions import bits, runs
from strandway.operators import digests, ordering, quantiles
from strandway.sources import stages

ODD = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.0, 1 - 2**-53, 1 + 2**-52, 2.0, 4.0, 8.0, 1e308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, math.nan, 1e-310, 3.3, 1024.0, 1023.9999999999999, 2.0**52, 2.0**53, 1e22]


def plain_image(x):
    if math.isnan(x):
        return (1 << 63) - 1
    return int(math.copysign(1, x)) * struct.unpack("<q", struct.pack("<d", abs(x)))[0]


def test_images_are_the_bits(spark):
    rng = random.Random(1)
    xs = ODD + [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)] + [2.0**e * s for e in range(-1074, 1024) for s in (1, -1)]
    rows = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").select("x", bits.image(F.col("x")).alias("i")).withColumn("y", bits.value(F.col("i"))).collect()
    for r in rows:
        if r.x is None:
            assert r.i is None and r.y is None
        else:
            assert r.i == plain_image(r.x) and (r.y == r.x or (math.isnan(r.x) and math.isnan(r.y)))


@pytest.mark.parametrize("bins", [4, 4096])
def test_quantiles_by_group(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = random.Random(2)
    kinds = {"a": lambda: rng.gauss(0, 1), "b": lambda: 10 ** rng.uniform(-300, 300) * rng.choice([-1, 1]), "c": lambda: float(rng.randrange(3)), "hot": lambda: 7.5, None: lambda: rng.uniform(-1e-310, 1e-310)}
    rows = [(g, f()) for g, f in kinds.items() for _ in range(300)] + [("hot", 1.0), ("one", 4.0), ("none", None), ("a", None)]
    probs = {"q0": 0, "q01": 0.01, "q5": 0.5, "q977": 0.977, "q1": 1}
    got = {r.g: r for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", probs).collect()}
    assert set(got) == {*kinds, "one"}
    for g in got:
        xs = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g].n == len(xs)
        for name, p in probs.items():
            at = p * (len(xs) - 1)
            low, high = xs[math.floor(at)], xs[math.ceil(at)]
            assert got[g][name] == (low if at == math.floor(at) else low + (high - low) * (at - math.floor(at)))


def test_quantiles_without_groups_or_rows(spark):
    few = spark.createDataFrame([(3.0,), (1.0,), (math.inf,), (math.nan,)], "x double")
    assert [tuple(r) for r in quantiles.exact_quantiles(few, [], "x", {"m": 1 / 3}).collect()] == [(4, 3.0)]
    assert quantiles.exact_quantiles(few.limit(0), [], "x", {"m": 0.5}).isEmpty()


def test_statistics_of_columns_and_components(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 3))
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)] + [(None, None)], "a int, v array<double>")
    got = {(r.column, r.dim): r for r in quantiles.column_statistics(rows, ["a", "v"]).collect()}
    for k, x in {("a", 0): np.arange(200.0), **{("v", d): v[:, d] for d in range(3)}}.items():
        want = [200, x.mean(), x.std(), x.min(), x.max(), np.quantile(x, 0.01), np.quantile(x, 0.99)]
        assert np.allclose([got[k][c] for c in ("n", "mean", "std", "min", "max", "q01", "q99")], want)
    assert len(got) == 4


def test_every_step_of_statistics_is_compiled(spark, monkeypatch):
    """HotSpot never compiles a method over 8000 bytes: the images of values, made twice in one step, took 10 us each."""
    longest, columns = {}, [f"c{i}" for i in range(8)]
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")

    def measured(df, name="table"):
        found = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        longest[name] = max([longest.get(name, 0), *[found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]])
        return stages.kept(df, name)

    monkeypatch.setattr(quantiles, "kept", measured)
    rows = spark.range(500).select((F.col("id") % 3).cast("string").alias("flag"), *[(F.col("id") * (i + 1)).alias(c) for i, c in enumerate(columns)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that plans are whole before they run
    try:
        assert quantiles.column_statistics(rows, columns, ["flag"]).count() == 24
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < longest["values"] and max(longest.values()) < 8000, longest


def test_few_values_come_near_a_rank(spark, monkeypatch):
    """Even bins leave a small part of the values, so later rounds don't read them all again."""
    rows = {}

    def counted(df, name="table"):
        table = stages.kept(df, name)
        rows[name] = table.count()
        return table

    monkeypatch.setattr(quantiles, "kept", counted)
    got = quantiles.exact_quantiles(spark.range(60_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x")), ["g"], "x", {"q01": 0.01, "q99": 0.99})
    assert {tuple(r) for r in got.collect()} == {(g, 30_000, 2 * 299.99 + g, 2 * 29699.01 + g) for g in (0, 1)}
    assert rows["values"] == 60_000 and 0 < rows["near"] < 600


def test_quantiles_of_ranges_that_have_no_even_bins(spark):
    tiny, huge = 5e-324, 1.7976931348623157e308
    groups = {"far": [-huge, huge, 1.0, 2.0, 3.0], "near": [tiny * i for i in range(5)], "signs": [-0.0, 0.0, -0.0, 0.0, tiny], "below": [-math.inf, 1.0, 2.0, 3.0, 4.0], "above": [1.0, 2.0, 3.0, math.inf, math.inf], "odd": [1.0, 2.0, 3.0, 4.0, math.nan], "all": [math.nan] * 5}
    data = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double")
    probs = {f"q{i}": i / 4 for i in range(5)}
    for r in quantiles.exact_quantiles(data, ["g"], "x", probs, {"most": F.max("x")}).collect():
        want = sorted(groups[r.g], key=lambda x: (math.isnan(x), x))
        assert r.n == 5 and all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip([*r[3:], r.most], [*want, want[-1]], strict=True)), r


def plain_counts(lengths):
    out = ""
    for i, x in enumerate(lengths):
        x = x - lengths[i - 2] if i > 2 else x
        more = True
        while more:
            c = x & 31
            x >>= 5
            more = x != (-1 if c & 16 else 0)
            out += chr(c + 48 + 32 * more)
    return out


def masks_of(n):
    rng = random.Random(7)
    out = [[], [0], [5], [0, 5], [3, 4, 5], [0, 1] * 40, [10**12, 3, 10**15, 1, 1, 10**14], [16, 31, 32, 15, 512, 511, 1023, 1024]]
    return out + [[rng.randrange(1, rng.choice([3, 40, 5000, 10**9])) for _ in range(rng.randrange(1, 60))] for _ in range(n)]


def test_run_lengths_both_ways(spark):
    lengths = masks_of(120)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "i int, lengths array<bigint>")
    coded = rows.select("i", runs.encoded(F.col("lengths")).alias("counts"))
    assert {r.i: r.counts for r in coded.collect()} == {i: plain_counts(x) for i, x in enumerate(lengths)}
    for r in runs.intervals(coded).collect():
        ends = np.cumsum(lengths[r.i]).tolist()
        assert [(x.start, x.stop) for x in r.ones] == [(ends[i - 1], ends[i]) for i in range(1, len(ends), 2) if lengths[r.i][i]] and r.fault is None


def test_faulty_texts_and_ranges(spark):
    texts = {1: None, 2: "", 3: "5\n", 4: "3P", 5: "P" * 12 + "0", 6: "3" + plain_counts([0, 4])[1:] + "O", 7: plain_counts([2, 3]), 8: "zz\x7f"}
    got = {r.i: r for r in runs.intervals(spark.createDataFrame(list(texts.items()), "i int, counts string")).withColumn("part", runs.clipped(F.col("ones"), F.col("i") - 4, F.lit(4))).collect()}
    assert {i: r.fault for i, r in got.items()} == {1: None, 2: None, 3: "digit", 4: "unfinished", 5: "long", 6: "negative", 7: None, 8: "digit"}
    assert got[1].ones is None and got[2].ones == [] and got[4].ones is None and [tuple(x) for x in got[7].ones] == [(2, 5)] and [tuple(x) for x in got[7].part] == [(0, 1)]
    assert got[2].part is None  # a range from -2
    assert runs.intervals(spark.createDataFrame([], "i int, counts string")).isEmpty()


def test_areas_by_frame(spark):
    bits_ = [random.Random(3).random() < 0.6 for _ in range(1000)]
    rows = spark.createDataFrame([("m", i, b) for i, b in enumerate(bits_)] + [("z", 0, None)], "k string, i int, b boolean")
    read = runs.intervals(runs.masks(rows, ["k"], ["i"], F.col("b")))
    got = {(r.k, r.frame): r.area for r in runs.frame_areas(read, ["k"], 37).collect()}
    assert got == {("m", f): sum(bits_[f * 37 : f * 37 + 37]) for f in range(28) if sum(bits_[f * 37 : f * 37 + 37])}
    assert {r.k: r.a for r in read.select("k", runs.area(F.col("ones")).alias("a")).collect()} == {"m": sum(bits_), "z": 0}


def plain_tree(rows, block):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [sha("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in r)) for r in rows]
    level = [sha("".join(level[i : i + block])) for i in range(0, len(level), block)]
    while len(level) > 1:
        level = [sha("".join(level[i : i + block])) for i in range(0, len(level), block)]
    return sha(f"{len(rows)}:{level[0]}")


@pytest.mark.parametrize("block", [2, 3, 64])
def test_hash_tree(spark, block):
    """One key holds most rows; others have one, two, or as many as make a last node that is alone."""
    cells = {"long": 900, "one": 1, "two": 2, None: block * block + 1}
    rows = [(k, i, ["x", None, "", "é|=", "|"][i % 5], i % 7) for k, n in cells.items() for i in range(n)]
    got = {r.k: r.sha256 for r in digests.content_hash(spark.createDataFrame(rows, "k string, i int, a string, b int").repartition(5), ["k"], ["i"], ["a", "b"], block).collect()}
    assert got == {k: plain_tree([r[2:] for r in rows if r[0] == k], block) for k in cells}


def test_unlike_cells_have_unlike_hashes(spark):
    rows = [("a|=b", "c"), ("a", "b|=c"), ("a", None), (None, "a"), ("", "a"), ("-", "a"), ("1:a", ""), ("a", "")]
    assert spark.createDataFrame(rows, "a string, b string").select(digests.row_hash([F.col("a"), F.col("b")]).alias("h")).distinct().count() == len(rows)


def test_blocks_of_parts_make_the_whole(spark):
    rows = spark.createDataFrame([("k", i, i * i) for i in range(500)], "k string, i int, v int")
    first = digests.blocks(rows.where("i < 192"), ["k"], ["i"], ["v"], 64)
    rest = digests.blocks(rows.where("i >= 192"), ["k"], ["i"], ["v"], 64).withColumn("idx", F.col("idx") + 3)
    assert digests.roots(first.unionByName(rest), ["k"], 64).first() == digests.content_hash(rows, ["k"], ["i"], ["v"], 64).first()
    assert digests.content_hash(rows.limit(0), ["k"], ["i"], ["v"]).isEmpty()


def test_derived_episodes_again(spark):
    rows = spark.createDataFrame([(k, i, i * 2, f"s{i}") for k in "abc" for i in range(70)], "k string, i int, v int, robot string")
    kept, first = digests.derived(rows, ["k"], ["i"], ["v"], ["v", "robot"])
    assert kept.columns == ["k", "i", "v"] and {r.status for r in first.collect()} == {"converted"}
    later = rows.where("k <> 'c'").withColumn("robot", F.when((F.col("k") == "b") & (F.col("i") == 69), "new").otherwise(F.col("robot"))).unionByName(rows.where("k = 'a'").withColumn("k", F.lit("d")))
    again, second = digests.derived(later, ["k"], ["i"], ["v"], ["v", "robot"], first)
    assert {r.k: r.status for r in second.collect()} == {"a": "reused", "b": "changed", "d": "converted"} and {r.k for r in again.collect()} == {"d"}
    with pytest.raises(ValueError, match="camera"):
        digests.derived(rows, ["k"], ["i"], ["camera"], ["v"])


def test_places_in_one_long_sequence(spark):
    rows = spark.range(5000).select((F.col("id") % 2 > 5).alias("k"), (F.col("id") * 7919 % 5003).alias("o")).union(spark.createDataFrame([(None, 3), (None, 1)], "k boolean, o long"))
    got = ordering.numbered(rows, ["k"], ["o"])
    want = {o: i for i, o in enumerate(sorted(i * 7919 % 5003 for i in range(5000)))}
    assert {r.o: r.pos for r in got.where("k IS NOT NULL").collect()} == want and {(r.o, r.pos, r.n) for r in got.where("k IS NULL").collect()} == {(1, 0, 2), (3, 1, 2)}


def test_tables_need_a_shared_folder(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "yarn"}.get(key, default))

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="shares"):
        stages.shared_root(Cluster)
