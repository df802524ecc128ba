"""Centroid clustering and the Merkle manifest against plain Python, the classifier against its definition and held-out rows."""

import hashlib
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from strandway.llm import centroids, manifest, queries, subwords  # noqa: E402
from strandway.llm.scratch import stage  # noqa: E402

DATA = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, cluster string, v string"


def plain_clusters(rows, k, rounds, scale):
    ints = [[int(np.floor(scale * x)) for x in v] for _, v in rows]
    order = sorted((i for i in range(len(rows)) if rows[i][0] is not None), key=lambda i: (hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), ints[i]))
    order += sorted((i for i in range(len(rows)) if rows[i][0] is None), key=lambda i: ints[i])
    cents = [ints[i] for i in order[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        where = [nearest(v)[0] for v in ints]
        for c in range(len(cents)):
            own = [v for v, w in zip(ints, where, strict=True) if w == c]
            if own:
                cents[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [nearest(v) for v in ints]
    inertia = {c: sum(d for w, d in last if w == c) for c in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(str((i, w, d, inertia[w], sum(inertia.values()), sha[w])) for (i, _), (w, d) in zip(rows, last, strict=True))


@pytest.mark.parametrize(("dims", "spread", "k", "rounds"), [(3, 4, 5, 3), (2, 2, 7, 6), (8, 300, 16, 5), (1, 3, 4, 3)])
def test_clusters_by_brute_force(spark, dims, spread, k, rounds):
    """Small spreads give many ties and repeated vectors, so two centroids may be alike and stay empty."""
    rng = random.Random(dims)
    rows = [(i if i % 9 else None, [rng.randrange(-spread, spread + 1) / 4 for _ in range(dims)]) for i in range(400)]
    rows += [(7, rows[7][1]), (7, rows[8][1])]
    given = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS).repartition(3)
    got = centroids.cluster(given, k, rounds, stage, dims=dims, scale=3)
    assert sorted(str(tuple(r)[:6]) for r in got.collect()) == plain_clusters(rows, k, rounds, 3)


def test_bounds_spare_scans(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 40, (6, 4))
    rows = [(i, (middle[i % 6] + rng.normal(0, 1, 4)).tolist(), "", "") for i in range(600)]
    got = centroids.cluster(spark.createDataFrame(rows, VECTORS), 6, 4, stage, dims=4, scale=64)
    assert got.where("scanned").count() < 300


def test_bounds_hold(spark):
    """After any moves, whatever is not scanned has the cluster that a scan would give."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        k, rows = int(rng.integers(1, 6)), rng.integers(-6, 7, (80, 2))
        cents = rng.integers(-6, 7, (k, 2))
        at, up, second, _ = centroids.assigned(rows, cents, np.full(80, -1), np.zeros(80), np.zeros(80), np.zeros(k))
        for _ in range(4):
            new = cents + rng.integers(-1, 2, cents.shape)
            moved, cents = np.sqrt(((new - cents) ** 2).sum(1)), new
            at, up, second, _ = centroids.assigned(rows, cents, at, up, second, moved)
            squared = ((rows[:, None, :] - cents[None]) ** 2).sum(2)
            assert (at == squared.argmin(1)).all() and (up >= np.sqrt(squared.min(1))).all()


def test_vectors_that_take_no_part(spark):
    fine = [1.0, 2.0]
    rows = [(1, fine), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (None, fine), (1, fine)]
    given = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    got = [(r.vec_id, r.cluster, r.distance) for r in centroids.cluster(given, 16, 3, stage, dims=2).collect()]
    assert sorted(map(str, got)) == ["(1, 0, 0)", "(1, 0, 0)", "(None, 0, 0)"]
    empty = centroids.cluster(given.limit(0), 16, 3, stage, dims=2)
    assert empty.isEmpty() and empty.columns == centroids.cluster(given, 16, 3, stage, dims=2).columns
    with pytest.raises(Exception, match="could leave 64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [1e300, 0.0], "", "")], VECTORS), 2, 1, stage, dims=2).collect()


def digest(values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def joined(digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text)."""

    def build(digests):
        """The root, and of each digest its path of (place in the run, run)."""
        paths, spots, at = [[] for _ in digests], list(range(len(digests))), digests
        while len(at) > 1:
            for i, s in enumerate(spots):
                paths[i].append((s % 8, at[s - s % 8 : s - s % 8 + 8]))
            at, spots = [joined(at[i : i + 8]) for i in range(0, len(at), 8)], [s // 8 for s in spots]
        return at[0], paths

    leaves = {}
    for r in rows:
        leaves.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, digest(r), r))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: build([leaf[2] for leaf in sorted(leaves[x], key=lambda y: y[:3])]) for x in langs}
    root, tops = build([built[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for (_, _, leaf, r), path in zip(sorted(leaves[x], key=lambda y: y[:3]), built[x][1], strict=True):
            drawn = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            got, proof = digest((*r[:4], text)) if drawn else leaf, []
            for at, run in [*path, *top]:
                proof += run[:at] + run[at + 1 :]
                got = joined([*run[:at], got, *run[at + 1 :]])
            out.append((r[0], leaf, built[x][0], root, joined(proof), got, got == root))
    return out


def manifest_rows(langs):
    rng = random.Random(8)
    rows = []
    for lang, n in langs:
        for i in range(n):
            text = rng.choice([None, "", "Éa Straße", "ALL caps here", "plain", "x" * 3000 + "Y", "ß" * 50])
            rows.append((len(rows) * 3 - 5, rng.choice([None, "src", "a:b", "-"]), lang, rng.choice([None, 0, 12]), text))
    return [*rows, rows[0], rows[0], (None, None, langs[0][0], None, None), (None, "src", langs[0][0], None, "Words")]


@pytest.mark.parametrize("langs", [[("en", 1)], [("en", 8), ("de", 9), (None, 65), ("", 1), ("é", 3), ("-", 2), ("=", 2)], [(f"l{i}", 1 + i % 3) for i in range(70)], [("en", 600), ("fr", 1)]])
def test_manifest_by_brute_force(spark, langs):
    rows = manifest_rows(langs)
    given = spark.createDataFrame([(*r, "mine", "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string").repartition(3)
    got = [tuple(r) for r in manifest.verify(given, stage).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_manifest(rows)))


def test_manifest_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest.verify(none, stage).isEmpty()


def test_lookalike_cells_have_unlike_leaves(spark):
    rows = [(1, "a", "b", None, "c"), (1, "a", "b", None, "1:c"), (1, None, "b", None, "c"), (1, "-", "b", None, "c"), (1, "", "b", None, "c"), (1, "a1:b", None, None, "c")]
    given = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert given.select(manifest.digest([F.col(c) for c in given.columns]).alias("d")).distinct().count() == len(rows)


def labelled(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            words = rng.choice([[w + "|" for w in words], [w for w in words for _ in range(4)], [w + rng.choice("xyz") * 2 for w in words]])
        rows.append((i, " ".join(words), 0 if bad else 1))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame(labelled(400), "doc_id long, text string, quality int")
    labels = rows.where("doc_id % 5 <> 0").select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (1, None), (2, 9)], "doc_id long, quality int"))
    return rows, labels, subwords.fit(rows.select("doc_id", "text"), labels, "quality", stage)


def test_classifier_on_held_out_rows(model):
    rows, _, m = model
    got = subwords.score(rows.where("doc_id % 5 = 0"), m, [F.col("quality")]).collect()
    assert sum((r.score[1] >= 0.5) == (r.quality == 1) for r in got) >= 0.95 * len(got)


def test_model_is_the_same_each_time(model):
    rows, labels, m = model
    again = subwords.fit(rows.select("doc_id", "text").repartition(7), labels.repartition(3), "quality", stage)
    assert np.array_equal(m, again) and m.shape == (subwords.ROWS + 1, 2)


def test_scores_by_definition(spark, model):
    """The average over all features of all words, however often a worker's memory is used; whole texts count."""
    m, wide = model[2].astype(float), (1 << 64) - 1

    def mixed(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & wide
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & wide
        return (h ^ (h >> 31)) >> 47

    def features(word):
        code = [ord(c) for c in f"^{word}$"]
        out = [mixed(sum(c * pow(int(subwords.WORD_BASE), i, 1 << 64) for i, c in enumerate(code)) & wide)]
        for k in (2, 3, 4):
            for a in range(len(code) - k + 1):
                h = 0
                for c in code[a : a + k]:
                    h = h * int(subwords.BYTE_BASE) + c & wide
                out.append(mixed(h + k & wide))
        return out

    long = "many different words " * 20_000 + "tail| " * 20_000
    texts = [None, "", " \n\t ", "one", "one one", "a b a b a", "x" * 5_000, long, "日本 日本", "", *[t for _, t, _ in labelled(30)]]
    got = {r.doc_id: r.score for r in subwords.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model[2]).collect()}
    for i, text in enumerate(texts):
        words, total, n = subwords.WORD.findall(text or ""), np.zeros(2), 0
        for w, times in Counter(words).items():
            f = features(w)
            total, n = total + times * m[f].sum(0), n + times * len(f)
        for back, at in ((1, -3), (2, -2)):
            times = sum(a == b for a, b in zip(words, words[back:], strict=False))
            total, n = total + times * m[at], n + times
        z = total / max(1, n) + m[-1]
        assert np.allclose(got[i], np.exp(z) / np.exp(z).sum(), atol=1e-9)


def test_worker_memory_does_not_matter(model, monkeypatch):
    import pyarrow as pa

    texts = pa.array([t for _, t, _ in labelled(60)] + [""])
    whole = subwords.Scorer(model[2]).scores(texts)
    for memo, chars in ((0, 1 << 20), (5, 50), (1 << 20, 200)):
        monkeypatch.setattr(subwords, "MEMO", memo)
        monkeypatch.setattr(subwords, "CHARS", chars)
        assert np.array_equal(whole, subwords.Scorer(model[2]).scores(texts))


def test_classifier_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y"), (None, "no id", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y")], "doc_id long, text string, score string, id string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (77, 1), (None, 1)], "doc_id long, quality int")
    got = subwords.score(docs, subwords.fit(docs, labels, "quality", stage)).collect()
    assert len(got) == 5 and all(0 <= r.score[1] <= 1 and abs(sum(r.score) - 1) < 1e-9 for r in got)
    nothing = subwords.fit(docs, labels.limit(0), "quality", stage)
    assert {tuple(r.score) for r in subwords.score(docs, nothing).collect()} == {(0.5, 0.5)}
    assert subwords.score(docs.limit(0), nothing).isEmpty()
    assert subwords.train(pd.DataFrame({"label": [], "ids": [], "shares": []}), 3).shape == (subwords.ROWS + 1, 3)


def test_sample_is_bounded(spark, model):
    rows, labels, _ = model
    few = subwords.fit(rows.select("doc_id", "text"), labels, "quality", stage, sample=20)
    assert not np.array_equal(few, model[2])


def test_query_keeps_good_documents(spark):
    got = queries.op13_quality_classifier(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out")
    wrong = got.where("predicted <> quality").count()
    assert wrong <= 0.1 * got.count()
