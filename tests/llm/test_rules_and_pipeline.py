"""Cutoffs against exact arithmetic, held-out accuracy of the language model, and the pipeline against brute force."""

import math
import random
import re
import sys
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from strandway.llm import langid, quality  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")


def exact_cdf(k: int, n: int, p: Fraction) -> Fraction:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_bound_is_exact(spark):
    cases = [(0, 1), (0, 700), (3, 120), (5, 130), (12, 400), (18, 19), (40, 1000)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.log_binomial_cdf(F.col("k"), F.col("n"), 0.05).alias("x")).collect()
    for r in got:
        if r.k < r.n * 0.05:
            assert abs(r.x - math.log(exact_cdf(r.k, r.n, Fraction(0.05)))) < 1e-9


def test_cutoffs_match_exact_arithmetic(spark):
    """The proposed rules, their order and the holdout's bound, by plain Python with fractions."""
    import hashlib

    rng, rows, labels = random.Random(4), [], []
    for i in range(1500):
        good = rng.random() < 0.7
        stratum = ["en", None, "few"][0 if i % 9 < 5 else 1 if i % 45 != 8 else 2]
        wide = [rng.choice([0, 1, 2, 3, 30] if rng.random() < 0.02 else [0, 1, 2, 3]) if good or k > 2 else rng.randrange(0, 60) for k in range(len(quality.RULES))]
        rows.append((i, stratum, i % 50 == 0, *wide))
        labels += [(i, int(good))] if i % 10 else [(i, 1), (i, 0), (i, None)]
    schema = "doc_id long, lang string, base_failed boolean, " + ", ".join(f"r_{r} int" for r in quality.RULES)
    risk, delta, cost = 0.1, 0.05, 3
    got = quality.cutoffs(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int"), risk, delta, cost).collect()
    lowest = {}
    for i, x in labels:
        if x is not None:
            lowest[i] = min(x, lowest.get(i, 1))
    held = [(s or "", lowest[i] > 0, x, int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 3 == 0) for i, s, failed, *x in rows if not failed]
    strata, want = {h[0] for h in held}, []
    for s in strata:
        fit, hold = ([h for h in held if h[0] == s and h[3] == f] for f in (True, False))
        path = []
        for j in range(len(quality.RULES)):
            values = sorted({h[2][j] for h in fit})
            each = [(sum(not h[1] for h in fit if h[2][j] > v) - cost * sum(h[1] for h in fit if h[2][j] > v), v if k + 1 == len(values) else (v + values[k + 1] - 1) // 2) for k, v in enumerate(values)]
            if each and max(each)[0] > 0:
                path.append((-max(each)[0], j, max(each)[1]))
        path.sort()

        def first(h, path):
            return next((k for k, (_, j, cut) in enumerate(path) if h[2][j] > cut), None)

        hits = [(first(h, path), h[1]) for h in fit]
        path = [p for k, p in enumerate(path) if sum(not g for x, g in hits if x == k) > cost * sum(g for x, g in hits if x == k)]
        n, used = sum(h[1] for h in hold), True
        for k, (_, j, cut) in enumerate(path):
            false, caught = (sum(h[1] == g for h in hold if first(h, path) is not None and first(h, path) <= k) for g in (True, False))
            used = used and false < n * Fraction(risk) and exact_cdf(false, n, Fraction(risk)) <= delta / len(strata)
            want.append((s, k + 1, quality.RULES[j], cut, n, false, caught, used))
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert any(w[-1] for w in want) and not any(w[-1] for w in want if w[0] == "few")


def test_measures_match_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a b", "Ab", " ", "\n", "\t", "#", "!", "é", "x y z ", "\xa0", "𝒳", "|"]) for _ in range(rng.randrange(0, 120))) for _ in range(150)] + ["", None, "a b c " * 40, "one"]
    got = {r.doc_id: r for r in quality.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        n = len(w)
        want = (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated_words(w), n < 50 or 100 * repeated_words(w) > 50 * n)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, repr(t)


def test_a_model_has_a_bound(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"word{chr(97 + i % 26)} and{chr(97 + i % 13)}") for i in range(200)], "doc_id long, lang string, text string")
    whole, small = langid.fit(docs), langid.fit(docs, room=20_000)
    assert 0 < len(small["at"]) * (langid.ENTRY + 8) <= 20_000 < len(whole["at"]) * (langid.ENTRY + 8)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    got = langid.predict(docs, langid.fit(docs, keep=third != 1), [F.col("lang"), (third == 1).alias("held")])
    seen = got.where("held AND lang IS NOT NULL AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share"), F.count("*").alias("n")).first()
    assert seen.n > 200 and seen.share > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "word " * 50_000)], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(odd, langid.fit(docs, keep=third != 1)).orderBy("doc_id").collect()][:3] == ["und"] * 3
    none = langid.fit(docs.where("lang = 'no such'"))
    assert langid.predict(odd, none).where("lang_pred <> 'und' OR score <> 0").isEmpty()


def repeated_words(words: list[str]) -> int:
    at, hit = {}, set()
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            hit |= {i + k for i in places for k in range(3)}
    return len(hit)


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(8)
    vocabulary = [a + b + c for a in ("ka", "mo", "ri", "te") for b in ("lun", "der", "sa") for c in ("vi", "po", "net", "zu", "ha")]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [prose(rng.choice([10, 49, 50, 120, 400])) for _ in range(30)]
    passage = prose(60)
    texts += [prose(80) + passage + prose(40), passage + prose(90), prose(30) + passage]
    near = prose(200)
    for _ in range(4):
        near = [*near]
        near[rng.randrange(200)] = "changed"
        texts.append(near)
    texts += [["same", "three", "words"] * 30, texts[3] if len(texts[3]) >= 50 else near]
    docs = [(i, " ".join(t), "en", "src", len(" ".join(t)), "extra") for i, t in enumerate(texts)] + [(900, None, None, None, None, None), (901, "", "en", "s", 0, "e")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, n_words string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    kept = {i: t for i, t in enumerate(texts) if len(t) >= 50 and 100 * repeated_words(t) <= 50 * len(t)}
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in kept.items()}
    root = {i: i for i in kept}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in kept:
        for b in kept:
            if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {i: t for i, t in kept.items() if find(i) == i}
    seen, left = set(), {}
    for i, t in sorted(kept.items()):
        keep = [True] * len(t)
        for a in range(len(t) - 49):
            key = tuple(t[a : a + 50])
            if key in seen:
                keep[a : a + 50] = [False] * 50
            seen.add(key)
        left[i] = " ".join(w for w, k in zip(t, keep, strict=True) if k)
    assert any(len(left[i].split()) < len(kept[i]) for i in kept) and len(kept) < 30
    tokens = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}

    got = pipeline.run(spark, str(tmp_path)).toPandas()
    assert got.groupby("doc_id").doc_tokens.first().to_dict() == want
    assert got.groupby("doc_id").length.sum().to_dict() == want
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(i, f"l{i:03d}", f"word{chr(97 + i // 26)}{chr(97 + i % 26)} same") for i in range(520)], "doc_id long, lang string, text string")
    assert langid.fit(docs)["langs"] == [f"l{i:03d}" for i in range(520)]


def test_every_stage_takes_effect(spark, tmp_path):
    """Rules in use, near copies, passages, personal data and packing: each stage's texts against plain Python."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(21)
    vocabulary = [a + b + c for a in ("ka", "mo", "ri", "te", "su") for b in ("lun", "der", "sa", "fo") for c in ("vi", "po", "net", "zu", "ha")]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    clean = [prose(rng.randrange(60, 110)) for _ in range(330)]
    passage, near = prose(70), prose(150)
    for i in range(0, 40, 5):  # a passage in eight documents, an address in others
        clean[i] = prose(70) + passage + prose(20)
    mails = {i: f"{vocabulary[i % 50]}{i % 3}@mail{i % 4}.org" for i in range(41, 200, 7)}
    for i, mail in mails.items():
        clean[i].insert(30, mail)
        clean[i] += ["Mrs", "Anna", "Weberin", "said", "hello"]
    for k in range(3):
        clean.append([*near[: 40 * k], "changed", *near[40 * k + 1 :]])
    junk = [[w + rng.choice("|#*") * 3 for w in prose(80)] for _ in range(90)]
    short = [prose(20) for _ in range(5)]
    texts = clean + junk + short
    rows = [(i, " ".join(t), "en", f"src{i % 3}", len(" ".join(t)), f"x{i}") for i, t in enumerate(texts)] + [(900, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(300)] + [(len(clean) + i, 0, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, found = docs.columns, []
    for k, (_, step) in enumerate(pipeline.STAGES):
        step(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) and r["a.b"] == f"x{r.doc_id}" and r.source == f"src{r.doc_id % 3}" for r in docs.collect())
            found.append({r.doc_id: r.text for r in docs.collect()})
    quality_, unique, unrepeated, private = found
    assert quality_ == {i: " ".join(t) for i, t in enumerate(clean)}  # by rules learned from two thirds of the junk
    copies = set(range(330, 333))
    assert set(unique) == set(range(len(clean))) - copies | {330} and all(unique[i] == quality_[i] for i in unique)
    for i, text in unique.items():
        words = text.split()
        at = 70 if 0 < i < 40 and i % 5 == 0 else None
        assert unrepeated[i] == " ".join(words if at is None else words[:at] + words[at + 70 :])
    made = {}
    for i, text in unrepeated.items():
        old, new = text.split(), private[i].split()
        assert len(old) == len(new)
        for a, b in zip(old, new, strict=True):
            own = "@" in a or a in ("Anna", "Weberin")
            assert (a != b) == own and made.setdefault(a, b) == b
    assert len(set(made.values())) == len(made) and len(mails) > 20
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = docs.toPandas()
    for i, part in got.groupby("doc_id"):
        ids = np.array([*library.encode(private[i], add_special_tokens=False).ids, 1], "<u4")
        part = part.sort_values("start")
        assert part.length.sum() == len(ids) and [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part.start, part.length, strict=True)] == part.ids_crc32.tolist()
    assert set(got.doc_id) == set(private) and (got.groupby("sequence_id").length.sum() <= 2048).all()
