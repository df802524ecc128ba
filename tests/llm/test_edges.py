"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every corpus operator."""

import hashlib
import random
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import public_tokenizers as P  # noqa: E402

from strandway.llm import bpe, html, langid, matching, neardup, packing, quality, secrets, substrings, surrogates, tokens, topk  # noqa: E402
from strandway.llm.scratch import stage  # noqa: E402

LONG = "word and more " * 30_000
ROWS = [(1, "en", "some text here"), (1, "en", "some text here"), (2, None, None), (None, "en", "no id"), (3, "en", ""), (4, "en", " \n\t "), (5, "de", LONG), (6, "de", LONG)]
BYTES = P.path("byte_bpe_50k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
OPERATORS = {
    "secrets": (secrets.scan, 8),
    "quality": (quality.measures, 8),
    "language": (lambda d: langid.predict(d, langid.fit(d)), 8),
    "packing": (lambda d: packing.pack(packing.pieces(d, BYTES, 2048, 1), 2048, stage).select("doc_id").distinct(), 7),
    "surrogates": (lambda d: surrogates.replace(d, "k"), 8),
    "substrings": (lambda d: substrings.remove_repeats(d, stage), 8),
    "bpe": (lambda d: bpe.digests(d, *RANKS), 8),
    "encode": (lambda d: bpe.decode(bpe.encode(d, *RANKS), *RANKS), 8),
    "neardup": (lambda d: neardup.near_duplicates(d, stage), 8),
}
CLASHES = "key spans known hits typed any rest _key _spans _hits _typed _words n_words n_rules sign rep component_id nth open offset id lead c0".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, lang string, text string")
    return rows.select("*", *[F.lit("mine").alias(c) for c in CLASHES])


@pytest.mark.parametrize("name", OPERATORS)
def test_defined_on_odd_rows(docs, name):
    run, rows = OPERATORS[name]
    got = run(docs)
    assert got.count() == rows
    if name in ("surrogates", "substrings"):
        stay = [c for c in CLASHES if c != "n_words" or name == "surrogates"]
        assert got.where(" OR ".join(f"`{c}` <> 'mine'" for c in stay)).isEmpty() and set(docs.columns) <= set(got.columns)
    if name == "quality":
        assert got.where("`_words` <> 'mine'").isEmpty() and {r.n_words for r in got.where("doc_id IN (2, 3, 4)").collect()} == {0}
    if name == "neardup":
        kept = {r.doc_id: (r.component_id, r.kept) for r in got.collect()}
        assert kept == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (5, False), None: (None, True)}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, name):
    assert OPERATORS[name][0](docs.limit(0)).isEmpty()


def test_pages_and_vectors_on_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html.extract(pages).collect()) == ["", "", "a", "a"] and html.extract(pages.limit(0)).isEmpty()
    v = [(0, [1.0]), (0, [0.5]), (1, [1.0, 2.0]), (2, None), (3, [None]), (4, [float("inf")]), (None, [1.0]), (5, [1.0]), (6, [1.0])]
    vectors = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("q", F.lit(1))
    got = [tuple(r) for r in topk.exact_topk(vectors, F.col("vec_id") % 50 == 0, stage, 2).collect()]
    assert got == [(0, 1, 1, 128 * 256), (0, 2, 5, 128 * 256)]  # ties to the smaller id, the query with the lesser vector
    assert topk.exact_topk(vectors.limit(0), F.col("vec_id") % 50 == 0, stage).isEmpty()
    with pytest.raises(ValueError):
        topk.exact_topk(spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, stage)


def test_topk_over_many_blocks(spark, monkeypatch):
    for name, value in {"QUERIES": 7, "MOST": 16, "LEAST": 4, "BINS": 8}.items():
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(9)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(3)]) for i in range(150)]
    got = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 4 == 0, stage, 3, 1)
    want = []
    for q, v in rows[::4]:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in rows if c != q)[:3]
        want += [(q, k + 1, c, -int(s)) for k, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == want


def odd_texts(n=4000):
    rng = random.Random(1)
    parts = [*" ab'.1é", "\xa0", "　", "\t", "\n", "  ", "\r\n", " ", "\x1c", "\x85", "日", "<|endoftext|>", "𝒳"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_packed_ids_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(str(BYTES)), [*odd_texts(), LONG]
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES, 64, 1).collect()
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert sorted(seen[i]) == [(a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes()), len(ids)) for a in range(0, len(ids), 64)]


def test_memo_without_room(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 0)
    memo = tokens.ChunkMemo(BYTES)
    for text in odd_texts(300):
        assert memo.encode(text) == np.array(memo.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() and not memo.memo


def test_packing_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS", 50)
    rng = random.Random(3)
    rows = [(7 if i % 3 == 0 else i, 0, rng.choice([5, 60, 61, 100, 128]), i, 1) for i in range(900)]  # a third has one id
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), 128, stage).toPandas()
    assert sorted(got[["doc_id", "ids_crc32", "length"]].itertuples(index=False, name=None)) == sorted((d, c, n) for d, _, n, c, _ in rows)
    for _, p in got.groupby("sequence_id"):
        p = p.sort_values("offset")
        assert p.length.sum() <= 128 and (p.offset.to_numpy() == p.length.cumsum().shift(fill_value=0).to_numpy()).all()


def test_bpe_equals_plain_tiktoken(spark):
    import tiktoken

    library = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=tokens.bpe_ranks(RANKS[0]), special_tokens={})
    texts = [*odd_texts(800), LONG]
    got = {r.doc_id: r for r in bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *RANKS).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_links_by_brute_force(spark):
    """Weak spans against every other span, in texts of many spans."""
    rng = random.Random(6)
    parts = ["login=abcd ", "password=longsecret ", "s3://h/p ", "AKIAABCDEFGHIJKLMN ", "x" * 90 + " ", "é" * 150 + " "]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (5, 30, 200, 900)]
    for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        import re

        found = {k: [(m.start(), m.end()) for m in re.finditer(p, texts[r.doc_id])] for k, p in (("assign", "password=longsecret"), ("access", "AKIA[A-Z]+"), ("ident", "login=abcd"), ("endpoint", r"s3://h/p"))}
        near = lambda x, ys: any(y[0] <= x[1] + 200 and x[0] <= y[1] + 200 for y in ys)
        secret, ident = found["assign"], found["access"] + found["ident"]
        want = {"ident": [x for x in found["ident"] if near(x, secret)], "endpoint": [x for x in found["endpoint"] if near(x, secret) and near(x, ident)]}
        assert {k: [(s.start, s.stop) for s in r[k]] for k in want} == want
        assert [(s.start, s.stop) for s in r["assign"]] == found["assign"]


def test_names_and_numbers_that_must_not_leak(spark):
    texts = ["Dr Anna Smith, Anna Smith, and Mr Smith", "call 415-555-0132 415-555-0199 today", "call 415-555-0132 2024-01-02 ok", "Mrs Ingrid O'Neil, Ingrid left", "my name is Bob Stone; Stone, B.", "from 10.1.2.3 to 192.168.7.9 and 172.16.5.4"]
    got = [r.text for r in surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    words = got[0].replace(",", "").split()
    assert words[1:3] == words[3:5] and words[2] == words[7] and "Smith" not in got[0] and "Anna" not in got[0]
    assert "0132" not in got[1] + got[2] and "0199" not in got[1] and "2024-01-02" in got[2]
    assert "Ingrid" not in got[3] and "Neil" not in got[3] and got[3].split()[1] == got[3].split()[3]
    assert "Stone" not in got[4] and got[4].startswith("my name is ")
    assert got[5].split()[1].startswith("10.") and got[5].split()[3].startswith("192.168.") and got[5].split()[5].startswith("172.16.") and "10.1.2.3" not in got[5]


def test_numbers_are_a_permutation_without_fixed_points(spark):
    """All nine-digit numbers that share a first digit and seven of the others: as many surrogates, none its own."""
    rows = spark.range(10_000).select(F.format_string("123-%02d-%04d", (F.col("id") / 10_000 + 45).cast("int"), F.col("id")).alias("text"))
    out = rows.select("text", surrogates.surrogate(F.col("text"), F.lit("ssn"), "k", 0, surrogates.people(F.lit(""))).alias("new"))
    assert out.select("new").distinct().count() == 10_000 and out.where("new = text").isEmpty() and out.where(r"NOT new RLIKE '^1\\d{2}-\\d{2}-\\d{4}$'").isEmpty()


@pytest.mark.parametrize("unit", ["<div>", "<a ", "<a href=\"", "<svg/>", "<!", "<table><tr><td>", "<blockquote><li>", "<x-y>"])
def test_markup_costs_linear_time(unit):
    def seconds(n):
        began = time.process_time()
        html.main_text(unit * n)
        return time.process_time() - began

    n = 100_000 // len(unit)
    seconds(n)
    assert seconds(8 * n) < 8 * 3 * max(seconds(n), 0.02)


def test_names_with_an_article_word_stay():
    body = "".join(f"<p>This is paragraph {i}, with commas, and enough words to count as text of an article.</p>" for i in range(4))
    page = f"<body><div class='post-content'>{body}<div class='legal-analysis'><p>Kept. {'The court held, as before, that the rule stands. ' * 8}</p></div></div><div class='footer'>Gone, {'entirely, ' * 60}</div></body>"
    assert "Kept." in html.main_text(page) and "Gone" not in html.main_text(page)


def test_hot_keys_are_cut_into_blocks(spark, monkeypatch):
    """Near copies and unlike texts that share keys, with blocks so small that all of them meet as pairs of blocks."""
    for name, value in {"LARGEST": 4, "VOLUME": 400, "BLOCK": 8}.items():
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(12)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    texts = []
    for i in range(60):
        w = [*base]
        for _ in range(rng.choice([0, 1, 2, 3, 6, 12])):
            w[rng.randrange(90)] = f"x{rng.randrange(50)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(86)} for t in texts]
    root = list(range(60))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), stage).collect()}
    assert got == {i: find(i) for i in range(60)}


def test_blocks_keep_order(spark):
    row = spark.range(1).select(*[F.flatten(matching.blocks(F.sequence(F.lit(1), F.lit(n)))).alias(f"n{n}") for n in (1, 2, 7, 100)], F.flatten(matching.running(F.array(F.lit(3), F.lit(0), F.lit(5)))).alias("sums")).first()
    assert all(row[f"n{n}"] == list(range(1, n + 1)) for n in (1, 2, 7, 100)) and row["sums"] == [0, 3, 3]
