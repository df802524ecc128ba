"""The corpus operators against brute force on small fixtures."""

import hashlib
import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from strandway.llm import bpe, fmindex, html, neardup, packing, secrets, substrings, surrogates, topk  # noqa: E402
from strandway.llm.scratch import stage  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, n_words string"


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 60, 200]))) for _ in range(40)]
    base = texts[7] + " " + texts[8]
    for _ in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base, base, "a " * 80, "a b c " * 30, "", None, "one", "one", "\n\t "]
    return [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id " * 30, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def test_near_duplicates(docs, spark):
    sets = {}
    for i, t, _ in corpus():
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets if i is not None}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in root:
        for b in root:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, stage).collect()}
    assert {i: got[i].component_id for i in root} == {i: find(i) for i in root}
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (find(i) == i) for i in root)
    assert got[None].kept and got[None].component_id is None
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA), stage).isEmpty()


@pytest.mark.parametrize("hot", [1 << 18, 30])
def test_substring_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    seen, want = set(), {}
    for i, t, _ in corpus():
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        if i is not None:
            for a in range(len(w) - 19):
                key = tuple(w[a : a + 20])
                if key in seen:
                    keep[a : a + 20] = [False] * 20
                seen.add(key)
        left = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        want[i] = (len(w), keep.count(False), hashlib.sha256(left.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, stage, window=20).collect()}
    assert got == want


def test_fm_index_finds_repeated_windows():
    import numpy as np

    text = np.array([1, 2, 3, 4] * 12 + [0] + [5, 6, 7, 8, 1, 2] * 5 + [0])
    starts = np.array([s for s in range(len(text) - 9) if 0 not in text[s : s + 10]])
    got, lo, hi = fmindex.FMIndex(text, 9).repeated(text, starts, 10)
    count = {int(s): sum(list(text[s : s + 10]) == list(text[o : o + 10]) for o in starts) for s in starts}
    assert {int(s): int(h - b) for s, b, h in zip(got, lo, hi, strict=True)} == {s: c for s, c in count.items() if c > 1}


def without_repeats(rows, window):
    """(words, words that earlier windows cover) of each document, by brute force."""
    seen, want = set(), {}
    for i, t in sorted(rows):
        w, hit = t.split(), set()
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if key in seen:
                hit.update(range(a, a + window))
            seen.add(key)
        want[i] = len(w), len(hit)
    return want


def test_windows_longer_than_the_default_depth(spark):
    """Passages, cut off after 32 to 49 words or with one word changed, before, between and after whole copies."""
    rng, rows, n = random.Random(11), [], 0
    prose = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    for trial in range(60):
        passage = prose(60)
        cut, at = rng.randrange(33, 50), rng.randrange(60)
        variants = [passage[:cut], passage[-cut:], [*passage[:at], "changed", *passage[at + 1 :]], passage, passage, passage]
        rng.shuffle(variants)
        for v in variants:
            rows.append((n, " ".join(prose(rng.randrange(1, 60)) + v + prose(rng.randrange(1, 60)))))
            n += 1
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), stage, window=50).collect()}
    assert got == without_repeats(rows, 50)


def test_fm_index_refuses_windows_over_its_depth():
    import numpy as np

    text = np.array([*range(1, 61), 0] * 2)
    with pytest.raises(ValueError):
        fmindex.FMIndex(text, 61).repeated(text, np.array([0]), 50)
    start, lo, hi = fmindex.FMIndex(text, 61, 50).repeated(text, np.array([0, 61]), 50)
    assert sorted(start) == [0, 61] and (hi - lo == 2).all()


def test_secrets(spark):
    rows = [(1, 'é token = "abcdefgh1" x'), (2, "token:token:abcdefgh"), (3, "AKIAABCDEFGHIJKL and s3://host/x"), (4, None), (5, "f" * 40), (6, "client_id=me42 password: longsecret s3://host/x")]
    got = {r.doc_id: (r.base, r.spans) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("assign:2:20",) * 2 and got[2] == ("", "") and got[3] == ("access:0:16",) * 2 and got[4] == ("", "") and got[5] == ("hex:0:40",) * 2
    assert [x.split(":")[0] for x in got[6][1].split(",")] == ["ident", "assign", "endpoint"]


def test_surrogates(spark):
    rows = [(1, "a.b@c.org A.B@C.org +1 (499) 555-6503 10.0.0.1 4111 1111 1111 1111"), (2, "Mrs Anna Smith, Mr Smith"), (3, None), (4, "plain 1234567890123456")]
    got = {r.doc_id: r for r in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    first = got[1].text.split()
    assert first[0] == first[1] != "a.b@c.org" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", " ".join(first[2:5]))
    assert got[1].n_card == got[1].n_ip == got[1].n_phone == 1 and got[1].n_email == 2
    assert got[2].text.split()[2].rstrip(",") == got[2].text.split()[4] and got[2].text.split()[1].endswith("ia")
    assert got[3].text is None and got[4].text == rows[3][1]


def test_numbers_next_to_other_digits(spark):
    """(text, kinds, what must stay): a run of digits that is no card gives back the numbers inside it."""
    card, phone = "4111 1111 1111 1111", "555 123 4567"
    cases = [
        (f"{card} 123", "card", " 123"),
        (f"{card} 12/27", "card", " 12/27"),
        (f"12 {card}", "card", "12 "),
        (f"1234 12 {card}", "card", "1234 12 "),
        ("12 41 1111 1111 1111 11", "card", "12 "),
        (f"12 {card} 5500-0000-0000-0004 7", "card card", "12 "),
        ("3782 822463 10005 1234", "card", " 1234"),
        ("4111111111111111 123", "card", " 123"),
        (f"{phone} 2024", "phone", " 2024"),
        ("555-123-4567 555-765-4321", "phone phone", ""),
        (f"{phone} {card}", "phone card", ""),
        ("2024 123-45-6789", "ssn", "2024 "),
        ("2024 1234 5678 10.0.0.1", "ip", "2024 1234 5678 "),
        ("1234 5678 9012 555.123.4567", "phone", "1234 5678 9012 "),
        ("1234 5678 9012 34@x.org", "email", "1234 5678 9012 "),
        ("1234 5678 9012 3456 789 " * 9, "", "1234 5678 9012 3456 789 " * 9),
        ("7 " * 20_000, "", "7 " * 20_000),
    ]
    got = {r.doc_id: r for r in surrogates.replace(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string"), "k").collect()}
    for i, (text, kinds, stays) in enumerate(cases):
        assert {k: got[i][f"n_{k}"] for k in surrogates.KINDS} == {k: kinds.split().count(k) for k in surrogates.KINDS}, text
        assert stays in got[i].text and (got[i].text == text) == (not kinds), text
        assert not kinds or not re.search(r"4111|555.\d{3}.\d{4}", text) or card not in got[i].text and phone not in got[i].text, text


def test_packing_holds_each_id_once(docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(packing.pieces(docs.where("doc_id IS NOT NULL"), path, 128, 1), 128, stage).toPandas()
    for _, p in got.groupby("doc_id"):
        p = p.sort_values("start")
        assert p.length.sum() == p.doc_tokens.iloc[0] and (p.start.to_numpy() == p.length.cumsum().shift(fill_value=0).to_numpy()).all()
    for _, p in got.groupby("sequence_id"):
        p = p.sort_values("offset")
        assert p.length.sum() <= 128 and (p.offset.to_numpy() == p.length.cumsum().shift(fill_value=0).to_numpy()).all()


def test_bpe_round_trip(docs):
    import public_tokenizers as P

    args = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    data = {r.doc_id: bytes(r.data) for r in bpe.decode(bpe.encode(docs, *args), *args).collect()}
    assert data == {i: (t or "").encode() for i, t, _ in corpus()}


def test_topk_matches_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(200)] + [(500, None), (501, [float("nan")] * 4)]
    v = {i: [int(256 * x // 1) for x in e] for i, e in rows[:200]}
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, stage, 5).collect()]
    want = []
    for q in range(0, 200, 50):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(got) == want


def test_main_text():
    article = "".join(f"<p>This is paragraph {i}, with commas, and enough words to count as text of an article.</p>" for i in range(4))
    page = f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1>{article}</article><div class='comments'>Nice, post, indeed, yes</div><script>var a;</script></body></html>"
    text = html.main_text(page)
    assert text.startswith("Title This is paragraph 0") and "Nice" not in text and "Home" not in text and "var" not in text
    assert html.main_text("") == ""


def test_slug_names_stay_in_the_article():
    body = "".join(f"<p>This is paragraph {i}, with commas, and enough words to count as text of an article.</p>" for i in range(8))
    long = "Earlier authors measured the same effect, with other tools, and came to results that agree with ours in most respects. " * 3
    parts = [
        f'<h1 class="article-header">Alpha</h1>{body}<section id="related-work"><h2>Beta</h2><p>{long}</p></section>',
        f'<h2 id="social-impact">Gamma</h2><p class="article-header">Delta, in short.</p><section id="feedback"><p>Epsilon. {long}</p></section>',
        '<div class="post-header"><h3 id="comments">Zeta</h3></div><div class="header"><h3>Eta</h3></div><p id="notice">Theta, as noted.</p>',
        '<div class="share">Lost1</div><ul class="related-posts"><li><a href=x>Lost2, another article</a></li></ul><div id="related"><a href=x>Lost3</a></div>',
        f'<div class="comments"><p>Lost4. {long}</p></div><p class="advertisement">Lost5</p>',
    ]
    text = html.main_text(f"<html><body><nav>Lost6</nav><article>{''.join(parts)}</article><div id=footer-links>Lost7</div></body></html>")
    assert [x for x in "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta".split() if x not in text] == [] and "Lost" not in text
    plain = html.main_text(f"<html><body><div>{body}<h2 id='social-impact'>Gamma</h2><section id='legal-basis'><p>Delta. {long}</p></section></div><div class='site-footer'>Lost</div></body></html>")
    assert "Gamma" in plain and "Delta" in plain and "Lost" not in plain


def test_signature_bound_follows_the_threshold():
    from fractions import Fraction
    from math import comb

    for percent, most, lost in ((80, 27, Fraction(6, 10**7)), (85, 25, Fraction(1, 10**7))):
        p = Fraction(100 - percent, 100)
        over = lambda d: sum(comb(56, i) * p**i * (1 - p) ** (56 - i) for i in range(d + 1, 57))  # noqa: B023, E731
        assert neardup.far(percent) == most and over(most) < lost


def test_every_pair_under_the_distance_shares_a_key():
    """Signatures that differ in as many positions as the threshold allows, spread as evenly over the chunks as can be
    and at random."""
    import numpy as np

    rng = np.random.default_rng(3)
    for trial in range(400):
        one = rng.integers(0, 1 << 16, 56).astype(np.uint16)
        two, most = one.copy(), neardup.far(80 if trial % 2 else 85)
        even = sorted(range(56), key=lambda i: (i % 4 > 1, i))[:most] if trial < 4 else rng.permutation(56)[:most]
        two[even] ^= 1
        a, b = neardup.keys(np.stack([one, two]))
        assert (a == b).any(), trial
    assert neardup.far(80) < 2 * neardup.CHUNKS and neardup.far(85) < 2 * neardup.CHUNKS
