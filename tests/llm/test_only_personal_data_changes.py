"""Texts of known pieces: what is personal data changes, everything else stays as it is."""

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from strandway.llm import surrogates  # noqa: E402
from strandway.llm.scratch import stage  # noqa: E402


def replaced(spark, texts):
    rows = surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    return [r.text for r in rows]


def test_ordinary_words_stay(spark):
    cases = [
        ("Herr Müller Haus steht. Das Haus ist alt.", ["Müller"], 1),
        ("Dr. Will said: Will you come?", [], 0),
        ("Mr Smith Yesterday we met. Yesterday it rained.", ["Smith"], 1),
        ("Dr. The plan. The end.", [], 0),
        ("Mrs Green Apple pie is an apple pie. Green said so.", ["Green"], 2),
        ("Mme Le Train part. Le train est là.", [], 0),
        ("Sr. El Sol sale. El sol brilla.", [], 0),
    ]
    for (text, names, n), got in zip(cases, replaced(spark, [c[0] for c in cases]), strict=True):
        before, after = text.split(), got.split()
        changed = [(a, b) for a, b in zip(before, after, strict=True) if a != b]
        assert len(changed) == n and {a.strip(".,:") for a, _ in changed} <= set(names) and all(x not in got for x in names), (text, got)


def test_names_in_capitals(spark):
    got = replaced(spark, ["My name is Jonas Weber. WEBER called, and JONAS WEBER too, and Jonas.", "Mrs Anna Smith, ANNA and SMITH"])
    given, surname = got[0].split()[3], got[0].split()[4].rstrip(".")
    assert got[0].split()[5] == surname.upper() and got[0].split()[8:10] == [given.upper(), surname.upper()] and got[0].endswith(f"and {given}.")
    assert "ANNA" not in got[1] and "SMITH" not in got[1] and "Smith" not in got[1] and got[1].split()[3] == got[1].split()[1].upper()


def test_phones_keep_their_country(spark):
    phones = ["+45 12 345 678", "+4512345678", "+353 1 234 5678", "+1 (499) 555-6503", "+49 30 1234567", "+33 1 23 45 67 89", "+7 495 123-45-67", "030 1234567", "01 23 45 67 89", "(212) 555-0100", "0171/1234567"]
    got = replaced(spark, [f"call {p} now" for p in phones])
    for phone, text in zip(phones, got, strict=True):
        new = text[5:-4]
        assert new != phone and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", phone) and text[:5] + text[-4:] == "call  now", (phone, text)
        if phone[0] == "+":
            code = re.match(surrogates.COUNTRY, re.sub(r"\D", "", phone))[0]
            assert re.sub(r"\D", "", new).startswith(code), (phone, new)
    assert re.sub(r"\D", "", got[0][5:-4]) == re.sub(r"\D", "", got[1][5:-4])


@pytest.mark.parametrize("text", ["from 01.02.2024 to 03.04.2025", "see 0123 for 4567 more", "version 1.0.10 of 2024-01-02", "a+45 b", "0.5 and 01234", "+12 points", "pages 012-345", "call 12 34 56"])
def test_other_numbers_stay(spark, text):
    assert replaced(spark, [text]) == [text]


def test_random_texts_of_known_pieces(spark):
    """Pieces are joined by blanks; each becomes itself, or a surrogate that is the same for the same piece everywhere."""
    rng = random.Random(5)
    given, family = ["Anna", "Jonas", "Marie", "Pedro", "Ingrid"], ["Weber", "Smith", "Dubois", "García", "Lindqvist"]
    plain = "we met in old towns and talked about work for some hours then it rained all night near rivers".split()
    texts, truth = [], []
    for _ in range(250):
        pieces, personal, person = [], [], None
        for _ in range(rng.randrange(5, 40)):
            kind = rng.choice(["plain"] * 6 + ["name", "mail", "phone", "again"])
            if kind == "plain" or kind == "again" and person is None:
                pieces.append(rng.choice(plain))
                personal.append(None)
            elif kind == "name" and person is None:
                person = rng.choice(given), rng.choice(family)
                pieces += ["Mrs", *person, "and"]
                personal += [None, ("given", person[0]), ("family", person[1]), None]
            elif kind == "again":
                which = rng.randrange(2)
                word = person[which]
                pieces += [word.upper() if rng.random() < 0.3 else word, "said"]
                personal += [(("given", "family")[which], word), None]
            elif kind == "mail":
                mail = f"{rng.choice(plain)}{rng.randrange(30)}@{rng.choice(plain)}.org"
                pieces.append(mail)
                personal.append(("mail", mail))
            elif kind == "phone":
                phone = f"+49-30-{rng.randrange(100, 120)}-4567"
                pieces += [phone, "was"]
                personal += [("phone", phone), None]
        texts.append(" ".join(pieces))
        truth.append((pieces, personal))
    seen = {}
    for (pieces, personal), text in zip(truth, replaced(spark, texts), strict=True):
        words = text.split(" ")
        assert len(words) == len(pieces), text
        for old, new, what in zip(pieces, words, personal, strict=True):
            if what is None:
                assert old == new, text
            else:
                assert old != new and (old == old.upper()) == (new == new.upper()), (old, new)
                assert seen.setdefault(what, new.lower()) == new.lower(), (what, new, ' '.join(pieces), text)
    for kind in ("given", "family", "mail", "phone"):
        own = [v for (k, _), v in seen.items() if k == kind]
        assert len(own) == len(set(own)) > 3


def test_nonces_are_tried_on_distinct_entities(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Mrs Anna Smith a@b.org"), (2, "Mr Anna Smith a@b.org A@B.org"), (3, None), (4, "")], "doc_id long, text string")
    found = sorted(map(tuple, surrogates.entities(docs).collect()), key=str)
    assert found == [("email", "a@b.org", None), ("given", "anna", False), ("given", "anna", True), ("surname", "smith", None)]
    assert surrogates.nonce_for(docs, "k") == 0 and surrogates.nonce_for(docs.limit(0), "k") == 0
    from pyspark.sql import functions as F

    monkeypatch.setattr(surrogates, "_mail", lambda low, salt: F.when(salt.endswith("|2"), F.concat(low, F.lit("x"))).otherwise(F.lit("same@example.org")))
    many = spark.createDataFrame([(1, "a@b.org c@d.org")], "doc_id long, text string")
    assert surrogates.nonce_for(many, "k") == 2 and not surrogates.collisions(stage(surrogates.entities(many), "e"), "k", 1).isEmpty()
