"""Personal data: base patterns against plain expressions, reliabilities against known ones, added spans on a small corpus."""

import hashlib
import random
import re

import numpy as np
import pytest

from sparkloft.llm import pii

SCHEMA = "doc_id long, text string, base string, spans string, kind int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def base(text):
    return sorted((pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)[0])


@pytest.mark.parametrize("alphabet,size", [("a1@.", 12), ("1.+", 14), ("0123456789 -", 40), ("+1() .-x", 16), ("a_é@.-+ 12\n", 20), ("12..", 30)])
def test_base_spans(alphabet, size):
    rng = random.Random(7)
    for _ in range(6000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(size)))
        assert base(text) == sorted(plain(text)), text


def test_base_spans_of_joined_parts():
    rng = random.Random(8)
    parts = ["4111 1111 1111 1111", "5500-0000-0000-0004", "a.b+c@d-e.fr", "192.168.0.1", "256.1.1.1", "+49 (30) 1234-567", "+1 2", " ", ",", "x", "é", "7", ".", "-"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(9)))
        assert base(text) == sorted(plain(text)), text


def test_long_runs_stay_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "1 " * 200_000, "+1" + "(" * 400_000, "a@" * 200_000, "@a" * 200_000, " at " * 50_000, ":" * 100_000):
        kept, dropped = pii.base_spans(text)
        pii.candidates(text, dropped)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "write to a@b.org"), (3, "write to a@b.org"), (3, "write to a@b.org"), (4, "x " * 200_000 + "10.0.0.1"), (5, "é😀 +1 (918) 555-3922 4111111111111111")]
    got = pii.personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(next(t for d, t in rows if d == r["doc_id"]))
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["spans"] == text
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS] and r["n_added"] == 0
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    got = pii.personal_data(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r["spans"].split(","))
        assert len([x for x in r["spans"].split(",") if x]) == len(want) + r["n_added"]
    assert sum(r["n_added"] for r in got) == 0  # numbers that fail their check digit, and "at" between words, are no personal data


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(3)
    truth = rng.random(40_000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.85, 0.55])
    votes = np.where(rng.random((len(truth), 6)) < right, truth[:, None], ~truth[:, None]) * 2
    votes[rng.random(votes.shape) < 0.2] = 1
    odds, guess = pii.reliabilities(votes, np.ones(len(truth)), np.zeros(len(truth), bool))
    found = odds[:, 1, 2] / (odds[:, 1, 2] + odds[:, 1, 0])
    assert np.abs(found - right).max() < 0.03
    assert ((guess > 0.5) == truth).mean() > 0.95


def corpus():
    """Lines with and without personal data in forms that the base patterns miss."""
    rng = random.Random(5)
    yes, no = [], []
    for _ in range(150):
        d = "".join(rng.choices("23456789", k=10))
        yes.append(("phone", "Please call me on ", f"({d[:3]}) {d[3:6]}-{d[6:]}", " after nine"))
        yes.append(("email", "you can mail ", f"{rng.choice(['jo', 'ana', 'lee'])}{d[:2]} at example dot com", " for it"))
        yes.append(("email", "contact: ", f"{rng.choice(['jo', 'ana', 'lee'])}{d[:2]}[at]mail{d[2]}.org", ""))
        yes.append(("ip", "the server ", f"10[.]{rng.randrange(256)}[.]{rng.randrange(256)}[.]7", " is down"))
        number = "4" + "".join(rng.choices("0123456789", k=14))
        number += next(c for c in "0123456789" if luhn(number + c))
        yes.append(("card", "my visa card ", ".".join(number[i : i + 4] for i in range(0, 16, 4)), " expires"))
        wrong = number[:-1] + str((int(number[-1]) + 1) % 10)
        no += [f"serial {wrong} was built", f"release date 2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", f"she looked at the {d[:2]} houses. Then", f"version 300.{d[:3]}.9.1 of the code",
               f"order {d[:3]} {d[3:6]} {d[6:9]}", f"at {d[0]}:30:{d[1]}5 in the hall"]
    return yes, no


def test_added_spans(spark):
    yes, no = corpus()
    rows = [(i, a + b + c) for i, (_, a, b, c) in enumerate(yes)] + [(10_000 + i, t) for i, t in enumerate(no)]
    rows += [(20_000 + i, "card 4111 1111 1111 1111 and mail a@b.com, call +1 (918) 555-3922 or host 10.0.0.1") for i in range(20)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, rows)).collect()}
    for kind in pii.KINDS:
        mine = [(i, a, b) for i, (k, a, b, _) in enumerate(yes) if k == kind]
        hit = [got[i] == f"{kind}:{len(a)}:{len(a) + len(b)}" for i, a, b in mine]
        assert np.mean(hit) > 0.95, (kind, [(rows[i][1], got[i]) for i, _, _ in mine if got[i] != f"{kind}"][:3])
    assert sum(got[10_000 + i] != "" for i in range(len(no))) == 0


def test_overlapping_candidates():
    model = pii.Model((None,) * 4, (None, None, np.zeros(1 + 12 + 6), np.zeros(1 + 12 + 6)))
    others = [dict(kind=k, start=s, end=e, votes=0, shapes=0) for k, s, e in ((3, 0, 10), (2, 5, 12), (2, 10, 14))]
    assert pii.accepted(others, model, 0.5) == [(2, 5, 12)]
    assert pii.accepted(others, model, 0.6) == []
