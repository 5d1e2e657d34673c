"""Names over time: the sweep against a plain loop."""

import random

import pytest

from sparkloft.operators import identity, ordered

ALIAS = "surface string, scope string, person_id string, valid_from string, valid_to string"
MENTION = "mention_id long, surface string, scope string, at string"


def plain(mentions, aliases):
    out = {}
    for m, name, scope, at in mentions:
        who = set()
        for a, a_scope, person, f, u in aliases:
            if name is None or a is None or person is None or a.lower() != name.lower() or a_scope not in (None, scope):
                continue
            after = f is None or at is not None and f <= at
            if after and (u is None or at is not None and u > at):
                who.add(person)
        out[m] = (min(who) if len(who) == 1 else None, len(who))
    return out


@pytest.mark.parametrize("rows_of_one_task", [100_000, 0])
def test_sweep(spark, monkeypatch, rows_of_one_task):
    monkeypatch.setattr(ordered, "PLAIN", rows_of_one_task)
    monkeypatch.setattr(ordered, "RANGES", 5)
    rng = random.Random(7)

    def time(none):
        return None if rng.random() < none else f"2024-{rng.randint(1, 9):02d}"

    names, scopes = ["Bo", "bo", "Al", "AL", None], [None, "x", "y"]
    aliases = [(rng.choice(names), rng.choice(scopes), rng.choice(["p", "q", "r", None]), time(0.3), time(0.4)) for _ in range(40)]
    aliases += aliases[:5] + [("Hub", None, f"p{k}", f"2024-{1 + k % 9:02d}", f"2024-{2 + k % 9:02d}") for k in range(30)] + [("one", "x", "solo", None, None)]
    mentions = [(k, rng.choice(names + ["hub", "HUB", "ONE", "nobody"]), rng.choice(scopes), time(0.1)) for k in range(200)]
    got = identity.resolve_all(spark.createDataFrame(mentions + mentions[:9], MENTION), spark.createDataFrame(aliases, ALIAS)).collect()
    assert len(got) == len(mentions)
    assert {r["mention_id"]: (r["person_id"], r["candidates"]) for r in got} == plain(mentions, aliases)
    some = spark.createDataFrame(mentions[:3], MENTION)
    assert {r["candidates"] for r in identity.resolve_all(some, spark.createDataFrame([], ALIAS)).collect()} == {0}
    assert identity.resolve_all(some.limit(0), spark.createDataFrame(aliases, ALIAS)).count() == 0
