"""Streams hold rows by pieces of time: what a timer reads at once, and how often it asks the state store, do not go by all rows."""

import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from sparkloft.operators import identity
from sparkloft.streaming import budget, watch


class Store:
    """A state store in memory; counts calls, and the most rows that one piece was read with."""

    def __init__(self):
        self.calls, self.most, self.timers = 0, 0, []

    def _state(self):
        data, store = {}, self

        def call(f):
            def run(*a):
                store.calls += 1
                return f(*a)

            return run

        def get(k=None):
            value = data[k]
            store.most = max(store.most, len(value[0]) if k is not None else 0)
            return value

        return SimpleNamespace(
            exists=call(lambda: None in data), get=call(get), update=call(lambda v: data.__setitem__(None, v)), getValue=call(get),
            updateValue=call(data.__setitem__), removeKey=call(lambda k: data.pop(k)), keys=call(lambda: list(data)), data=data,
        )

    def getMapState(self, *a):
        return self._state()

    def getValueState(self, *a):
        return self._state()

    def registerTimer(self, at):
        self.timers.append(at)


def at(ms):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def frames(rows, columns, n=100):
    for i in range(0, len(rows), n):
        part = pd.DataFrame(rows[i : i + n], columns=columns)
        part["ts"] = pd.to_datetime(part["ts"], unit="us")
        yield part


def test_a_folder_is_read_by_pieces():
    hour, rng = 3_600_000_000, random.Random(3)
    rows = [(h * hour + rng.randrange(hour // 4), f"p{rng.randrange(9)}", 600.0) for h in range(200) for _ in range(20)]
    rng.shuffle(rows)
    store, folder = Store(), watch._Bursts(30.0, 0.0)
    folder.init(store)
    list(folder.handleInputRows(("f",), frames(rows, ["ts", "path", "debounce"]), at(0)))
    got = []
    for now in (hour * 100 // 1000, hour * 300 // 1000):
        got += [r for part in folder.handleExpiredTimer(("f",), at(now), None) for r in part.itertuples(index=False)]
    want = []
    for t, path, _ in sorted(rows):
        if want and t - want[-1][1] < 600_000_000:
            want[-1][1] = t
            want[-1][2].add(path)
        else:
            want.append([t, t, {path}])
    assert [(r.first.value // 1000, r.last.value // 1000, r.files) for r in got] == [(a, b, len(p)) for a, b, p in want]
    assert store.most == 20 and not folder.held.rows.data


def test_keys_share_a_state():
    rng = random.Random(4)
    rows = [(f"u{rng.randrange(300)}", i, rng.randrange(10**6) * 10**6) for i in range(3000)]
    store, shard = Store(), budget._Trailing(2, 7200.0)
    shard.init(store)
    list(shard.handleInputRows((1,), frames(rows, ["key", "id", "ts"]), at(0)))
    got = {}
    for now in (400_000_000, 700_000_000, 10**9):
        for part in shard.handleExpiredTimer((1,), at(now), None):
            got |= {r.id: (r.key, r.in_hour, r.allowed) for r in part.itertuples(index=False)}
    want = {}
    for k, i, t in rows:
        n = sum(a == k and t - 7200 * 10**6 <= b <= t for a, _, b in rows)
        want[i] = (k, n, n <= 2)
    assert got == want and not shard.held.rows.data
    assert store.calls < 3 * 10**6 // 7200 * 2  # by pieces of time, not by key


def test_mentions_are_not_shuffled_to_find_equal_ones(spark, monkeypatch):
    seen = []
    plain = identity.running_total
    monkeypatch.setattr(identity, "running_total", lambda rows, *a: seen.append(rows) or plain(rows, *a))
    mentions = spark.range(40).select(F.col("id").alias("mention_id"), F.lit("a").alias("surface"), F.lit(None).cast("string").alias("scope"), F.lit("5").alias("at"))
    aliases = spark.createDataFrame([("A", None, "p", "1", None)], "surface string, scope string, person_id string, valid_from string, valid_to string")
    got = identity.resolve_all(mentions.union(mentions), aliases).collect()
    assert len(got) == 40 and {(r["person_id"], r["candidates"]) for r in got} == {("p", 1)}
    lines = seen[-1]._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Aggregate" in x and "mention_id" in x for x in lines)
