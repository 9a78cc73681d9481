"""The kept index against a plain list under puts, removals, compactions and openings anew; and what its questions read."""

import random
from bisect import bisect_left
from collections import defaultdict

import pytest

from tidejoin.operators import files
from tidejoin.operators.kept_index import KeptIndex, build


class Plain:
    def __init__(self):
        self.held = defaultdict(list)

    def put(self, rows):
        for k, v in rows:
            if k is not None:
                self.held[k].append(v)

    def remove(self, keys):
        for k in keys:
            self.held.pop(k, None)

    def remove_values(self, rows):
        for k, v in rows:
            if v in self.held.get(k, []):
                self.held[k].remove(v)
            if not self.held.get(k, [0]):
                del self.held[k]

    def keys(self):
        return sorted(k for k, v in self.held.items() if v)


def hold(spark, index, plain, probes, key):
    ask = spark.createDataFrame([(p,) for p in probes], f"key {key}")
    keys = plain.keys()
    assert {r.key: r["values"] for r in index.get(ask).collect()} == {p: sorted(plain.held[p]) if plain.held.get(p) else None for p in probes}
    below = {p: bisect_left(keys, p) for p in probes}
    assert {r.key: r["rank"] for r in index.rank(ask).collect()} == below
    assert {r.key: r.found for r in index.floor(ask).collect()} == {p: p if p in plain.held and plain.held[p] else keys[below[p] - 1] if below[p] else None for p in probes}
    assert index.size() == len(keys)


@pytest.mark.parametrize("key, some", [("long", lambda r: r.randrange(-40, 40)), ("string", lambda r: r.choice("abcdeé") * r.randrange(1, 4))])
def test_changes_and_questions(spark, tmp_path, key, some):
    rng, plain = random.Random(7), Plain()
    rows = [(some(rng), rng.randrange(5)) for _ in range(150)] + [(None, 1)]
    table = lambda rows: spark.createDataFrame(rows, f"key {key}, value long")
    keys = lambda keys: spark.createDataFrame([(k,) for k in keys], f"key {key}")
    index = build(spark, str(tmp_path / "index"), table(rows), slice_rows=20)
    plain.put(rows)
    probes = sorted({some(rng) for _ in range(25)})
    hold(spark, index, plain, probes, key)
    for round_ in range(2):
        more, gone, less = [(some(rng), rng.randrange(9)) for _ in range(40)], [some(rng) for _ in range(6)], [(some(rng), rng.randrange(5)) for _ in range(30)]
        index.remove(keys(gone))
        plain.remove(gone)
        index.put(table(more))
        plain.put(more)
        index.remove_values(table(less))
        plain.remove_values(less)
        again = KeptIndex(spark, index.folder, key, "long", 20)  # opened anew
        hold(spark, again, plain, probes, key)
        again.compact()
        again.sweep()
        if round_:
            hold(spark, again, plain, probes, key)
    everything = plain.keys()
    index.remove(keys(everything))
    plain.remove(everything)
    hold(spark, index, plain, probes[:3], key)
    index.compact()
    hold(spark, index, plain, probes[:3], key)


def test_questions_read_only_the_slices_that_they_hit(spark, tmp_path):
    index = build(spark, str(tmp_path / "index"), spark.range(4000).selectExpr("id AS key", "id * 2 AS value"), slice_rows=100)
    slices = index._zones(index._version()).count()
    assert slices >= 40
    ask = spark.createDataFrame([(5,), (7,), (3990,)], "key long")
    assert {r.key: r["values"] for r in index.get(ask).collect()} == {5: [10], 7: [14], 3990: [7980]}
    assert len(index.read_last) == 2
    assert {r.key: r.found for r in index.floor(ask).collect()} == {5: 5, 7: 7, 3990: 3990}
    assert len(index.read_last) == 2
    index.put(spark.createDataFrame([(2000, 1), (2000, 2)], "key long, value long"))
    assert {r.key: r["rank"] for r in index.rank(ask).collect()} == {5: 5, 7: 7, 3990: 3990}
    assert len(index.read_last) == 3  # the slice that the change lies in too
    before = {v: files.names(spark, f"{index.folder}/slices/{v}") for v in files.names(spark, f"{index.folder}/slices")}
    assert len(index.compact()) == 1
    after = files.names(spark, f"{index.folder}/slices")
    assert all(files.names(spark, f"{index.folder}/slices/{v}") == s for v, s in before.items()) and len(after) == len(before) + 1
    # A floor goes on to the slice before where its own has nothing left.
    index.remove(spark.range(1000, 1500).selectExpr("id AS key"))
    assert index.floor(spark.createDataFrame([(1499,)], "key long")).first().found == 999
    assert 5 <= len(index.read_last) <= 8


def test_a_slice_that_grows_is_split(spark, tmp_path):
    index = build(spark, str(tmp_path / "index"), spark.range(50).selectExpr("id * 100 AS key", "id AS value"), slice_rows=30)
    index.put(spark.range(500).selectExpr("id AS key", "id AS value"))
    index.compact()
    zones = index._zones(index._version()).orderBy("slice").collect()
    assert len(zones) > 8 and zones[0].low is None and [z.low for z in zones[1:]] == sorted(z.low for z in zones[1:])
    assert index.size() == 500 + 45
