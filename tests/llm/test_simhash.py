import random

import numpy as np
import pytest
import xxhash

from edgetide.llm import simhash
from edgetide.llm.components import components
from tests.llm.tables import awkward, empty, prose


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, distance):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", ["", " \n", "a", "a b c", "A b\tC d", "a b c d e É x", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near(rng, value, most):
    for bit in rng.sample(range(64), rng.randint(0, most)):
        value ^= 1 << bit
    return value


@pytest.mark.parametrize("block", [2048, 9])
def test_links_connect_what_all_links_connect(spark, block):
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(12):
        centre = rng.getrandbits(64)
        values |= {near(rng, centre, 5) for _ in range(rng.choice([2, 5, 60, 90]))}
    values = sorted(values)
    signed = [int(np.array([v], "<u8").view("<i8")[0]) for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    roots = {r["node"]: r["root"] for r in components(simhash.links(frame, 4, block), "a", "b").collect()}
    mine, expected = {}, {}
    for v, s, g in zip(values, signed, groups(values, 4)):
        mine.setdefault(roots.get(s, s), set()).add(v)
        expected.setdefault(g, set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(200)] + [(500, 501), (7, 7), (900, 900), (None, 3)], "a long, b long").repartition(4)
    roots = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
    assert roots == {**{n: 0 for n in range(201)}, 500: 500, 501: 500, 900: 900}


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        words = prose(rng, 150).split()
        for _ in range(4):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    docs = awkward(spark, texts + texts[:5])
    every = [(r["doc_id"], plain_fingerprint(r["text"] or "")) for r in docs.collect()]
    root = groups([f for _, f in every], 4)
    least = {g: min((d for (d, _), h in zip(every, root) if h == g and d is not None), default=None) for g in root}
    expected = sorted(((d, f"{f:016x}", least[g]) for (d, f), g in zip(every, root)), key=repr)
    assert sorted(map(tuple, simhash.fingerprint_components(docs).collect()), key=repr) == expected
    kept = simhash.one_per_group(docs).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == sorted(least.values(), key=repr)


def test_empty_and_extra(spark):
    assert simhash.fingerprint_components(empty(spark)).count() == 0
    assert simhash.one_per_group(empty(spark)).count() == 0
    docs = awkward(spark, extra=True)
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 4").count() == 1
    unnamed = docs.where("doc_id is null")
    assert simhash.one_per_group(unnamed).count() == 2  # two texts without ids
