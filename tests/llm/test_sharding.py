import zlib

import numpy as np
import pytest

from edgetide.llm import sharding
from tests.llm.tables import awkward, empty


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(size):
    places = sharding.permute(np.arange(size), size, 3)
    assert sorted(places.tolist()) == list(range(size))
    assert places.tolist() == [int(sharding.permute(np.array([n]), size, 3)[0]) for n in range(size)]
    if size > 100:
        other = sharding.permute(np.arange(size), size, 4)
        assert (places != other).mean() > 0.9 and abs(np.corrcoef(places, np.arange(size))[0, 1]) < 0.1


def test_large_numbers():
    size = (1 << 40) + 7
    numbers = np.arange(size - 2000, size)
    places = sharding.permute(numbers, size, 9)
    assert len(set(places.tolist())) == 2000 and places.min() >= 0 and places.max() < size and places.max() > size // 2


def test_shards(spark):
    docs = awkward(spark, [f"text {n}" for n in range(300)])
    result = sharding.document_shards(docs, 40).collect()
    assert len(result) == docs.count()
    sizes = {}
    for r in result:
        sizes.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    counts = [len(sizes.get(n, [])) for n in range(40)]
    assert max(counts) - min(counts) <= 1
    expected = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in result), key=repr) == expected


def test_independent_of_partitions(spark):
    docs = awkward(spark, [f"text {n}" for n in range(50)])
    one, other = (sorted(map(tuple, sharding.document_shards(d, 7).collect()), key=repr) for d in (docs.repartition(1), docs.repartition(9)))
    assert one == other


def test_empty_and_extra(spark):
    assert sharding.document_shards(empty(spark)).count() == 0
    docs = awkward(spark, extra=True)
    dealt = sharding.assign_shards(docs, ["doc_id", "text"], 5)
    assert set(docs.columns) | {"slot"} == set(dealt.columns) and dealt.count() == docs.count()
