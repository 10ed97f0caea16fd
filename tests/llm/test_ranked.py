import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from edgetide.llm import ranked
from tests.llm.tables import DOCS, awkward, empty, prose, rows

ITEMS = "item_id long, text string, term string, n long"
NAMES = ("item_id", "rank", "doc_id", "score")


def split(text):
    return re.findall(ranked.TERM, (text or "").translate(str.maketrans(ranked.UPPER, ranked.LOWER)))


def brute(docs, items, k=50):
    texts = [(r["doc_id"], split(r["text"])) for r in docs.collect()]
    texts = [(i, t) for i, t in texts if t]
    n, length = len(texts), sum(len(t) for _, t in texts)
    df = Counter(t for _, ts in texts for t in set(ts))
    asked = {}
    for r in items.collect():
        asked.setdefault(r["item_id"], set()).update(split(r["text"]))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, ts in texts:
            tf, m = Counter(ts), 100 - 50 + (50 * len(ts) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, rank + 1, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def questions(spark, texts):
    rows_ = [(n, t, "x", 1) for n, t in enumerate(texts)] + [(90, None, None, None), (91, "", "x", 1), (92, "word", "x", 1), (92, "word line", "x", 1), (None, "shared text", "x", 1)]
    return spark.createDataFrame(rows_, ITEMS).repartition(3)


@pytest.mark.parametrize("blocks", [(500_000, 2048), (400, 3)])
def test_against_brute_force(spark, blocks):
    rng = random.Random(1)
    texts = [prose(rng, rng.choice([1, 5, 40, 300]), "abcÉ7") for _ in range(150)]
    docs = awkward(spark, texts + texts[:20], extra=True)  # copies have equal scores
    items = questions(spark, [prose(rng, 12, "abcÉ7") for _ in range(8)] + texts[:3])
    for k in (3, 50):
        assert rows(ranked.rank_documents(docs, items, k, *blocks), *NAMES) == brute(docs, items, k)


def test_unicode_terms(spark):
    docs = spark.createDataFrame([(1, "Ünï x \U0001F600word-ÀB", "a", "b", 0), (2, "other", "a", "b", 0), (3, "\U0001F600word", "a", "b", 0)], DOCS)
    items = questions(spark, ["\U0001F600WORD", "Ünï X", "Àb", "àb"])
    got = rows(ranked.rank_documents(docs, items), *NAMES)
    assert got == brute(docs, items) and {r[2] for r in got if r[0] == 0} == {1, 3} and not [r for r in got if r[0] == 3]


def test_best_positions_stop_early_and_keep_ties():
    rng = np.random.default_rng(4)
    term, doc, impact = [], [], []
    for t in range(12):
        held = rng.permutation(20_000)[:6000]
        term.append(np.full(6000, t * 3)), doc.append(held), impact.append((rng.pareto(1.2, 6000) * 100).astype(np.int64) + 1)
    term, doc, impact = map(np.concatenate, (term, doc, impact))
    lists = ranked.Lists(term, doc, impact, 20_000)
    for asked in ([0, 3, 6], [9, 33, 1000], [12], [1, 2], []):
        docs, scores = lists.search(np.array(asked, np.int64), 10)
        total = np.zeros(20_000, np.int64)
        np.add.at(total, doc[np.isin(term, asked)], impact[np.isin(term, asked)])
        kth = np.sort(total)[-10]
        expected = np.flatnonzero((total >= kth) & (total > 0))
        assert sorted(docs) == expected.tolist() and all(total[docs] == scores)
        assert lists.scored.sum() < 5000  # of up to 20 000 documents
    same = ranked.Lists(np.zeros(500, int), np.arange(500), np.full(500, 7), 500)
    assert len(same.search(np.array([0]), 10)[0]) == 500  # the bound is never strictly below equal scores


def test_empty(spark):
    docs, items = awkward(spark), questions(spark, ["word"])
    for d, i in ((empty(spark), items), (docs, items.limit(0)), (empty(spark), items.limit(0))):
        found = ranked.rank_documents(d, i)
        assert found.columns == list(NAMES) and found.count() == 0
