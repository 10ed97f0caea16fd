import numpy as np
from pyspark.sql import functions as F

from edgetide.llm import toxicity
from edgetide.llm.common import held_out
from tests.llm.tables import awkward, empty

FOLDER = "/root/testdata/sf0.1"


def slow_segments(scores):
    """The best segment, then the same on both sides of it."""

    def search(low, high):
        best = None
        for a in range(low, high):
            for b in range(a + 1, high + 1):
                s = scores[a:b].sum()
                if s > 0 and (best is None or s > best[2] + 1e-12):
                    best = (a, b, s)
        return search(low, best[0]) + [best] + search(best[1], high) if best else []

    return search(0, len(scores))


def test_maximal_segments():
    rng = np.random.default_rng(1)
    for _ in range(300):
        scores = rng.normal(-0.2, 1, rng.integers(0, 18))
        found, expected = toxicity.maximal_segments(scores), slow_segments(scores)
        assert [f[:2] for f in found] == [e[:2] for e in expected]
        assert np.allclose([f[2] for f in found], [e[2] for e in expected])
    assert toxicity.maximal_segments(np.full(5, 1.0)) == [(0, 5, 5.0)]
    assert len(toxicity.maximal_segments(np.where(np.arange(200_000) % 2, -2.0, 1.0))) == 100_000


def test_held_out_accuracy_and_passages(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.document_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic = found["toxic"] == 1
    assert len(found) > 500 and (found["predicted"] == found["toxic"]).mean() > 0.97
    assert found.loc[toxic, "predicted"].mean() > 0.85 and found.loc[~toxic, "predicted"].mean() < 0.02
    assert (found.loc[found["predicted"] == 1, "n_passages"] > 0).mean() > 0.9


def test_passages_name_their_place(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    plain = "the and of to in was is are with this " * 200
    text = plain + "you worthless loser idiot scum " + plain
    frame = spark.createDataFrame([(text,), (plain,), ("",), (None,)], "text string")
    rows = frame.select("text", toxicity.scored(F.col("text"), model).alias("r")).collect()
    bad = next(r for r in rows if r["text"] == text)["r"]
    passage, = bad["passages"]
    assert "worthless loser idiot scum" in text[passage["start"]:passage["end"]] and passage["end"] - passage["start"] < 60
    assert bad["score"] > 0.5 and all(r["r"]["score"] < 0.5 and not r["r"]["passages"] for r in rows if r["text"] != text)


def test_copies_and_held_out_rows_teach_nothing(spark):
    rows = [(n, f"plain words number {n} here" if n % 3 else f"plain words vile number {n}") for n in range(400)] + [(n, "copied unusual text") for n in range(400, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(text like '%vile%' or text like 'copied%' as int) as toxic")
    model = toxicity.train(docs, labels)
    assert model.scores["vile"] > 1 and "copied" not in model.scores
    unlearned = toxicity.train(docs, labels, learn=held_out("doc_id", 5, 0) & F.lit(False))
    assert unlearned.scores == {}


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(n, 1, n % 2) for n in range(1, 9)] + [(4, 1, 1), (None, 1, 1), (6, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = awkward(spark, extra=True)
    got = toxicity.document_toxicity(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1 or predicted is null").count() == 0
    assert toxicity.document_toxicity(docs, labels.limit(0)).where("predicted = 0 or score = 0.5").count() == docs.count()
    assert toxicity.document_toxicity(empty(spark), labels).count() == 0
