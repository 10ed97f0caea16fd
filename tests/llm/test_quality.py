import numpy as np
import pytest
from pyspark.sql import functions as F

from edgetide.llm import quality
from tests.llm.tables import awkward, empty

FOLDER = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones, zeros = label.sum(), (1 - label).sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / ones / zeros


def test_gradients():
    rng = np.random.default_rng(1)
    net = quality.untrained()
    for name, part in net.parts().items():
        setattr(net, name, part.astype(float))
    points = rng.integers(97, 123, (5, 2 * quality.BLOCK + quality.STRIDE)).astype(np.int16)
    points[4, 100:] = quality.PAD
    data = quality.Examples(points, np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0]))

    def loss():
        response = net.embed[data.points].reshape(5, -1, quality.STRIDE * quality.EMBED)
        half = quality.STRIDE * quality.EMBED
        window = response[:, :-1] @ net.filters[:half] + response[:, 1:] @ net.filters[half:]
        window[data.points[:, :-quality.STRIDE:quality.STRIDE] == quality.PAD] = -1e9
        hidden = np.maximum(np.maximum(window.max(axis=1) + net.bias, 0) @ net.layer + net.layer_bias, 0)
        rows = [hidden[:2], hidden[2:3], hidden[3:]]
        z = np.array([np.r_[h.mean(axis=0), h.max(axis=0)] @ net.out + net.out_bias[0] for h in rows])
        return np.mean(np.log1p(np.exp(z)) - data.labels * z)

    found = quality.gradients(net, data)
    for name, g in found.items():
        part = net.parts()[name]
        at = np.unravel_index(np.abs(g).argmax(), part.shape)
        part[at] += 1e-6
        up = loss()
        part[at] -= 2e-6
        down = loss()
        part[at] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-3, abs=1e-7), name


def test_scores_do_not_depend_on_neighbours():
    net = quality.untrained()
    rng = np.random.default_rng(2)
    texts = [b"", b"a", bytes(rng.integers(32, 127, 252)), bytes(rng.integers(32, 127, 256)), bytes(rng.integers(0, 256, 70_000)), b"x" * 1_300_000, b"end"]
    together = quality.logits(net, texts)
    alone = np.array([quality.logits(net, [t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-4)
    moved = quality.logits(net, [texts[4] + b"#" * 3000])[0]
    assert abs(moved - alone[4]) > 1e-6  # the end of a long text counts


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.document_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(found) > 500 and auc(found["score"].to_numpy(), found["quality"].to_numpy()) > 0.95
    assert (found["predicted"] == found["quality"]).mean() > 0.92


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(1, 9)] + [(4, 1, 1), (None, 1, 1), (6, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = awkward(spark, extra=True)
    got = quality.document_quality(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    same = {r["score"] for r in got.where("doc_id = 4").collect()}
    assert len(same) == 1
    one_class = quality.document_quality(docs, labels.where("quality = 1"))
    assert one_class.agg(F.min("predicted")).first()[0] == 1
    assert quality.document_quality(docs, labels.limit(0)).where("score = 0.5").count() == docs.count()
    assert quality.document_quality(empty(spark), labels).count() == 0
