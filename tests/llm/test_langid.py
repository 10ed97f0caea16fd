import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgetide.llm import langid
from edgetide.llm.common import held_out
from tests.llm.tables import awkward, empty

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return langid.train(docs, ~held_out("doc_id", 3, 1))


def test_labels_are_the_best_path():
    rng = np.random.default_rng(3)
    labeller = langid.Labeller(langid.Model(["a", "b", "c"], np.zeros((4, langid.BUCKETS, 3), np.float32), {}))
    for _ in range(300):
        scores = -np.abs(rng.normal(size=(3, rng.integers(1, 7))) * 2)

        def total(path):
            return sum(scores[l, n] for n, l in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:]))

        best = max(map(total, itertools.product(range(3), repeat=scores.shape[1])))
        assert total(labeller.labels(scores, 3.0).tolist()) == pytest.approx(best)


def test_n_grams():
    words = ["ab", "é", "abcde"]
    found = [(word.tolist(), len(bucket)) for word, bucket in langid.gram_buckets(words)]
    assert [n for _, n in found] == [8, 3 + 2 + 6, 2 + 1 + 5, 1 + 0 + 4]
    alone = [b for _, b in langid.gram_buckets(["abcde"])]
    together = [b[w == 2] for w, b in langid.gram_buckets(words)]
    assert all((a == b).all() for a, b in zip(alone, together))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = langid.document_languages(docs).join(docs.select("doc_id", "lang"), "doc_id")
    row = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert row["right"] > 0.97 and row["n"] > 200
    assert found.where("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_mixed_text_has_spans(spark, model):
    docs = {r["lang"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("n_chars between 600 and 1200").orderBy("doc_id").collect()}
    text = docs["en"] + "\n" + docs["de"] + "\n" + docs["fr"]
    (lang, score, n, spans), = langid.Labeller(model).read([text])
    assert [s[2] for s in spans if s[1] - s[0] > 200] == ["en", "de", "fr"] and n == len(spans)
    cut = len(docs["en"])
    assert any(abs(s[1] - cut) < 60 for s in spans) and 0 < score < 1


def test_scripts(model):
    assert langid.script_of("a") == "latin" and langid.script_of("ж") == "cyrillic" and langid.script_of("漢") == "han"
    scripts = {"latin": np.array([True, False]), "cyrillic": np.array([False, True])}
    two = langid.Model(["x", "y"], np.zeros((4, langid.BUCKETS, 2), np.float32), scripts)
    found = langid.Labeller(two).read(["hello there", "привет мир", "hello there hello привет привет мир мир снова", "123 !?", ""])
    assert [f[0] for f in found] == ["x", "y", "y", "und", "und"]
    assert [s[2] for s in found[2][3]] == ["x", "y"]


def test_awkward_rows(spark):
    docs = awkward(spark, ["the and of to in is was" for _ in range(5)])
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.document_languages(docs).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "und"), (None, "und"), (7, "und")} <= got and (100, "en") in got
    assert langid.document_languages(docs).count() == docs.count()
    wide = awkward(spark, extra=True)
    kept = langid.accepted_documents(wide)
    assert kept.columns == wide.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert kept.where("doc_id = 4").count() == 2 and kept.where("doc_id = 6").count() == 1
    assert langid.document_languages(empty(spark)).count() == 0 and langid.accepted_documents(empty(spark)).count() == 0
