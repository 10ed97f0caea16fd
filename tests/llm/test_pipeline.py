"""The pipeline on a small table, next to a plain computation of every stage."""

import hashlib

import corpus_pipeline
from edgetide.llm import bpe, queries
from tests.llm.tables import awkward, empty
from tests.llm.test_decontaminate import QUESTION, brute
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_simhash import groups, plain_fingerprint

ITEMS = [(1, QUESTION)]


def folder_of(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_against_brute_force(spark, tmp_path):
    shared = [f"Own words number {n} of this document stay {'abcdefghijkl'[n]} here.\nA line in very many documents." for n in range(12)]
    near = "One long enough text that will be copied with a small change at the end of all of it " * 6
    docs = awkward(spark, [*shared, near + "x", near + "y", QUESTION + " More text follows."])
    folder = folder_of(spark, tmp_path, docs)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = [d for d in now if any(c.isalpha() for c in d[1] or "")]
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        assert frame.columns == docs.columns
        if name == "language":
            assert {r["lang"] for r in frame.select("lang").collect()} <= {r["lang"] for r in docs.select("lang").collect()} - {None}
        elif name == "lines":
            digests = [x[2] for x in brute_lines([t for _, t in expected], 10)]
            assert sorted(((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in frame.collect()), key=repr) == sorted(((d, h) for (d, _), h in zip(expected, digests)), key=repr)
            expected = [(r["doc_id"], r["text"]) for r in frame.collect()]
        elif name == "near_duplicates":
            root = groups([plain_fingerprint(t) for _, t in expected], 4)
            chosen = {g: min(((d is None, d or 0), t) for (d, t), h in zip(expected, root) if h == g) for g in root}
            expected = [(None if missing else d, t) for (missing, d), t in chosen.values()]
        elif name == "benchmark_leaks":
            bad = {r[0] for r in brute(expected, ITEMS)}
            assert len(bad) == 1
            expected = [d for d in expected if d[0] not in bad]
        assert sorted(((r["doc_id"]) for r in frame.collect()), key=repr) == sorted((d for d, _ in expected), key=repr), name
    result = corpus_pipeline.run(spark, folder).collect()
    coder = bpe.Codec(bpe.default_vocabulary())
    assert sorted(((r["doc_id"], bytes(r["ids"]), r["decoded_sha256"]) for r in result), key=repr) == sorted(
        ((d, coder.encode(t or "").tobytes(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in expected), key=repr)


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, empty(spark))).count() == 0


def test_names():
    names = [name for name in queries.QUERIES if name.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries.QUERIES
    assert set(queries.ORACLES) <= set(queries.QUERIES)
