import hashlib
from collections import Counter

import duckdb
import numpy as np

from edgetide.llm import linededup
from edgetide.session import stored
from tests.llm.tables import DOCS, awkward, empty, rows


def brute(texts, threshold):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < threshold]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_against_brute_force(spark):
    texts = [f" Shared Line \nown {n}\n\nÉtat\nétat\nshared line" for n in range(12)] + ["SHARED LINE", "x\n" * 5]
    docs = awkward(spark, texts)
    every = docs.collect()
    for threshold in (2, 10):
        got = rows(linededup.line_digest(docs, threshold), "doc_id", "n_lines", "n_dropped", "kept_sha256")
        expected = [(r["doc_id"], *x) for r, x in zip(every, brute([r["text"] for r in every], threshold))]
        assert got == sorted(expected, key=repr)


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    expected = sorted(base.execute(linededup.LINE_DIGEST_SQL).fetchall(), key=repr)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert rows(linededup.line_digest(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == expected


def test_filter_never_forgets():
    rng = np.random.default_rng(1)
    keys = [rng.bytes(16) for _ in range(3000)]
    known = linededup.built(keys)
    assert known.contains(keys).all()
    assert known.contains([rng.bytes(16) for _ in range(3000)]).mean() < 0.02
    known.remove(keys[:1500])
    assert known.contains(keys[1500:]).all() and known.contains(keys[:1500]).mean() < 0.02
    assert known.add(keys[:1500]) and known.contains(keys).all()


def test_insert_and_delete_are_reversible(spark):
    first = spark.createDataFrame([(n, f"common\nown {n}\nrare {n % 4}") for n in range(6)], "doc_id long, text string")
    second = spark.createDataFrame([(10 + n, f"COMMON \nlate {n % 2}\nrare {n % 4}\n" + "\n".join(f"f{n % 3}{m}" for m in range(40))) for n in range(9)], "doc_id long, text string")
    one, two = (stored(linededup.occurrences(d)) for d in (first, second))
    index = linededup.new_index(one, 3, shards=4)
    grown = linededup.changed_index(index, two, 1)
    built = linededup.new_index(one.unionByName(two), 3, shards=4)
    keys = one.unionByName(two).select("key").distinct()

    def frequent(i):
        return {bytes(r["key"]) for r in linededup.frequent_keys(i, keys).collect()}

    def exact(i):
        return {(bytes(r["key"]), r["n_docs"]) for r in i.refs.collect()}

    assert exact(grown) == exact(built) and frequent(grown) == frequent(built) and len(frequent(built)) > 20
    back = linededup.changed_index(grown, two, -1)
    assert exact(back) == exact(index) and frequent(back) == frequent(index)


def test_empty_and_extra(spark):
    assert linededup.line_digest(empty(spark)).count() == 0
    docs = awkward(spark, extra=True)
    cleaned = linededup.cleaned_documents(docs, 2)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert cleaned.where("text is null").count() == docs.where("text is null").count()
    twice = cleaned.where("doc_id = 4").select("text", "n_chars").collect()
    assert [tuple(r) for r in twice] == [("", 0)] * 2
    assert DOCS


def test_names_of_helper_columns_are_free(spark):
    rows = [(n, f"own {n}\nshared", "mine", "x", "y") for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cleaned string, _right_id string, right_id string")
    got = sorted(tuple(r) for r in linededup.cleaned_documents(docs, 2).collect())
    assert got == [(n, f"own {n}", "mine", "x", "y") for n in range(3)]
