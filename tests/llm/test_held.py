"""Copies of items in their own words, of any length, and with one word replaced."""

import random
import re

from edgetide.llm import decontaminate as dec
from tests.llm.tables import awkward, empty, prose

ITEMS = "item_id long, text string"


def words(text):
    return [w for w in (re.sub(r"[!-/:-@\[-`{-~]+", "", x).lower() for x in text.split()) if w]


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {(r["doc_id"], r["item_id"]) for r in dec.held_items(docs, spark.createDataFrame(items, ITEMS)).collect()}


def test_verbatim_copies_of_every_kind(spark):
    items = ["What is 17 times 23?", "Paris", "short one", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "Ann Bob Carl Dora Emil Fred Gina Hans",
             "今天的天气怎么样", "Which river runs through the old town of Basel", "The farmer has 7 red apples and sells 3 of them"]
    texts = [f"before it came {t} and more after it" for t in items] + [f"Before it came. {t.upper()} More" for t in items] + ["我想知道今天的天气怎么样呢"]
    got = found(spark, texts, list(enumerate(items)))
    assert {(n, n) for n in range(8)} | {(n + 8, n) for n in range(8)} | {(16, 5)} == got


def test_nothing_from_numbers_alone(spark):
    items = [(1, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (2, "What is 17 times 23?")]
    texts = ["31 32 33 34 35 36 37 38 39 40 41 42 43 44 45", "5 6 7 8 90 91 92 93 94 95 96 97", "17 times 23 is what", ""]
    assert found(spark, texts, items) == set()


def test_one_replaced_word(spark):
    rng = random.Random(4)
    items, texts, expected = [], [], set()
    for n in range(8, 24):
        item = prose(rng, n).split()
        items.append((n, " ".join(item)))
        for place in range(n):
            expected.add((len(texts), n))
            texts.append(" ".join([*prose(rng, 5, "xyz").split(), *item[:place], "replaced", *item[place + 1:], *prose(rng, 5, "xyz").split()]))
    assert found(spark, texts, items) == expected


def test_changed_values_with_a_replaced_word(spark):
    items = [(1, "The farmer has 7 red apples and sells 3 of them today")]
    texts = ["In 2020 The farmer has 9 red apples and sells 4 of them today", "so the farmer has 9 red apples and gives 4 of them today",
             "Bob farmer had 9 red pears or sold 4 to them now"]
    assert found(spark, texts, items) == {(0, 1), (1, 1)}


def test_brute_force_of_whole_copies(spark):
    rng = random.Random(11)
    items = [(n, " ".join(rng.choice([w, w.title(), w + ",", str(rng.randint(1, 99)), f"{rng.randint(1, 9)} km"]) for w in prose(rng, rng.randint(1, 24), "abc").split()))
             for n in range(40)]
    texts = [" ".join([prose(rng, rng.randint(0, 20), "abc"), *(t for _, t in rng.sample(items, 2)), prose(rng, rng.randint(0, 20), "abc")]) for _ in range(60)]
    expected = set()
    for d, text in enumerate(texts):
        line = f" {' '.join(words(text))} "
        expected |= {(d, n) for n, item in items if f" {' '.join(words(item))} " in line}
    got = found(spark, texts, items)
    long = {n for n, item in items if len(words(item)) >= dec.WINDOW}
    assert expected <= got and {x for x in got - expected if x[1] not in long} == set()


def test_holds_the_template_rule(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    key = ["doc_id", "item_id"]
    old, new = ({tuple(r) for r in f(docs, items).select(*key).collect()} for f in (dec.leaks, dec.held_items))
    assert old and old <= new
    plan = dec.held_items(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_and_cleaned(spark):
    items = spark.createDataFrame([(1, "short one"), (2, None), (3, " ?! ")], ITEMS)
    docs = awkward(spark, ["a short one", "a longer one"], extra=True)
    assert dec.held_items(empty(spark), items).count() == 0 and dec.held_items(docs, items.limit(0)).count() == 0
    kept = dec.clean_documents(docs, items, dec.held)
    assert kept.columns == docs.columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {100}
