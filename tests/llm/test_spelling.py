import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from edgetide.llm import spelling
from tests.llm.tables import DOCS, awkward, empty, rows

NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def brute(docs, min_length=7, min_count=2, ratio=10, every=31):
    counts, lower = Counter(), str.maketrans(spelling.UPPER, spelling.LOWER)
    for r in docs.select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = defaultdict(set)
    for a in words:
        for b in words:
            if a < b and one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in words:
        best = min(((-words[x], x) for x in near[w]), default=None)
        if best and -best[0] >= ratio * words[w]:
            form[w] = best[1]

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()), key=repr)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def variants(rng, word):
    at, letter = rng.randrange(len(word)), rng.choice("aehiortzéß")
    return rng.choice([word[:at] + word[at + 1:], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1:]])


def texts(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abeéilnorstÜß", k=rng.randint(6, 12))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaaaa", "abababab"]
    out = []
    for _ in range(60):
        line = []
        for w in rng.choices(words, k=60):
            while rng.random() < 0.15:
                w = variants(rng, w)
            line.append(rng.choice([w, w.upper(), w.capitalize()]))
        out.append(rng.choice(" -_0\n").join(line))
    return out


def test_against_brute_force(spark):
    docs = awkward(spark, texts(), extra=True)
    got = rows(spelling.spelling_variants(docs), *NAMES)
    assert got == brute(docs) and any(r[1] for r in got)


def test_every_parameter_and_any_alphabet(spark):
    docs = awkward(spark, texts(4))
    expected = brute(docs, 5, 1, 3, 4)
    for symbols in (1, 2, 5, 16):  # one symbol leaves the whole work to the verification
        assert rows(spelling.spelling_variants(docs, 5, 1, 3, 4, symbols), *NAMES) == expected


def test_neighbourhood_is_whole_and_generated_once(spark):
    words = sorted({"".join(random.Random(n).choices("abc", k=n % 6)) for n in range(300)})
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    found = Counter()
    for w, near in frame.select("w", spelling.neighbourhood(F.col("w"), 3)).collect():
        assert len(near) == len(set(near))
        found.update(frozenset((w, x)) for x in near if x in words)
    assert found == Counter(frozenset(p) for p in [(a, b) for a in words for b in words if a < b and one_edit(a, b)] + [(a,) for a in words])


def test_chain_of_forms_and_a_frequent_root(spark):
    words = [("wanderer", 1000), ("wandererr", 100), ("wandererrr", 10), ("wandererrrr", 1)] + [(f"wander{c}r", 50) for c in "abcd"]
    texts_ = [" ".join([w] * n) for w, n in words]
    got = {r[0]: r for r in rows(spelling.spelling_variants(awkward(spark, texts_), min_count=1, every=1 << 40), *NAMES)}
    assert got["wandererrrr"][1:3] == ("wandererrr", "wanderer") and got["wandererrr"][2] == "wanderer"
    assert got["wanderar"][1:] == ("wanderer", "wanderer", 50, 4, 1000) and got["wanderer"][4] == 5


def test_ties_go_to_the_smaller_word_in_code_point_order(spark):
    docs = spark.createDataFrame([(1, " ".join(["strasses"] * 1 + ["straßses", "strazses"] * 20), "de", "s", 0)], DOCS)
    got = {r[0]: r for r in rows(spelling.spelling_variants(docs, min_count=1, every=1 << 40), *NAMES)}
    assert got["strasses"][1] == "strazses" and got["strazses"][4] == 2


def test_empty(spark):
    assert spelling.spelling_variants(empty(spark)).columns == list(NAMES)
    assert spelling.spelling_variants(empty(spark)).count() == 0


def test_no_table_of_words_goes_through_the_driver(spark):
    """Spark sizes tables before their explode, or by their files: neighbourhoods and words were broadcast (F1)."""
    words = spark.createDataFrame([("variant", 9), ("varient", 2), ("variants", 3), ("deviant", 4)], "word string, n long")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1g")
    try:
        for frame in (spelling.near_words(words), spelling.spelling_variants(awkward(spark, texts()))):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    finally:
        spark.conf.set(limit, before)
