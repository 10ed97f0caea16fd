import random
import re

from edgetide.llm import decontaminate as dec
from tests.llm.tables import awkward, empty, prose

ITEMS = "item_id long, text string, hash long, extra string"


def template(text):
    """Template token and raw token, as the module's docstring says, token by token."""
    raw = re.split(r"[ \t\n\x0b\f\r\x01-\x03]+", text)
    punctuation = r"[!-/:-@\[-`{-~]"
    out = []
    for n, word in enumerate(raw):
        bare = re.sub(punctuation, "", word)
        before = raw[n - 1] if n else ""
        is_number = bool(re.match(rf"{punctuation}*[0-9]", word))
        name = bare[:1].isupper() and bool(re.match(rf"{punctuation}*[^\W\d_]", word)) and any(c.islower() for c in word) and before and before[-1] not in ".!?:"
        kind = dec.NAME if name else dec.NUMBER if is_number else bare.lower()
        if kind == bare.lower() and kind in dec.UNITS and out and re.match(rf"{punctuation}*[0-9]", before):
            kind = dec.UNIT
        out.append((kind, word))
    return [x for x in out if x[0]]


def brute(docs, items):
    found = set()
    for doc_id, text in docs:
        d = template(text or "")
        for item_id, question in set(items):
            t = template(question or "")
            if len(t) < dec.SHORTEST:
                continue
            size, alignments = min(dec.WINDOW, len(t)), {}
            for i in range(len(t) - size + 1):
                window = [x[0] for x in t[i:i + size]]
                if sum(w not in (dec.NAME, dec.NUMBER, dec.UNIT) for w in window) < dec.LITERALS:
                    continue
                for j in range(len(d) - size + 1):
                    if [x[0] for x in d[j:j + size]] == window:
                        alignments.setdefault(j - i, set()).update(range(i, i + size))
            covered, changed = set(), False
            for shift, places in alignments.items():
                clean = lambda w: re.sub(r"[!-/:-@\[-`{-~]+", "", w).lower()
                slots = {(t[i][0], clean(t[i][1]), clean(d[i + shift][1])) for i in places if t[i][0] in (dec.NAME, dec.NUMBER, dec.UNIT)}
                if len({s[:2] for s in slots}) == len(slots):
                    covered |= places
                    changed |= any(a != b for _, a, b in slots)
            if len(covered) >= min(dec.MATCHED, len(t)):
                found.add((doc_id, item_id, len(covered), len(t), changed))
    return found


QUESTION = "Tom has 12 apples and gives 12 km of them to his friend Anna before the long walk home."


def test_changed_values(spark):
    items = spark.createDataFrame([(1, QUESTION, 0, ""), (2, "short one", 0, ""), (3, "exactly five tokens are here", 0, ""), (4, None, 0, ""), (5, "", 0, ""), (1, QUESTION, 0, "")], ITEMS)
    texts = [
        "Intro. Bob has 7 apples and gives 7 km of them to his friend Mary before the long walk home. End",  # consistent
        "Intro. Bob has 7 apples and gives 8 km of them to his friend Mary before the long walk home. End",  # 12 became 7 and 8
        QUESTION.upper(), "so exactly five tokens are here indeed", "short one", "apples and gives 12 km of them to his friend", QUESTION + " " + QUESTION]
    docs = awkward(spark, texts + texts[:1])
    got = {tuple(r) for r in dec.leaks(docs, items).collect()}
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == expected
    assert {100, 103, 106, 107} <= {r[0] for r in got} and not {101, 104, 105} & {r[0] for r in got}
    kept = dec.clean_documents(docs, items)
    assert {r["doc_id"] for r in docs.collect()} - {r[0] for r in got} == {r["doc_id"] for r in kept.collect()}


def test_random_prose_against_brute_force(spark):
    rng = random.Random(8)

    def varied(n):
        words = prose(rng, n, "abc").split()
        return " ".join(rng.choice([w, w, w, w.title(), w + ".", str(rng.randint(1, 30)), f"{rng.randint(1, 9)} km"]) for w in words)

    items = [(n, varied(rng.randint(3, 30))) for n in range(25)]
    docs = []
    for n in range(60):
        pieces = [varied(rng.randint(0, 30))]
        for _, question in rng.sample(items, rng.randint(0, 2)):
            words = question.split()
            cut = rng.randint(0, len(words) // 2)
            part = " ".join(words[cut:])
            pieces += [re.sub(r"\d+", lambda m: str(int(m.group()) + 1), part) if rng.random() < 0.4 else part, varied(rng.randint(0, 20))]
        docs.append((n, "\n".join(pieces)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    table = spark.createDataFrame([(*i, 0, "") for i in items], ITEMS)
    got = {tuple(r) for r in dec.leaks(frame, table).collect()}
    assert got == brute(docs, items) and 20 < len(got) and any(r[4] for r in got)


def test_no_python_in_the_plan(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    plan = dec.leaks(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_and_extra(spark):
    items = spark.createDataFrame([(1, QUESTION, 0, "")], ITEMS)
    docs = awkward(spark, [QUESTION], extra=True)
    assert dec.leaks(empty(spark), items).count() == 0 and dec.leaks(docs, items.limit(0)).count() == 0
    kept = dec.clean_documents(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert dec.clean_documents(docs, items.limit(0)).count() == docs.count()
