"""Language of mixed-language text: script ranges narrow the candidates, a Viterbi pass over word scores with a
penalty for switching labels spans.

A word's score for a language is the log-likelihood of its character n-grams (one to four characters, with word
ends, hashed into buckets). n-gram counts come from a bounded sample of labelled documents per language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgetide.llm.common import fresh, held_out, sampled, small, whole_text

ORDERS = 4  # n-grams of one to so many characters
BITS = 16
BUCKETS = 1 << BITS
SAMPLE = 600  # documents of each language, about, that n-grams are counted in
SWITCH = 12.0  # log-likelihood that a change of language has to bring
FOREIGN = -10.0  # for each letter of a word, if the language is not written in its script
SMOOTH = 0.1
REMEMBERED = 200_000  # words whose scores a task remembers
TOGETHER = 200  # texts scored together

# Unicode ranges of scripts (first, last code point).
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "sinhala": ((0xD80, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "tibetan": ((0xF00, 0xFFF),),
    "myanmar": ((0x1000, 0x109F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "ethiopic": ((0x1200, 0x139F),),
    "khmer": ((0x1780, 0x17FF),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
}
UNDETERMINED = "und"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ENDING = regex.compile(r"(?r)\p{L}\p{M}*")  # searches from the end


def script_of(letter: str) -> str:
    point = ord(letter)
    if point < 0x250:
        return "latin"
    for name, ranges in SCRIPTS.items():
        if any(low <= point <= high for low, high in ranges):
            return name
    return "other"


def gram_buckets(words: list[str]):
    """For each n-gram length: numbers of the words and buckets of their n-grams.

    n-grams see the word's ends as blanks and are told apart by a hash into ``BUCKETS`` buckets.
    """
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    blank = points == 32
    word = np.cumsum(blank) - 1
    mixed = np.zeros(len(points), np.uint64)
    inner = np.zeros(len(points), bool)  # a blank strictly inside the n-gram
    with np.errstate(over="ignore"):
        for order in range(1, ORDERS + 1):
            n = len(points) - order + 1
            if n <= 0:
                return
            if order > 2:
                inner = inner[:n] | blank[order - 2:order - 2 + n]
            mixed = mixed[:n] * np.uint64(0x100000001B3) + points[order - 1:]
            valid = ~blank if order == 1 else ~inner[:n] & (word[:n] < len(words))
            hashed = (mixed[valid] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
            yield word[:n][valid], hashed.astype(np.int64)


@dataclass
class Model:
    """Log-probabilities of n-gram buckets by length, bucket and language; the scripts a language is written in."""

    languages: list[str]
    weights: np.ndarray
    scripts: dict[str, np.ndarray]


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """Counts n-grams of ``text`` by ``lang`` over a bounded sample of the rows where ``learn`` holds."""
    rows = docs.where(learn).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    chosen = sampled(rows.select("doc_id", "lang"), "lang", ["doc_id"], sample).select("doc_id").distinct()
    texts = rows.join(small(chosen), "doc_id", "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                words = Counter(w.lower() for text in own["text"] for w in LETTERS.findall(text))
                if not words:
                    continue
                times, scripts = np.array(list(words.values())), Counter()
                for word, n in words.items():
                    scripts[script_of(word[0])] += n * len(word)
                yield pd.DataFrame({"lang": lang, "order": 0, "bucket": 0, "script": list(scripts), "n": list(scripts.values())})
                for order, (word, bucket) in enumerate(gram_buckets(list(words)), 1):
                    n = np.bincount(bucket, weights=times[word], minlength=BUCKETS).astype(np.int64)
                    used = np.flatnonzero(n)
                    yield pd.DataFrame({"lang": lang, "order": order, "bucket": used, "script": "", "n": n[used]})

    key = ["lang", "order", "bucket", "script"]
    counts = texts.mapInPandas(count, "lang string, order long, bucket long, script string, n long")
    table = counts.groupBy(*key).agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(table["lang"]))
    found = np.zeros((ORDERS + 1, BUCKETS, len(languages)))
    scripts: dict[str, np.ndarray] = {}
    for at, lang in enumerate(languages):
        own = table[table["lang"] == lang]
        grams, letters = own[own["order"] > 0], own[own["order"] == 0]
        found[grams["order"], grams["bucket"], at] = grams["n"]
        for script, n in zip(letters["script"], letters["n"]):
            if n * 100 >= letters["n"].sum():  # a language is written in the scripts of a hundredth of its letters
                scripts.setdefault(script, np.zeros(len(languages), bool))[at] = True
    smooth = found[1:] + SMOOTH
    return Model(languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32), scripts)


class Numbering(dict):
    """Numbers words in the order they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


class Labeller:
    """Word scores, remembered per word, and the exact best labelling of a word sequence."""

    def __init__(self, model: Model):
        self.model, self.size = model, len(model.languages)
        self.forget()

    def forget(self):
        self.number, self.table = Numbering(), np.zeros((self.size, 1024))

    def learn(self, words: list[str]) -> None:
        """Scores the newest words; the best language of a word has score zero."""
        scores = np.zeros((self.size, len(words)))
        for order, (word, bucket) in enumerate(gram_buckets(words)):
            rows = self.model.weights[order, bucket]
            for at in range(self.size):
                scores[at] += np.bincount(word, weights=rows[:, at], minlength=len(words))
        scores /= ORDERS  # n-grams overlap: their sum counts every character about so many times
        for n, word in enumerate(words):
            allowed = self.model.scripts.get(script_of(word[0]))
            if allowed is not None and not allowed.all():
                scores[:, n] = np.where(allowed, scores[:, n], scores[:, n].min() + FOREIGN * len(word))
        first = len(self.number) - len(words)
        while len(self.number) > self.table.shape[1]:
            self.table = np.hstack([self.table, np.zeros_like(self.table)])
        self.table[:, first:len(self.number)] = scores - scores.max(axis=0)

    def scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text an array of languages by words."""
        if len(self.number) > REMEMBERED:
            self.forget()
        numbers = [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) for words in texts]
        if self.number.new:
            self.learn(self.number.new)
            self.number.new = []
        return [self.table[:, own] for own in numbers]

    def labels(self, scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
        """The labelling with the largest sum of scores less ``switch`` per change; ties go to the first language."""
        best = int(scores.sum(axis=1).argmax())
        # another path has r >= 1 runs in other languages and at least max(1, r - 1) changes, so one
        # language throughout is best where no run of another gains more than half a change
        gain = np.cumsum(scores - scores[best], axis=1)
        lowest = np.minimum.accumulate(gain, axis=1)
        if max(gain.max(), (gain[:, 1:] - lowest[:, :-1]).max(initial=0.0)) <= switch / 2:
            return np.full(scores.shape[1], best)
        value, origins = scores[:, 0].tolist(), []
        for row in scores[:, 1:].T.tolist():
            top = max(value)
            source, least = value.index(top), top - switch
            origins.append([n if v >= least else source for n, v in enumerate(value)])
            value = [(v if v >= least else least) + s for v, s in zip(value, row)]
        path = [value.index(max(value))]
        for origin in reversed(origins):
            path.append(origin[path[-1]])
        return np.array(path[::-1])

    def read(self, texts: list[str]) -> list[tuple[str, float, int, list[tuple[int, int, str]]]]:
        """For each text the language with most letters, a score, the number of spans and the spans.

        The score is the share of letters in the language's spans times its posterior within these spans.
        """
        words = [LETTERS.findall(t.lower()) for t in texts]
        out = []
        for text, own, scores in zip(texts, words, self.scores(words) if self.size else words):
            if not own or not self.size:
                out.append((UNDETERMINED, 0.0, 0, []))
                continue
            labels = self.labels(scores)
            edges = np.flatnonzero(labels[1:] != labels[:-1]) + 1
            if not len(edges):
                best, share, total = int(labels[0]), 1.0, scores.sum(axis=1)
                spans = [(LETTERS.search(text).start(), last_letter(text), self.model.languages[best])]
            else:
                letters = np.fromiter(map(len, own), np.int64, len(own))
                weight = np.bincount(labels, weights=letters, minlength=self.size)
                best = int(weight.argmax())
                share, total = weight[best] / letters.sum(), scores[:, labels == best].sum(axis=1)
                spans = self.spans(text, np.r_[0, edges], labels)
            posterior = 1 / np.exp(np.clip(total - total[best], -50, 50)).sum()
            out.append((self.model.languages[best], float(share * min(1.0, posterior)), len(spans), spans))
        return out

    def spans(self, text: str, edges: np.ndarray, labels: np.ndarray) -> list[tuple[int, int, str]]:
        places = [m.span() for m in LETTERS.finditer(text)]
        ends = np.r_[edges[1:], len(labels)] - 1
        return [(places[a][0], places[b][1], self.model.languages[labels[a]]) for a, b in zip(edges, ends)]


def last_letter(text: str) -> int:
    """End of the last word."""
    return next(m.end() for m in ENDING.finditer(text))


RESULT = "struct<lang: string, score: double, n_spans: int, spans: array<struct<start: int, end: int, lang: string>>>"


def identified(text: Column, model: Model) -> Column:
    """Struct of language, score, number of spans and the spans (positions in characters)."""
    @F.pandas_udf(RESULT)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model)
        for texts in batches:
            rows = []
            for at in range(0, len(texts), TOGETHER):
                rows += labeller.read(list(texts[at:at + TOGETHER]))
            frame = pd.DataFrame(rows, columns=["lang", "score", "n_spans", "spans"])
            frame["spans"] = [[{"start": a, "end": b, "lang": x} for a, b, x in spans] for spans in frame["spans"]]
            yield frame

    return read(whole_text(text))


def predict(docs: DataFrame) -> DataFrame:
    """``docs`` with ``language`` (see ``identified``), learned from the rows outside the held-out fold.

    A text that is null, empty or without letters is ``und`` with score zero, as is every text if nothing could be
    learned. A column ``language`` of ``docs`` is replaced; repeated rows stay.
    """
    model = train(docs, ~held_out("doc_id", 3, 1))
    return docs.drop("language").withColumn("language", identified(F.col("text"), model))


def document_languages(docs: DataFrame) -> DataFrame:
    found = predict(docs.select("doc_id", "text", "lang"))
    return found.select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), F.col("language.n_spans").alias("n_spans"))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents that have a language, with the predicted one as ``lang``; those without a letter (``und``) go."""
    found = fresh(docs.columns, "found_language")
    model = train(docs, ~held_out("doc_id", 3, 1))
    named = docs.withColumn(found, identified(F.col("text"), model))
    own = [F.col(found)["lang"].alias(c) if c.lower() == "lang" else F.col(c) for c in docs.columns]
    return named.where(F.col(found)["lang"] != UNDETERMINED).select(own)
