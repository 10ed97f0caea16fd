"""Toxicity by maximum-scoring segments.

Tokens are scored by their log-odds between toxic and other documents under an informative Dirichlet prior, less a
constant drift, so that ordinary text falls and toxic passages rise. A linear-time scan finds every maximal
segment. Segment scores of ordinary documents follow an extreme-value law; its two parameters turn each segment's
score into an expected number of such segments by chance, and a logistic curve over this evidence gives a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import held_out, sampled, small, whole_text
from edgetide.session import stored

SAMPLE = 3000  # labelled documents of each class, about, that the model is fitted on
PRIOR = 0.02  # weight of the prior, as a share of all counts
SURE = 2.5  # standard errors a token's log-odds must differ from zero to count
DRIFT = 0.3  # taken from every token's score
FLOOR = -2.0
CHANCE = 0.05  # expected number of segments by chance up to which a passage is reported
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)]


@dataclass
class Counts:
    kept: pd.DataFrame  # token, toxic, other (numbers of documents) and score of the tokens that tell the classes apart
    toxic: int  # all counts of the class
    other: int


def token_scores(counts: DataFrame) -> Counts:
    """Scores of all tokens whose log-odds are surely not zero; ``counts`` has token, toxic, other.

    Only they reach the driver. A token that is seldom seen is not sure, so each of them stands in some twenty sampled
    documents or more.
    """
    totals = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.sum("other"), F.lit(0)).alias("other")).first()
    n_a, n_b = totals["toxic"], totals["other"]
    if not n_a or not n_b:
        return Counts(pd.DataFrame({"token": [], "toxic": [], "other": [], "score": []}), n_a, n_b)
    total = PRIOR * (n_a + n_b)
    prior = PRIOR * (F.col("toxic") + F.col("other"))
    a, b = F.col("toxic") + prior, F.col("other") + prior
    odds = F.log(F.try_divide(a, F.lit(n_a + total) - a)) - F.log(F.try_divide(b, F.lit(n_b + total) - b))
    sure = F.abs(F.col("odds")) / F.sqrt(F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b))
    kept = counts.withColumn("odds", odds).where(sure >= SURE).orderBy("token").toPandas()
    return Counts(kept.assign(score=np.maximum(kept["odds"].to_numpy(float) - DRIFT, FLOOR)), n_a, n_b)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in order, in one pass.

    They are disjoint, each is the best within itself, and none can be made better by moving an end.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list[float]] = []  # start, end, total before, total after
    links: list[int] = []  # for each candidate the last earlier one with a smaller total before it
    for at in np.flatnonzero(scores > 0).tolist():
        start, low, high = at, total[at], total[at + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = links[j]
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:], links[j:]
        found.append([start, at + 1, low, high])
        links.append(j)
    return [(int(a), int(b), float(high - low)) for a, b, low, high in found]


@dataclass
class Model:
    scores: dict[str, float]
    rate: float  # lambda of the extreme-value law
    scale: float  # K of the law
    weights: np.ndarray  # of the logistic curve: intercept, best segment, all segments


def segments_of(words: list[str], scores: dict[str, float]) -> list[tuple[int, int, float]]:
    get = scores.get
    values = np.array([get(w, -DRIFT) for w in words])
    return maximal_segments(values) if len(values) and values.max() > 0 else []


def law(counts: Counts) -> float:
    """The positive rate at which the mean of exp(rate * score) over ordinary tokens is one."""
    kept, total = counts.kept, counts.other + PRIOR * (counts.toxic + counts.other)
    if not len(kept) or kept["score"].max() <= 0:
        return 1.0
    own = (kept["other"] + PRIOR * (kept["other"] + kept["toxic"])).to_numpy(float) / total
    share = np.append(own, max(0.0, 1 - own.sum()))  # all other tokens lose the drift
    values = np.append(kept["score"].to_numpy(float), -DRIFT)
    low, high = 0.0, 1.0
    while (share * np.exp(np.minimum(high * values, 500))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(np.minimum(middle * values, 500))).sum() < 1 else (low, middle)
    return high


def evidence(found: list[tuple[int, int, float]], n: int, rate: float, scale: float) -> tuple[float, float]:
    """Evidence, in units of -log(expected number by chance), of the best segment and of all that have any."""
    if not found:
        return 0.0, 0.0
    own = rate * np.array([s for _, _, s in found]) - np.log(scale * n)
    return float(max(own.max(), 0)), float(own[own > 0].sum())


def features(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(x[:, 1])])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    w, ridge = np.zeros(x.shape[1]), 1e-3 * weight.sum() * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ w
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fits the model on a bounded sample of labelled rows outside the held-out fold.

    Labels above zero count as one, null labels and ids are left out, an id with several labels counts by their
    mean. Equal texts count once per label, so groups of copies do not make their words look toxic.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.where(~held_out("doc_id", 5, 0) if learn is None else learn)
    marked = known.groupBy("doc_id").agg((F.avg((F.col(label) > 0).cast("int")) >= 0.5).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    chosen = docs.select("doc_id", "text").join(small(sampled(marked, "label", ["doc_id"], sample)), "doc_id")
    texts = chosen.select(whole_text("text").alias("text"), "label").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, 1 - y, y) for text, y in zip(batch["text"], batch["label"]) for w in set(words_of(text))]
            yield pd.DataFrame(rows, columns=["token", "other", "toxic"])

    counts = token_scores(stored(texts.mapInPandas(count, "token string, other long, toxic long").groupBy("token").agg(
        F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))))
    scores, rate = dict(zip(counts.kept["token"], counts.kept["score"].tolist())), law(counts)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, y in zip(batch["text"], batch["label"]):
                words = words_of(text)
                rows.append((y, max(len(words), 1), [s for _, _, s in segments_of(words, scores)]))
            yield pd.DataFrame(rows, columns=["label", "n", "found"])

    seen = texts.mapInPandas(scan, "label int, n long, found array<double>").toPandas()
    plain = seen[seen["label"] == 0]
    best = np.array([max(f, default=0.0) for f in plain["found"]])
    # the law's maximum-likelihood scale for its rate, from the best segments of ordinary documents
    scale = (len(plain) + 1) / (float((plain["n"].to_numpy() * np.exp(-rate * best)).sum()) + 1)
    x = np.array([evidence([(0, 0, s) for s in f], n, rate, scale) for f, n in zip(seen["found"], seen["n"])]).reshape(-1, 2)
    y = seen["label"].to_numpy(float)
    share = y.mean() if len(y) else 0.0
    prior = (ones + 1) / (ones + zeros + 2)
    if not 0 < share < 1:
        return Model({}, rate, scale, np.array([np.log(prior) - np.log1p(-prior), 0.0, 0.0]))
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    return Model(scores, rate, scale, logistic(features(x), y, weight))


RESULT = "struct<score: double, passages: array<struct<start: int, end: int, score: double, by_chance: double>>>"


def scored(text: Column, model: Model) -> Column:
    """Probability of a toxic text (null: empty) and its significant passages with positions in characters."""

    @F.pandas_udf(RESULT)
    def read(texts: pd.Series) -> pd.DataFrame:
        x, passages = [], []
        for text in texts:
            words = words_of(text)
            found = segments_of(words, model.scores)
            x.append(evidence(found, len(words), model.rate, model.scale))
            own = []
            if found:
                places = [m.span() for m in WORDS.finditer(text)]
                for a, b, s in found:
                    chance = model.scale * len(words) * np.exp(-model.rate * s)
                    if chance <= CHANCE:
                        own.append({"start": places[a][0], "end": places[b - 1][1], "score": s, "by_chance": float(chance)})
            passages.append(own)
        logit = features(np.array(x, float).reshape(-1, 2)) @ model.weights
        return pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(logit, -500, 500))), "passages": passages})

    return read(whole_text(text))


def document_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages) of every row. Repeated rows stay; an empty text has no evidence."""
    model = train(docs, labels)
    found = docs.select("doc_id", "text").withColumn("found", scored(F.col("text"), model))
    return found.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("found.score").alias("score"),
        (F.col("found.score") >= threshold).cast("int").alias("predicted"), F.size("found.passages").alias("n_passages"))
