"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters over bytes run over the whole document; their responses are max-pooled over overlapping chunks of 512
bytes, a small layer reads each chunk, and mean and maximum over all chunks give one probability. The filters
step by four bytes and see eight, so neighbouring windows and chunks overlap everywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import held_out, sampled, small, whole_text

STRIDE, WIDTH = 4, 8
BLOCK = 256  # a chunk is two neighbouring blocks, and chunks overlap by one
PER_BLOCK = BLOCK // STRIDE
PAD = 256
EMBED, FILTERS, HIDDEN = 6, 32, 16
SAMPLE = 1500  # labelled documents of each class, about, that the network is fitted on
CHUNKS = 6  # chunks, at most, taken from each of them while fitting; predictions read all chunks
EPOCHS, BATCH, RATE = 10, 64, 0.004
TOGETHER = 1 << 20  # bytes that are convolved in one go


@dataclass
class Network:
    embed: np.ndarray  # 257 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    layer: np.ndarray  # FILTERS x HIDDEN
    layer_bias: np.ndarray
    out: np.ndarray  # 2 * HIDDEN
    out_bias: np.ndarray  # one number

    def parts(self) -> dict[str, np.ndarray]:
        return vars(self)


def untrained(seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return Network(
        normal(257, EMBED, scale=0.5), normal(WIDTH * EMBED, FILTERS, scale=0.2), np.zeros(FILTERS, np.float32),
        normal(FILTERS, HIDDEN, scale=0.2), np.zeros(HIDDEN, np.float32), normal(2 * HIDDEN, scale=0.2), np.zeros(1, np.float32))


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of byte numbers, each in whole blocks, and the number of blocks of each.

    Padding follows every text, so no window that starts in a text reaches the next one.
    """
    counts = np.array([-(-(len(t) + STRIDE) // BLOCK) for t in texts])
    points = np.full(counts.sum() * BLOCK, PAD, np.int16)
    at = 0
    for text, n in zip(texts, counts):
        points[at:at + len(text)] = np.frombuffer(text, np.uint8)
        at += n * BLOCK
    return points, counts


def pooled(net: Network, points: np.ndarray) -> np.ndarray:
    """Largest response of each filter over the windows that start in a block; zero where none is positive."""
    half = STRIDE * EMBED
    both = np.hstack([net.filters[:half], net.filters[half:]])
    blank = (np.tile(net.embed[PAD], STRIDE) @ both[:, FILTERS:])[None]
    starts = points.reshape(-1, PER_BLOCK, STRIDE)[:, :, 0] != PAD
    response = net.embed[points].reshape(-1, half) @ both
    second = np.vstack([response[1:, FILTERS:], blank]).reshape(-1, PER_BLOCK, FILTERS)
    first = response[:, :FILTERS].reshape(-1, PER_BLOCK, FILTERS) + second
    first[~starts] = -np.inf
    return np.maximum(first.max(axis=1) + net.bias, 0)


def chunked(blocks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk features (maximum of two neighbouring blocks of one document) and the first chunk of each document."""
    ends = np.cumsum(counts)
    chunks = np.maximum(blocks, np.vstack([blocks[1:], blocks[-1:]]))
    chunks[ends - 1] = blocks[ends - 1]
    keep = np.ones(len(blocks), bool)
    keep[(ends - 1)[counts > 1]] = False  # a last block alone is part of the chunk before
    sizes = np.maximum(counts - 1, 1)
    return chunks[keep], np.r_[0, np.cumsum(sizes)[:-1]]


def logits(net: Network, texts: list[bytes]) -> np.ndarray:
    points, counts = padded(texts)
    blocks = np.vstack([
        pooled(net, points[at:at + TOGETHER + BLOCK])[:TOGETHER // BLOCK] for at in range(0, len(points), TOGETHER)])
    chunks, starts = chunked(blocks, counts)
    hidden = np.maximum(chunks @ net.layer + net.layer_bias, 0)
    sizes = np.diff(np.r_[starts, len(hidden)])
    mean = np.add.reduceat(hidden, starts) / sizes[:, None]
    return np.hstack([mean, np.maximum.reduceat(hidden, starts)]) @ net.out + net.out_bias[0]


def chunk_rows(text: bytes) -> list[bytes]:
    """Up to ``CHUNKS`` chunks of a text, drawn by its checksum, each with the bytes its last window looks at."""
    count = max(1, -(-(len(text) + STRIDE) // BLOCK) - 1)
    chosen = np.sort(np.random.default_rng(zlib.crc32(text)).permutation(count)[:CHUNKS])
    return [text[c * BLOCK:(c + 2) * BLOCK + STRIDE] for c in chosen]


@dataclass
class Examples:
    points: np.ndarray  # chunks x (2 * BLOCK + STRIDE)
    starts: np.ndarray  # first chunk of each document
    labels: np.ndarray

    def batch(self, chosen: np.ndarray) -> Examples:
        ends = np.r_[self.starts[1:], len(self.points)]
        sizes = ends[chosen] - self.starts[chosen]
        rows = np.concatenate([np.arange(a, b) for a, b in zip(self.starts[chosen], ends[chosen])])
        return Examples(self.points[rows], np.r_[0, np.cumsum(sizes)[:-1]], self.labels[chosen])


def gradients(net: Network, data: Examples) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy; the maxima pass gradients to the windows that won."""
    n, half = len(data.points), STRIDE * EMBED
    sizes = np.diff(np.r_[data.starts, n])
    document = np.repeat(np.arange(len(sizes)), sizes)
    both = np.hstack([net.filters[:half], net.filters[half:]])
    response = net.embed[data.points].reshape(n, -1, half) @ both
    window = response[:, :-1, :FILTERS] + response[:, 1:, FILTERS:]
    window[data.points[:, :-STRIDE:STRIDE] == PAD] = -1e9
    winner = window.argmax(axis=1)
    before = np.take_along_axis(window, winner[:, None], axis=1)[:, 0] + net.bias
    chunk = np.maximum(before, 0)
    hidden = np.maximum(chunk @ net.layer + net.layer_bias, 0)
    mean, top = np.add.reduceat(hidden, data.starts) / sizes[:, None], np.maximum.reduceat(hidden, data.starts)
    joined = np.hstack([mean, top])
    slope = (1 / (1 + np.exp(-np.clip(joined @ net.out + net.out_bias[0], -30, 30))) - data.labels) / len(sizes)
    back = slope[:, None] * net.out
    at_hidden = (back[:, :HIDDEN] / sizes[:, None])[document] + (hidden == top[document]) * back[:, HIDDEN:][document]
    at_hidden *= hidden > 0
    at_window = (at_hidden @ net.layer.T) * (before > 0)
    bytes_seen = np.take_along_axis(
        data.points, (winner[:, :, None] * STRIDE + np.arange(WIDTH)).reshape(n, -1), axis=1).reshape(n, FILTERS, WIDTH)
    seen = net.embed[bytes_seen].reshape(n, FILTERS, WIDTH * EMBED)
    at_bytes = (at_window[:, :, None] * net.filters.T).reshape(-1, EMBED)
    embed = np.stack([np.bincount(bytes_seen.ravel(), weights=w, minlength=257) for w in at_bytes.T], axis=1)
    return {
        "embed": embed, "filters": np.einsum("nf,nfe->ef", at_window, seen, optimize=True), "bias": at_window.sum(axis=0),
        "layer": chunk.T @ at_hidden, "layer_bias": at_hidden.sum(axis=0), "out": joined.T @ slope, "out_bias": slope.sum(keepdims=True)}


def fitted(data: Examples, prior: float, seed: int = 5) -> Network:
    """A network fitted by Adam; ``prior`` is the share of label 1 among all labelled rows."""
    net, odds = untrained(seed), float(np.log(prior) - np.log1p(-prior))
    share = data.labels.mean() if len(data.labels) else 0.0
    if not 0 < share < 1:  # nothing to tell apart: every text gets the prior
        net.out[:], net.out_bias[:] = 0, odds
        return net
    rng, parts = np.random.default_rng(seed), net.parts()
    first, second = ({k: np.zeros_like(v) for k, v in parts.items()} for _ in range(2))
    step, total = 0, EPOCHS * -(-len(data.labels) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(data.labels))
        for at in range(0, len(order), BATCH):
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for name, g in gradients(net, data.batch(np.sort(order[at:at + BATCH]))).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                move = first[name] / (1 - 0.9 ** step) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
                parts[name] -= (rate * move).astype(np.float32)
    net.out_bias += odds - float(np.log(share) - np.log1p(-share))  # classes were drawn evenly
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, sample: int = SAMPLE) -> Network:
    """Fits a network on a bounded sample of labelled rows outside the held-out fold.

    Labels above zero count as one, null labels and ids are left out, and an id with several labels counts by their mean.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.where(~held_out("doc_id", 5, 0) if learn is None else learn)
    marked = known.groupBy("doc_id").agg((F.avg((F.col(label) > 0).cast("int")) >= 0.5).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    texts = docs.select("doc_id", "text").join(small(sampled(marked, "label", ["doc_id"], sample)), "doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc_id, zlib.crc32(data), label, n, chunk)
                for doc_id, text, label in zip(batch["doc_id"], batch["text"], batch["label"])
                for data in [(text or "").encode()] for n, chunk in enumerate(chunk_rows(data))]
            yield pd.DataFrame(rows, columns=["doc_id", "text_crc", "label", "n", "chunk"])

    found = texts.select("doc_id", "text", "label").mapInPandas(cut, "doc_id long, text_crc long, label int, n int, chunk binary").toPandas()
    found = found.sort_values(["doc_id", "text_crc", "n"], kind="stable", ignore_index=True)
    points = np.full((len(found), 2 * BLOCK + STRIDE), PAD, np.int16)
    for row, chunk in zip(points, found["chunk"]):
        row[:len(chunk)] = np.frombuffer(chunk, np.uint8)
    starts = np.flatnonzero(found["n"].to_numpy() == 0)
    data = Examples(points, starts, found["label"].to_numpy()[starts].astype(np.float32))
    return fitted(data, (ones + 1) / (ones + zeros + 2))


def score(text: Column, net: Network) -> Column:
    """Probability of label 1 for a whole text (null: empty)."""

    @F.pandas_udf("double")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found, group, size = [], [], 0
            for n, text in enumerate(batch):
                group.append(text.encode())
                size += len(group[-1])
                if size >= TOGETHER or n == len(batch) - 1:
                    found.append(logits(net, group))
                    group, size = [], 0
            values = np.concatenate(found) if found else np.zeros(0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(values, -500, 500).astype(float))))

    return read(whole_text(text))


def document_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Repeated rows stay; an empty text is scored like any other."""
    net = train(docs, labels)
    return docs.select("doc_id", "text").withColumn("score", score(F.col("text"), net)).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
