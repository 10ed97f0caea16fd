"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

The vocabulary is a file of a public byte-level BPE tokenizer. Its tokens are strings over an alphabet of 256
characters that stand for bytes. Encoding maps each pre-token's bytes to that alphabet and lets the library's BPE
model merge them; decoding reverses the alphabet to bytes, so a token may hold a part of a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import fresh, whole_text

CACHED = 100_000  # pre-tokens remembered per task
SHORT = 64  # longer pre-tokens are not remembered


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from 256 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet, spare = [chr(b) if b in printable else "" for b in range(256)], 256
    for byte in range(256):
        if not alphabet[byte]:
            alphabet[byte], spare = chr(spare), spare + 1
    return alphabet


class Codec:
    """Encoder and decoder of one vocabulary file; built once per task."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        alphabet = byte_alphabet()
        self.to_alphabet = dict(enumerate(alphabet))
        to_byte = {c: b for b, c in enumerate(alphabet)}
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, number in vocabulary.items():
            if all(c in to_byte for c in token):
                self.token_bytes[number] = bytes(to_byte[c] for c in token)
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: str) -> list[int]:
        ids = [t.id for t in self.model.tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(self.to_alphabet))]
        if len(piece) <= SHORT:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        known, merge, out = self.known.get, self.merge, []
        for piece in self.split(text):
            ids = known(piece)
            out.extend(merge(piece) if ids is None else ids)
        return np.array(out, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``; an id outside the vocabulary is an error."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Start and end of each token in characters; the parts of a split character all span that character."""
        data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80)  # number of the character a byte belongs to, from 1
        ends = np.cumsum([len(self.token_bytes[i]) for i in ids.tolist()], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return np.stack([character[starts] - 1, character[ends - 1]], axis=1).astype("<u4") if len(ends) else np.zeros((0, 2), "<u4")


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(text: Column, path: str | None = None) -> Column:
    """The ids of a text (null: empty) as little-endian unsigned 32-bit integers in one binary value."""
    name = path or default_vocabulary()

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Codec(name)
        for batch in batches:
            yield pd.Series([encoder.encode(t).tobytes() for t in batch], dtype=object)

    return encode(whole_text(text))


def decoded(ids: Column, path: str | None = None) -> Column:
    """The bytes that a binary value of ids stands for. They need not be whole characters when ids were cut."""
    name = path or default_vocabulary()

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Codec(name)
        for batch in batches:
            yield pd.Series([decoder.decode(np.frombuffer(b, "<u4")) for b in batch], dtype=object)

    return decode(F.coalesce(ids, F.lit(b"")))


def token_spans(text: Column, ids: Column, path: str | None = None) -> Column:
    """Array of structs (id, start, end), positions in characters of the text."""
    name = path or default_vocabulary()

    @F.pandas_udf("array<struct<id: int, start: int, end: int>>")
    def spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        coder = Codec(name)
        for texts, packed in batches:
            rows = []
            for t, b in zip(texts, packed):
                numbers = np.frombuffer(b, "<u4")
                places = coder.offsets(t, numbers)
                rows.append([{"id": int(i), "start": int(s), "end": int(e)} for i, (s, e) in zip(numbers, places)])
            yield pd.Series(rows, dtype=object)

    return spans(whole_text(text), F.coalesce(ids, F.lit(b"")))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (binary) and ``n_tokens``; earlier columns of these names are replaced.

    Every whole text is encoded; an empty or null one has no tokens. Rows are independent of each other.
    """
    kept = docs.drop("ids", "n_tokens")
    return kept.withColumn("ids", encoded(F.col("text"), path)).withColumn(
        "n_tokens", (F.octet_length("ids") / 4).cast("long"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of tokens, digest of the ids and digest of the bytes decoded from them."""
    coded = encode_documents(docs.select("doc_id", "text"), path)
    data = fresh(coded.columns, "data")
    return coded.withColumn(data, decoded(F.col("ids"), path)).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(data, 256).alias("decoded_sha256"))
