import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from edgetide.llm import bpe
from tests.llm.tables import awkward, empty, rows


@pytest.fixture(scope="module")
def reference():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    ranges = [(32, 127), (32, 127), (9, 14), (0x80, 0x250), (0x370, 0x600), (0x900, 0xA00), (0x2000, 0x2070), (0x3040, 0x3100), (0x4E00, 0x4F00), (0x1F600, 0x1F650), (0x300, 0x330)]
    out = ["", "<|endoftext|> don't  we'll\n\n 12345 \x1c\x85\xa0 ", "a" * 5000, "\x00\x01", " " * 300 + "x"]
    for _ in range(300):
        out.append("".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randint(1, 60))))
    return out


def test_equals_public_library(reference):
    coder = bpe.Codec(bpe.default_vocabulary())
    for text in texts():
        ids = coder.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text), repr(text)
        assert coder.decode(ids) == text.encode()


def test_offsets_and_split_characters():
    coder = bpe.Codec(bpe.default_vocabulary())
    text = "a\U0001F600é word"
    ids = coder.encode(text)
    places = coder.offsets(text, ids)
    for number, (start, end) in zip(ids.tolist(), places.tolist()):
        part = coder.token_bytes[number]
        assert part in text[start:end].encode() and end > start
    assert places[0][0] == 0 and places[-1][1] == len(text)
    for n in range(len(ids)):  # cut anywhere: bytes, not characters, are what comes back
        assert coder.decode(ids[:n]) + coder.decode(ids[n:]) == text.encode()
    assert coder.offsets("", ids[:0]).shape == (0, 2)


def test_documents(spark, reference):
    docs = awkward(spark, texts()[:40])
    got = rows(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    expected = []
    for r in docs.collect():
        text = r["text"] or ""
        ids = reference.encode_ordinary(text)
        expected.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(expected, key=repr)


def test_spans_empty_and_extra(spark):
    assert bpe.round_trip(empty(spark)).count() == 0
    docs = awkward(spark, extra=True)
    coded = bpe.encode_documents(docs)
    assert set(coded.columns) == set(docs.columns) | {"n_tokens"} and coded.count() == docs.count()
    spans = coded.where("doc_id = 8").select("text", bpe.token_spans(coded["text"], coded["ids"]).alias("s")).first()
    assert spans["s"][-1]["end"] == len(spans["text"])
