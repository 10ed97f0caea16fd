import base64
import gzip
import hashlib
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from edgetide.llm import warc
from tests.llm.tables import rows

PAGES = "page_id long, url string, html string, record string, at long, _part int"
NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pages(spark, extra=()):
    base = [
        (1, "http://a.org/x", "<p>one</p>"), (2, "http://www.a.org/x#f", "<p>one</p>"), (3, "https://b.a.org:8080/y?q=1", "<p>one</p>"), (4, None, None), (5, "", ""),
        (6, "http://c.org/\r\nWARC-Type: evil", "WARC/1.1\r\nWARC-Type: response\r\n\r\nx"), (7, "not a url", "\r\n\r\n"), (8, "http://[broken", "\r\n"),
        (9, "http://c.org", "a\rb\nc\r\nd\r\n"), (10, "http://d.org/ü", "äöü \U0001F600" * 30000), (None, "http://e.org", "<p>none</p>"), (None, "http://f.org", "<p>none</p>"),
        (11, "http://g.org", "twice"), (11, "http://g.org", "twice"), (12, "http://g.org", "x" * 5), (-5, "http://g.org", "minus"), (1 << 62, "http://g.org", "minus"),
    ]
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in [*base, *extra]], PAGES).repartition(5)


def brute(frame, least=0):
    data = [(r["page_id"], (r["html"] or "").encode()) for r in frame.collect()]
    out = []
    for body in {b for _, b in data}:
        ids = sorted((i for i, b in data if b == body), key=lambda i: (i is not None, i or 0))
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if len(body) < least:
            out += [(i, len(body), digest, "response", None) for i in ids]
        else:
            out += [(i, len(body), digest, "revisit", ids[-1]) for i in ids[:-1]] + [(ids[-1], len(body), digest, "response", None)]
    return sorted(out, key=repr)


def test_round_trip_against_brute_force(spark):
    frame = pages(spark)
    found = warc.archived_pages(frame)
    assert rows(found, *NAMES) == brute(frame) and found.where("not digest_ok").isEmpty()
    assert rows(warc.archived_pages(frame, 6), *NAMES) == brute(frame, 6)


def test_archives_are_plain_warc(spark, tmp_path):
    frame = pages(spark)
    warc.write_archives(frame, str(tmp_path / "archives"))
    captures = {(r["archive"], r["at"]): r for r in warc.read_archives(spark, str(tmp_path / "archives")).collect()}
    files = sorted((tmp_path / "archives").glob("part-*"))
    assert len(captures) == frame.count() and len(files) > 1
    for file in files:
        data, at = gzip.decompress(file.read_bytes()), 0
        while at < len(data):
            head, _, rest = data[at:].partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and rest[int(fields["Content-Length"]):].startswith(b"\r\n\r\n")
            length = len(head) + 4 + int(fields["Content-Length"]) + 4
            capture = captures.pop((file.name, at))
            assert (capture["length"], capture["record_type"], capture["record"]) == (length, fields["WARC-Type"], fields["WARC-Record-ID"])
            if fields["WARC-Type"] == "revisit":
                assert {"WARC-Refers-To", "WARC-Refers-To-Date", "WARC-Profile"} <= set(fields)
            at += length
    assert not captures


def test_damage_is_found(spark, tmp_path):
    warc.write_archives(pages(spark), str(tmp_path / "archives"))
    file = max((tmp_path / "archives").glob("part-*"), key=lambda f: f.stat().st_size)
    data = gzip.decompress(file.read_bytes())
    file.write_bytes(gzip.compress(data.replace("äöü".encode(), "aou  ü".encode()[:6], 1)))
    pathlib.Path(file.parent, f".{file.name}.crc").unlink(missing_ok=True)
    assert warc.read_archives(spark, str(file.parent)).where("not digest_ok").count() == 1
    file.write_bytes(gzip.compress(data[:-30]))
    with pytest.raises(Exception, match="ends inside|does not end"):
        warc.read_archives(spark, str(file.parent)).collect()


def test_index_is_in_global_order_and_splits_a_busy_url(spark, tmp_path):
    rng = random.Random(2)
    extra = [(100 + n, "http://busy.org/" if n % 3 else f"https://h{rng.randint(0, 50)}.org/{n}", f"body {n}") for n in range(900)]
    warc.write_archives(pages(spark, extra), str(tmp_path / "archives"))
    captures = warc.read_archives(spark, str(tmp_path / "archives"))
    index = warc.capture_index(captures, range_rows=60).orderBy("range", "place").collect()
    keys = [(r["url_key"], r["captured"], r["record"]) for r in index]
    assert keys == sorted(keys) and sorted(keys) == sorted(tuple(r) for r in captures.select(*warc.KEY).collect())
    assert len({r["range"] for r in index if r["url_key"] == "org,busy)/"}) > 3
    assert max(sum(r["range"] == n for r in index) for n in {r["range"] for r in index}) < 300


def test_loser_tree():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 5, 8, 13):
        for _ in range(20):
            runs = [sorted(rng.randint(0, 9) for _ in range(rng.choice([0, 1, 7]))) for _ in range(k)]
            merged = list(warc.LoserTree(runs))
            assert [runs[n][at] for n, at in merged] == sorted(x for r in runs for x in r)
            assert merged == sorted(merged, key=lambda p: (runs[p[0]][p[1]], *p))  # equal keys in the order of runs


def test_url_keys():
    pairs = {"http://www.a.org/x?b=1#f": "org,a)/x?b=1", "https://A.ORG:443": "org,a)/", "http://a.org:81/": "org,a:81)/", None: "", "": "", "plain": "plain", "http://[x": "http://[x"}
    assert {u: warc.url_key(u) for u in pairs} == pairs


def test_empty(spark):
    frame = pages(spark).limit(0)
    assert rows(warc.archived_pages(frame), *NAMES) == []
    assert rows(warc.archived_pages(pages(spark).where(F.col("page_id") == 1)), *NAMES) == brute(pages(spark).where("page_id = 1"))
