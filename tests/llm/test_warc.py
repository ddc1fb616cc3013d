"""Archives: exact round trip, duplicates, merge order."""

import gzip
import random

import pytest
from texts import sha

from revlens.llm import warc

LONG = "é" * 80
PAGES = [
    (7, "http://b.example/x", LONG),
    (3, "https://WWW.b.example:443/X#frag", LONG),
    (3, "https://b.example/x", LONG),
    (9, None, LONG),
    (1, "http://a.example", "short"),
    (2, "http://a.example", "short"),
    (4, "http://a.example/", None),
    (5, "http://a.example/\r\nX: y", "a\r\n\r\nWARC/1.1\r\n" * 20),
    (6, "", "\x00" * 120),
    (None, "http://c.example", LONG),
    (8, "http://a.example:8080/q?A=1", "z" * 200_000),
]


def frame(spark, pages):
    return spark.createDataFrame([(*p, "d", 1) for p in pages], "page_id long, url string, html string, digest string, HTML int").repartition(3)


def expected(pages):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        h = h or ""
        again = len(h.encode()) >= 100 and i is not None and first[h] < i
        out.append((i, len(h.encode()), sha(h), "revisit" if again else "response", first[h] if again else None))
    return out


def test_round_trip(spark):
    got = [tuple(r) for r in warc.digest(frame(spark, PAGES)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted(expected(PAGES), key=str)


def test_files_and_order(spark, tmp_path):
    warc.write_archive(frame(spark, PAGES), str(tmp_path / "a"), records_per_file=2)
    files = sorted((tmp_path / "a").glob("*.gz"))
    assert len(files) >= 5
    texts = [gzip.decompress(f.read_bytes()) for f in files]
    assert all(t.startswith(b"WARC/1.1\r\n") and t.endswith(b"\r\n\r\n") for t in texts if t)
    index = warc.build_index(spark, str(tmp_path / "a"), str(tmp_path / "runs")).collect()
    order = [(r.urlkey, r.ts or "", r.page_id is not None, r.page_id or 0) for r in index]
    assert order == sorted(order) and len(index) == len(PAGES)
    by_name = {f.name: t for f, t in zip(files, texts)}
    for r in index:  # offset and length point at the record
        record = by_name[r.file.rsplit("/", 1)[1]][r.offset : r.offset + r.length]
        assert record.startswith(b"WARC/1.1") and f"sha256:{r.payload_digest}".encode() in record


@pytest.mark.parametrize("k", range(10))
def test_merge(k):
    rng = random.Random(k)
    row = lambda: (rng.choice("abc"), rng.choice(["1", "2", None]), rng.choice([None, 1, 2, 3]))
    runs = [sorted((row() for _ in range(rng.choice([0, 1, 9]))), key=warc._order) for _ in range(k)]
    assert [warc._order(r) for r in warc.merge(runs)] == sorted(warc._order(r) for run in runs for r in run)


def test_members_and_damage():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nWARC-Payload-Digest: sha256:" + sha("hi").encode() + b"\r\nContent-Length: 8\r\n\r\nH: 1\r\n\r\n"[:-4] + b"\r\n\r\nhi\r\n\r\n"
    record = record.replace(b"Content-Length: 8", b"Content-Length: %d" % len(b"H: 1\r\n\r\nhi"))
    many = gzip.compress(record) + gzip.compress(record * 3)
    assert [c[2] for c in warc.captures_in(many, "f")] == [5] * 4
    for bad in (gzip.compress(record[:-6]), gzip.compress(record.replace(b"\r\n\r\nhi", b"\r\n\r\nho"))):
        with pytest.raises(ValueError):
            list(warc.captures_in(bad, "f"))


def test_url_keys():
    assert warc.url_key("HTTP://user@www.Example.COM:80/A?b#c") == "com,example)/a?b"
    assert warc.url_key("https://example.com:8443") == "com,example:8443)/" and warc.url_key(None) == "" == warc.url_key("")


def test_empty(spark):
    assert warc.digest(frame(spark, [])).collect() == []
