"""Archives read back through their index, and by a plain reader beside it."""

import gzip
import hashlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphweave.llm import warc

SCHEMA = "page_id long, url string, html string, file string, key string, digest string"
LONG = "<p>copy é</p>" * 120
URL = "https://www.example.com/a"


def pages():
    rows = [(i, f"http://h{i % 7}.example.org/{i}?q=1", f"<p>page {i}</p>" * (i * 3)) for i in range(60)]
    rows += [(100 + i, f"http://mirror{i}.example.net/", LONG) for i in range(25)] + [(200 + i, URL, f"version {i}") for i in range(50)]
    # Nulls, empty and very long pages, small copies, repeated rows, an id with two pages, odd URLs, text that looks like records.
    rows += [(300, None, "no url"), (301, "no url at all", ""), (302, URL, None), (303, "", "x"), (304, "HTTP://User:pw@WWW.Example.COM:8080", "y" * 1_000_000), (305, "http://e.org/a b\nc\r\nX: y", "é\r\n\r\nWARC/1.1\r\n\r\n")]
    rows += [(306, URL, "short"), (307, URL, "short"), (308, "http://é.example/ü%20", "short"), (309, URL, "twice"), (309, URL, "twice"), (310, URL, "one"), (310, URL, "other"), (None, URL, LONG), (124, "http://again.example/", LONG)]
    rows += [(None, "http://null.example/", "n" * 1000), (None, "http://null.example/", "n" * 1000), (400, URL, "b" * 999), (401, URL, "b" * 999), (402, URL, "b" * 1000), (403, URL, "b" * 1000)]
    return rows


def brute(rows):
    body = [(i, (h or "").encode()) for i, _, h in rows]
    ids = {}
    for i, b in body:
        if len(b) >= 1000 and i is not None:
            ids[b] = max(i, ids.get(b, i))
    refers = [ids[b] if len(b) >= 1000 and b in ids and ids[b] != i else None for i, b in body]
    return Counter((i, len(b), hashlib.sha1(b).hexdigest(), "response" if r is None else "revisit", r) for (i, b), r in zip(body, refers))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", "k", "d") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    return warc.write_archive(frame(spark, pages()), str(tmp_path_factory.mktemp("archive")), block_lines=7)


def test_facts_equal_brute_force(spark, archive):
    got = warc.facts(archive, frame(spark, pages())).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == brute(pages())


def test_files_are_plain_warc(archive):
    """Every file, read from end to end without the index, is a run of records whose lengths add up."""
    kinds, payloads = Counter(), Counter()
    for f in Path(archive.root, "warc").iterdir():
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            block, end, data = data[:n], data[n : n + 4], data[n + 4 :]
            assert end == b"\r\n\r\n"
            kinds[fields["WARC-Type"]] += 1
            if fields["WARC-Type"] == "response":
                payloads[block.split(b"\r\n\r\n", 1)[1]] += 1
    want = brute(pages())
    assert kinds["revisit"] == sum(n for r, n in want.items() if r[3] == "revisit") and kinds["response"] == sum(n for r, n in want.items() if r[3] == "response")
    assert payloads[("y" * 1_000_000).encode()] == 1 and payloads[b""] == 3 and payloads[LONG.encode()] == 2


def test_lookup_of_some_urls(spark, archive):
    """One key over many blocks and files, one capture, keys that are not there, before all and after all."""
    asked = [URL, URL, "http://h3.example.org/3?q=1", "http://nobody.example/", "http://0.0/", "~~~", None]
    got = Counter(r["page_id"] for r in warc.captures(archive, spark.createDataFrame([(u,) for u in asked], "url string")).collect())
    want = Counter(i for i, u, _ in pages() if u == URL) + Counter([3]) + Counter(i for i, u, _ in pages() if u is None or u == "")
    assert got == want
    texts = {r["page_id"]: r["payload"] for r in warc.captures(archive, spark.createDataFrame([(URL,)], "url string")).collect() if r["page_id"] in (200, 249)}
    assert texts == {200: b"version 0", 249: b"version 49"}


def test_a_lookup_reads_few_blocks(archive, monkeypatch):
    """The directory alone tells which blocks can hold a key."""
    read = []
    own = warc._IndexFile.read
    monkeypatch.setattr(warc._IndexFile, "read", lambda self, block: (read.append(block), own(self, block)))
    system, folder = warc._files(archive.root)
    name, size, first, _ = max(archive.parts, key=lambda p: p[1])
    index = warc._IndexFile(system, f"{folder}/{name}", size)
    assert len(index.directory) > 2
    found = [e for rows in index.find(first.encode()) for e in rows]
    assert found and len(read) <= 1 + -(-len(found) // 7)


def test_keys(spark):
    urls = ["https://www.Example.com:443/A?b=C#d", "http://u:p@a.b.c", "mailto:x", "", None, "http://h/ \t\n"]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(warc.url_key(F.col("u"))).collect()]
    assert got == ["com,example,www)/A?b=C#d", "c,b,a)", "mailto:x", "", "", "h)/%20%20%20"]


def test_archive_of_nothing(spark):
    none = frame(spark, pages()).where("false")
    archive = warc.write_archive(none)
    assert archive.parts == [] and warc.facts(archive, none).count() == 0 and warc.captures(archive, frame(spark, pages())).count() == 0
