"""WARC archives of web pages with a two-level capture index: compressed blocks of sorted keys and a sparse directory of them."""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm.common import batches_of, discard, shared_folder, shuffle_partitions, slices, written

#: Payloads from this size on that equal another page's become revisits.
LEAST_REVISITED = 1000
#: Index lines of a compressed block, bytes of an archive file, and bytes that neighbouring records are read in at once.
BLOCK_LINES, FILE_BYTES, READ_BYTES = 3000, 1 << 30, 1 << 22
ENTRY = "key string, page_id long, file string, offset long, length int"
_RECORD = "page_id long, record_type string, url string, digest string, refers_to long, payload binary"
_END = b"\r\n\r\n"


def url_key(url: Column) -> Column:
    """Sort key of a URL: the host's labels in reverse, lower-cased and joined by commas, then ``)`` and the rest; scheme, user and port go. White space and controls become ``%20``; what is no URL keeps its text, null is empty."""
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?(?s:(.*))$"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, parts, 1)), r"\.")), ",")
    key = F.when(url.rlike(parts), F.concat(host, F.lit(")"), F.regexp_extract(url, parts, 2))).otherwise(url)
    return F.regexp_replace(F.coalesce(key, F.lit("")), r"[\x00-\x20]", "%20")


def decided(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest`` (hex SHA-1 of the UTF-8 payload) and ``refers_to``: of equal payloads of LEAST_REVISITED bytes and more the largest page_id is the response, which the others name.

    Only ids and digests are grouped; pages are shuffled once, by their id. Rows that share the largest id are responses all; a null id is no larger than any.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes"))
    large = rows.where(F.col("bytes") >= LEAST_REVISITED).select("page_id", "digest")
    largest = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")
    again = large.join(largest, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").hint("merge")
    same = rows["page_id"].eqNullSafe(again["_id"]) & (rows["digest"] == again["_digest"])
    return rows.join(again, same, "left").select("page_id", "url", "html", "digest", "refers_to")


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    """The page id in a record's name, None for none."""
    number = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return None if number in ("", "null") else int(number)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A compressed WARC record (one gzip member): a response with the payload, or a revisit of ``refers_to`` without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload)
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:x-page:{page_id}"
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _name(page_id), "WARC-Date": date, "WARC-Target-URI": target}
    head["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    if refers_to is not None:
        head |= {"WARC-Refers-To": _name(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        payload = b""
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(http) + len(_END) + len(payload))}
    lines = "".join(f"\r\n{k}: {v}" for k, v in head.items()).encode()
    return _member(b"".join([b"WARC/1.1", lines, _END, http, _END, payload, _END]))


def parse_record(data: bytes) -> dict:
    """A record's named fields, in lower case, with ``payload``; a revisit's payload is empty."""
    whole = zlib.decompress(data, 31)
    head, _, rest = whole.partition(_END)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[: int(fields["content-length"])]
    return fields | {"payload": block.partition(_END)[2]}


def _member(data: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _files(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder (a path or a URI that Arrow knows) and the path in it."""
    return arrow_fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))


@dataclass
class Archive:
    """An archive under ``root``: index files by key, each with its size and its first and last key."""

    spark: SparkSession
    root: str
    parts: list[tuple[str, int, str, str]]


def write_records(rows: DataFrame, root: str, date: str) -> DataFrame:
    """Write ``rows`` (as ``decided`` gives them) as WARC files under ``root``, where each task has files of its own; entries of the index (ENTRY).

    A task that runs again writes new files; only the entries of tasks that succeed are kept, so what lost tasks left is never read.
    """
    keyed = rows.select(url_key(F.col("url")).alias("key"), "page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _files(root)
        system.create_dir(f"{folder}/warc", recursive=True)
        out, name, at = None, "", 0
        for batch in slices(batches, 64):
            entries = []
            for key, page_id, url, html, digest, refers_to in zip(*[batch.column(c).cast(pa.binary()).to_pylist() if c == "html" else batch.column(c).to_pylist() for c in ("key", "page_id", "url", "html", "digest", "refers_to")]):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"warc/{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    info = b"software: graphweave\r\nformat: WARC file version 1.1\r\n"
                    first = _member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d%s%s%s" % (name[5:37].encode(), date.encode(), len(info), _END, info, _END))
                    at = out.write(first)
                data = record(page_id, url, html or b"", digest, refers_to, date)
                out.write(data)
                entries.append({"key": key, "page_id": page_id, "file": name, "offset": at, "length": len(data)})
                at += len(data)
            yield pa.RecordBatch.from_pylist(entries, schema=_ENTRY)
        if out is not None:
            out.close()

    return keyed.mapInArrow(run, ENTRY)


_ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int32())])


def write_index(entries: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, int, str, str]]:
    """Sort ``entries`` by key over all tasks and write each range as one index file; returns file, size, first and last key of each, in order.

    A file holds gzip members of ``block_lines`` lines (key, tab, the rest as JSON) and ends with a directory, the first key, place and
    length of every block, and its length in 8 bytes. There are at most as many files as shuffle partitions, so the list returned has that bound.
    """
    ranged = entries.repartitionByRange(shuffle_partitions(entries.sparkSession), "key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _files(root)
        system.create_dir(f"{folder}/index", recursive=True)
        name, out, lines, directory, at, last = f"index/{uuid.uuid4().hex}.cdx", None, [], [], 0, ""

        def flush() -> None:
            nonlocal at, lines
            data = _member("".join(f"{k}\t{rest}\n" for k, rest in lines).encode())
            directory.append([lines[0][0], at, len(data)])
            at += out.write(data)
            lines = []

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                last = r["key"]
                lines.append((last, json.dumps([r["page_id"], r["file"], r["offset"], r["length"]])))
                if len(lines) >= block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            foot = _member(json.dumps(directory).encode())
            out.write(foot)
            out.write(len(foot).to_bytes(8, "big"))
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "size": pa.array([at + len(foot) + 8], pa.int64()), "first": [directory[0][0]], "last": [last]})

    files = written(ranged.mapInArrow(run, "file string, size long, first string, last string"), "index")
    return sorted(((r["file"], r["size"], r["first"], r["last"]) for r in files.collect()), key=lambda r: (r[2].encode(), r[3].encode()))


def write_archive(pages: DataFrame, root: str | None = None, date: str = "1970-01-01T00:00:00Z", block_lines: int = BLOCK_LINES) -> Archive:
    """Archive ``pages`` (``page_id, url, html``) under ``root`` (a new place in the shared folder by default): a record per row, and the index of all.

    Null html is an empty payload, a null url a target named by the page. Repeated rows are records each. No rows make an archive without files. Other columns are ignored.
    """
    spark = pages.sparkSession
    root = root or f"{shared_folder(spark)}/graphweave-archive-{uuid.uuid4().hex}"
    with batches_of(spark, 256):
        entries = written(write_records(decided(pages), root, date), "entries")
    archive = Archive(spark, root, write_index(entries, root, block_lines))
    discard(entries)
    return archive


class _IndexFile:
    """One index file: its directory, read once, and the block read last."""

    def __init__(self, system: arrow_fs.FileSystem, path: str, size: int) -> None:
        self.file = system.open_input_file(path)
        foot = int.from_bytes(self.file.read_at(8, size - 8), "big")
        self.directory = json.loads(zlib.decompress(self.file.read_at(foot, size - 8 - foot), 31))
        self.firsts = [first.encode() for first, _, _ in self.directory]
        self.block, self.keys, self.rests = -1, [], []

    def read(self, block: int) -> None:
        if block != self.block:
            _, at, length = self.directory[block]
            lines = zlib.decompress(self.file.read_at(length, at), 31).split(b"\n")[:-1]
            self.keys, self.rests = zip(*[line.split(b"\t", 1) for line in lines])
            self.block = block

    def find(self, key: bytes) -> Iterator[list]:
        """Blocks that can hold ``key`` by binary search of the directory, lines with it by binary search of each."""
        for block in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            self.read(block)
            found = self.rests[bisect_left(self.keys, key) : bisect_right(self.keys, key)]
            if found:
                yield [json.loads(r) for r in found]


def lookup(archive: Archive, keys: DataFrame) -> DataFrame:
    """Entries (ENTRY) of the captures of each distinct ``key``. A key goes to the index files whose range holds it, and requests are sorted, so a task reads each block once."""
    parts, root = archive.parts, archive.root
    firsts, lasts = [p[2].encode() for p in parts], [p[3].encode() for p in parts]

    @F.pandas_udf("array<int>")
    def places(keys):
        return keys.map(lambda k: list(range(bisect_left(lasts, k.encode()), bisect_right(firsts, k.encode()))))

    asked = keys.select("key").where("key IS NOT NULL").distinct().select("key", F.explode(places("key")).alias("part"))
    asked = asked.repartitionByRange(shuffle_partitions(archive.spark), "part", "key").sortWithinPartitions("part", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _files(root)
        held, index = -1, None
        for batch in batches:
            for key, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist()):
                if part != held:
                    held, index = part, _IndexFile(system, f"{folder}/{parts[part][0]}", parts[part][1])
                for rows in index.find(key.encode()):
                    yield pa.RecordBatch.from_pylist([{"key": key, "page_id": i, "file": f, "offset": o, "length": n} for i, f, o, n in rows], schema=_ENTRY)

    return asked.mapInArrow(run, ENTRY)


def read_records(archive: Archive, entries: DataFrame) -> DataFrame:
    """``page_id, record_type, url, digest`` (hex, as the record states it) ``, refers_to, payload`` of the records at ``entries``. Records that lie together are read in ranges of up to READ_BYTES."""
    root = archive.root
    placed = entries.select("file", "offset", "length").repartitionByRange(shuffle_partitions(archive.spark), "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _files(root)
        name, file = None, None
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def read(spans: list[tuple[int, int]]) -> pa.RecordBatch:
            start, end = spans[0][0], spans[-1][0] + spans[-1][1]
            data, rows = file.read_at(end - start, start), []
            for at, length in spans:
                r = parse_record(data[at - start : at - start + length])
                digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                rows.append({"page_id": _id(r["warc-record-id"]), "record_type": r["warc-type"], "url": r["warc-target-uri"], "digest": digest, "refers_to": _id(r.get("warc-refers-to")), "payload": r["payload"]})
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        spans: list[tuple[int, int]] = []
        for batch in batches:
            for of, at, length in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")]):
                together = spans and of == name and at == spans[-1][0] + spans[-1][1] and at + length - spans[0][0] <= READ_BYTES
                if spans and not together:
                    yield read(spans)
                    spans = []
                if of != name:
                    name, file = of, system.open_input_file(f"{folder}/{of}")
                spans.append((at, length))
        if spans:
            yield read(spans)

    return placed.mapInArrow(run, _RECORD)


def captures(archive: Archive, urls: DataFrame) -> DataFrame:
    """The records of each ``url`` in the archive (see ``read_records``), found through the index."""
    return read_records(archive, lookup(archive, urls.select(url_key(F.col("url")).alias("key"))))


def facts(archive: Archive, urls: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records of ``urls`` as the archive holds them; a revisit's size is that of the response it names, which must be among them."""
    read = captures(archive, urls)
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("digest"))
    rows = written(read.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to"), "records")
    first = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").where("refers_to IS NOT NULL").distinct()
    again = rows.where("record_type = 'revisit'").drop("payload_bytes").join(first, ["refers_to", "payload_digest"], "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.where("record_type = 'response'").select(*names).unionByName(again.select(*names))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return facts(write_archive(pages), pages)


#: The same rows in DuckDB, without an archive.
SQL = """
WITH held AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
largest AS (SELECT payload_digest, max(page_id) AS largest FROM held WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT h.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, h.payload_digest,
  CASE WHEN l.largest IS NULL OR l.largest = h.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN l.largest <> h.page_id THEN l.largest END AS refers_to
FROM held h LEFT JOIN largest l ON h.payload_digest = l.payload_digest AND h.payload_bytes >= 1000
"""
