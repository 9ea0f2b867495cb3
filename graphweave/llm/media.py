"""Media columns: interleaved text and media sequences of HTML documents, with payloads joined by digest."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import small_batches, written

WIDTH = 64
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_SPACE = re.compile(r"\s+")
_BLOCKS = set("p div section article li ul ol h1 h2 h3 h4 h5 h6 tr td th table blockquote figure figcaption br hr".split())
_MEDIA = {"img", "audio", "video", "source", "embed"}


class _Reader(HTMLParser):
    """Collects (kind, text, ref, caption) in page order; a figure's caption goes to the media in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[list] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] | None = None
        self.skip = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.words)).strip()
        self.words = []
        if text:
            self.out.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        if tag in _BLOCKS or tag in _MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA and (ref := dict(attrs).get("src")):
            if self.figure is not None:
                self.figure.append(len(self.out))
            self.out.append(["media", None, ref, dict(attrs).get("alt") or None])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag in _BLOCKS:
            self.flush()
        if tag == "figcaption" and self.caption is not None:
            text = _SPACE.sub(" ", "".join(self.caption)).strip()
            for i in self.figure or []:
                self.out[i][3] = text or self.out[i][3]
            self.caption = None
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        (self.words if self.caption is None else self.caption).append(data)


def read_sequence(page: str | None) -> list[tuple]:
    """Ordered (position, kind, text, ref, caption) of one page; media keep the caption of their figure, else their alt text."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return [(i, *row) for i, row in enumerate(reader.out)]


def parse(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Add ``sequence`` to the rows of ``pages``: structs of position, kind (``text`` or ``media``), text, ref and caption.

    Null or empty html gives an empty sequence. All columns and rows stay; one named ``sequence`` is replaced.
    """

    @F.pandas_udf(SEQUENCE)
    def sequence(page: pd.Series) -> pd.Series:
        keys = ("position", "kind", "text", "ref", "caption")
        return pd.Series([[dict(zip(keys, row)) for row in read_sequence(p)] for p in page])

    return pages.withColumn("sequence", sequence(html_column))


def resolve(sequences: DataFrame, key: str, store: DataFrame, payload_columns: list[str]) -> DataFrame:
    """Join the media references of ``sequences`` with ``store`` by ``digest``.

    Returns ``key, position, caption, digest`` and the payload columns, one row per media reference in page order of ``position``;
    a reference without a payload keeps its row with nulls, so positions and captions stay aligned. The store may
    hold a digest more than once; one row of it counts. Only references and the named columns are shuffled, never texts.
    """
    refs = sequences.select(key, F.explode(F.filter("sequence", lambda e: e["kind"] == "media")).alias("e"))
    refs = refs.select(key, "e.position", "e.caption", F.regexp_extract("e.ref", r"^(?:sha256:)?([0-9a-f]{64})$", 1).alias("digest"))
    once = store.groupBy("digest").agg(*[F.any_value(c).alias(c) for c in payload_columns])
    return refs.join(once, "digest", "left")


def to_image(payload: Column) -> Column:
    """Bytes, a multiple of WIDTH, as a grey image (binary PGM, 8 bits a sample)."""
    rows = (F.octet_length(payload) / WIDTH).cast("long").cast("string")
    return F.concat(F.encode(F.concat(F.lit(f"P5\n{WIDTH} "), rows, F.lit("\n255\n")), "US-ASCII"), payload)


def from_image(media: bytes) -> bytes:
    """The samples of a PGM image."""
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", media)
    if m is None:
        raise ValueError("not an 8-bit PGM image")
    body = media[m.end() :]
    if len(body) != int(m[1]) * int(m[2]):
        raise ValueError("PGM samples are missing")
    return body


def image_features(media: DataFrame) -> DataFrame:
    """Read stored images (``digest, media``) back: ``digest``, sizes and digests of payload and stored form, ``feature``.

    The feature names the height, the mean and deviation of the samples, the share of sample 0 and a 64-bit sign pattern: column means above their mean.
    """
    import hashlib
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist()):
                body = from_image(stored)
                grid = np.frombuffer(body, np.uint8).reshape(-1, WIDTH)
                columns = grid.sum(axis=0, dtype=np.int64)
                total, squares = int(columns.sum()), int((grid.astype(np.uint32) ** 2).sum(dtype=np.int64))
                n = grid.size
                mean = total / n
                sign = int(np.packbits(columns * WIDTH > total).view(">u8")[0])
                feature = f"h={len(grid)};mean={mean:.6f};dev={max(0.0, squares / n - mean * mean) ** 0.5:.6f};zero={int((grid == 0).sum()) / n:.6f};sign={sign:016x}"
                rows.append((digest, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])], names)

    return media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def text_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts as illustrated pages and as the payloads these refer to.

    The payload is the text's UTF-8 bytes (null: none) padded with bytes 0 to a positive multiple of WIDTH, named by its SHA-256. The
    page sets the text's lines as paragraphs and then the picture of its bytes, captioned with their number.
    Returns pages (``doc_id, n_bytes, html``) and payloads (``digest, media``).
    """
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), body.alias("body")).withColumn("n_bytes", F.octet_length("body").cast("long"))
    padded = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / WIDTH)) * WIDTH
    rows = rows.withColumn("payload", F.rpad(F.col("body"), padded.cast("int"), F.lit(b"\x00"))).withColumn("digest", F.sha2("payload", 256))
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(
        F.lit("<article><p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit('</p><figure><img src="sha256:'), F.col("digest"),
        F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></article>"),
    )
    return rows.select("doc_id", "n_bytes", page.alias("html")), rows.select("digest", to_image(F.col("payload")).alias("media"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    small_batches(spark)
    pages, payloads = text_media(docs)
    read = image_features(written(payloads, "media"))
    facts = [c for c in read.columns if c != "digest"]
    sequences = parse(pages).drop("html")
    joined = resolve(sequences.withColumn("key", F.struct("doc_id", "n_bytes", F.size("sequence").alias("parts"))), "key", read, facts)
    feature = F.concat("feature", F.lit(";at="), F.col("position"), F.lit("/"), F.col("key.parts"), F.lit(";caption="), "caption")
    return joined.select("key.doc_id", "key.n_bytes", *[F.col(c) for c in facts if c != "feature"], feature.alias("feature"), "position", "caption")
