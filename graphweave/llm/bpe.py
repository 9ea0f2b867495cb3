"""Byte-level BPE encoding and decoding through a global shuffle of distinct words."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm.common import shuffle_partitions, slices, small_batches, written_buckets

#: Bytes of text that are cut into one block; the most that one group of the reassembly holds.
BLOCK_BYTES = 8 << 20


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (a fixed vocabulary, well under a MB), read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str) -> regex.Pattern:
    """The split pattern as Unicode defines it: white space is the property, without the control codes U+001C to U+001F."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbouring parts of least rank (leftmost first) until none of the joined parts has one."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        least, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (least is None or rank < least):
                least, at = rank, i
        if least is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _heap_encode(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for long words, in n log n steps."""
    import heapq

    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, 1) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heap = [(r, i, i + 2) for r, i, _ in heap]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get(word[k : end[after[k]]])) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _pack(lengths: list[int] | np.ndarray, body: bytes) -> bytes:
    return zstandard.compress(np.uint32(len(lengths)).tobytes() + np.asarray(lengths, np.uint32).tobytes() + body, 3)


def _unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return np.frombuffer(raw, np.uint32, n, 4), raw[4 + 4 * n :]


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers with their bytes grouped by place, which compresses better."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _split_blocks(pattern: str, ranks_cast, buckets: int, block_bytes: int):
    """Texts to blocks. A block has one ``seq`` row and a ``words`` row per word bucket with words.

    The seq row lists the documents and, position by position, each pre-token: its id if it is itself a
    token of the vocabulary, else the vocabulary's size plus its place among the block's distinct words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, ranks = splitter(pattern), ranks_cast.value
        first = max(ranks.values()) + 1
        single = {}
        for token, rank in ranks.items():
            try:
                single[token.decode()] = rank
            except UnicodeDecodeError:
                continue
        part, number = TaskContext.get().partitionId(), 0
        ids, counts, places, own, size = [], [], [], {}, 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number, ids, counts, places, own, size
            name = (part << 32) + number
            words = [w.encode("utf-8", "surrogatepass") for w in own]
            home = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.array(sorted(range(len(words)), key=lambda i: (home[i], words[i])), np.int64)
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words))
            flat = np.concatenate(places)
            late = flat >= first
            flat[late] = place[flat[late] - first] + first
            # The most frequent first: small numbers whose upper bytes are mostly 0.
            kinds, at, often = np.unique(flat, return_inverse=True, return_counts=True)
            order_of = np.argsort(-often, kind="stable")
            rank = np.empty(len(kinds), np.int32)
            rank[order_of] = np.arange(len(kinds))
            rows = [(name, -1, _pack([len(kinds), *counts], _planes(np.concatenate([kinds[order_of], rank[at]]))), ids)]
            ends = np.searchsorted(home[order], np.arange(buckets + 1))
            for b in np.unique(home):
                mine = [words[i] for i in order[ends[b] : ends[b + 1]]]
                rows.append((name, int(b), _pack([len(w) for w in mine], b"".join(mine)), None))
            number += 1
            ids, counts, places, own, size = [], [], [], {}, 0
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.int64()))], ["block", "bucket", "data", "ids"])

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = cut.findall(text or "")
                line = np.empty(len(found), np.int32)
                for i, w in enumerate(found):
                    rank = single.get(w)
                    line[i] = rank if rank is not None else first + own.setdefault(w, len(own))
                ids.append(doc)
                counts.append(len(found))
                places.append(line)
                size += len(text or "")
                if size >= block_bytes:
                    yield from block()
        if ids:
            yield from block()

    return run


def _encode_buckets(ranks_cast):
    """Rows of word buckets, sorted by bucket: every distinct word of a bucket is encoded once, and each block gets its ids back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, bucket, known = ranks_cast.value, None, {}
        for pdf in batches:
            out = []
            for b, data in zip(pdf["bucket"], pdf["data"]):
                if b != bucket:
                    bucket, known = b, {}
                lengths, body = _unpack(data)
                ends = np.cumsum(lengths).tolist()
                start, found = 0, []
                for end in ends:
                    word = body[start:end]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode_word(word, ranks) if len(word) < 40 else _heap_encode(word, ranks), "<u4").tobytes()
                    found.append(ids)
                    start = end
                out.append(_pack([len(x) // 4 for x in found], _planes(np.frombuffer(b"".join(found), "<u4"))))
            yield pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "data": out})

    return run


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of ``values`` one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _reassemble(first: int):
    def run(sequences: pa.Table, words: pa.Table) -> pa.Table:
        (counts, body), docs = _unpack(sequences.column("data")[0].as_py()), sequences.column("ids")[0].as_py()
        numbers, edges = _unplanes(body), np.cumsum(np.append(0, counts[1:].astype(np.int64)))
        flat = numbers[: counts[0]][numbers[counts[0] :]].astype(np.int64)
        parts = [_unpack(data) for _, data in sorted(zip(words.column("bucket").to_pylist(), words.column("data").to_pylist()))]
        lengths = np.concatenate([np.ones(first, np.int64), *[n.astype(np.int64) for n, _ in parts]])
        values = np.concatenate([np.arange(first, dtype="<u4"), *[_unplanes(ids) for _, ids in parts]])
        starts = np.cumsum(lengths) - lengths
        long = lengths[flat]
        ids = gather(values, starts[flat], long)
        token_ends = np.cumsum(np.append(0, long))[edges]
        raw = ids.astype("<u4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(token_ends[:-1].tolist(), token_ends[1:].tolist())]
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "n_tokens": pa.array(np.diff(token_ends)), "ids": pa.array(out, pa.binary())})

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, buckets: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Token ids of every whole text: ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers).

    Texts are cut into pre-tokens in blocks of about ``block_bytes``. A block keeps its pre-tokens by position
    and sends its distinct words that are no tokens, once each, to word buckets; a
    bucket encodes each distinct word of the whole corpus once; the ids go back to the blocks, which put them in
    their positions. What a very frequent word costs grows with the blocks, not with its occurrences.

    Null and empty texts have no tokens. Repeated rows and null doc_ids come out as they came in.
    No rows give no rows. Other columns are ignored. doc_id must be an integer.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = shuffle_partitions(spark)
    buckets = buckets or 4 * n
    ranks = read_ranks(spark, ranks_path)
    cast, first = spark.sparkContext.broadcast(ranks), max(ranks.values()) + 1
    schema = "block long, bucket int, data binary, ids array<long>"
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    # Bucketed by block, so that the sequences, the bulk of it, are joined where they lie.
    blocks = written_buckets(slim.mapInArrow(_split_blocks(pattern, cast, buckets, block_bytes), schema), "blocks", n, "block")
    words = blocks.where("bucket >= 0").repartition(n, "bucket").sortWithinPartitions("bucket")
    back = words.mapInPandas(_encode_buckets(cast), "block long, bucket int, data binary")
    joined = blocks.where("bucket < 0").groupBy("block").cogroup(back.groupBy("block"))
    return joined.applyInArrow(_reassemble(first), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``decoded``, the bytes that ``ids`` stand for: a join of every id with the table of token bytes.

    That table has one row per vocabulary entry, a fixed size, so each task holds it whole and joins by position.
    """
    spark = encoded.sparkSession
    cast = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b""] * (max(cast.value.values()) + 1)
        for token, rank in cast.value.items():
            table[rank] = token
        lengths = np.array([len(t) for t in table], np.int64)
        values, starts = np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths
        for batch in slices(batches):
            out = []
            for raw in batch.column("ids").to_pylist():
                ids = np.frombuffer(raw, "<u4")
                out.append(gather(values, starts[ids], lengths[ids]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded documents."""
    return decode(encoded, ranks_path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def tokenizer() -> tuple[str, str]:
    """Path of the production vocabulary and its split pattern, from the installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode(docs, path, pattern), path)
