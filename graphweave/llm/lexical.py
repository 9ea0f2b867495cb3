"""Ranked lexical search: MaxScore whose bounds are tightened by what pairs of terms reach together."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave.llm.common import batches_of, discard, running_sum, slices, written

#: Documents of an index block, and of the runs in it that bounds are kept for.
BLOCK_DOCS, RUN_DOCS = 8192, 64
#: Bytes of query texts that one pass over the documents answers; more queries take more passes.
PASS_BYTES = 1 << 25
TOP = 20

# Bytes of terms, and the constants of the score.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SATURATION, PIVOT, SHARE = 12, 100, 25
UNIT = 1_000_000_000


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, letters and bytes from 128 on, A-Z lower-cased. Bytes of other code points never fall into the ASCII separators."""
    return (text or b"").translate(_TERM_BYTES).split()


@dataclass
class Vocabulary:
    """Numbers of the terms of one pass's queries, and each query as (item, {term: repeats})."""

    numbers: dict[bytes, int]
    queries: list[tuple[int | None, dict[int, int]]]


def vocabulary(items: list[tuple[int | None, bytes]]) -> Vocabulary:
    numbers: dict[bytes, int] = {}
    queries = [(item, dict(Counter(numbers.setdefault(t, len(numbers)) for t in terms(text)))) for item, text in items]
    return Vocabulary(numbers, queries)


def postings(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """``doc_id, n, terms, tfs``: the length of every document and the occurrences of vocabulary terms in it, from whole texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = docs.sparkSession.sparkContext.broadcast(words.numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in slices(batches):
            lengths, found, tfs, ends = [], [], [], [0]
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                held = terms(text)
                lengths.append(len(held))
                own = sorted((known[t], tf) for t, tf in Counter(held).items() if t in known)
                found.extend(t for t, _ in own)
                tfs.extend(tf for _, tf in own)
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind_of)) for values, kind_of in ((found, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


@dataclass
class Statistics:
    """N documents with a term, L terms in all, and the weight of every vocabulary term."""

    docs: int
    length: int
    weights: np.ndarray

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What an occurrence count adds per unit of weight, in whole numbers."""
        m = PIVOT - SHARE + (SHARE * n * self.docs) // self.length
        return (UNIT * tf) // (1000 * tf + SATURATION * m)


def statistics(index: DataFrame, n_terms: int) -> Statistics:
    """Counts over all documents; documents of a term are counted per task before they are shuffled."""
    whole = index.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64), minlength=n_terms)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at.astype(np.int32)), "df": pa.array(counts[at])})

    df = np.zeros(n_terms, np.int64)
    for r in index.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = [math.floor(1000 * math.log((2 * whole["docs"] + 2) / (2 * int(d) + 1))) for d in df]
    return Statistics(whole["docs"], max(1, whole["length"]), np.array(weights, np.int64))


def paired(query: dict[int, int], weights: np.ndarray) -> list[tuple[int, ...]]:
    """Disjoint pairs of a query's terms, the heaviest two first and so on; a lone last term."""
    order = sorted((t for t in query if weights[t] > 0), key=lambda t: (-int(weights[t]) * query[t], t))
    return [tuple(order[i : i + 2]) for i in range(0, len(order), 2)]


class Block:
    """Postings of up to BLOCK_DOCS documents with, per run of RUN_DOCS of them, every term's greatest score and every listed pair's greatest joint score."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, starts: dict[int, slice], docs: np.ndarray, scores: np.ndarray, pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> None:
        self.ids, self.null, self.starts, self.docs, self.scores, self.pairs = ids, null, starts, docs, scores, pairs
        self.runs = -(-len(ids) // RUN_DOCS)
        self.tops: dict[int, np.ndarray] = {}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.starts.get(term, slice(0, 0))
        return self.docs[at], self.scores[at]

    def top(self, term: int) -> np.ndarray:
        """A term's greatest score in each run."""
        if term not in self.tops:
            docs, scores = self.of(term)
            self.tops[term] = _run_tops(docs, scores, self.runs)
        return self.tops[term]

    def bound(self, group: tuple[int, ...], query: dict[int, int], by_pairs: bool = True) -> np.ndarray:
        """The most that the terms of ``group`` add to a document of each run.

        Documents with both terms of a pair score at most its joint maximum, those with one at most that term's; what one term is
        repeated more often than the other counts by its own maximum.
        """
        if len(group) == 1:
            return query[group[0]] * self.top(group[0])
        a, b = group
        if not by_pairs:
            return query[a] * self.top(a) + query[b] * self.top(b)
        joint = np.maximum(self.top(a), self.top(b))
        runs, tops = self.pairs.get((min(a, b), max(a, b)), (np.empty(0, np.int64), np.empty(0, np.int64)))
        joint[runs] = np.maximum(joint[runs], tops)
        both = min(query[a], query[b])
        return both * joint + (query[a] - both) * self.top(a) + (query[b] - both) * self.top(b)


def _run_tops(docs: np.ndarray, scores: np.ndarray, runs: int) -> np.ndarray:
    out = np.zeros(runs, np.int64)
    if len(docs):
        run = docs // RUN_DOCS
        at = np.flatnonzero(np.diff(run, prepend=-1))
        out[run[at]] = np.maximum.reduceat(scores, at)
    return out


def pair_list(block: Block, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Intersection list of two terms: the runs in which documents have both, and the greatest joint score there."""
    (docs_a, scores_a), (docs_b, scores_b) = block.of(a), block.of(b)
    docs, at_a, at_b = np.intersect1d(docs_a, docs_b, assume_unique=True, return_indices=True)
    tops = _run_tops(docs, scores_a[at_a] + scores_b[at_b], block.runs)
    runs = np.unique(docs // RUN_DOCS)
    return runs, tops[runs]


_LAYOUT = "ids binary, nulls binary, terms binary, starts binary, docs binary, scores binary, pair_a binary, pair_b binary, pair_ends binary, pair_runs binary, pair_tops binary"


def index_blocks(index: DataFrame, stats: Statistics, pairs: list[tuple[int, int]]) -> DataFrame:
    """Blocks of ``index``: postings by term with their scores, and the intersection lists of ``pairs``. Every row is in one block."""

    def block(ids, nulls, lengths, counts, found, tfs) -> dict:
        docs = np.repeat(np.arange(len(ids)), counts)
        scores = stats.weights[found] * stats.impacts(np.repeat(lengths, counts), tfs)
        order = np.lexsort((docs, found))
        found, docs, scores = found[order], docs[order], scores[order]
        own, starts = np.unique(found, return_index=True)
        starts = np.append(starts, len(found))
        made = Block(ids, nulls, {int(t): slice(s, e) for t, s, e in zip(own, starts, starts[1:])}, docs, scores, {})
        here = set(own.tolist())
        lists = [(a, b, *pair_list(made, a, b)) for a, b in pairs if a in here and b in here]
        lists = [p for p in lists if len(p[2])]
        return {
            "ids": ids.tobytes(), "nulls": nulls.tobytes(), "terms": own.astype(np.int64).tobytes(), "starts": starts.astype(np.int64).tobytes(), "docs": docs.astype(np.int32).tobytes(), "scores": scores.tobytes(),
            "pair_a": np.array([p[0] for p in lists], np.int64).tobytes(), "pair_b": np.array([p[1] for p in lists], np.int64).tobytes(), "pair_ends": np.cumsum([0, *[len(p[2]) for p in lists]]).astype(np.int64).tobytes(),
            "pair_runs": np.concatenate([np.empty(0, np.int64), *[p[2] for p in lists]]).tobytes(), "pair_tops": np.concatenate([np.empty(0, np.int64), *[p[3] for p in lists]]).tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, lists = table["doc_id"].combine_chunks(), table["terms"].combine_chunks()
            whole = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), table["n"].to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)]
            flat = [table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs")]
            return pa.RecordBatch.from_pylist([block(*whole, *flat)], schema=pa.schema([(c.split()[0], pa.binary()) for c in _LAYOUT.split(", ")]))

        for batch in slices(batches, 1024):
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_DOCS:
                yield made()
                held = []
        if held and sum(b.num_rows for b in held):
            yield made()

    return index.mapInArrow(run, _LAYOUT)


def read_block(row: dict) -> Block:
    array = lambda name, kind=np.int64: np.frombuffer(row[name], kind)
    starts, ends, runs, tops = array("starts"), array("pair_ends"), array("pair_runs"), array("pair_tops")
    pairs = {(a, b): (runs[s:e], tops[s:e]) for a, b, s, e in zip(array("pair_a").tolist(), array("pair_b").tolist(), ends[:-1], ends[1:])}
    return Block(array("ids"), array("nulls", bool), {t: slice(s, e) for t, s, e in zip(array("terms").tolist(), starts[:-1], starts[1:])}, array("docs", np.int32).astype(np.int64), array("scores"), pairs)


def best_of(block: Block, query: dict[int, int], groups: list[tuple[int, ...]], floor: int, k: int, by_pairs: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """The documents (places in the block) that can be among the ``k`` best with scores of ``floor`` or more, their scores, and how many were scored.

    Groups are taken by their weight; bounds of what is still to come are sums over groups per run. Runs whose whole bound stays under the floor
    are skipped. The run of the greatest bound is scored first, and its k-th score raises the floor. Then group by group
    a document is dropped as soon as its score so far and the bound of the rest stay under the floor. Equal scores are never dropped.
    """
    bounds = [block.bound(g, query, by_pairs) for g in groups]
    rest = np.zeros((len(groups) + 1, block.runs), np.int64)
    for i in range(len(groups) - 1, -1, -1):
        rest[i] = rest[i + 1] + bounds[i]
    floor, scored = max(floor, 1), 0
    live = rest[0] >= floor
    if not live.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    total = np.zeros(len(block.ids), np.int64)

    def add(group: tuple[int, ...], wanted: np.ndarray) -> None:
        for t in group:
            docs, scores = block.of(t)
            at = wanted[docs]
            total[docs[at]] += query[t] * scores[at]

    def score(runs: np.ndarray, floor: int) -> tuple[np.ndarray, int]:
        """Places that are left of the documents in ``runs``, and how many were met."""
        wanted = np.repeat(runs, RUN_DOCS)[: len(block.ids)]
        met = int(wanted.sum())
        run_of = np.arange(len(block.ids)) // RUN_DOCS
        for i, group in enumerate(groups):
            add(group, wanted)
            wanted &= total + rest[i + 1][run_of] >= floor
            if not wanted.any():
                break
        return np.flatnonzero(wanted), met

    first = np.zeros(block.runs, bool)
    first[np.argsort(-rest[0], kind="stable")[: -(-k // RUN_DOCS)]] = True
    kept, met = score(first & live, floor)
    scored += met
    if len(kept) >= k:
        floor = max(floor, int(np.partition(total[kept], len(kept) - k)[len(kept) - k]))
    more, met = score(live & ~first & (rest[0] >= floor), floor)
    kept = np.concatenate([kept, more])
    kept = kept[total[kept] >= floor]
    return kept, total[kept], scored + met


def _ordered(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, null, -scores))[:k]


def search_blocks(blocks: DataFrame, words: Vocabulary, stats: Statistics, k: int, doc_kind: str, item_kind: str) -> DataFrame:
    """``item, doc_id, score``: each task's ``k`` best of every query, found block by block with the floor that its blocks before have set."""
    sent = blocks.sparkSession.sparkContext.broadcast([(item, query, paired(query, stats.weights)) for item, query in words.queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        best = [empty] * len(sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                block = read_block(row)
                for q, (_, query, groups) in enumerate(sent.value):
                    scores, ids, null = best[q]
                    kept, found, _ = best_of(block, query, groups, int(scores[k - 1]) if len(scores) >= k else 1, k)
                    if len(kept):
                        scores, ids, null = np.concatenate([scores, found]), np.concatenate([ids, block.ids[kept]]), np.concatenate([null, block.null[kept]])
                        order = _ordered(scores, ids, null, k)
                        best[q] = scores[order], ids[order], null[order]
        for (item, _, _), (scores, ids, null) in zip(sent.value, best):
            if len(scores):
                columns = [pa.array([item] * len(scores), item_type), pa.array(ids, mask=null).cast(doc_type), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    types = {"int": pa.int32(), "bigint": pa.int64()}
    doc_type, item_type = types[doc_kind], types[item_kind]
    return blocks.mapInArrow(run, f"item_id {item_kind}, doc_id {doc_kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` documents of highest score for every item: ``item_id, rank, doc_id, score``, scores above 0, equal ones by ascending doc_id (null last).

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``; ids are whole numbers. Every text is read whole. Documents are tokenised where they lie; counts (documents, lengths, documents
    of a term) go over all of them. Items are answered in passes of at most PASS_BYTES of their text (and one item), so that what is broadcast has that
    bound. In a pass every block of documents gets its postings and the intersection lists of the items' pairs, and is searched with all the pass's items.

    Null and empty texts have no terms: such documents are found by nothing and do not count, such items find nothing. Repeated document rows are documents each.
    Of an item_id with several texts the least counts. No documents or items give no rows. Other columns are ignored.
    """
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id")))
    once = items.groupBy("item_id").agg(F.min("text").alias("text")).where(F.col("text").isNotNull()).withColumn("bytes", F.octet_length("text").cast("long"))
    if once.isEmpty():
        return docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    placed = written(running_sum(once, ["item_id"], "bytes", "upto").withColumn("pass", F.floor((F.col("upto") - F.col("bytes")) / PASS_BYTES)), "items")
    found = []
    for p in sorted(r["pass"] for r in placed.select("pass").distinct().collect()):
        asked = placed.where(F.col("pass") == p).orderBy("item_id").select("item_id", F.col("text").cast("binary").alias("text")).collect()
        words = vocabulary([(r["item_id"], bytes(r["text"])) for r in asked])
        with batches_of(docs.sparkSession, 256):
            index = written(postings(docs, words), "postings")
        stats = statistics(index, len(words.numbers))
        pairs = sorted({tuple(sorted(g)) for _, query in words.queries for g in paired(query, stats.weights) if len(g) == 2})
        with batches_of(docs.sparkSession, 1024):
            blocks = written(index_blocks(index.where(F.size("terms") > 0), stats, pairs), "blocks")
        with batches_of(docs.sparkSession, 1):
            found.append(written(search_blocks(blocks, words, stats, k, doc_kind, item_kind), "found"))
        discard(index, blocks)
    discard(placed)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(docs.select("doc_id", "text"), items.select("item_id", "text"))


_SPLIT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

#: The same rows in DuckDB: every document is scored.
SQL = f"""
WITH held AS (SELECT doc_id, unnest({_SPLIT}) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark) GROUP BY item_id, term),
counted AS (SELECT doc_id, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weighed AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), whole),
scored AS (SELECT a.item_id, c.doc_id, CAST(sum(a.times * g.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (75 + (25 * l.n * whole.docs) // whole.words)))) AS BIGINT) AS score
           FROM asked a JOIN counted c ON a.term = c.term JOIN weighed g ON a.term = g.term JOIN lengths l ON c.doc_id = l.doc_id, whole GROUP BY a.item_id, c.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""
