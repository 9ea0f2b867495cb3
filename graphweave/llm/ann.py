"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave.llm.common import batches_of, discard, shuffle_partitions, written

#: Bound of the fit: vectors sampled for the codebooks.
SAMPLE_VECTORS = 8192
BOOKS, WORDS, BEAM = 16, 256, 8
#: Vectors per index block, queries per query block, candidates per query (of all vectors together) that are scored exactly.
BLOCK_ROWS, QUERY_ROWS, RERANKED = 4096, 256, 384
#: Pairs of blocks that travel to a Python worker at once.
PAIRS_AT_ONCE = 32


@dataclass
class Quantiser:
    """``books``: BOOKS full-dimensional codebooks of WORDS codewords; a vector is the sum of one word of each."""

    books: np.ndarray

    @property
    def flat(self) -> np.ndarray:
        return self.books.reshape(-1, self.books.shape[2])

    def encode(self, x: np.ndarray, beam: int = BEAM, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared norms of the sums, some ``rows`` at a time to bound memory."""
        parts = [self._encode(x[at : at + rows], beam) for at in range(0, max(len(x), 1), rows)]
        return np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Book by book the ``beam`` best partial sums are kept."""
        m, k, _ = self.books.shape
        flat = self.flat
        gram, dots = flat @ flat.T, x @ flat.T
        n, rows = len(x), np.arange(len(x))[:, None]
        codes, cost, norm = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1)), np.zeros((n, 1))
        for b in range(m):
            own = slice(b * k, (b + 1) * k)
            # |x - s - c|^2 - |x - s|^2 = |c|^2 - 2 x.c + 2 s.c, where s is the sum so far
            cross = sum((gram[codes[:, :, j] + j * k, own] for j in range(b)), np.zeros((n, codes.shape[1], k), x.dtype))
            more = np.diag(gram)[own] + 2 * cross
            total = cost[:, :, None] + more - 2 * dots[:, None, own]
            keep = min(beam, total[0].size if n else beam)
            best = np.argpartition(total.reshape(n, -1), keep - 1, axis=1)[:, :keep]
            from_, word = best // k, best % k
            cost = total.reshape(n, -1)[rows, best]
            norm = norm[rows, from_] + more[rows, from_, word]
            codes = np.concatenate([codes[rows, from_], word[:, :, None]], axis=2)
        pick = cost.argmin(axis=1)
        return codes[np.arange(n), pick].astype(np.uint8), norm[np.arange(n), pick].astype(np.float32)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    """k-means of the rows; k rows (repeated where there are fewer) to begin with."""
    words = x[rng.permutation(len(x))[np.arange(k) % len(x)]].copy()
    for _ in range(steps):
        near = ((words**2).sum(1) - 2 * x @ words.T).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words[count > 0] = sums[count > 0] / count[count > 0, None]
    return words


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 1) -> Quantiser:
    """Codebooks from unit vectors: k-means of what the books before leave over after beam search."""
    rng, found = np.random.default_rng(seed), np.zeros((0, words, sample.shape[1]), np.float32)
    left = sample
    for _ in range(books):
        found = np.concatenate([found, _means(left, words, rng)[None].astype(np.float32)])
        codes, _ = Quantiser(found).encode(sample)
        left = sample - sum(found[j][codes[:, j]] for j in range(len(found)))
    return Quantiser(found)


def _units(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return (wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part, one per vec_id (the least embedding)."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.where(finite).where(some).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _stack(pdf: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("vec_id")
    vectors = np.array(pdf["embedding"].tolist(), np.float32).reshape(-1, dim)
    return pdf["vec_id"].to_numpy(np.int64), vectors


def _blocks(dim: int, rows: int, quantiser: Quantiser | None):
    """Blocks of the index (ids, codes and norms), or of queries (ids and unit vectors)."""

    def block(pdf: pd.DataFrame) -> dict:
        ids, vectors = _stack(pdf, dim)
        if quantiser is None:
            return {"q_ids": ids.tobytes(), "q_units": _units(vectors).tobytes()}
        codes, norms = quantiser.encode(_units(vectors))
        return {"ids": ids.tobytes(), "codes": codes.tobytes(), "norms": norms.tobytes()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            while len(held) >= rows:
                yield pd.DataFrame([block(held[:rows])])
                held = held[rows:]
        if held is not None and len(held):
            yield pd.DataFrame([block(held)])

    return run


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``most`` greatest scores and their ids, of equal scores the smaller ids."""
    if scores.shape[1] <= most:
        return scores, ids
    order = np.lexsort((ids, -scores), axis=1)[:, :most]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _scan(quantiser: Quantiser, most: int):
    """Pairs of an index block and a query block to the ``most`` candidates of each query in all blocks of the task, scored by lookup tables on codes and norms alone."""

    def rough(query_ids, units, ids, codes, norms):
        tables = (units @ quantiser.flat.T).reshape(len(units), *quantiser.books.shape[:2])
        found = sum(tables[:, b, :][:, codes[:, b]] for b in range(quantiser.books.shape[0])) / np.sqrt(np.maximum(norms, 1e-12))
        found[query_ids[:, None] == ids[None, :]] = -np.inf
        if len(ids) <= most:
            return found, np.broadcast_to(ids, found.shape)
        floor = -np.partition(-found, most - 1, axis=1)[:, most - 1 : most]
        above, level = found > floor, found == floor
        # Of those on the floor the first by id, which ascend in a block, so that copies of one vector rank alike in every block.
        keep = above | level & (np.cumsum(level, axis=1) <= most - above.sum(axis=1, keepdims=True))
        at = np.nonzero(keep)[1].reshape(len(found), most)
        return np.take_along_axis(found, at, 1), ids[at]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                query_ids, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                units = np.frombuffer(r.q_units, np.float32).reshape(len(query_ids), -1)
                scores, found = rough(query_ids, units, ids, np.frombuffer(r.codes, np.uint8).reshape(len(ids), -1), np.frombuffer(r.norms, np.float32))
                if r.q_ids in held:
                    before = held[r.q_ids]
                    scores, found = _best(np.concatenate([before[0], scores], axis=1), np.concatenate([before[1], found], axis=1), most)
                held[r.q_ids] = scores, found
        for key, (scores, found) in held.items():
            query_ids = np.repeat(np.frombuffer(key, np.int64), scores.shape[1])
            fine = np.isfinite(scores).reshape(-1)
            yield pd.DataFrame({"query_id": query_ids[fine], "vec_id": found.reshape(-1)[fine], "rough": scores.reshape(-1)[fine].astype(np.float32)})

    return run


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, reranked: int = RERANKED) -> DataFrame:
    """The ``k`` nearest found of every query among the vectors of its length: ``query_id, rank, vec_id, score`` (cosine in double precision).

    Each length has an index of its own (see ``_neighbours``). Vectors that are null, zero, or hold null or non-finite components take no part, nor do null
    ids. Rows that share a vec_id count once (the least embedding). A vector is no neighbour of its own id. Equal scores rank by the smaller
    vec_id. No rows give no rows. Other columns are ignored.
    """
    rows, asked = written(usable(vectors), "vectors"), usable(queries)
    sizes = sorted(r["d"] for r in rows.select(F.size("embedding").alias("d")).distinct().collect()) or [1]
    found = [_neighbours(rows.where(F.size("embedding") == d), asked.where(F.size("embedding") == d), d, k, reranked) for d in sizes]
    return reduce(DataFrame.unionByName, found)


def _neighbours(rows: DataFrame, asked: DataFrame, dim: int, k: int, reranked: int) -> DataFrame:
    """The search among usable vectors of ``dim`` components.

    Codebooks come from at most SAMPLE_VECTORS unit vectors, chosen by hash; every vector is encoded by beam search and indexed
    in blocks of codes and norms, without the vectors. Each block of queries meets each block of the index once, and lookup tables score all its
    vectors; a task keeps the ``reranked`` best of each query over all its blocks. Of these the ``reranked`` best of all tasks are
    joined with the original vectors and scored exactly.
    """
    spark = rows.sparkSession
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit("codebook"))).limit(SAMPLE_VECTORS).toPandas()
    quantiser = train(_units(_stack(sample, dim)[1])) if n else Quantiser(np.zeros((BOOKS, WORDS, dim), np.float32))
    parts = shuffle_partitions(spark)
    index = written(rows.repartition(max(1, min(parts, -(-n // BLOCK_ROWS)))).mapInPandas(_blocks(dim, BLOCK_ROWS, quantiser), "ids binary, codes binary, norms binary"), "index")
    own = written(asked, "asked")
    blocks = written(own.mapInPandas(_blocks(dim, QUERY_ROWS, None), "q_ids binary, q_units binary"), "queries")
    # Blocks meet where the index lies.
    with batches_of(spark, PAIRS_AT_ONCE):
        found = written(index.crossJoin(blocks).mapInPandas(_scan(quantiser, reranked), "query_id long, vec_id long, rough float"), "found")
    discard(index, blocks)
    place = lambda *by: F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    best = found.withColumn("place", place(F.desc("rough"), "vec_id")).where(F.col("place") <= reranked).select("query_id", "vec_id")
    pairs = best.join(rows.select("vec_id", "embedding"), "vec_id").join(own.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    score = _dot(F.col("q"), F.col("embedding")) / (F.sqrt(_dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(_dot(F.col("q"), F.col("q"))))
    scored = pairs.select("query_id", "vec_id", score.alias("score"))
    return scored.withColumn("rank", place(F.desc("score"), "vec_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours(vectors, vectors.where("vec_id % 50 = 0"))
