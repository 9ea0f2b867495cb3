"""SimHash near-dedup with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import connected, discard, shuffle_partitions, slices, small_batches, written

RADIUS = 3
SEED = 42
#: Up to this many fingerprints of a bucket are compared with each other in memory; larger buckets take the ball join.
SMALL_BUCKET = 1024

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Bit masks such that any two words that differ in at most ``radius`` bits agree under one of them.

    Every bit position gets a non-zero vector of radius + 1 bits; mask v keeps the positions whose
    vector has odd inner product with v. The vectors of ``radius`` differing positions leave some
    v != 0 orthogonal to all of them, and that mask keeps none of these positions (Pagh 2016).
    """
    size = (1 << (radius + 1)) - 1
    vectors = [i % size + 1 for i in range(bits)]
    return [sum(1 << i for i, p in enumerate(vectors) if (p & v).bit_count() & 1) for v in range(1, size + 1)]


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    columns = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, j], minlength=256) @ _BYTE_BITS for j in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: bytes, words_each: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included, of the words of ``text`` with A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < words_each:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_each))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)


def fingerprints(docs: DataFrame, words_each: int = 3, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row; null text counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([majority_bits(shingle_hashes(t or b"", words_each, seed)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _near_forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of pairs within ``radius``, nearest pairs first (Prim)."""
    m = len(fps)
    out, open_ = [], np.ones(m, bool)
    best, by = np.full(m, 255, np.int64), np.zeros(m, np.int64)
    while open_.any():
        at = int(np.where(open_, best, 256).argmin())
        if best[at] <= radius:
            out.append((int(fps[at]), int(fps[by[at]])))
        else:
            best[:] = 255
        open_[at] = False
        far = np.bitwise_count(fps ^ fps[at]).astype(np.int64)
        closer = open_ & (far < best)
        best[closer], by[closer] = far[closer], at
    return out


def _links_in_buckets(radius: int, most: int):
    """Reads rows sorted by (mask, key, fp), bucket by bucket; a bucket over ``most`` is passed on member by member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, passing = None, [], False
        for pdf in batches:
            mask, key, fp = pdf["mask"].to_numpy(), pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
            rows: list[tuple[int, int, int, bool]] = []
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], cut])
            ends = np.concatenate([cut, [len(fp)]])
            busy = np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1))
            for i in busy:
                s, e = starts[i], ends[i]
                name = (mask[s], key[s])
                if name != current:
                    rows += _forest_rows(held, radius, current)
                    current, held, passing = name, [], False
                if passing:
                    rows += [(int(x), int(x), name[0], True) for x in fp[s:e]]
                    continue
                held.append(fp[s:e])
                if sum(map(len, held)) > most:
                    rows += [(int(x), int(x), name[0], True) for part in held for x in part]
                    held, passing = [], True
                elif i < len(starts) - 1:
                    rows += _forest_rows(held, radius, current)
                    held = []
            yield _rows(rows)
        yield _rows(_forest_rows(held, radius, current))

    return run


def _forest_rows(held: list[np.ndarray], radius: int, bucket: tuple | None) -> list[tuple[int, int, int, bool]]:
    return [(a, b, bucket[0], False) for a, b in _near_forest(np.concatenate(held), radius)] if held else []


def _rows(rows: list[tuple[int, int, int, bool]]) -> pd.DataFrame:
    a, b, mask, large = zip(*rows) if rows else ((), (), (), ())
    signed = lambda x: np.array(x, np.uint64).view(np.int64)
    return pd.DataFrame({"a": signed(a), "b": signed(b), "mask": np.array(mask, np.int32), "large": np.array(large, bool)})


def _balls(masks: list[int], radius: int):
    """For members of large buckets, the words near them in the bits that their mask leaves out.

    Two words of a bucket within ``radius`` have a third word between them, at most radius // 2 from
    the one and the rest from the other. ``near`` tells the short steps.
    """
    short = radius // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = {}
        for pdf in batches:
            for mask, rows in pdf.groupby("mask"):
                if mask not in steps:
                    free = [1 << i for i in range(64) if not masks[mask % len(masks)] >> i & 1]
                    flips = [(k, sum(c)) for k in range(radius - short + 1) for c in combinations(free, k)]
                    steps[mask] = np.array([f for _, f in flips], np.uint64), np.array([k > short for k, _ in flips])
                flips, far = steps[mask]
                fps = rows["a"].to_numpy().view(np.uint64)
                for at in range(0, len(fps), 32):
                    own = fps[at : at + 32, None]
                    yield pd.DataFrame({"mask": mask, "z": (flips ^ own).view(np.int64).ravel(), "far": np.tile(far, len(own)), "fp": np.repeat(own.view(np.int64).ravel(), len(flips))})

    return run


def _links_in_balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads rows sorted by (mask, z, far): a near one in a ball is linked with all others of the ball."""
    first = None
    for pdf in batches:
        rows = pdf if first is None else pd.concat([first, pdf], ignore_index=True)
        mask, z, fp = rows["mask"].to_numpy(), rows["z"].to_numpy(), rows["fp"].to_numpy()
        i = np.arange(len(rows))
        head = np.maximum.accumulate(np.where((i == 0) | (mask != np.roll(mask, 1)) | (z != np.roll(z, 1)), i, 0))
        linked = ~rows["far"].to_numpy()[head] & (fp != fp[head])
        if len(rows):
            first = rows.iloc[[head[-1]]]
        yield pd.DataFrame({"a": fp[linked], "b": fp[head[linked]], "mask": mask[linked]})


def near_links(fps: DataFrame, radius: int = RADIUS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Pairs ``space, a, b`` of fingerprints within ``radius`` bits that connect all that such pairs connect.

    ``fps`` has columns ``space`` (int) and ``fp``, each combination once; only one space's fingerprints are linked
    with each other. A fingerprint goes into one bucket per covering mask. Buckets up to
    ``small_bucket`` are compared in memory and give a spanning forest. The members of larger ones
    are joined through the words between them, which costs a fixed number of rows a member,
    so no bucket costs the square of its size and none is cut.
    """
    masks = covering_masks(radius)
    n = shuffle_partitions(fps.sparkSession)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    number = [(F.col("space") * len(masks) + i).cast("int").alias("mask") for i in range(len(masks))]
    keys = F.array(*[F.struct(number[i], F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("k.mask", "k.key", "fp")
    dealt = rows.repartition(n, "mask", "key").sortWithinPartitions("mask", "key", "fp")
    found = written(dealt.mapInPandas(_links_in_buckets(radius, small_bucket), "a long, b long, mask int, large boolean"), "links")
    balls = found.where("large").mapInPandas(_balls(masks, radius), "mask int, z long, far boolean, fp long")
    balls = balls.repartition(n, "mask", "z").sortWithinPartitions("mask", "z", "far")
    links = found.where("NOT large").select("a", "b", "mask").union(balls.mapInPandas(_links_in_balls, "a long, b long, mask int"))
    return links.select(F.floor(F.col("mask") / len(masks)).cast("int").alias("space"), "a", "b")


def link_documents(docs: DataFrame, words_each: int = 3, radius: int = RADIUS, seed: int = SEED, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Fingerprint whole texts and link fingerprints that differ in at most ``radius`` bits.

    Returns ``doc_id, fingerprint`` (16 hex digits) ``, component_id`` (the smallest doc_id that links
    reach) with one row per input row. Null, empty and blank texts have fingerprint 0, which is linked
    like any other. Fewer than ``words_each`` words make one shingle. Null doc_ids keep their row and
    are no component's id unless nothing else is in it. Repeated rows come out repeated. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = written(fingerprints(docs, words_each, seed), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = connected(near_links(classes.select(F.lit(0).alias("space"), "fp"), radius, small_bucket))
    placed = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = placed.join(smallest, "component").select("fp", "component_id")
    return rows.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# Near copies by five-word shingles.

#: Fingerprints per text.
TABLES = 2
#: Texts sampled to learn which shingles are common, and how many of these are kept; both only shape the order of shingles.
SAMPLE_TEXTS = 4096
COMMON = 100_000
#: Texts that share a shingle and are still in different groups are compared in salted blocks of about this size.
SMALL_GROUP = 1024


def _mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """The n-th derived hash (a SplitMix64 step)."""
    x = hashes + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_fingerprints(words: np.ndarray, count: np.ndarray, tables: int) -> list[int]:
    """Majority words of ``tables`` derived hashes of the distinct ``words``, weighted by the root of their count, 4096 words at a time.

    Weights are whole sixteenths, so that sums are exact in any order.
    """
    weights, sums = np.round(16 * np.sqrt(count)).astype(np.float32), np.zeros(64 * tables)
    for at in range(0, len(words), 4096):
        hashes = np.stack([_mixed(words[at : at + 4096], k) for k in range(tables)], axis=1)
        bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")
        sums += weights[at : at + 4096] @ bits.astype(np.float32)
    ahead = 2 * sums > weights.sum(dtype=np.float64)
    return np.packbits(ahead, bitorder="little").view(np.uint64).tolist()


def histogram(shingles: np.ndarray) -> bytes:
    """Counts of a set's hashes in a power of two of bins, about four to a bin; empty if a count does not fit a byte."""
    bins = 1 << int(np.clip(np.round(np.log2(max(len(shingles), 1) / 4)), 4, 12))
    counts = np.bincount((shingles & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_shared(a: bytes, b: bytes) -> int:
    """The most members that two sets with these histograms can share: in no bin more than the lesser count. -1 if nothing is known."""
    if not a or not b:
        return -1
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, n).sum(axis=0), y.reshape(-1, n).sum(axis=0)).sum())


def possible(pairs: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """``pairs`` (with ``a, b``) without those whose sets cannot have a similarity of ``least``, by ``rep, size, hist`` of each; no other is lost."""

    @F.pandas_udf("int")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([most_shared(x, y) for x, y in zip(a, b)], dtype="int32")

    both = pairs.join(facts.toDF("a", "na", "ha"), "a").join(facts.toDF("b", "nb", "hb"), "b").withColumn("most", shared("ha", "hb"))
    # Hashes that a set's 32-bit form joins could share one member less.
    kept = (F.col("most") < 0) | (F.col("most") + 1 >= least * (F.col("na") + F.col("nb") - F.col("most") - 1))
    return both.where(kept).select(*pairs.columns).distinct()


def shingle_sets(docs: DataFrame, words_each: int) -> DataFrame:
    """``doc_id, shingles``: the distinct shingles of whole texts as 32-bit hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t or b"", words_each).astype(np.uint32)).view(np.int32) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int32()))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, shingles array<int>")


def resembling(pairs: DataFrame, docs: DataFrame, words_each: int, least: float) -> DataFrame:
    """The ``pairs`` (doc_ids ``a, b``) whose shingle sets have a Jaccard similarity of ``least`` or more, by whole texts.

    Only texts in a pair are hashed; each pair brings its two sets together. The result is written.
    """
    members = written(pairs.select("a").union(pairs.select("b")).toDF("_gw_member").distinct(), "members")
    sets = written(shingle_sets(docs.join(members, docs["doc_id"] == members["_gw_member"], "left_semi"), words_each), "shingles")
    both = pairs.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    out = written(both.where(shared >= least * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "alike")
    discard(members, sets)
    return out


def common_shingles(docs: DataFrame, words_each: int, most: int = COMMON, texts: int = SAMPLE_TEXTS) -> np.ndarray:
    """Shingles (XXH64) that three or more of about ``texts`` sampled texts hold, rarest first, the ``most`` most frequent at most."""
    n = docs.count()
    sample = docs if n <= texts else docs.where(F.pmod(F.xxhash64("doc_id", F.lit("texts")), F.lit(1 << 30)) < int((1 << 30) * texts / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t or b"", words_each)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["token"])

    counted = sample.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n >= 3")
    rows = counted.orderBy(F.desc("n"), "token").limit(most).collect()
    return np.array([r["token"] for r in reversed(rows)], np.int64).view(np.uint64)


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first of the distinct, sorted ``shingles`` in one order for all texts: uncommon ones by hash, then ``common`` ones, rarest first.

    Two sets of similarity ``least`` or more share at least ``least`` of either's members, so that leaving out
    one member less than that of each still leaves their first common member in both prefixes.
    ``common`` has the common shingles sorted and the rank of each.
    """
    length = len(shingles) - int(np.ceil(least * len(shingles) - 1e-9)) + 1
    known, rank = common
    if not len(known):
        return shingles[:length]
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    found = known[at] == shingles
    rare = shingles[~found][:length]
    if len(rare) == length:
        return rare
    return np.concatenate([rare, shingles[found][np.argsort(rank[at[found]])][: length - len(rare)]])


def _able(least: float, size_a, size_b, pos_a, pos_b):
    """Whether two sets that first meet at these places of their orders can reach ``least``, for arrays as for columns."""
    left_a, left_b = size_a - pos_a, size_b - pos_b
    need = least / (1 + least) * (size_a + size_b) - 1e-6
    return (size_a >= least * size_b - 1e-6) & (size_b >= least * size_a - 1e-6) & (left_a >= need) & (left_b >= need)


def _leads(least: float):
    """Whether a text can be the smaller one (or one of two equals) of a pair that first meets at its ``pos``: enough of it is left to reach ``least`` with a set of its own size, which asks least of it."""
    return F.col("size") - F.col("pos") >= 2 * least / (1 + least) * F.col("size") - 1e-6


def meetings(texts: DataFrame, least: float) -> DataFrame:
    """Every shingle of a prefix where a pair can first meet: ``token, rep, size, pos``, and of the least text ``head, head_size, head_pos``.

    Left out are shingles that one text alone has there, and those at which no text leads: of two sets that reach ``least`` the smaller one leads
    where they first meet, so what stands late in all prefixes (a template that its texts fill differently) joins nobody.
    """
    rows = texts.select(F.posexplode("prefix").alias("pos", "token"), "rep", "size")
    # Least and greatest are combined before the shuffle, and a shingle of very many texts is split by the join.
    heads = rows.groupBy("token").agg(F.min(F.struct("rep", "size", "pos")).alias("h"), F.max("rep").alias("l"), F.bool_or(_leads(least)).alias("led")).where("h.rep != l AND led")
    met = rows.join(heads.drop("l", "led").hint("merge"), "token")
    return met.select("token", "rep", "size", "pos", F.col("h.rep").alias("head"), F.col("h.size").alias("head_size"), F.col("h.pos").alias("head_pos"))


def open_pairs(met: DataFrame, least: float, small_group: int = SMALL_GROUP) -> DataFrame:
    """Pairs ``a, b`` of texts (with their groups ``ga, gb``) of different groups (``component``) that meet and can have a similarity of ``least``.

    Shingles whose texts are all of one group are left out at once. Texts that lead meet those of their size or more; texts that do not lead never meet each other.
    Sets whose sizes differ by more than ``least`` never meet: sizes fall into classes of that ratio, and a text joins the leading ones of its own and the next lower class.
    A shingle with more than ``small_group`` leading texts of a class is joined in salted blocks, so no task takes a whole such shingle.
    """
    counts = met.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    rows = met.join(counts.where("lo != hi").select("token"), "token").select("token", "rep", "size", "pos", "component")
    rows = written(rows.withColumn("class", F.floor(F.log("size") / float(-np.log(least)) + 1e-9).cast("int")), "open")
    leading = rows.where(_leads(least))
    blocks = leading.groupBy("token", "class").agg(F.ceil(F.count("*") / small_group).cast("int").alias("blocks"))
    one = leading.join(blocks, ["token", "class"]).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
    other = rows.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") - 1))).join(blocks, ["token", "class"])
    other = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = other.select("token", "class", "salt", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("size").alias("size_b"), F.col("pos").alias("pos_b"))
    larger = (F.col("size") < F.col("size_b")) | ((F.col("size") == F.col("size_b")) & (F.col("rep") > F.col("b")))
    pairs = one.join(other, ["token", "class", "salt"]).where((F.col("component") != F.col("cb")) & larger)
    pairs = pairs.where(_able(least, F.col("size"), F.col("size_b"), F.col("pos"), F.col("pos_b")))
    first = F.col("rep") < F.col("b")
    ordered = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in [("rep", "b", "a"), ("b", "rep", "b"), ("component", "cb", "ga"), ("cb", "component", "gb")]]
    return pairs.select(*ordered).distinct()


def prefix_pairs(texts: DataFrame, least: float, small_group: int = SMALL_GROUP) -> DataFrame:
    """All pairs ``a, b`` of texts (with their groups ``ga, gb``) of different groups whose shingle sets can have a similarity of ``least``.

    ``texts`` has ``rep``, ``component``, ``size`` (of the set) and ``prefix``. Texts meet at every shingle of their prefixes; sizes and places
    tell at once which cannot reach ``least``. Nothing else is left out.
    """
    return open_pairs(meetings(texts, least).join(texts.select("rep", "component"), "rep"), least, small_group)


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (``node, component``) after ``links`` (``a, b``) between components or lone nodes joined them; each takes the least id."""
    # What is in no such link keeps its group.
    merged = connected(links).toDF("group", "component_id")
    lone = merged.select(F.col("group").alias("node"), F.col("group").alias("component")).join(groups, "node", "left_anti")
    every = groups.union(lone).join(merged, F.col("component") == F.col("group"), "left")
    return written(every.select("node", F.coalesce("component_id", "component").alias("component")), "groups")


def near_copies(docs: DataFrame, words_each: int = 5, least: float = 0.8, radius: int = RADIUS, tables: int = TABLES) -> DataFrame:
    """Groups of exact and near copies: ``doc_id, component_id`` for every doc_id in a group of two or more.

    Equal texts are linked at once; of each only one goes on. Two rounds link the rest, and in both the Jaccard similarity of
    whole shingle sets decides. The first takes few candidates that link most near copies: the covering buckets of ``tables``
    SimHash fingerprints over single words (weight: root of the count), which change little where near copies differ, and each
    text with the least text that shares a shingle of its prefix. The second is complete: every pair that links do not join yet and
    that the prefix filter cannot rule out. Rows with null doc_id or with no word take no part.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, fps, wholes, sizes, prefixes, hists = batch.column("doc_id"), [], [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words, count = np.unique(shingle_hashes(text or b"", 1), return_counts=True)
                fps.append(word_fingerprints(words, count, tables))
                shingles = np.unique(shingle_hashes(text or b"", words_each))
                sizes.append(len(shingles))
                hists.append(histogram(shingles))
                prefixes.append(prefix(shingles, common.value, least).view(np.int64) if len(words) else None)
                wholes.append(xxhash.xxh128_digest(b" ".join((text or b"").lower().split())))
            flat = pa.array(np.array(fps, np.uint64).reshape(-1).view(np.int64))
            offsets = pa.array(np.arange(len(fps) + 1, dtype=np.int32) * tables)
            columns = {"doc_id": ids, "whole": pa.array(wholes, pa.binary()), "fps": pa.ListArray.from_arrays(offsets, flat)}
            yield pa.RecordBatch.from_pydict(columns | {"size": pa.array(sizes, pa.int32()), "hist": pa.array(hists, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64()))})

    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    ranked = common_shingles(named, words_each)
    by_hash = np.argsort(ranked)
    common = docs.sparkSession.sparkContext.broadcast((ranked[by_hash], by_hash))
    hashed = written(named.mapInArrow(run, f"doc_id {kind}, whole binary, fps array<long>, size int, hist binary, prefix array<long>"), "hashed")
    rows = hashed.where(F.col("prefix").isNotNull())
    copied = (F.min("doc_id") != F.max("doc_id")).alias("copied")
    texts = written(rows.groupBy("whole").agg(F.min("doc_id").alias("rep"), copied, *[F.any_value(c).alias(c) for c in ("fps", "size", "hist", "prefix")]), "texts")
    # Only texts are linked, each named by its least doc_id; a doc_id that has several texts joins them.
    members = written(rows.select("doc_id", "whole").join(texts.select("whole", "rep", "copied"), "whole").select("doc_id", "rep", "copied"), "placed")
    discard(hashed)
    several = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a != b")
    several = members.join(several.drop("a"), "doc_id").where("rep != b").select(F.col("rep").alias("a"), "b")
    met = written(meetings(texts.select("rep", "size", "prefix"), least), "meetings")
    spread = texts.select("rep", F.posexplode("fps").alias("space", "fp"))
    owners = written(spread.groupBy("space", "fp").agg(F.min("rep").alias("head")), "owners")
    links = near_links(owners.select("space", "fp"), radius)
    heads = owners.toDF("space", "a", "ha"), owners.toDF("space", "b", "hb")
    buckets = links.join(heads[0], ["space", "a"]).join(heads[1], ["space", "b"]).select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    same = spread.join(owners, ["space", "fp"]).where("rep != head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    least_of = met.where("rep != head").where(_able(least, F.col("size"), F.col("head_size"), F.col("pos"), F.col("head_pos"))).select(F.col("rep").alias("a"), F.col("head").alias("b"))
    candidates = buckets.union(same).union(least_of).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    facts = texts.select("rep", "size", "hist")
    candidates = written(possible(candidates, facts, least), "candidates")
    discard(owners)
    found = resembling(candidates, named, words_each, least)
    groups = written(connected(found.union(several)), "groups")
    discard(candidates, found)
    placed = met.join(groups.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    pairs = written(possible(open_pairs(placed, least), facts, least), "pairs")
    discard(met, texts)
    found = resembling(pairs, named, words_each, least)
    every = joined(groups, pairs.join(found, ["a", "b"]).select(F.col("ga").alias("a"), F.col("gb").alias("b"))).toDF("node", "component_id")
    discard(pairs, found, groups)
    grouped = members.join(every, members["rep"] == every["node"], "left").where("copied OR node IS NOT NULL")
    return grouped.select("doc_id", F.coalesce("component_id", "rep").alias("component_id")).distinct()


def dedup_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose doc_id is in a group of near copies but not its least.

    All columns stay as they are. Rows repeated under one doc_id are one document and stay
    together; rows with null doc_id or without words stay.
    """
    gone = near_copies(docs).where("doc_id != component_id").select(F.col("doc_id").alias("_gw_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gw_gone"], "left_anti")
