"""Ranked lexical search against exhaustive scoring."""

import math
import re
from collections import Counter

import numpy as np

from graphweave.llm import lexical

DOCS, ITEMS = "doc_id long, text string, item_id long, rank int, score string", "item_id long, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k):
    held = [(i, Counter(split(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in held]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in held for t in c)
    once = {}
    for i, t in items:
        once[i] = t if once.get(i) is None else once[i] if t is None else min(t, once[i])
    out = set()
    for item, text in once.items():
        scores = []
        for (i, c), n in zip(held, lengths):
            s = 0
            for t in split(text):
                if c[t]:
                    m = 75 + 25 * n * n_docs // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out |= {(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def compare(spark, docs, items, k=20, partitions=3):
    got = lexical.search(spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], DOCS).repartition(partitions), spark.createDataFrame([(i, t, "y") for i, t in items], ITEMS), k).collect()
    want = brute(docs, items, k)
    assert len(got) == len(want) and {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got} == want


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    share = 1 / np.arange(1, 401)
    share /= share.sum()
    return rng, words, [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=share))) for i in range(n)]


def test_search_equals_exhaustive_scoring(spark, monkeypatch):
    rng, words, docs = corpus(5, 600)
    # Copies tie, passages repeat, one text is very long, some hold nothing, ids are null or repeated.
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [docs[4], (None, docs[5][1]), (2000, None), (2001, ""), (2002, "--- !!"), (2003, "w1 w9 " * 20000), (2004, "É été ÀB ß w300"), (-5, docs[3][1])]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(30)] + [(100, docs[3][1]), (101, None), (102, ""), (103, "w300 " * 5 + "W300 w1"), (104, "nowhere"), (105, "é ÉTÉ été ß"), (None, "w7 w8"), (106, "w5 w6"), (106, "w5 w6"), (107, "w9"), (107, "w10")]
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 128)
    monkeypatch.setattr(lexical, "RUN_DOCS", 8)
    compare(spark, docs, items)
    compare(spark, docs, items, k=3)
    # The same in several passes over the documents.
    monkeypatch.setattr(lexical, "PASS_BYTES", 1500)
    compare(spark, docs, items)


def test_search_of_nothing(spark):
    _, _, docs = corpus(6, 20)
    compare(spark, docs, [])
    compare(spark, [], [(1, "w1")])
    compare(spark, [(1, None), (2, "")], [(1, "w1")])
    compare(spark, [(1, "same"), (2, "same")], [(1, "same")])


def test_pair_bounds_skip_what_single_bounds_do_not():
    """Where two terms seldom stand together, their maxima add up singly but not jointly."""
    rng = np.random.default_rng(7)
    n, n_terms = 4096, 40
    # Each document has one of two neighbouring terms, one run in sixteen has documents with both.
    docs, found = [], []
    for d in range(n):
        for t in range(0, n_terms, 2):
            for u in (t, t + 1) if d // 64 % 16 == 7 and d % 9 == 0 else (t + d % 2,):
                docs.append(d)
                found.append(u)
    docs, found = np.array(docs), np.array(found)
    scores = rng.integers(900, 1000, len(docs))
    order = np.lexsort((docs, found))
    docs, found, scores = docs[order], found[order], scores[order]
    starts = np.searchsorted(found, np.arange(n_terms + 1))
    block = lexical.Block(np.arange(n), np.zeros(n, bool), {t: slice(starts[t], starts[t + 1]) for t in range(n_terms)}, docs, scores, {})
    weights = np.ones(n_terms, np.int64)
    dense = np.zeros((n_terms, n), np.int64)
    dense[found, docs] = scores
    query = {t: 1 + t // 2 % 3 for t in range(12)}
    groups = lexical.paired(query, weights)
    for g in groups:
        block.pairs[min(g), max(g)] = lexical.pair_list(block, *g)
    total = sum(c * dense[t] for t, c in query.items())
    want = sorted(range(n), key=lambda d: (-total[d], d))[:5]
    seen = {}
    for by_pairs in (True, False):
        kept, found_scores, seen[by_pairs] = lexical.best_of(block, query, groups, 1, 5, by_pairs)
        top = kept[np.lexsort((kept, -found_scores))[:5]]
        assert top.tolist() == want and (total[kept] == found_scores).all()
        for g in groups:
            runs = sum(query[t] * dense[t] for t in g).reshape(-1, lexical.RUN_DOCS).max(axis=1)
            assert (block.bound(g, query, by_pairs) >= runs).all()
    assert seen[True] < 0.2 * seen[False]
