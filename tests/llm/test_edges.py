"""The corpus operators against brute force, and on nulls, repeated rows, ties, empty tables, very long texts and clashing columns."""

import hashlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweave.llm import ann, html_text, langid, line_dedup, media, models, sharding, simhash, toxicity

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(300))


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# Main text


@pytest.mark.parametrize(("page", "want"), [
    (f"<body class='single has-sidebar'><article><h1>T</h1><p>{LONG}</p></article></body>", f"T\n\n{LONG}"),
    (f"<body><article><div class='article-header'><h1>Title</h1></div><p>{LONG}</p></article></body>", f"Title\n\n{LONG}"),
    (f"<body><article><p>{LONG}</p></article><nav>{'menu ' * 400}</nav><article><p>{LONG}</p></article></body>", f"{LONG}\n\n{LONG}"),
    (f"<body><div><p>{'alpha ' * 20}</p></div><div class=ad>{'buy ' * 30}</div><div><p>{'beta ' * 40}</p></div></body>", ("alpha " * 20).strip() + "\n\n" + ("beta " * 40).strip()),
    (f"<p><a title=it's>link</a> {LONG}</p>", f"link {LONG}"),
    (f"<p><a title=\"a>b\" rel='x>y'>link</a> {LONG}</p>", f"link {LONG}"),
])
def test_main_text_probes(page, want):
    assert html_text.main_text(page, html_text.Weights()) == want


@pytest.mark.parametrize("piece", ["<div>w", "<p>w <b>", "<li>w<ul>", "<a href=\"x", "<a x=' y>w", "<!-- <", "<script>"])
def test_reading_is_linear(piece):
    def took(n):
        best = 9e9
        for _ in range(3):
            start = time.process_time()
            html_text.main_text(piece * n, html_text.Weights())
            best = min(best, time.process_time() - start)
        return best

    assert took(16_000) < 4 * took(8_000) + 0.05


def test_main_text_of_held_out_pages(spark):
    """Every page of the table against its article element, and again with that element taken out of the page."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    weights = html_text.fit_weights(pages)
    taken, found, right = 0, 0, 0
    for r in pages.collect():
        p = html_text.read_page(r["html"])
        want = " ".join(text for tag, text, at in p.tokens if tag is None and html_text._labelled(p, at)).split()
        got = html_text.main_text(html_text._LABEL.sub("", r["html"]), weights)
        got = got.replace("&", "&amp;").replace("<", "&lt;").split()
        taken, found, right = taken + len(got), found + len(want), right + sum(a == b for a, b in zip(got, want))
    assert right > 0.9 * taken and right > 0.9 * found


def test_extract_edges(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b</p>", 9, "x"), (1, "u", "<p>a b</p>", 9, "x"), (2, None, None, 9, "x"), (3, "v", "", 9, "x"), (None, "w", "<p>" + "long " * 100_000 + "</p>", 9, "x")], "page_id long, url string, html string, n_chars int, text string")
    got = html_text.extract(pages, html_text.Weights())
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert rows(got, "page_id", "n_chars") == sorted([(1, 3), (1, 3), (2, 0), (3, 0), (None, 499_999)], key=str)
    assert html_text.extract(pages.limit(0), html_text.fit_weights(pages.limit(0))).count() == 0


# Lines


def test_line_removal_is_linear(spark):
    def took(n):
        lines = [f"line {i}" for i in range(n)]
        docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([*lines[: n // 2], "a", "b", "c", *lines[n // 2 :]]))], "doc_id long, text string")
        start = time.time()
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
        assert got[1] == "\n".join(lines) and got[2] == "a\nb\nc"
        return time.time() - start

    took(1000)
    assert took(64_000) < 3 * took(32_000) + 2


def test_lines_of_repeated_and_clashing_rows(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 7, "k"), (1, "a\nb\nc", 7, "k"), (2, "a\nb\nc\nd", 8, "l"), (None, "a\nb\nc", 9, "m")], "doc_id long, text string, n_lines int, _gw_id string")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    # The null doc_id comes first; rows that agree in id and text come out alike.
    assert rows(got, "doc_id", "text", "n_removed") == sorted([(None, "a\nb\nc", 0), (1, "", 3), (1, "", 3), (2, "d", 3)], key=str)


# Shards


def test_shards_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None), (5, "x", "en", None), (5, "x", "en", None)], docs.schema))
    hashed = docs.select("*", F.pmod(F.xxhash64("lang"), F.lit(32)).alias("hl"), F.pmod(F.xxhash64("source"), F.lit(32)).alias("hs")).collect()
    ids, sizes = [r["doc_id"] for r in hashed if r["doc_id"] is not None], [len((r["text"] or "").encode()) + 16 for r in hashed]
    low, high = np.log2(min(sizes)), np.log2(max(sizes))
    least, span = min(ids), max(ids) - min(ids) + 1
    keyed = []
    for r, size in zip(hashed, sizes):
        cells = [0 if r["lang"] is None else r["hl"], 0 if r["source"] is None else r["hs"], min(31, int((np.log2(size) - low) / (high - low) * 32)), 0 if r["doc_id"] is None else min(31, int((r["doc_id"] - least) / span * 32))]
        keyed.append((int(sharding.hilbert_index(np.array([cells]), 5)[0]), zlib.crc32((r["text"] or "").encode()), (r["doc_id"] is not None, r["doc_id"] or 0), size, r["doc_id"]))
    keyed.sort(key=lambda k: k[:4])
    n = len(keyed)
    want = sorted([(k[4], k[3], i * 7 // n) for i, k in enumerate(keyed)], key=str)
    assert rows(sharding.shard(docs, shards=7), "doc_id", "size", "shard") == want


def test_shards_prune(spark):
    """A filter on language and size meets few shards, which hashing by key would all touch."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    placed = sharding.shard(docs).join(docs.select("doc_id", "lang"), "doc_id")
    met = placed.where("lang = 'de' AND size > 4000").select("shard").distinct().count()
    assert 0 < met <= 24


# Language


def test_language_equals_row_at_a_time(spark):
    coder = langid.fit_coder(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang"))
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()] + [None, "", "123 !?", "a"]
    for text, (lang, score, _) in zip(texts, coder.predict_all(texts, rows=7)):
        x = langid.features(text)
        if x is None:
            assert (lang, score) == ("und", 0.0)
            continue
        losses = []
        for code in coder.codes:
            total = sum(t * np.log1p(np.exp(-c * np.clip(float(x @ w) + b, -20, 20))) for c, w, b, t in zip(code, coder.weights.T, coder.biases, coder.trust))
            losses.append(total / coder.trust.sum())
        share = np.exp(-4 * (np.array(losses) - min(losses)))
        assert lang == coder.languages[int(np.argmin(losses))] and abs(score - share.max() / share.sum()) < 1e-4


def test_language_of_many_languages_samples_no_more(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 90)
    docs = spark.createDataFrame([(i, f"{'abcdefghij'[i % 9] * 3} text {i}", f"l{i % 9}") for i in range(1800)], "doc_id long, text string, lang string")
    coder = langid.fit_coder(docs)
    assert len(coder.languages) == 9 and coder.codes.shape == (9, 64)
    clash = spark.createDataFrame([(1, "aaa text", "x", 1.0, True)] * 2, "doc_id long, text string, lang_pred string, score double, _gw_found boolean")
    got = langid.identify(clash, coder)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "ambiguous"] and got.count() == 2
    assert langid.identify(clash.limit(0), coder).count() == 0


# Toxicity


def test_chain_equals_row_at_a_time():
    chain = toxicity.Chain(["a", "b"], ["x", "y"], [np.array([1.0, -2.0]), np.array([0.5, 3.0, -4.0])], [0.1, -0.2])
    texts = ["x", "Y y", "x, y!", None, "", "z"]
    got = chain.probabilities(texts)
    for text, (p, q) in zip(texts, got):
        x, y = float("x" in (text or "").lower()), float("y" in (text or "").lower())
        first = 1 / (1 + np.exp(-(x - 2 * y + 0.1)))
        assert abs(p - first) < 1e-12 and abs(q - 1 / (1 + np.exp(-(0.5 * x + 3 * y - 4 * first - 0.2)))) < 1e-12


def test_best_cut_equals_brute_force():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        p, y = rng.integers(0, 9, 30) / 10 + 0.05, (rng.random(30) < 0.3).astype(float)
        f1 = lambda cut: 2 * (y * (p >= cut)).sum() / ((p >= cut).sum() + y.sum())
        cut = toxicity.best_cut(p, y)
        assert y.sum() == 0 and cut == 1 or f1(cut) == max(f1(c) for c in p)


def test_fit_does_not_hang_on_rounding():
    rng = np.random.default_rng(3)
    x, w = (rng.random((2000, 300)) < 0.05).astype(np.float32), rng.normal(size=300)
    y = (x @ w > 0.5).astype(float)
    order = rng.permutation(len(x))
    one, other = models.fit_logistic(x, y), models.fit_logistic(x[order], y[order])
    assert np.abs(models.sigmoid(x @ one[0] + one[1]) - models.sigmoid(x @ other[0] + other[1])).max() < 1e-3


def test_toxicity_learns_words_not_noise(spark):
    rng = np.random.default_rng(5)
    bad = ["vile", "foul", "mean"]
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 400, 60)) + (" " + bad[k % 3] if k % 8 == 0 else "") for k in range(800)]
    # One label in twenty is wrong.
    data = [(k, t, int(k % 5 == 0), int((k % 8 == 0) != (rng.random() < 0.05))) for k, t in enumerate(texts)]
    chain = toxicity.fit_chain(spark.createDataFrame(data, "doc_id long, text string, low long, toxic long"), ["low", "toxic"])
    docs = spark.createDataFrame([(k, t, 1.0, False) for k, t in enumerate(texts)], "doc_id long, text string, p_toxic double, rejected boolean")
    got = toxicity.score(docs, chain)
    assert got.columns == ["doc_id", "text", "p_low", "p_toxic", "rejected"]
    assert {r["doc_id"] for r in got.where("rejected").collect()} == set(range(0, 800, 8))
    assert toxicity.score(docs.limit(0), chain).count() == 0
    at = got.where("doc_id = 0").first()["p_toxic"]
    assert toxicity.score(docs.where("doc_id = 0"), chain, at).first()["rejected"]


# Media


def test_media_facts_equal_brute_force(spark):
    kept = {r["doc_id"]: r for r in media.query(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        body = (r["text"] or "").encode()
        padded = body + bytes(-len(body) % 64 if body else 64)
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        columns = [sum(padded[c::64]) for c in range(64)]
        mean = sum(padded) / len(padded)
        dev = (sum(b * b for b in padded) / len(padded) - mean * mean) ** 0.5
        sign = sum(1 << (63 - c) for c in range(64) if columns[c] * 64 > sum(columns))
        got = kept[r["doc_id"]]
        assert (got["media_bytes"], got["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert got["feature"].startswith(f"h={len(padded) // 64};mean={mean:.6f};dev={dev:.6f};zero={padded.count(0) / len(padded):.6f};sign={sign:016x};at={got['position']}/")
        paragraphs = [line for line in (r["text"] or "").split("\n") if line.split()]
        assert got["caption"] == f"{len(body)} bytes" and got["position"] == len(paragraphs)


def test_media_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    pages, payloads = media.text_media(docs)
    assert media.parse(pages).count() == 0 and media.image_features(payloads).count() == 0
    with pytest.raises(ValueError):
        media.from_image(b"P5\n64 2\n255\n" + bytes(64))


# Neighbours


def test_neighbours_recall_on_many_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(200, 32))
    vectors = (centres[rng.integers(0, 200, 20_000)] + 0.7 * rng.normal(size=(20_000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = ann.neighbours(df, df.where("vec_id % 400 = 0"), reranked=128).collect()
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 20_000, 400):
        score = unit @ unit[q]
        score[q] = -9
        hits += len(set(np.argsort(-score)[:5].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    # 128 of each block of 4,096 are scored exactly: about 3 %.
    assert len(got) == 250 and hits >= 0.9 * 250


def test_neighbours_ties_repeats_and_lengths(spark):
    data = [(i, [1.0, 0.0]) for i in (9, 3, 5, 7)] + [(9, [1.0, 0.0]), (4, [0.0, 1.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (8, [])]
    df = spark.createDataFrame([(i, [float(x) for x in v], "k") for i, v in data], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in ann.neighbours(df, df.where("vec_id IN (5, 2)"), k=4).collect())
    assert got == [(2, 1, 1, pytest.approx(0.5**0.5)), (5, 1, 3, 1.0), (5, 2, 7, 1.0), (5, 3, 9, 1.0), (5, 4, 4, 0.0)]


# SimHash and near copies


def test_histograms_bound_what_sets_share():
    rng = np.random.default_rng(11)
    for n in (1, 7, 60, 500, 5000, 30_000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for kept in (0.0, 0.5, 0.95):
            b = np.unique(np.concatenate([a[: int(n * kept)], rng.integers(0, 2**64, int(n * 1.2 * (1 - kept)) + 1, dtype=np.uint64)]))
            assert simhash.most_shared(simhash.histogram(a), simhash.histogram(b)) >= len(np.intersect1d(a, b))
    crowded = np.arange(300, dtype=np.uint64) << np.uint64(20)
    assert simhash.histogram(crowded) == b"" and simhash.most_shared(b"", simhash.histogram(crowded[:9])) == -1


def test_links_of_nothing_and_of_ties(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.link_documents(none).count() == 0
    docs = spark.createDataFrame([(4, "a b c d"), (2, "A B C D"), (2, "a b c d"), (None, "a b c d"), (7, None), (6, "")], "doc_id long, text string")
    got = rows(simhash.link_documents(docs), "doc_id", "component_id")
    assert got == sorted([(4, 2), (2, 2), (2, 2), (None, 2), (7, 6), (6, 6)], key=str)


def test_large_group_of_near_copies(spark):
    """More near copies than a block holds, and as many texts that only share a passage with each other."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 200)]
    passage = [f"p{i}" for i in range(40)]
    data = []
    for k in range(150):
        words = list(base)
        words[int(rng.integers(200))] = f"c{k}"
        data.append((k, " ".join(words)))
        data.append((1000 + k, " ".join(passage + [f"u{k}x{i}" for i in range(20)])))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert got == {k: 0 for k in range(150)}


# Pipeline


def test_stages_on_hard_rows(spark, tmp_path):
    """Null texts, repeated rows, an empty table; every stage keeps what is clean and the columns of documents."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    line = "\n".join(f"a line of text number {i}" for i in range(30))
    data = [(1, line, "en", "s", len(line)), (1, line, "en", "s", len(line)), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "plain words here", "en", None, 16), (5, line + "\nmore", "en", "t", 9), (6, "other plain words", "en", "t", 17)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(data, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert rows(kept, "doc_id") == rows(docs, "doc_id")
    lines = corpus_pipeline.drop_lines(spark, kept, str(tmp_path))
    assert rows(lines, "doc_id", "n_chars")[-1] == (6, 17) and lines.where("doc_id = 5").first()["text"] == "more"
    near = corpus_pipeline.drop_near_copies(spark, lines, str(tmp_path))
    assert [r[0] for r in rows(near, "doc_id")] == [1, 1, 2, 3, 4, 5, 6]
    mixed = corpus_pipeline.mix_sources(spark, near, str(tmp_path))
    assert mixed.columns == docs.columns and set(rows(mixed, "doc_id")) <= set(rows(near, "doc_id"))
    tokens = corpus_pipeline.tokenize(spark, near, str(tmp_path))
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.collect()}[2] == 0 and tokens.count() == near.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    toxic = F.lower("text").rlike("idiot|moron|scum|worthless|pathetic|clown|trash|loser|disgusting|stupid")
    kept = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.01").select("doc_id").withColumn("kept", F.lit(1))
    got = docs.select("doc_id", F.coalesce(toxic, F.lit(False)).alias("toxic")).join(kept, "doc_id", "left").groupBy("toxic").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("kept")).collect()
    share = {r["toxic"]: r["kept"] for r in got}
    assert share[True] < 0.1 and share[False] > 0.95


def test_mix_stage_comes_near_its_targets(spark):
    import corpus_pipeline

    from graphweave.llm.mixing import mix

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = {r["source"]: r["target"] for r in mix(docs).select("source", "target").distinct().collect()}
    got = corpus_pipeline.mix_sources(spark, docs, "/root/testdata/sf0.01")
    words = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))).alias("n")).collect()}
    for source, target in wanted.items():
        assert abs(words.get(source, 0) - target) < 0.1 * target + 3000
    assert got.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
