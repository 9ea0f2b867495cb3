"""The corpus operators on small fixtures: brute force, and the cases their docstrings define."""

import hashlib
import zlib

import numpy as np
import pytest

from graphweave.llm import ann, bpe, html_text, langid, line_dedup, media, mixing, registry, sharding, simhash, toxicity
from tests.compare import duck_rows, spark_rows

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos string, size string, key string"
TEXTS = ["a b c", None, "", "a b c", "one\ntwo\nthree\nfour", "x\none\ntwo\nthree", "é ñ    z\t\n", "!!! 123", "w" * 5000, "one two three four five six " * 300]


def small(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, None, "p", "q", "r") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id", None, None, None, None, None, None)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    got, want = spark_rows(registry.QUERIES[name](spark, DATA)), duck_rows(registry.SQL[name], DATA)
    assert got == want


def test_line_windows(spark):
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(small(spark)).collect()}
    assert rows[4]["text"] == "one\ntwo\nthree\nfour" and rows[4]["n_removed"] == 0
    assert rows[5]["text"] == "x" and rows[5]["n_removed"] == 3
    assert rows[1]["text"] is None and rows[1]["n_lines"] == 0 and rows[2]["text"] == "" and rows[None]["text"] == "no id"
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_mix(spark):
    rows = mixing.mix(small(spark)).collect()
    assert len(rows) == 12 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(empty(spark)).count() == 0


def test_shards(spark):
    for law in ("rows", "bytes"):
        rows = sharding.shard(small(spark), shards=3, law=law).collect()
        assert len(rows) == 12
        for s in {r["shard"] for r in rows}:
            slots = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert slots == list(range(len(slots)))
    counts = np.bincount([r["shard"] for r in sharding.shard(small(spark), shards=5).collect()])
    assert counts.max() - counts.min() <= 1
    assert sharding.shard(empty(spark)).count() == 0


def test_hilbert_steps_to_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    index = sharding.hilbert_index(grid, 3)
    path = grid[np.argsort(index)]
    assert sorted(index) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_covering_masks_meet_every_pair():
    masks, rng = simhash.covering_masks(3), np.random.default_rng(0)
    for _ in range(2000):
        flips = sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 4), replace=False))
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("bucket", [1, 1024])
def test_simhash_components(spark, bucket):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(small(spark).where("doc_id < 4").selectExpr("doc_id + 1000000 AS doc_id", "text"))
    rows = {r["doc_id"]: r for r in simhash.link_documents(docs, small_bucket=bucket).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fp = {i: simhash.majority_bits(simhash.shingle_hashes((t or "").encode(), 3)) for i, t in texts.items()}
    label = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            least = min(label[j] for j in texts if (fp[i] ^ fp[j]).bit_count() <= 3)
            if least < label[i]:
                label[i], changed = least, True
    assert {i: r["component_id"] for i, r in rows.items()} == label
    assert all(r["fingerprint"] == f"{fp[i]:016x}" for i, r in rows.items())


def test_near_copies(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 5000, 600)]
    near = [*words]
    near[100] = "changed"
    other = [f"v{i}" for i in rng.integers(0, 5000, 600)]
    rows = [(3, " ".join(words)), (7, " ".join(words)), (9, " ".join(near)), (1, " ".join(other)), (4, None), (5, "")]
    kept = simhash.dedup_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]
    assert simhash.dedup_near_copies(empty(spark)).count() == 0


def test_near_copies_equal_brute_force(spark):
    """Groups against all pairs' exact similarity, with near copies on both sides of 0.8 and repeated passages."""
    rng = np.random.default_rng(4)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for base in range(30):
        words = [f"w{i}" for i in rng.integers(0, 3000, int(rng.integers(60, 500)))]
        texts[10_000 + 10 * base] = " ".join(words)
        for copy in range(1, 4):
            changed = [f"x{rng.integers(9999)}" if rng.random() < 0.012 * copy else w for w in words]
            texts[10_000 + 10 * base + copy] = " ".join(changed)
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        if words:
            sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    grouped = {i for pair in pairs for i in pair}
    assert len(grouped) > 60 and got == {i: label[i] for i in grouped}


def brute_near_copies(texts):
    """Label of every text in a group, by all pairs' exact similarity."""
    sets = {}
    for i, t in texts.items():
        words = t.encode().lower().split()
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {i: label[i] for pair in pairs for i in pair}


def test_near_copies_with_blocks(spark):
    """Blocks of new words put before, into or after a text, or cut off it, on both sides of 0.8."""
    rng, texts = np.random.default_rng(9), {}
    for base in range(24):
        n = int(rng.integers(20, 300))
        words, fresh = [f"w{i}" for i in rng.integers(0, 10**6, n)], [f"x{i}" for i in rng.integers(0, 10**6, n)]
        k = int(n * (0.1, 0.17, 0.22, 0.3)[base % 4])
        texts |= {10 * base: " ".join(words), 10 * base + 1: " ".join(words + fresh[:k]), 10 * base + 2: " ".join(fresh[k : 2 * k] + words)}
        texts |= {10 * base + 3: " ".join(words[: n // 2] + fresh[-k:] + words[n // 2 :]), 10 * base + 4: " ".join(words[: n - k // 2])}
    want = brute_near_copies(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert len(want) > 60 and got == want


def test_near_copies_in_equal_words(spark):
    """Texts of one bag of words have equal fingerprints; one of another order is no copy and must not stand between those that are."""
    rng = np.random.default_rng(10)
    words = [f"w{i}" for i in range(200)]
    texts = {1: " ".join(rng.permutation(words)), 2: " ".join(words), 3: " ".join(words[:100] + [words[101], words[100]] + words[102:])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()} == brute_near_copies(texts) == {2: 2, 3: 2}


def test_prefix_pairs_of_common_shingles(spark):
    """A shingle with more texts than one block holds pairs all of them, but for those of one group."""
    rows = [(i, i // 2, 3, [7, 100 + i]) for i in range(40)] + [(90, 90, 9, [7, 8])]
    texts = spark.createDataFrame(rows, "rep long, component long, size int, prefix array<long>")
    want = {(i, j) for i in range(40) for j in range(i) if i // 2 != j // 2}
    for most in (4, 1024):
        got = [(r["b"], r["a"]) for r in simhash.prefix_pairs(texts, 0.8, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_prefix_pairs_lose_none_and_templates_join_nobody(spark):
    """Random sets over few shingles: every pair of similarity 0.8 or more is there. Texts that share 84 % of their shingles, met late in the order, are no pairs and meet nowhere."""
    rng = np.random.default_rng(5)
    base = [rng.choice(60, size=n, replace=False) for n in (10, 15, 20, 25, 30)]
    sets = {i: set(int(x) for x in rng.permutation(base[i % 5])[: len(base[i % 5]) - int(rng.integers(0, 4))]) | {int(x) for x in rng.choice(60, size=int(rng.integers(0, 3)))} for i in range(120)}
    cut = lambda s: s[: len(s) - int(np.ceil(0.8 * len(s) - 1e-9)) + 1]
    schema = "rep long, component long, size int, prefix array<long>"
    texts = spark.createDataFrame([(i, i, len(s), cut(sorted(s))) for i, s in sets.items()], schema)
    alike = {(i, j) for i in sets for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    for most in (2, 1024):
        got = [(r["b"], r["a"]) for r in simhash.prefix_pairs(texts, 0.8, most).collect()]
        assert len(alike) > 50 and len(got) == len(set(got)) and alike <= set(got)
    filled = spark.createDataFrame([(i, i, 100, cut([1000 + 16 * i + k for k in range(16)] + [10**6 + k for k in range(84)])) for i in range(300)], schema)
    assert filled.selectExpr("max(size(prefix)) AS n").first()["n"] == 21
    assert simhash.meetings(filled, 0.8).count() == 0


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path, pattern = bpe.tokenizer()
    ranks = bpe.read_ranks(spark, path)
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = small(spark).unionByName(spark.createDataFrame([(50, "\x1c\x1d a b  c\n\n d's <|endoftext|> 日本語", None, None, None, None, None, None)], SCHEMA))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = bpe.digests(bpe.encode(docs, path, pattern, block_bytes=2000), path).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = encoder.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode(empty(spark), path, pattern).count() == 0


def test_media_round_trip(spark):
    rows = {r["doc_id"]: r for r in media.query(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        body = (r["text"] or "").encode()
        padded = body + bytes(-len(body) % 64 if body else 64)
        got = rows[r["doc_id"]]
        assert (got["n_bytes"], got["payload_bytes"], got["tail_crc32"]) == (len(body), len(padded), zlib.crc32(padded[-64:]))
        assert got["payload_sha256"] == hashlib.sha256(padded).hexdigest()


def test_sequences_stay_aligned(spark):
    page = '<p>one</p><figure><img src="%s"><figcaption>first</figcaption></figure><p>two<img src="%s" alt="second">three</p>' % ("a" * 64, "b" * 64)
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    parsed = media.parse(pages)
    kinds = {r["page_id"]: [e["kind"] for e in r["sequence"]] for r in parsed.collect()}
    assert kinds == {1: ["text", "media", "text", "media", "text"], 2: [], 3: []}
    store = spark.createDataFrame([("b" * 64, 7), ("b" * 64, 7)], "digest string, size int")
    got = sorted((r["position"], r["caption"], r["size"]) for r in media.resolve(parsed, "page_id", store, ["size"]).collect())
    assert got == [(1, "first", None), (3, "second", 7)]


def test_language(spark):
    held = {r["doc_id"]: r for r in langid.query(spark, DATA).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    tried = [i for i, r in held.items() if r["held_out"]]
    assert np.mean([held[i]["lang_pred"] == truth[i] for i in tried]) > 0.9
    coder = langid.fit_coder(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang"))
    rows = {r["doc_id"]: r for r in langid.identify(small(spark), coder).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 7))
    assert langid.fit_coder(empty(spark).select("doc_id", "text", "lang")).predict("abc")[0] == "und"


def test_codewords_differ():
    for k in (2, 4, 9, 30):
        codes = langid.codewords(k)
        assert min((codes[a] != codes[b]).sum() for a in range(k) for b in range(a)) >= 1


def test_toxicity_chain(spark):
    rows = [(i, f"plain words number {i} here" + (" vile" if i % 4 == 0 else "") + (" %%%" if i % 5 == 0 else ""), int(i % 5 == 0), int(i % 4 == 0)) for i in range(400)]
    chain = toxicity.fit_chain(spark.createDataFrame(rows, "doc_id long, text string, low long, toxic long"), ["low", "toxic"])
    fresh = spark.createDataFrame([(1, "vile things"), (2, "nice things"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["rejected"] for r in toxicity.score(fresh, chain).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    blank = toxicity.fit_chain(spark.createDataFrame([], "doc_id long, text string, low long, toxic long"), ["low", "toxic"])
    assert not any(r["rejected"] for r in toxicity.score(fresh, blank).collect())


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 16)).astype(np.float32)
    vectors[7] = vectors[50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.neighbours(df, df.where("vec_id % 50 = 0")).collect()
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 300, 50):
        score = unit @ unit[q]
        score[q] = -9
        hits += len(set(np.argsort(-score)[:5]) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 27 and len(got) == 30
    assert ann.neighbours(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


def test_best_run():
    for seed in range(50):
        s = np.random.default_rng(seed).integers(-5, 5, 12).tolist()
        a, b = html_text.best_run(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(12) for j in range(i + 1, 13))])


def test_main_text():
    page = "<html><head><title>T</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy now</div><div><h1>Head &amp; line</h1><p>First  long\nparagraph of <a href=y>many</a> words<p>second paragraph of words</div><aside>side</aside><div class=comments><p>nice post</div><footer>end</footer>"
    weights = html_text.Weights()
    assert html_text.main_text(page, weights) == "Head & line\n\nFirst long paragraph of many words\n\nsecond paragraph of words"
    assert html_text.main_text(None, weights) == html_text.main_text("", weights) == html_text.main_text("<p><br>", weights) == ""


LONG = " ".join(f"word{i}" for i in range(120))


@pytest.mark.parametrize("page", [
    f"<body class='single no-sidebar'><div class=nav>menu</div><p>{LONG}</p></body>",
    f"<body><div class='elementor-widget'><h1></h1><p>{LONG}</p></div><div class='widget'>small</div></body>",
    f"<body><div id='content' class='with-sidebar' data-id='comments'><p>{LONG}</p></div><div class='sidebar'>small</div></body>",
    f"<body class='hidden'><main class='legal'><article class='post category-legal comments-open share'><p>{LONG}</p></article></main></body>",
    f"<body><div class='page social'><p>{LONG}</p></div><div class='comments'>small</div></body>",
    f"<body><div class='ad'>{'buy now ' * 100}</div><div><h1></h1><p>{LONG}</p></div></body>",
])
def test_main_text_in_named_wrappers(page):
    assert html_text.main_text(page, html_text.Weights()) == LONG


@pytest.mark.parametrize("other", ["<article class='comment-body'>nice post</article>", "<article class='comments'>nice post</article>", "<article class='related'><h3>Teaser</h3>next</article>" * 5])
def test_main_text_beside_small_articles(other):
    """Articles that hold readers' comments or cards do not make the page one that labels its article."""
    page = f"<body><div class='text'><h1>Head</h1><p>{LONG}</p></div><div class='comments'>{other}</div></body>"
    assert html_text.main_text(page, html_text.Weights()) == f"Head\n\n{LONG}"
    page = f"<body><div class='text'><h1>Head</h1><p>{LONG}</p></div>{other}</body>"
    assert html_text.main_text(page, html_text.Weights()).startswith(f"Head\n\n{LONG}")


def test_learned_names_stand_above_the_list():
    page = f"<body><div class='promo'><p>{LONG}</p></div><div><h1>{LONG}</h1>{LONG}</div></body>"
    assert html_text.main_text(page, html_text.Weights()).count(LONG) == 2
    assert html_text.main_text(page, html_text.Weights(on={".promo"})).count(LONG) == 3


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() > 100
