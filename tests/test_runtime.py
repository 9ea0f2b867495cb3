"""Streams with late rows, hybrid retrieval with split hot terms, near names, and secrets, against plain versions."""

import datetime
import itertools
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphweave.functions import secrets
from graphweave.operators import retrieval
from graphweave.operators.names import near_names
from graphweave.streaming.runtime import anomalies, drained, event_stream, windowed

EVENTS = "event_id long, ts timestamp, user_id long, value double"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def put(spark, folder, number, rows):
    """One file of the stream; later numbers are newer."""
    path = f"{folder}/part-{number}.parquet"
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}-made-{number}")
    made = next(f for f in os.listdir(f"{folder}-made-{number}") if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{folder}-made-{number}/{made}", path)
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def test_windows_with_late_rows(spark, tmp_path):
    folder = f"{tmp_path}/events"
    put(spark, folder, 0, [(1, at(1), 1, 1.0), (2, at(5), 2, 2.0), (3, at(65), 1, 4.0)])
    # Out of order but within the delay of 30 minutes, and a user without a route.
    put(spark, folder, 1, [(4, at(50), 1, 8.0), (5, at(66), 9, 16.0), (6, at(200), 2, 32.0)])
    put(spark, folder, 2, [(10, at(190), 1, 512.0)])
    # The newest of the batches before the last is 200: rows of windows that closed before 170 are dropped, those of open windows count.
    put(spark, folder, 3, [(7, at(2), 1, 64.0), (8, at(61), 1, 128.0), (9, at(185), 1, 256.0)])
    routes = spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, route string")
    stream = event_stream(spark, folder, files_at_once=1).select("ts", "user_id", "value")
    got = drained(windowed(stream, routes, "user_id", ["route"], "1 hour", "30 minutes"), ["start", "route"])
    assert {(r["start"], r["route"]): (r["seen"], r["total"]) for r in got.collect()} == {
        (at(0), "a"): (2, 9.0), (at(0), "b"): (1, 2.0), (at(60), "a"): (1, 4.0), (at(60), None): (1, 16.0), (at(180), "b"): (1, 32.0), (at(180), "a"): (2, 768.0),
    }


def test_stream_equals_batch_and_nothing(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, at(rng.randrange(600)), rng.randrange(4), float(i)) for i in range(300)]
    for i in range(3):
        put(spark, f"{tmp_path}/e", i, rows[i::3])
    routes = spark.createDataFrame([(u, f"r{u % 2}") for u in range(3)], "user_id long, route string")
    stream = event_stream(spark, f"{tmp_path}/e", files_at_once=1).select("ts", "user_id", "value")
    got = drained(windowed(stream, routes, "user_id", ["route"], "1 hour", "30 hours"), ["start", "route"])
    want = Counter((at(t.hour * 60), f"r{u % 2}" if u < 3 else None) for _, t, u, _ in rows)
    assert {(r["start"], r["route"]): r["seen"] for r in got.collect()} == want
    put(spark, f"{tmp_path}/none", 0, [])
    none = drained(windowed(event_stream(spark, f"{tmp_path}/none").select("ts", "user_id", "value"), routes, "user_id", ["route"], "1 hour", "1 hour"), ["start", "route"])
    assert none.count() == 0


def test_anomalies(spark):
    counts = spark.createDataFrame([(at(60 * h), "a", n, 0.0) for h, n in enumerate([2, 4, 6, 10])] + [(at(0), "b", 3, 0.0), (at(180), "b", 3, 0.0), (at(180), None, 7, 0.0)], "start timestamp, route string, seen long, total double")
    got = {r["route"]: (r["score"], r["share"]) for r in anomalies(counts, ["route"], F.lit(at(180))).collect()}
    assert got == {"a": (round(6 / math.sqrt(8 / 3), 6), 0.5), "b": (None, 0.15), None: (None, 0.35)}


def test_retrieval_with_and_without_split_terms(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, i % 3 if i % 10 else 0, " ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.randint(1, 25))), [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    docs += [(900, 0, None, None), (901, 0, "", [0.0] * 4), (902, 0, "W1 w1, W1!", [float("nan")] * 4), (903, 1, "w2", [1.0] * 3), (904, None, "w1", [1.0] * 4)]
    asked = [(i, i % 3, " ".join(rng.sample(words, 4)), [rng.uniform(-1, 1) for _ in range(4)]) for i in range(6)] + [(950, 0, "nowhere", [1.0] * 4), (951, 0, None, None), (952, 5, "w1", [1.0] * 4)]
    d = spark.createDataFrame(docs, "doc long, part int, text string, embedding array<double>")
    q = spark.createDataFrame(asked, "item long, part int, text string, embedding array<double>")
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    held = [(i, p, Counter(split(t))) for i, p, t, _ in docs]
    some = [c.total() for _, _, c in held if c]
    df = Counter(t for _, _, c in held for t in c)
    fine = lambda v: v and all(math.isfinite(x) for x in v) and any(v)
    wants = {}
    for item, part, text, vector in asked:
        scores = {}
        for i, p, c in held:
            if p == part and (found := set(split(text)) & set(c)):
                scores[i] = sum(math.floor(1e6 * (math.log(1 + (len(some) - df[t] + 0.5) / (df[t] + 0.5)) * (c[t] * 2.2) / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / (sum(some) / len(some)))))) for t in found)
        wants["w", item] = sorted(scores, key=lambda i: (-scores[i], i))[:7]
        near = {}
        for i, p, _, v in docs:
            if p == part and fine(v) and fine(vector) and len(v) == len(vector) and i != item:
                near[i] = round(sum(a * b for a, b in zip(v, vector)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in vector)), 9)
        wants["v", item] = sorted(near, key=lambda i: (-near[i], i))[:7]
    for hot in (20_000, 10):
        by_words, by_vectors = retrieval.word_ranks(d, q, 7, hot), retrieval.vector_ranks(d, q, 7, hot)
        for kind, ranks in (("w", by_words), ("v", by_vectors)):
            got = {}
            for r in ranks.orderBy("item", "rank").collect():
                got.setdefault(r["item"], []).append(r["doc"])
            assert got == {i: w for (k, i), w in wants.items() if k == kind and w}
    fused = {}
    for r in retrieval.fused(by_words, by_vectors, 4).orderBy("item", "rank").collect():
        fused.setdefault(r["item"], []).append(r["doc"])
    for item in fused:
        w, v = wants["w", item], wants["v", item]
        score = {i: round(sum(1 / (61 + x.index(i)) for x in (w, v) if i in x), 9) for i in {*w, *v}}
        assert fused[item] == sorted(score, key=lambda i: (-score[i], i))[:4]
    assert retrieval.word_ranks(d.limit(0), q, 3).count() == 0 and retrieval.vector_ranks(d, q.limit(0), 3).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_near_names_equal_all_pairs(spark, most):
    rng = random.Random(6)
    names = {"".join(rng.choices("abcé", k=rng.randint(0, 6))) for _ in range(120)} | {"", "a", "ab", "acme/framework", "acme/framewrok", "acm/framwork", "acme/framewor"}
    want = {(a, b, d) for a, b in itertools.combinations(sorted(names), 2) if (d := distance(a, b)) <= most}
    got = near_names(spark.createDataFrame([(n, 1) for n in [*names, *names, None]], "name string, other int").select("name"), most).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_secret_spans_entropy_and_check_digits(spark):
    key = "A1b2C3d4E5f6G7h8I9j0+/="
    text = f"token: {key} and 4111 1111-1111 1111, then {key}{key}\nid 4111111111111112 " + "x" * 5000 + " end"
    row = spark.createDataFrame([(text,)], "t string").select(secrets.spans(F.col("t"), secrets.TOKEN).alias("k"), secrets.spans(F.col("t"), secrets.DIGITS).alias("n")).first()
    assert [s["value"] for s in row["k"]] == [key, key + key, "x" * 5000] and row["k"][0]["context"] == "token: "
    assert [s["value"] for s in row["n"]] == ["4111 1111-1111 1111", "4111111111111112"] and len(row["n"][0]["context"]) == 24
    texts = ["", "aaaa", "abab", "abcd", key]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(secrets.entropy(F.col("t"))).collect()]
    assert got == [round(-sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()), 6) + 0 if t else 0 for t in texts]
    rng = random.Random(8)
    numbers = ["".join(rng.choices("0123456789", k=rng.randint(2, 19))) for _ in range(200)] + ["79927398713", "4111111111111111"]
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(s))) % 10 == 0
    got = {r["t"]: r["ok"] for r in spark.createDataFrame([(n,) for n in numbers], "t string").select("t", secrets.check_digit(F.col("t")).alias("ok")).collect()}
    assert got == {n: luhn(n) for n in numbers}
    assert spark.createDataFrame([(None,)], "t string").select(secrets.spans(F.col("t"), secrets.TOKEN).alias("k")).first()["k"] is None
