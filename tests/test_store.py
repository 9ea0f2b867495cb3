"""Stored tables in parts, two writers at once, and incremental scans."""

import random
import threading
from pathlib import Path

import pytest

from graphweave.operators.incremental import changed_symbols, scan
from graphweave.operators.store import Store

EDGES = "kind string, src long, dst long, conf int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(folder):
    return {f for f in Path(folder, "data").rglob("*.parquet")}


def test_replacing_a_part_writes_only_its_files(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    edges = spark.createDataFrame([(k, i, i + 1, 90) for k in ("CALLS", "HANDLES", "USES", None) for i in range(20)], EDGES)
    assert store.commit(parts={"edges": (edges, ["kind"])}) == 1
    first = files(tmp_path)
    assert rows(store.read("edges")) == rows(edges) and store.read("edges").columns == edges.columns
    new = spark.createDataFrame([("CALLS", 7, 8, 10), ("NEW", 1, 2, 20)], EDGES)
    assert store.commit(parts={"edges": (new, ["kind"])}, other=new) == 2
    added = files(tmp_path) - first
    assert first <= files(tmp_path) and {f.parent.name for f in added if "edges" in str(f)} == {"kind=CALLS", "kind=NEW"}
    assert rows(store.read("edges")) == sorted([*[r for r in rows(edges) if r[0] != "CALLS"], *rows(new)], key=str)
    assert rows(store.read("edges", 1)) == rows(edges) and store.read("other", 1) is None and rows(store.read("other")) == rows(new)
    # A filter by part reads that part's files only.
    assert {Path(f).parent.name for f in store.read("edges").where("kind = 'CALLS'").inputFiles()} >= {"kind=CALLS"}
    plan = store.read("edges").where("kind = 'USES'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan
    # Nothing to replace replaces nothing; other columns than those of the parts are an error.
    assert store.commit(parts={"edges": (new.limit(0), ["kind"])}) == 3 and len(rows(store.read("edges"))) == 62
    with pytest.raises(ValueError):
        store.commit(parts={"edges": (new, ["src"])})
    with pytest.raises(ValueError):
        store.commit(parts={"other": (new, ["kind"])})


def test_of_two_writers_one_succeeds(spark, tmp_path):
    """Both have read the same version and written their files when they publish."""
    ready = threading.Barrier(2)

    class Waiting(Store):
        def _publish(self, manifest, version):
            ready.wait()
            super()._publish(manifest, version)

    said = {}

    def write(name):
        try:
            said[name] = Waiting(spark, str(tmp_path)).commit(**{name: spark.createDataFrame([(name,)], "who string")})
        except RuntimeError as error:
            said[name] = str(error)

    for round_ in range(1, 4):
        threads = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        won = [n for n, v in said.items() if v == round_]
        assert len(won) == 1 and sorted(map(str, said.values()))[1] == f"version {round_} was published meanwhile"
        store = Store(spark, str(tmp_path))
        assert store.version() == round_ and rows(store.read(won[0])) == [(won[0],)]
    assert not list(Path(tmp_path).glob("staged-*"))


def test_changed_symbols(spark):
    before, now = (spark.createDataFrame(r, "node long, digest string") for r in ([(1, "a"), (2, "b"), (3, None), (4, "d")], [(1, "a"), (2, "x"), (3, None), (5, "e")]))
    assert rows(changed_symbols(before, now)) == [(2, "changed"), (4, "removed"), (5, "added")]
    assert rows(changed_symbols(None, now)) == [(n, "added") for n in (1, 2, 3, 5)]


def brute(edges, own):
    after = {}
    for s, d in edges:
        after.setdefault(s, set()).add(d)
    out = {}
    for n in own:
        seen, todo = {n}, [n]
        while todo:
            for m in after.get(todo.pop(), ()):
                if m not in seen and m in own:
                    seen.add(m)
                    todo.append(m)
        out[n] = (seen, 0)
        for m in seen:
            out[n] = (seen, out[n][1] | own[m])
    return out


def test_incremental_scans_equal_full_ones(spark, tmp_path):
    rng = random.Random(2)
    store = Store(spark, str(tmp_path))
    own = {n: 1 << rng.randrange(12) for n in range(40)}
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(55)}
    before = {}
    for change in range(5):
        if change == 2:
            own[50], own[51] = 1, 2
            edges |= {(50, 51), (50, 3), (rng.randrange(40), 50)}
        elif change == 3:
            gone = rng.randrange(40)
            del own[gone]
            edges = {e for e in edges if gone not in e}
        elif change == 4:
            own[5], edges = own.get(5, 0) ^ 2049, edges ^ {(7, 8), (9, 7)}
            edges = {e for e in edges if e[0] in own and e[1] in own}
        body = {n: f"{own[n]}|{sorted(d for s, d in edges if s == n)}" for n in own}
        symbols = spark.createDataFrame([(n, body[n], m) for n, m in own.items()], "node long, digest string, mask int")
        got = {r["node"]: (r["mask"], r["touched"]) for r in scan(store, symbols, spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
        want = brute(edges, own)
        changed = {n for n in own if before.get(n) != body[n]}
        assert got == {n: (m, bool(seen & changed)) for n, (seen, m) in want.items()}
        if change == 1:
            assert not changed and not any(t for _, t in got.values())
        if change > 1:
            assert 0 < sum(t for _, t in got.values()) < len(own)
        before = body
