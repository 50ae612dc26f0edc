"""SimHash, top-k, decontamination and mixing against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from heronbase.llm import decontam, mixing, simhash, topk


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_classes(fps, distance=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(make, words):
    base = words(1, 400)
    texts = [" ".join(base), " ".join(base).upper(), " ".join(base[:200] + ["x"] + base[201:]), None, "", "one", "One", "one two", " ".join(words(2, 5000)), "日本 " * 30]
    texts += [" ".join(base[:k] + ["y"] + base[k:]) for k in range(0, 400, 20)] + [" ".join(words(s, 30)) for s in range(20, 60)]
    docs = [(100 - i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (None, "lonely text here"), (None, "one")]
    fps = [brute_fingerprint(t) for _, t in docs]
    label = brute_classes(fps)
    least = {c: min((d for (d, _), x in zip(docs, label) if x == c and d is not None), default=None) for c in label}
    want = sorted(((d, f"{f:016x}", least[c]) for (d, _), f, c in zip(docs, fps, label)), key=repr)
    got = simhash.near_duplicates(make(docs))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert simhash.near_duplicates(make([])).collect() == []
    kept = simhash.representatives(make(docs).select("doc_id", "text", F.struct("*").alias("row")), "row").select("row.*")
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(x or -1 for x in least.values()) and "fp" in kept.columns


def test_classes_that_share_an_id_keep_their_own_document(make, words):
    a, b, c, d = (" ".join(words(s, 80, 5000)) for s in range(4))
    docs = [(5, a), (9, a), (5, b), (8, b), (None, c), (None, c), (None, d)]
    kept = simhash.representatives(make(docs).select("doc_id", "text", F.struct("*").alias("row")), "row").select("row.*")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(5, a), (5, b), (None, c), (None, d)], key=repr)


@pytest.mark.parametrize("parts, shard", [(1, 50), (2, 40), (4, 10_000)])
def test_links_across_shards(spark, parts, shard):
    r = random.Random(parts)
    points = {r.getrandbits(64) for _ in range(150)}
    for p in list(points):
        for _ in range(r.randrange(4)):
            for bit in r.sample(range(64), r.randrange(1, 6)):
                p ^= 1 << bit
            points.add(p)
    points |= {sum(1 << b for b in r.sample(range(8), 4)) for _ in range(60)}
    points = sorted(points)
    signed = [int(np.uint64(p).view(np.int64)) for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    stars = simhash.connected(simhash.links(df, 3, parts, shard))
    root = {x.node: x.root for x in stars.collect()}
    got = [root.get(p, p) for p in signed]
    want = brute_classes(points)
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(points)) for j in range(i))


def test_chains_connect(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30] + [(70, 70), (5, 2), (5, 2)], "u long, v long")
    got = {r.node: r.root for r in simhash.connected(edges).collect()}
    assert all(got.get(i, i) == (0 if i <= 30 else 31) for i in range(61)) and 70 not in got
    assert simhash.connected(edges.limit(0)).collect() == []


def test_best_of_blocks():
    r = np.random.default_rng(0)
    for trial in range(90):
        n, d, k, m = int(r.integers(1, 200)), int(r.integers(1, 6)), int(r.integers(1, 7)), (2, 50, 2**40)[trial % 3]
        v = r.integers(-m, m, (n, d))
        ids = np.sort(r.integers(0, 2 * n, n))
        q, own = v[: min(n, 8)], ids[: min(n, 8)]
        a, b, c, _ = topk.best(q, own, v, ids, k, int(r.integers(1, 40)))
        for i in range(len(q)):
            exact = sorted((-sum(int(x) * int(y) for x, y in zip(q[i], v[j])), int(ids[j])) for j in range(n) if ids[j] != own[i])[:k]
            assert [x for _, x in exact] == b[a == i].tolist()
            assert [max(min(-s, 2**63 - 1), -(2**63)) for s, _ in exact] == c[a == i].tolist()


def test_pruning_skips_blocks():
    ids = np.arange(4096)
    v = np.sort(np.random.default_rng(1).integers(0, 1000, 4096))[:, None]
    *_, scored = topk.best(np.array([[5]]), np.array([-1]), v, ids, 5, 64)
    assert scored.sum() <= 3 * 64


def clustered(spark, n, seed=0):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 1, (12, 8))
    rows = [(i, [float(x) for x in middle[r.integers(12)] + r.normal(0, 0.03, 8)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_clusters_are_pruned(spark):
    rows, df = clustered(spark, 3000)
    is_query = F.col("vec_id") % 50 == 0
    assert topk.scored(df, is_query, shard=256) < 0.2 and topk.scored(df, is_query) < 0.2
    got = {}
    for r in topk.search(df, is_query, shard=256).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    v = np.floor(256 * np.array([x for _, x in rows], np.float32).astype(np.float64)).astype(np.int64)
    for q in range(0, 3000, 50):
        order = [i for i in np.lexsort((np.arange(3000), -(v @ v[q]))) if i != q][:5]
        assert sorted(got[q]) == [(n, i, int(v[i] @ v[q])) for n, i in enumerate(order, 1)]


def test_search(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(230)] + [(7, [0.5] * 8), (230, [0.5] * 8), (231, None), (232, []), (233, [1.0, None] + [0.0] * 6), (234, [float("nan")] * 8), (235, [0.9] * 5), (None, [1.0] * 8), (250, [math.inf] * 8), (300, [0.1] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS v", "1 AS score")
    got = topk.search(df, F.col("vec_id") % 50 == 0, shard=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0).collect()))
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for qi, q in ok:
        if qi % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in ok if i != qi)[:5]
            want += [(qi, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.schema["rank"].dataType.simpleString() == "int"
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def brute_hits(docs, items, n=13, slop=3):
    import re

    table = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(table))
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - n + 1) if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found, near, whole = split(text), set(), set(), set(), False
        for i in range(len(w)):
            for size in {len(x) for x in windows}:
                if own := windows.get(tuple(w[i : i + size])):
                    if i + size <= len(w):
                        hit.update(range(i, i + size))
                        found |= own
                        whole |= size >= n
        for x, own in windows.items():
            if set(x) <= set(w) and any(set(x) <= set(w[i : i + len(x) + slop]) for i in range(len(w))):
                near |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), whole, len(near)))
    return out


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS words", "1 AS window_id")


def test_contamination(spark, make, words):
    a, b = words(1, 40, 5000), words(2, 20, 5000)
    items = [(10, " ".join(a)), (9, "  ".join(b).upper() + "!"), (9, " ".join(b)), (11, " ".join(b)), (12, "the cat"), (13, None), (14, " .,"), (None, "zzz"), (15, "w1 w1 w1"), (16, "École ça va")]
    docs = [(1, " ".join(words(3, 30) + a + words(4, 30))), (2, " ".join(words(5, 500) + b[:15])), (3, "see THE-CAT, the cat the cat"), (4, None), (5, ""), (6, " ".join(a[:12])), (7, "w1 w1 w1 w1 w1"), (8, "l'École, ça va"), (9, " ".join(words(6, 5000) + a)), (1, "the cat"), (None, "the cat"), (2, " ".join(words(5, 500) + b[:15])), (20, "zzz")]
    got = decontam.contamination(make(docs), benchmark(spark, items)).drop("doc", "version")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_hits(docs, items), key=repr)
    assert decontam.contamination(make([]), benchmark(spark, items)).collect() == []
    clean = decontam.contamination(make(docs), benchmark(spark, [])).collect()
    assert len(clean) == len(docs) and not any(r.contaminated or r.n_hit for r in clean)


def test_without_broadcasts(spark, make, words, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    a = words(1, 40, 5000)
    docs, items = [(i, " ".join(words(i, 30) + a[: 5 * i])) for i in range(8)], [(1, " ".join(a))]
    got = decontam.contamination(make(docs), benchmark(spark, items)).drop("doc", "version")
    assert sorted(map(tuple, got.collect())) == sorted(brute_hits(docs, items))


def test_proximity(spark, make):
    docs = [(0, "alpha beta gamma delta"), (1, "alpha x beta gamma x delta"), (2, "delta x gamma x beta x alpha"), (3, "alpha " + "x " * 9 + "delta beta gamma"), (4, "delta y delta x gamma beta x x x alpha"), (5, "delta alpha gamma")]
    items = [(1, "alpha beta gamma delta"), (2, "x beta")]
    got = decontam.contamination(make(docs), benchmark(spark, items)).drop("doc", "version")
    assert sorted(map(tuple, got.collect())) == sorted(brute_hits(docs, items))
    assert {r.doc_id: r.n_near for r in got.collect()} == {0: 1, 1: 2, 2: 2, 3: 1, 4: 1, 5: 0}


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, out, live = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        share = sum(w[s] for s in live)
        level = (total - sum(out.values())) / share if share else 0
        over = [s for s in live if level * w[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return out | {s: level * w[s] for s in live}
        for s in over:
            out[s] = 2.0 * sizes[s]
            live.discard(s)


def test_mix(make):
    r = random.Random(1)
    docs = [(i, " ".join("w" for _ in range(r.randrange(1, 120))), r.choice(["a", "b", "b", "b", "c", "é", "z", None])) for i in range(900)]
    docs += [(900, None, "a"), (901, "", "b"), (None, "x y", "c"), (5, "again again", "a"), (5, "again again", "a")]
    got = mixing.mix(make(docs)).collect()
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    by = {}
    assert len(got) == len(docs) and all(g.taken <= 2 * g.size and g.taken == g.copies * g.size for g in got)
    at = {}
    for d, t, s in docs:
        at.setdefault((d, len((t or "").split())), set()).add(s)
    for g in got:
        (source,) = at[g.doc_id, g.size]
        assert g.source_size == sizes[source] and abs(g.target - want[source]) < 1e-6
        by[source] = by.get(source, 0) + g.taken
    assert all(abs(by[s] - want[s]) <= max(150, 0.06 * want[s]) for s in sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(make(docs).repartition(7)).collect()))
    assert mixing.mix(make([])).collect() == []
    assert [g.taken for g in mixing.mix(make([(1, None), (2, "")])).collect()] == [0, 0]
