"""Substring and suffix-array dedup against brute force."""

import hashlib
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pytest

from heronbase.llm import induced, pieces, substring_dedup, suffix_dedup
from heronbase.llm.induced import Folder, suffixes
from heronbase.llm.substring_dedup import Automaton, runs

NULL = 2**63 - 1


def brute_words(docs, width=13):
    first = {}
    for doc, text in docs:
        w = (text or "").encode().split()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, NULL), NULL if doc is None else doc)
    out = []
    for doc, text in docs:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (NULL if doc is None else doc):
                gone.update(range(i, i + width))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return out


def brute_bytes(docs, width=200):
    count = defaultdict(int)
    for _, text in docs:
        t = (text or "").encode()
        for i in range(len(t) - width + 1):
            count[t[i : i + width]] += 1
    out = []
    for doc, text in docs:
        t = (text or "").encode()
        hit = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                hit[i : i + width] = 1
        h = hit[:-1] > 0 if len(t) else np.zeros(0, bool)
        left = bytes(b for b, x in zip(t, h.tolist()) if not x)
        spans = int((np.diff(np.concatenate(([0], h.astype(int)))) == 1).sum())
        out.append((doc, len(t), int(h.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus(words):
    base, passage = words(1, 300), words(2, 60, 5000)
    texts = [" ".join(base), " ".join(base), " ".join(base[:150] + ["edit"] + base[151:]), " ".join(words(3, 40) + passage + words(4, 40)), "  ".join(words(5, 30) + passage), " ".join(passage[10:40])]
    texts += [" ".join(passage[:30] + words(s, 20, 3000)) for s in range(10, 40)]
    texts += [None, "", " \t\n", "short text", "a " * 500, "aé" * 400, "x" * 1500, " ".join(words(6, 20_000, 50_000) + passage)]
    docs = [(3 * i + 1, t) for i, t in enumerate(texts)]
    return docs + [(None, texts[0]), (4, " ".join(words(7, 50))), (4, " ".join(words(7, 50))), (4, " ".join(passage))]


@pytest.mark.parametrize("hot", [2000, 3])
def test_words(make, words, monkeypatch, hot):
    monkeypatch.setattr(pieces, "HOT", hot)
    docs = corpus(words)
    got = substring_dedup.deduplicate(make(docs)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_words(docs), key=repr)


@pytest.mark.parametrize("hot, memory", [(2000, 1 << 20), (3, 500)])
def test_bytes(make, words, monkeypatch, hot, memory):
    monkeypatch.setattr(pieces, "HOT", hot)
    docs = corpus(words)
    got = suffix_dedup.deduplicate(make(docs), shard_bytes=20_000, memory=memory, names=memory).drop("kept")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_bytes(docs), key=repr)


def test_empty(make):
    assert substring_dedup.deduplicate(make([])).collect() == []
    assert suffix_dedup.deduplicate(make([])).collect() == []


def test_against_reference(spark, make, words):
    passage = words(2, 60, 5000)
    texts = [" ".join(words(8, 50) + passage), None, " ".join(words(9, 30)), " ".join(words(10, 300))]
    docs = ["start " + " ".join(passage[5:45]) + " end", " ".join(passage[:12]), None, " ".join(words(10, 300)[100:220] + words(9, 30)[3:20]), "x"]
    rows = [*enumerate(docs), (0, docs[3]), (None, docs[0])]
    for size in (40, 10_000):
        got = substring_dedup.against(make(rows), make(texts), shard_words=size)
        held = {tuple(w[i : i + 13]) for t in texts for w in [(t or "").split()] for i in range(len(w) - 12)}
        want = []
        for doc, text in rows:
            w = (text or "").split()
            gone = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in held for j in range(i, i + 13)}
            want.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
        assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=repr) == sorted(want, key=repr)
    assert substring_dedup.shards(make(texts), 13, 40).count() > 5
    assert [r.n_removed for r in substring_dedup.against(make(rows[:1]), make([]), 13).collect()] == [0]


def test_other_text_under_equal_hashes_raises(make, words, monkeypatch):
    monkeypatch.setattr(pieces.Kind, "mark", lambda self, tokens: int(np.random.default_rng().integers(1 << 60)))
    docs = [(i, " ".join(words(1, 60))) for i in range(3)]
    for run in (substring_dedup.deduplicate, suffix_dedup.deduplicate):
        with pytest.raises(Exception, match="same hashes"):
            run(make(docs)).collect()


def test_answers_are_shared_out():
    assert list(pieces.within([3, 2, 4], [(0, 1), (2, 4), (8, 1)])) == [(0, [(0, 1), (2, 1)]), (1, [(0, 2)]), (2, [(0, 1), (3, 1)])]
    assert list(pieces.within([3], [])) == []


def test_matching_statistics():
    a = Automaton()
    a.add("abcabx")
    a.add("bcd")
    assert list(a.statistics("xabcdz")) == [1, 1, 2, 3, 3, 0]
    assert list(runs(a, list("zabcabq"), 3)) == [(1, 3)]


def test_pieces_hold_every_window_once():
    h, r = pieces.Hasher(10), np.random.default_rng(0)
    for values in (r.integers(0, 3, 700).astype(np.uint64), np.zeros(500, np.uint64)):
        got = [x for part in pieces.cut(h, pieces.mixed(values), 20, 6) for x in zip(*(p.tolist() for p in part))]
        assert [s for s, *_ in got] == list(np.cumsum([0, *(n for _, n, *_ in got)])[:-1]) and sum(n for _, n, *_ in got) == len(values) - 19
        anchors = defaultdict(set)
        for s, n, mh, _ in got:
            for i in range(s, s + n):
                anchors[tuple(values[i : i + 20].tolist())].add(mh)
        assert all(len(x) == 1 for x in anchors.values())


def sorted_by_induction(t, depth, folder, memory, names):
    own = Folder(folder, memory, names)
    text = np.concatenate((t.astype(np.uint8), np.zeros(induced.PAD, np.uint8)))
    order, common = [], []
    for at, lcp in suffixes(text, len(t), depth, own):
        order += at.tolist()
        common += lcp.tolist()
    return order, common, own.counters


@pytest.mark.parametrize("memory", [1 << 20, 3, 25])
def test_induced_sorting(memory, monkeypatch, tmp_path):
    monkeypatch.setattr(induced, "CHUNK", 1 << 18 if memory > 25 else 7)
    r = np.random.default_rng(memory)
    levels = 0
    for trial in range(90):
        n, sigma, depth = int(r.integers(1, 250)), int(r.integers(1, 6)), int(r.integers(2, 40))
        t = r.integers(0, sigma, n).astype(np.uint8)
        if trial % 3 == 0:
            t = np.concatenate([t, t[: n // 2], np.zeros(1, np.uint8), t])
        with tempfile.TemporaryDirectory(dir=tmp_path) as folder:
            order, common, counters = sorted_by_induction(t, depth, folder, memory, memory)
        levels = max(levels, counters.levels)
        keys = [tuple(t[i : i + depth].tolist()) for i in range(len(t))]
        assert sorted(order) == list(range(len(t))) and [keys[i] for i in order] == sorted(keys, reverse=True)
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            same = next((x for x in range(depth) if a + x >= len(t) or b + x >= len(t) or t[a + x] != t[b + x]), depth)
            assert min(common[k], depth) == same or (common[k] > same and max(a, b) + same == len(t))  # what is behind the end may count as zeros
    assert levels > 1 or memory > 25


def test_a_shard_of_the_query_is_sorted_beyond_memory(tmp_path):
    """With the query's own bounds, half a shard spills its queues and recurses on its names."""
    r = np.random.default_rng(0)
    words = [bytes(r.integers(97, 123, int(k)).astype(np.uint8)) for k in r.integers(2, 9, 3000)]
    texts = [b" ".join(words[i] for i in r.integers(0, 3000, 60)) for _ in range(suffix_dedup.SHARD_BYTES // 2 // 390)]
    texts += texts[:50]
    folder = Folder(str(tmp_path))
    spool = suffix_dedup.Spool(folder, 200)
    texts = [t for t in texts if len(t) >= 200]
    rows = pieces.pa.array([[{"mh": 0, "ch": i, "n": len(t) - 199, "weight": 1, "spread": False}] for i, t in enumerate(texts)], pieces.pa.list_(pieces.PART))
    spool.fill(iter([pieces.pa.RecordBatch.from_arrays([rows, pieces.pa.array(texts, pieces.pa.binary())], names=["parts", "text"])]))
    got = {ch: spans for b in spool.answers(lambda tokens: 0) for ch, spans in zip(b.column(1).to_pylist(), b.column(4).to_pylist())}
    twice = {t for t, n in Counter(texts).items() if n > 1}
    assert got == {i: [] for i, t in enumerate(texts) if t in twice}
    assert folder.counters.spilled > 0 and folder.counters.levels > 1
