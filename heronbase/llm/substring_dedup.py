"""Substring dedup with suffix automata: words that an earlier document already has in a long enough run.

A reference shard's suffix automaton reads documents word by word and tells, at every
word, how long a run ending there the shard holds (matching statistics); runs of
``width`` words or more are removed.

Against a fixed reference, ``against`` broadcasts the automata of its shards, one at a
time, each of a bounded number of words.  Within one corpus the reference is the corpus
itself: as many shards as documents would each have to be broadcast to all documents, work
that grows with the square of the corpus.  So shards are content-defined there
(``pieces``): a text is streamed through the automaton of the one shard that can hold its
windows, in order of id, and joins it afterwards.  Every window's answer comes from an
automaton; hashes only route, and fold equal texts, which are held against each other by
digest.

Defined cases: null and empty texts have no words and keep none; a null id counts as
larger than any other; rows that share an id are not earlier than each other; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronbase.llm.common import materialize
from heronbase.llm.pieces import ANSWERS, Kind, answered, applied, covered, documents, repeated, unpack, within

#: Words in the automaton of one broadcast shard.
SHARD_WORDS = 500_000


class Automaton:
    """Generalised suffix automaton over any hashable symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, symbol, q: int) -> int:
        new = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = new
            p = self.link[p]
        return new

    def add(self, sequence) -> None:
        nexts, link, length = self.next, self.link, self.len
        last = 0
        for symbol in sequence:
            q = nexts[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, symbol, q)
                continue
            new = self._state(length[last] + 1, {}, 0)
            p = last
            while p >= 0 and symbol not in nexts[p]:
                nexts[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][symbol]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, symbol, q)
            last = new

    def statistics(self, sequence) -> Iterator[int]:
        """For each symbol, the length of the longest run ending there that the automaton holds."""
        nexts, link, length = self.next, self.link, self.len
        state = run = 0
        for symbol in sequence:
            while state and symbol not in nexts[state]:
                state = link[state]
                run = length[state]
            q = nexts[state].get(symbol)
            if q is None:
                run = 0
            else:
                state, run = q, run + 1
            yield run


def runs(automaton: Automaton, words: list, width: int) -> Iterator[tuple[int, int]]:
    """Maximal spans as first window and number of windows."""
    start = n = 0
    for i, run in enumerate(automaton.statistics(words)):
        if run >= width:
            if n and start + n == i - width + 1:
                n += 1
            else:
                if n:
                    yield start, n
                start, n = i - width + 1, 1
    if n:
        yield start, n


def compare(texts: DataFrame, kind: Kind) -> DataFrame:
    """Answers by the automata of the shards, one for each anchor.

    Documents pass in order of id.  A text is streamed through the automaton of what earlier
    documents hold, which answers for its first document; then it joins the automaton and,
    if later documents hold it too, is streamed again, which answers for them.
    """
    n, width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), kind.width

    def answers(parts: list[dict], words: list[bytes], spans: list[tuple[int, int]], later: bool) -> Iterator[tuple]:
        edges = np.concatenate(([0], np.cumsum([p["n"] for p in parts]))).tolist()
        for i, own in within([p["n"] for p in parts], spans):
            p = parts[i]
            if not later or p["spread"]:
                yield p["mh"], p["ch"], later, kind.mark(words[edges[i] : edges[i + 1] + width - 1]), [] if own == [(0, p["n"])] else own

    def of_anchor(group: list[tuple]) -> Iterator[tuple]:
        automaton = Automaton()
        waiting: list[tuple[list[bytes], list[dict]]] = []

        def join() -> Iterator[tuple]:
            for words, parts in waiting:
                automaton.add(words)
                if any(p["spread"] for p in parts):
                    yield from answers(parts, words, list(runs(automaton, words, width)), True)
            waiting.clear()

        now = None
        for doc, parts, text in group:
            if doc != now:
                yield from join()
                now = doc
            words = text.split()
            if len(automaton.len) > 1:
                yield from answers(parts, words, list(runs(automaton, words, width)), False)
            waiting.append((words, parts))
        yield from join()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, group = None, []
        for b in batches:
            out = []
            for mh, *row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if mh != anchor:
                    out += of_anchor(group)
                    anchor, group = mh, []
                group.append(tuple(row))
            yield answered(out)
        yield answered(list(of_anchor(group)))

    return texts.repartition(n, "mh").sortWithinPartitions("mh", "doc").select("mh", "doc", "parts", "text").mapInArrow(run, ANSWERS)


def cleaned(words: list[bytes], starts: np.ndarray, ns: np.ndarray, width: int) -> tuple:
    left, gone = words, 0
    if len(starts):
        hit = covered(starts, ns, width, len(words))
        left, gone = list(compress(words, (~hit).tolist())), int(hit.sum())
    text = b" ".join(left)
    return len(words), gone, hashlib.sha256(text).hexdigest(), text.decode()


COLUMNS = "n_words long, n_removed long, kept_sha256 string, kept_text string"


def deduplicate(docs: DataFrame, width: int = 13, gram: int = 5) -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, kept_sha256``, with the kept words as ``kept_text``."""
    kind = Kind(width, gram, words=True)
    packed, repeats = documents(docs)
    by_doc = repeated(packed, kind, True, lambda texts, size: compare(texts, kind), repeats)
    return applied(packed, by_doc, kind, COLUMNS, lambda words, starts, ns: cleaned(words, starts, ns, width))


def shards(reference: DataFrame, width: int, shard_words: int) -> DataFrame:
    """``shard, automaton`` (pickled) over all texts of ``reference``, built by tasks, each of ``shard_words`` words or little more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                # parts overlap, so no window is lost
                parts = [words[lo : lo + shard_words + width - 1] for lo in range(0, max(0, len(words) - width + 1), shard_words)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in parts], pa.int64()), pa.array([b" ".join(p) for p in parts], pa.binary())], names=["n", "text"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def shard() -> pa.RecordBatch:
            blob = pickle.dumps((automaton.next, automaton.link, automaton.len))
            return pa.RecordBatch.from_arrays([pa.array([f"{TaskContext.get().partitionId()}-{number}"]), pa.array([blob], pa.binary())], names=["shard", "automaton"])

        automaton, size, number = Automaton(), 0, 0
        for b in batches:
            for text in b.column(1).to_pylist():
                words = text.split()
                automaton.add(words)
                size += len(words)
                if size >= shard_words:
                    yield shard()
                    automaton, size, number = Automaton(), 0, number + 1
        if size:
            yield shard()

    parts = materialize(reference.select(reference["text"].cast("string").alias("text")).mapInArrow(cut, "n long, text binary"), "reference")
    words = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return materialize(parts.repartition(max(1, -(-words // shard_words))).mapInArrow(build, "shard string, automaton binary"), "automata")


def against(docs: DataFrame, reference: DataFrame, width: int = 13, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Removes from ``docs`` every word in a run of ``width`` words that a text of ``reference`` holds: columns as of ``deduplicate``.

    Tasks build the automata of the reference's shards.  One at a time, a shard's automaton is
    fetched (``shard_words`` words, some 35 bytes each, whatever the reference's size; some
    320 each in a worker's memory) and broadcast, all documents stream through it, what it finds is written, and the broadcast
    goes.  So the work is that of all documents for each shard: this is for references of
    a fixed size; a corpus against itself is ``deduplicate``.
    """
    spark = docs.sparkSession
    packed = materialize(documents(docs)[0], "documents")
    automata, found = shards(reference, width, shard_words), None
    for (name,) in sorted(map(tuple, automata.select("shard").collect())):  # names alone
        shared = spark.sparkContext.broadcast(automata.where(F.col("shard") == name).first().automaton)

        def stream(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = Automaton()
            automaton.next, automaton.link, automaton.len = pickle.loads(shared.value)
            for b in batches:
                out = []
                for doc, ver, z in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    out += [(doc, ver, s, n) for s, n in runs(automaton, unpack(z).split(), width)]
                yield pa.RecordBatch.from_pylist([dict(zip(("doc", "ver", "start", "n"), x, strict=True)) for x in out], schema=pa.schema([(k, pa.int64()) for k in ("doc", "ver", "start", "n")]))

        one = materialize(packed.select("doc", "ver", "z").mapInArrow(stream, "doc long, ver long, start long, n long"), "matches")
        shared.destroy()
        found = one if found is None else found.union(one)
    if found is None:
        found = spark.createDataFrame([], "doc long, ver long, start long, n long")
    by_doc = found.distinct().groupBy("doc", "ver").agg(F.collect_list(F.struct("start", "n")).alias("own"))
    near = packed.join(by_doc, ["doc", "ver"], "left").select("id", "z", "own")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for b in batches:
            out = []
            for i in range(b.num_rows):
                own = b.column(2)[i].values
                starts, ns = (none, none) if own is None else (own.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n"))
                out.append(cleaned(unpack(b.column(1)[i].as_py()).split(), starts, ns, width))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x)) for x in zip(*out, strict=True))], names=["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])

    return near.mapInArrow(finish, f"doc_id {dict(packed.dtypes)['id']}, {COLUMNS}")
