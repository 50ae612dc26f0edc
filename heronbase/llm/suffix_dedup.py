"""Substring dedup with suffix arrays: bytes that stand in a long enough string occurring more than once.

Texts that can hold repeats are found and routed by content (``pieces``); a shard is a
set of anchors.  A task spools its shard's texts to a file, one after the other with a
separator below all bytes, and sorts their suffixes by external induced sorting
(``induced``): a run of neighbours with a common prefix of ``width`` bytes is one string,
and it repeats if the run has more than one place.  Equal texts are spooled once, with the
number of their places as weight.  Every byte's answer comes from this order.

Text, order, names, weights and hits are mapped files and queues go to disk, so a shard
may be far larger than memory; memory holds some 40 bytes for each text of a shard (one
in 90 bytes or so).  The files lie where the executor itself spills (``SPARK_LOCAL_DIRS``,
which Spark tells its Python workers), are read by their own task alone and go with it; a
task that is lost starts again from the shuffled texts.

Defined cases: null and empty texts have no bytes; texts shorter than ``width`` lose
nothing; rows that share an id, and equal rows, are documents of their own (so equal
rows of ``width`` bytes or more repeat each other); what is left of a text may no longer
be valid UTF-8 and is kept as bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heronbase.llm.induced import MEMORY, NAMES, PAD, Folder, suffixes
from heronbase.llm.pieces import ANSWERS, Kind, answered, applied, covered, documents, repeated

#: Bytes of texts that a shard should hold; some sixteen times the entries that its queues keep in memory.
SHARD_BYTES = 16 << 20


def scratch() -> tempfile.TemporaryDirectory:
    """A folder for one task, where its executor spills."""
    return tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)


class Spool:
    """A shard's texts in a file, bytes raised by one and a 0 behind each; their contents; the weight of each window (2: or more)."""

    def __init__(self, folder: Folder, width: int):
        self.folder, self.width, self.n = folder, width, 0
        self.path, self.weights = folder.name(), folder.name()
        self.mh, self.ch, self.size, self.first = [], [], [], []

    def fill(self, batches: Iterator[pa.RecordBatch]) -> None:
        with open(self.path, "wb") as text, open(self.weights, "wb") as weight:
            for b in batches:
                lists, raw = b.column(0), b.column(1)
                parts = lists.flatten()
                mh, ch, n, w = (parts.field(k).to_numpy(zero_copy_only=False) for k in ("mh", "ch", "n", "weight"))
                per = lists.value_lengths().to_numpy(zero_copy_only=False)
                size = np.fromiter((len(x.as_buffer()) for x in raw), np.int64, len(raw))
                start = self.n + np.cumsum(size + 1) - size - 1
                ends = np.cumsum(n) - n  # windows before, in the batch
                of = np.repeat(np.arange(len(per)), per)
                head = np.cumsum(per) - per
                self.mh.append(mh), self.ch.append(ch), self.size.append(n)
                self.first.append(start[of] + ends - ends[head][of])
                text.write((np.frombuffer(b"\xff".join([x.as_buffer() for x in raw]) + b"\xff", np.uint8) + np.uint8(1)).tobytes())  # UTF-8 never has FF: it becomes 0
                line = np.zeros(int((size + 1).sum()), np.uint8)
                at = np.repeat(self.first[-1] - self.n - (np.cumsum(n) - n), n) + np.arange(n.sum())
                line[at] = np.repeat(np.minimum(w, 2), n).astype(np.uint8)
                weight.write(line.tobytes())
                self.n += len(line)
            text.write(bytes(PAD))
        self.mh, self.ch, self.size, self.first = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.mh, self.ch, self.size, self.first))

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """The text, and for each place of it: does a window that repeats start there?"""
        text = np.memmap(self.path, np.uint8, "r").view(np.ndarray)
        weight = np.memmap(self.weights, np.uint8, "r").view(np.ndarray)
        hit, left = self.folder.array(self.n, bool), np.empty(0, np.int64)

        def close(at: np.ndarray, heads: np.ndarray) -> None:
            w = weight[at]
            total = np.add.reduceat(w.astype(np.int64), heads)
            some = np.repeat(total > 1, np.diff(np.append(heads, len(at)))) & (w > 0)
            hit[at[some]] = True

        for at, lcp in suffixes(text, self.n, self.width, self.folder):
            at = np.concatenate((left, at.astype(np.int64)))
            same = np.concatenate((np.arange(len(left)) > 0, lcp >= self.width))
            same[0] = False
            heads = np.flatnonzero(~same)
            if len(heads) > 1:
                close(at[: heads[-1]], heads[:-1])
            left = at[heads[-1] :]  # the run may go on
        if len(left):
            close(left, np.zeros(1, np.int64))
        return text, hit

    def answers(self, mark) -> Iterator[pa.RecordBatch]:
        text, hit = self.repeats()
        for lo in range(0, len(self.first), 4096):
            first, size = self.first[lo : lo + 4096], self.size[lo : lo + 4096]
            out = []
            for mh, ch, a, n in zip(self.mh[lo : lo + 4096].tolist(), self.ch[lo : lo + 4096].tolist(), first.tolist(), size.tolist(), strict=True):
                own = hit[a : a + n]
                if own.all():
                    spans = []
                elif own.any():
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0])))).tolist()
                    spans = [(s, e - s) for s, e in zip(turn[::2], turn[1::2], strict=True)]
                else:
                    continue
                out.append((mh, ch, False, mark((text[a : a + n + self.width - 1] - np.uint8(1)).tobytes()), spans))
            yield answered(out)


def compare(texts: DataFrame, kind: Kind, shards: int, memory: int = MEMORY, names: int = NAMES) -> DataFrame:
    """Answers by the suffix order of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with scratch() as path:
            spool = Spool(Folder(path, memory, names), kind.width)
            spool.fill(batches)
            if spool.n:
                yield from spool.answers(kind.mark)

    return texts.repartition(shards, "mh").select("parts", "text").mapInArrow(run, ANSWERS)


def deduplicate(docs: DataFrame, width: int = 200, gram: int = 64, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY, names: int = NAMES) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, with the bytes that are left as ``kept``; ``width`` is below 255."""
    kind = Kind(width, gram, words=False)
    packed, repeats = documents(docs)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_doc = repeated(packed, kind, False, lambda texts, size: compare(texts, kind, max(least, size // shard_bytes + 1), memory, names), repeats)

    def per_text(text: bytes, starts: np.ndarray, ns: np.ndarray) -> tuple:
        if not len(starts):
            return len(text), 0, 0, hashlib.sha256(text).hexdigest(), text
        hit = covered(starts, ns, width, len(text))
        left = np.frombuffer(text, np.uint8)[~hit].tobytes()
        return len(text), int(hit.sum()), int((np.diff(np.concatenate(([0], hit.astype(np.int8)))) == 1).sum()), hashlib.sha256(left).hexdigest(), left

    return applied(packed, by_doc, kind, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", per_text)
