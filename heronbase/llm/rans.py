"""Token ids in files, entropy-coded with static rANS.

Two folders make a data set: ``table`` has one row, the frequencies that all blocks
share (quantised to ``2**BITS``); ``blocks`` has rows ``shard, block, first, n_docs,
n_tokens, body``.  Shards and blocks are in ascending order of document id, and
documents are whole within a block.  A block's ``body`` stands alone:

    magic "HRB1" | u32 header length | header (zlib) | states | words
    header: JSON {n, lanes, stride, words, table, crc, docs, sizes}

``lanes`` coders take turns, token by token, and share one stream of 32-bit words.
Every ``stride`` turns a checkpoint holds all lanes' states and the place in the
stream, so that a block can be entered there and its stretches decoded side by side.
``crc`` is the checksum of states and words, ``table`` that of the frequencies, and
a checksum of each document's ids is kept in ``docs``.  Spark writes both folders, so
a lost executor's tasks are simply run again.

Defined cases: null and empty texts have the end id alone; a null id counts as larger
than any other and reads back as null; equal ids keep a row each, in order of their
ids' bytes; an empty table gives an empty data set; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronbase.llm.common import NULL_ID, doc_key, materialize, pick, scratch, small_batches
from heronbase.llm.tokens import encoder

BITS = 20
LOW = np.uint64(1 << 31)
LANES, STRIDE = 2048, 64
#: Tokens after which a block ends with the document at hand.
BLOCK = 1 << 18
U64 = np.uint64


class DamagedBlock(ValueError):
    """A checksum does not match."""


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to ``2**BITS``, none of a symbol that occurs below one."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint32)
    live = np.flatnonzero(counts)
    if len(live) > 1 << BITS:
        raise ValueError(f"more than {1 << BITS} symbols")
    f = np.zeros(len(counts), np.int64)
    f[live] = np.maximum(1, counts[live].astype(np.float64) / total * (1 << BITS)).astype(np.int64)
    while off := (1 << BITS) - int(f.sum()):
        by_size = live[np.argsort(-f[live], kind="stable")]
        if off < 0:
            by_size = by_size[f[by_size] > 1]
        part = by_size[: max(1, min(abs(off), len(by_size) // 8))]
        step = max(1, abs(off) // len(part))
        f[part] = np.maximum(1, f[part] - step) if off < 0 and step * len(part) <= -off else f[part] + step if off > 0 else np.maximum(1, f[part] - 1)
    return f.astype(np.uint32)


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.most = self.freq << U64(31 - BITS + 32)
        self.mark = zlib.crc32(freq.astype("<u4").tobytes())
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode(table: Table, ids: np.ndarray, docs: list, sizes: list, lanes: int = LANES, stride: int = STRIDE) -> bytes:
    """One block of ``ids``: the documents ``docs`` with ``sizes`` ids each."""
    n = len(ids)
    turns = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    held, marks = 0, []
    freq, start, most = table.freq[ids], table.start[ids], table.most[ids]
    for t in range(turns - 1, -1, -1):
        lo = t * lanes
        k = min(lanes, n - lo)
        f, c = freq[lo : lo + k], start[lo : lo + k]
        own = x[:k]
        full = np.flatnonzero(own >= most[lo : lo + k])
        if len(full):
            words.append((own[full] & U64(0xFFFFFFFF)).astype("<u4"))
            held += len(full)
            own[full] >>= U64(32)
        q, r = np.divmod(own, f)
        x[:k] = (q << U64(BITS)) + r + c
        if t % stride == 0:
            marks.append((held, x.astype("<u8").tobytes()))
    marks.reverse()
    states = b"".join(struct.pack("<Q", held - at) + s for at, s in marks)
    stream = np.concatenate(words[::-1]).tobytes() if words else b""
    ends = np.cumsum(sizes)
    little = ids.astype("<u4")
    sums = [zlib.crc32(little[e - s : e].tobytes()) for s, e in zip(sizes, ends.tolist(), strict=True)]
    head = {"n": n, "lanes": lanes, "stride": stride, "words": held, "table": table.mark, "crc": zlib.crc32(stream, zlib.crc32(states)), "docs": list(zip(docs, sums, strict=True)), "sizes": sizes}
    packed = zlib.compress(json.dumps(head, separators=(",", ":")).encode(), 1)
    return b"HRB1" + struct.pack("<I", len(packed)) + packed + states + stream


class Block:
    """A block's header and stretches."""

    def __init__(self, table: Table, body: bytes):
        if body[:4] != b"HRB1":
            raise DamagedBlock("no block")
        (size,) = struct.unpack_from("<I", body, 4)
        try:
            self.head = json.loads(zlib.decompress(body[8 : 8 + size]))
        except (zlib.error, ValueError) as e:
            raise DamagedBlock("header") from e
        self.table, self.n, self.lanes, self.stride = table, self.head["n"], self.head["lanes"], self.head["stride"]
        self.turns = -(-self.n // self.lanes)
        self.stretches = -(-self.turns // self.stride)
        rest = body[8 + size :]
        if zlib.crc32(rest) != self.head["crc"] or table.mark != self.head["table"]:
            raise DamagedBlock("checksum")
        each = 8 + 8 * self.lanes
        self.marks = [(struct.unpack_from("<Q", rest, i * each)[0], np.frombuffer(rest, "<u8", self.lanes, i * each + 8)) for i in range(self.stretches)]
        self.stream = np.frombuffer(rest, "<u4", self.head["words"], self.stretches * each)

    def stretch(self, i: int) -> np.ndarray:
        """Ids between two checkpoints; needs nothing of the others."""
        at, x = self.marks[i]
        x = x.astype(np.uint64)
        first, last = i * self.stride, min(self.turns, (i + 1) * self.stride)
        out = np.empty(min(self.n, last * self.lanes) - first * self.lanes, np.uint32)
        mask, symbol, freq, start = U64((1 << BITS) - 1), self.table.symbol, self.table.freq, self.table.start
        for t in range(first, last):
            k = min(self.lanes, self.n - t * self.lanes)
            own = x[:k]
            slot = own & mask
            s = symbol[slot.astype(np.int64)]
            out[(t - first) * self.lanes :][:k] = s
            own = freq[s] * (own >> U64(BITS)) + slot - start[s]
            low = np.flatnonzero(own < LOW)
            if len(low):
                own[low] = (own[low] << U64(32)) | self.stream[at : at + len(low)]
                at += len(low)
            x[:k] = own
        return out

    def ids(self) -> np.ndarray:
        return np.concatenate([self.stretch(i) for i in range(self.stretches)]) if self.n else np.empty(0, np.uint32)

    def documents(self) -> Iterator[tuple[int, np.ndarray, int]]:
        """``id, ids, checksum`` of each document, checked."""
        ids, at = self.ids().astype("<u4"), 0
        for (doc, mark), size in zip(self.head["docs"], self.head["sizes"], strict=True):
            own = ids[at : at + size]
            at += size
            found = zlib.crc32(own.tobytes())
            if found != mark:
                raise DamagedBlock(f"document {doc}")
            yield doc, own, found


def width_of(vocabulary: str) -> str:
    """The least kind of number that holds the vocabulary's ids."""
    return "<u2" if encoder(vocabulary).size <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, vocabulary: str, end: int, width: str) -> DataFrame:
    """``doc, ids``: each document's ids and the end id, little-endian, in ``width`` bytes each; ``counts`` of all ids in a row of its own for each task."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, tail = encoder(vocabulary), np.array([end], width)
        counts = np.zeros(max(encode_texts.size, end + 1), np.int64)
        for b in batches:
            ids = encode_texts(b.column(1))
            counts += np.bincount(np.concatenate(ids), minlength=len(counts)) if ids else 0
            counts[end] += len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.append(x, tail).astype(width).tobytes() for x in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], names=["doc", "ids", "counts"])
        encode_texts.rest()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["doc", "ids", "counts"])

    return pick(docs, "doc_id", "text").select(doc_key().alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc long, ids binary, counts binary")


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Counts of all ids; no larger than the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                own = np.frombuffer(x, "<i8")
                total = own.copy() if total is None else total + own
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 2, block: int = BLOCK) -> str:
    """Tokenizes whole texts and writes the data set to ``path``."""
    spark = docs.sparkSession
    width = width_of(vocabulary)
    tokens = materialize(tokenised(docs, vocabulary, end, width), "tokens")
    freq, each = quantised(frequencies(tokens)), np.dtype(width).itemsize
    spark.createDataFrame([(BITS, bytearray(zlib.compress(freq.astype("<u4").tobytes())))], "bits int, frequencies binary").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)  # no larger than the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, shard, number = Table(shared.value), TaskContext.get().partitionId(), 0
        docs, parts, held, first = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, docs, parts, held, first
            sizes = [len(p) // each for p in parts]
            body = encode(table, np.frombuffer(b"".join(parts), width), docs, sizes)
            row = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((shard, pa.int32()), (number, pa.int32()), (first, pa.int64()), (len(docs), pa.int64()), (held, pa.int64()), (body, pa.binary()))], names=["shard", "block", "first", "n_docs", "n_tokens", "body"])
            number, first = number + 1, first + held
            docs, parts, held = [], [], 0
            return row

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append(doc)
                parts.append(ids)
                held += len(ids) // each
                if held >= block:
                    yield flush()
        if docs:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.where("counts IS NULL").select("doc", "ids").repartitionByRange(n, "doc").sortWithinPartitions("doc", "ids")
    ordered.mapInArrow(run, "shard int, block int, first long, n_docs long, n_tokens long, body binary").write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of every document, decoded block by block."""
    small_batches(spark)
    row = spark.read.parquet(f"{path}/table").first()
    freq = np.frombuffer(zlib.decompress(bytes(row.frequencies)), "<u4")
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema("shard int, block int, first long, n_docs long, n_tokens long, body binary").parquet(f"{path}/blocks")
    # one row a shard: where its ids begin
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    begin = F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(F.broadcast(sizes.select("shard", begin.alias("begin"))), "shard").select((F.col("begin") + F.col("first")).alias("at"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for b in batches:
            for at, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs, starts, sizes, sums, ids = [], [], [], [], []
                for doc, own, mark in Block(table, body.as_py()).documents():
                    docs.append(None if doc == NULL_ID else doc)
                    starts.append(at)
                    sizes.append(len(own))
                    sums.append(mark)
                    ids.append(own.tobytes())
                    at += len(own)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str, end: int = 2, path: str | None = None) -> DataFrame:
    """Writes the files and reads them back."""
    return read(docs.sparkSession, write(docs, path or scratch(docs.sparkSession, "rans"), vocabulary, end))
