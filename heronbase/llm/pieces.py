"""Which stretches of documents can repeat, found and routed by content.

A window is ``width`` consecutive symbols.  Its anchor is the smallest hash among
its grams of ``gram`` symbols, the leftmost of equal ones; consecutive windows with the
same gram as anchor form a piece.  Equal windows have equal anchors at the same offset,
so whatever repeats meets under its anchor, every window of a document belongs to one
piece of it, and no piece holds a window twice.  A document yields a piece per
``(width - gram) / 2`` windows or so; texts are not moved to find out what repeats.

Hashes only route and fold.  Copies of a piece are one content; one text of each content
whose anchor occurs more than once goes to the caller's method, together with the others
under its anchor, and the method's answer is joined back to every copy.  There the copy's
own text is held against a cryptographic digest of the text that was answered for, so no
two contents with equal hashes can pass for each other unnoticed: that raises.  A content that is
alone under its anchor has no other one to be compared with; such neighbours in a
document travel as one stretch.

An anchor with more than ``HOT`` different contents (the edges of a passage that a large
part of the corpus shares) is dealt anew window by window, each under the hash of its
whole content: windows are counted by a grouping that combines before the shuffle, and the
text of each that repeats goes to the method once.

A piece that a document holds more than once (a line repeated over and over) travels
once, with the number of its places; they are found again where the text is at hand.
Copies among the documents of a batch are combined before the shuffle: the earliest one
stands for all, and the others are dealt at random instead of to the anchor's task.  So a
passage that a third of all documents share sends each anchor a row a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronbase.llm.common import doc_key, materialize, pick, small_batches

#: Windows hashed at a time; longer documents are taken in overlapping stretches.
STRETCH = 1 << 16
PLACE = np.uint64((1 << 17) - 1)
#: Different contents that may meet under an anchor.
HOT = 2000
BASE = 0x9E3779B97F4A7C15
PIECES = "doc long, ver long, start long, n int, reps int, mh long, ch long"
#: ``more``: places in other documents that were combined into this row; ``known``: combined into another row.
FOUND = PIECES + ", more int, known boolean"
#: What the method gets: one text with the contents that it is made of, in order (``weight``: places of each; ``spread``: documents after its first hold it too).
PART = pa.struct([("mh", pa.int64()), ("ch", pa.int64()), ("n", pa.int32()), ("weight", pa.int64()), ("spread", pa.bool_())])
TEXTS = "mh long, doc long, parts array<struct<mh:long,ch:long,n:int,weight:long,spread:boolean>>, text binary, hot boolean"
#: What it answers: windows of a content that repeat (no spans: all), for its first document and, with ``later``, for all others.
ANSWERS = "mh long, ch long, later boolean, mark long, spans array<struct<off:int,k:int>>"


class Collision(ValueError):
    """Two contents with equal hashes."""


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Polynomial hashes modulo 2**64 of any stretch of up to ``size`` symbols."""

    def __init__(self, size: int):
        self.size = 0
        self.bytes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        self.grow(size)

    def grow(self, size: int) -> None:
        if size > self.size:
            self.size = size
            up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts, ends) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.down[starts])

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words between ASCII white space."""
        out = []
        lo = 0
        while lo < len(text):
            hi = lo + STRETCH
            while hi < len(text) and not text[hi : hi + 1].isspace():
                hi += 1
            b = np.frombuffer(text, np.uint8, min(hi, len(text)) - lo, lo)
            gap = np.ones(len(b) + 2, bool)
            gap[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
            turn = np.flatnonzero(gap[1:] != gap[:-1])
            s, e = turn[::2], turn[1::2]
            out.append((s + lo, e + lo, self.spans(self.prefix(self.bytes[b]), s, e)))
            lo = hi
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while k * 2 <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if k < w else x


def cut(h: Hasher, values: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``start, n, anchor, content`` of the pieces of a document's symbols."""
    for lo in range(0, len(values) - width + 1, STRETCH):
        v = values[lo : lo + STRETCH + width - 1]
        sums = h.prefix(v)
        grams = np.arange(len(v) - gram + 1)
        hashes = h.spans(sums, grams, grams + gram)
        # the place in the low bits tells equal grams apart
        low = sliding_min((hashes & ~PLACE) | grams.astype(np.uint64), width - gram + 1)
        change = np.flatnonzero(low[1:] != low[:-1]) + 1
        s, e = np.concatenate(([0], change)), np.concatenate((change, [len(low)]))
        yield s + lo, (e - s).astype(np.int32), hashes[(low[s] & PLACE).astype(np.int64)], h.spans(sums, s, e - 1 + width) ^ mixed((e - s).astype(np.uint64))


@dataclass(frozen=True)
class Kind:
    """What symbols are: bytes, or words as bytes between white space."""

    width: int
    gram: int
    words: bool

    def symbols(self, h: Hasher, text: bytes) -> np.ndarray:
        return h.words(text)[2] if self.words else h.bytes[np.frombuffer(text, np.uint8)]

    def tokens(self, text: bytes) -> bytes | list[bytes]:
        return text.split() if self.words else text

    def mark(self, tokens: bytes | list[bytes]) -> int:
        """A cryptographic digest of a content."""
        return int.from_bytes(hashlib.blake2b(b" ".join(tokens) if self.words else tokens, digest_size=8).digest(), "little", signed=True)

    def content(self, h: Hasher, text: bytes, starts: np.ndarray, ns: np.ndarray) -> list[bytes]:
        ends = starts + ns + self.width - 1
        if self.words:
            s, e, _ = h.words(text)
            starts, ends = s[starts], e[ends - 1]
        return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def documents(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``id, doc, ver, z``: the row's id as given, its comparable id, a mark that tells texts under one id apart, the packed text; and whether ids repeat."""
    small_batches(docs.sparkSession)
    own = pick(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), doc_key().alias("doc"), F.col("text").cast("string").alias("text"))
    repeats = bool(own.groupBy("doc").count().where("count > 1").head(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from xxhash import xxh3_64_intdigest

        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            ver = np.array([xxh3_64_intdigest(t) if repeats else 0 for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ver), pa.array([pack.compress(t) for t in texts], pa.binary())], names=["id", "doc", "ver", "z"])

    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, doc long, ver long, z binary"), repeats


def unpack(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z) if z else b""


@dataclass
class Laid:
    """All pieces of a text, in order of their starts."""

    start: np.ndarray
    n: np.ndarray
    mh: np.ndarray
    ch: np.ndarray

    @classmethod
    def of(cls, h: Hasher, kind: Kind, text: bytes) -> Laid | None:
        parts = list(cut(h, kind.symbols(h, text), kind.width, kind.gram))
        return cls(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else None

    def key(self) -> np.ndarray:
        return mixed(self.mh) + self.ch


def combined(out: list[tuple], first: bool) -> pa.RecordBatch:
    """A batch's pieces, copies told apart from the one that stands for them."""
    doc, ver, start, n, reps, mh, ch = (np.concatenate(x) for x in zip(*out, strict=True))
    key = mixed(mh.view(np.uint64)) + ch.view(np.uint64)
    order = np.lexsort((start, doc, key))
    key, doc, ver, start, n, reps, mh, ch = (x[order] for x in (key, doc, ver, start, n, reps, mh, ch))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    head = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    known = ~new & ((doc > doc[head][of]) | (not first))
    more = np.zeros(len(key), np.int64)
    more[head] = np.add.reduceat(np.where(known, reps, 0), head)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, ver, start, n, reps, mh, ch, more.astype(np.int32), known)], names=["doc", "ver", "start", "n", "reps", "mh", "ch", "more", "known"])


def pieces(packed: DataFrame, kind: Kind, first: bool) -> DataFrame:
    """The different pieces of all documents, each with its first place in a document and the number of its places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(STRETCH + kind.width)
        for b in batches:
            out, held = [], 0
            for doc, ver, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = Laid.of(h, kind, unpack(z.as_py()))
                if own is None:
                    continue
                _, at, reps = np.unique(own.key(), return_index=True, return_counts=True)
                k = len(at)
                out.append((np.full(k, doc, np.int64), np.full(k, ver, np.int64), own.start[at].astype(np.int64), own.n[at], reps.astype(np.int32), own.mh[at].view(np.int64), own.ch[at].view(np.int64)))
                held += k
                if held > 200_000:
                    yield combined(out, first)
                    out, held = [], 0
            if out:
                yield combined(out, first)

    return packed.select("doc", "ver", "z").mapInArrow(run, FOUND)


def settle(found: DataFrame, first: bool) -> DataFrame:
    """Pieces whose anchor occurs more than once: ``later`` (in a document after the content's first), ``rep`` (stands for its content), the content's places as ``weight``, whether later documents hold it too (``spread``), whether it is the ``single`` one under its anchor or one of a ``hot`` number.

    ``first``: only what stands in an earlier document counts; else whatever stands anywhere else.
    """
    found = found.withColumn("at", F.when(F.col("known"), F.xxhash64("doc", "start", "mh")).otherwise(F.col("mh")))
    met = Window.partitionBy("at", "known")
    same = Window.partitionBy("at", "known", "ch")
    n = found.sparkSession.conf.get("spark.sql.shuffle.partitions")
    x = found.repartition(int(n), "at")
    # most anchors occur once, and go before anything else is computed
    if first:
        x = x.withColumns({"least": F.min("doc").over(met), "most": F.max("doc").over(met), "elsewhere": F.sum("more").over(met)}).where("known or elsewhere > 0 or least < most")
        x = x.withColumns({"lo": F.min("doc").over(same), "last": F.max("doc").over(same), "folded": F.sum("more").over(same)})
        later, spread = F.expr("known or doc > lo"), F.expr("folded > 0 or last > lo")
    else:
        x = x.withColumn("places", F.sum(F.col("reps") + F.col("more")).over(met)).where("known or places > 1")
        later = spread = F.lit(False)
    x = x.withColumn("weight", F.sum(F.col("reps") + F.col("more")).over(same)).withColumn("nth", F.row_number().over(same.orderBy("doc", "start", "ver")))
    x = x.withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(met))
    rep = F.expr("not known and nth = 1")
    return x.select("doc", "ver", "start", "n", "reps", "mh", "ch", later.alias("later"), rep.alias("rep"), F.col("weight").cast("long").alias("weight"), spread.alias("spread"), (F.col("kinds") == 1).alias("single"), (F.col("kinds") > HOT).alias("hot"))


def with_text(packed: DataFrame, reps: DataFrame, kind: Kind) -> DataFrame:
    """The texts of ``doc, ver, start, n, mh, ch, weight, spread, single, hot``; single ones that follow each other in a document as one."""
    by_doc = reps.groupBy("doc", "ver").agg(F.array_sort(F.collect_list(F.struct("start", "n", "mh", "ch", "weight", "spread", "single", "hot"))).alias("own"))
    near = packed.select("doc", "ver", "z").join(by_doc, ["doc", "ver"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(STRETCH + kind.width)
        for b in batches:
            for i in range(b.num_rows):
                doc = b.column(0)[i].as_py()
                own, text = b.column(3)[i].values, unpack(b.column(2)[i].as_py())
                start, n, single = (own.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n", "single"))
                # a stretch begins where the one before ends elsewhere, or either is not single
                begins = np.concatenate(([True], (start[1:] != start[:-1] + n[:-1]) | ~single[1:] | ~single[:-1]))
                head = np.flatnonzero(begins)
                whole = np.add.reduceat(n.astype(np.int64), head)
                texts = kind.content(h, text, start[head].astype(np.int64), whole)
                parts = pa.StructArray.from_arrays([own.field(t.name).cast(t.type) for t in PART], fields=list(PART))
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(n)).astype(np.int32)), parts)
                at = pa.array(head)
                yield pa.RecordBatch.from_arrays([own.field("mh").take(at), pa.array(np.full(len(head), doc, np.int64)), lists, pa.array(texts, pa.binary()), own.field("hot").take(at)], names=["mh", "doc", "parts", "text", "hot"])

    return near.mapInArrow(run, TEXTS)


def dealt_anew(texts: DataFrame, kind: Kind) -> DataFrame:
    """Every window of the contents: its hash ``w`` and its text; its place ``off`` in content ``mh, ch`` with digest ``mark``, whose first document is ``doc``, whose places are ``weight`` and which is ``spread``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(STRETCH + kind.width)
        for b in batches:
            for doc, parts, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                (own,) = parts
                tokens = kind.tokens(text)
                mark = kind.mark(tokens)
                for off, _, w, _ in cut(h, kind.symbols(h, text), kind.width, kind.width):  # the whole window is its own gram
                    k = len(off)
                    each = [tokens[i : i + kind.width] for i in off.tolist()]
                    columns = [pa.array(w.view(np.int64)), pa.array(off.astype(np.int32)), *(pa.array(np.full(k, x, np.int64)) for x in (own["mh"], own["ch"], own["weight"], mark, doc)), pa.array(np.full(k, own["spread"]))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([b" ".join(x) for x in each] if kind.words else each, pa.binary())], names=["w", "off", "mh", "ch", "weight", "mark", "doc", "spread", "text"])

    return texts.select("doc", "parts", "text").mapInArrow(run, "w long, off int, mh long, ch long, weight long, mark long, doc long, spread boolean, text binary")


Method = Callable[[DataFrame, int], DataFrame]


def of_hot(texts: DataFrame, kind: Kind, first: bool, method: Method) -> DataFrame:
    """Answers for contents under hot anchors, put together from answers for their windows."""
    wins = materialize(dealt_anew(texts, kind), "windows")
    one = F.xxhash64("mh", "ch", "off")  # tells the places of a window apart
    per = wins.groupBy("w").agg(F.min("doc").alias("lo"), F.max("doc").alias("most"), F.bool_or("spread").alias("any"), F.sum("weight").alias("all"), F.min(one).alias("one"))
    per = materialize(per.where("any or lo < most" if first else "all > 1"), "repeated-windows")
    part = F.struct(F.col("w").alias("mh"), F.col("w").alias("ch"), F.lit(1).alias("n"), F.col("all").alias("weight"), F.expr("any or lo < most").alias("spread"))
    asked = wins.select("w", "text", one.alias("own")).join(per, "w").where("own = one").select(F.col("w").alias("mh"), F.col("lo").alias("doc"), F.array(part).alias("parts"), "text")
    found = materialize(method(asked, per.count() * (kind.width + 1)).select(F.col("mh").alias("w"), F.col("later").alias("after")).distinct(), "window-answers")
    each = wins.drop("text").join(per.select("w", "lo"), "w").withColumn("later", F.explode(F.array(F.lit(False), F.lit(True)))).where(F.expr("not later or spread") if first else F.expr("not later"))
    hits = each.withColumn("after", F.expr("later or doc > lo") if first else F.lit(False)).join(found, ["w", "after"])
    return hits.groupBy("mh", "ch", "later").agg(F.min("mark").alias("mark"), F.collect_set(F.struct("off", F.lit(1).alias("k"))).alias("spans"))


def repeated(packed: DataFrame, kind: Kind, first: bool, method: Method, repeats: bool) -> DataFrame:
    """``doc, ver, own``: each document's pieces with repeated windows, and what the method says of them.

    ``method`` gets texts (``TEXTS``) and the number of symbols in them, and answers
    (``ANSWERS``).  Where ids repeat (``repeats``), very many rows may be equal: the result is
    written, so that they make a skewed join, which Spark splits.
    """
    settled = materialize(settle(pieces(packed, kind, first), first), "settled")
    asked = F.when(F.expr("rep and not hot"), F.col("n") + F.when(F.col("single"), 16).otherwise(kind.width))
    size, hot = settled.agg(F.coalesce(F.sum(asked), F.lit(0)), F.coalesce(F.bool_or("hot"), F.lit(False))).first()
    texts = with_text(packed, settled.where("rep"), kind)
    if hot:
        texts = materialize(texts, "texts")
    answers = method(texts.where("not hot"), size)
    if hot:
        answers = answers.unionByName(of_hot(texts.where("hot"), kind, first, method))
    answers = materialize(answers, "answers")
    found = settled.select("doc", "ver", "start", "n", "reps", "mh", "ch", "later").join(answers, ["mh", "ch", "later"])
    by_doc = found.groupBy("doc", "ver").agg(F.collect_list(F.struct("start", "n", "reps", "mark", "spans")).alias("own"))
    return materialize(by_doc, "spans") if repeats else by_doc


def within(sizes: list[int], spans: list[tuple[int, int]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Which of the contents of a stretch, of ``sizes`` windows each, have windows in ``spans`` (in order), and where in them."""
    if not spans:
        return
    edge = at = 0
    for i, n in enumerate(sizes):
        own = []
        while at < len(spans) and spans[at][0] < edge + n:
            s, k = spans[at]
            own.append((max(s - edge, 0), min(s + k, edge + n) - max(s, edge)))
            if s + k > edge + n:
                break
            at += 1
        edge += n
        if own:
            yield i, own


def answered(rows: list[tuple]) -> pa.RecordBatch:
    """``mh, ch, later, mark, [(off, k), ...]`` as answers."""
    mh, ch, later, mark, spans = zip(*rows, strict=True) if rows else ((),) * 5
    flat = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
    both = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["off", "k"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in spans]))).astype(np.int32)), both)
    return pa.RecordBatch.from_arrays([pa.array(mh, pa.int64()), pa.array(ch, pa.int64()), pa.array(later, pa.bool_()), pa.array(mark, pa.int64()), lists], names=["mh", "ch", "later", "mark", "spans"])


def covered(starts: np.ndarray, ns: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` symbols lie in a window of the spans."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + ns + width - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def applied(packed: DataFrame, by_doc: DataFrame, kind: Kind, schema: str, per_text: Callable[[bytes | list[bytes], np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """``per_text(tokens, starts, ns)`` for each document with its spans, as columns after ``doc_id``."""
    near = packed.join(by_doc, ["doc", "ver"], "left").select("id", "z", "own")
    names = [x.split()[0] for x in schema.split(",")]

    def placed(h: Hasher, text: bytes, tokens: bytes | list[bytes], own: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of windows, once the text of each piece is found to be the one that was answered for."""
        start, n, reps = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "n", "reps"))
        marks, spans = own.field("mark").to_numpy(zero_copy_only=False), own.field("spans")
        given = spans.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        whole = given == 0
        count = np.where(whole, 1, given)
        first = np.cumsum(count) - count
        off, k = np.zeros(int(count.sum()), np.int64), np.zeros(int(count.sum()), np.int64)
        k[first[whole]] = n[whole]
        at = np.repeat(first, given) + np.arange(int(given.sum())) - np.repeat(np.cumsum(given) - given, given)
        off[at], k[at] = (spans.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("off", "k"))
        piece = np.arange(len(start))
        if (often := reps > 1).any():
            laid = Laid.of(h, kind, text)
            key = laid.key()
            mine = key[np.searchsorted(laid.start, start[often])]
            places = np.flatnonzero(np.isin(key, mine))
            of = dict(zip(mine.tolist(), np.flatnonzero(often).tolist(), strict=True))
            piece = np.concatenate((piece[~often], np.array([of[x] for x in key[places].tolist()], np.int64)))
            start = np.concatenate((start[~often], laid.start[places]))
        for a, b, mark in zip(start.tolist(), (start + n[piece] + kind.width - 1).tolist(), marks[piece].tolist(), strict=True):
            if kind.mark(tokens[a:b]) != mark:
                raise Collision("two contents have the same hashes")
        own_count = count[piece]
        which = np.repeat(first[piece], own_count) + np.arange(int(own_count.sum())) - np.repeat(np.cumsum(own_count) - own_count, own_count)
        return np.repeat(start, own_count) + off[which], k[which]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, none = Hasher(STRETCH + kind.width), np.empty(0, np.int64)
        for b in batches:
            out = []
            for i in range(b.num_rows):
                own, text = b.column(2)[i].values, unpack(b.column(1)[i].as_py())
                tokens = kind.tokens(text)
                out.append(per_text(tokens, *((none, none) if own is None else placed(h, text, tokens, own))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x)) for x in zip(*out, strict=True))], names=["doc_id", *names])

    return near.mapInArrow(run, f"doc_id {dict(packed.dtypes)['id']}, {schema}")
