"""Personal data: fixed forms first, then contextual extraction bootstrapped from them.

Seeds are e-mail addresses, IP addresses, card numbers and phone numbers in their usual
forms.  The words around a seed induce lexical patterns: the two before, the one before
with the one after, the two after.  A pattern with ``SUPPORT`` different seeds of a kind
is then looked up in the whole corpus, and its confidence is the share of what it stands
next to that is known: seeds count fully, other identifier-like instances as far as their
own patterns vouch for them (noisy or), plain words not at all.  An instance is a token,
or a run of tokens of digits and number punctuation, with the patterns around the run.
Confidences and instance scores are iterated over the pattern-instance graph as joins;
identifier-like instances at patterns of at least ``CONFIDENCE`` are added as spans of the
pattern's kind.

Patterns are broadcast in parts of at most ``PART`` hashes; each part has a pass over the
texts, whose finds are written before the next part is fetched, so no broadcast grows
with the corpus.

Defined cases: null and empty texts have no spans; overlapping spans of different kinds
all count; an instance that a base span touches is never added; equal rows (id and text)
count once as evidence of identifiers, their plain words at each place, and each keep their
row; other columns are ignored.  Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronbase.llm.common import doc_key, materialize, pick, small_batches
from heronbase.llm.hashed import hasher
from heronbase.llm.pieces import Hasher, mixed

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.8, 3
PART = 1 << 22
#: Bytes of tokens that can stand in a run, and the fewest digits that make one an instance.
NUMERIC, DIGITS = np.isin(np.arange(256), np.frombuffer(b"0123456789()+-./", np.uint8)), 7

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its start alone: if that fails, so does every later start in it
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SPACE = re.compile(r"[ \t-\r]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` of the fixed forms, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((3, *m.span()))
    return out


class Line:
    """A text's tokens between ASCII white space, as offsets in code points and hashes of their lower-case bytes."""

    def __init__(self, h: Hasher, text: str):
        self.text = text
        raw = text.lower().encode() if text.isascii() else text.encode().lower()
        s, e, self.w = h.words(raw)
        self.raw, self.at = raw, (s, e)
        if len(raw) == len(text):
            self.starts, self.ends = s, e
        else:
            lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            self.starts, self.ends = lead[s] - 1, np.concatenate((lead, [len(text)]))[e - 1]

    def patterns(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The three patterns around tokens ``first .. last``, as rows; 0 where a word is missing."""
        n, w = len(self.w), np.concatenate((self.w, np.zeros(1, np.uint64)))
        at = lambda i: w[np.where((i >= 0) & (i < n), i, n)]
        out = []
        for salt, (a, b) in enumerate(((first - 2, first - 1), (first - 1, last + 1), (last + 1, last + 2)), 1):
            x, y = at(a), at(b)
            out.append(np.where((x != 0) & (y != 0), mixed(mixed(x + np.uint64(salt)) * np.uint64(31) + y), 0))
        return np.stack(out, axis=1)


    def instances(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last token of every instance: the tokens, but runs of numeric ones as one."""
        every = np.arange(len(self.w))
        b = np.frombuffer(self.raw, np.uint8)
        count = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
        fits, digits = count(NUMERIC[b]), count((b >= 48) & (b <= 57))
        s, e = self.at
        numeric = (fits[e] - fits[s] == e - s) & (digits[e] > digits[s])
        if not (numeric[1:] & numeric[:-1]).any():
            return every, every
        goes_on = np.concatenate(([False], numeric[1:] & numeric[:-1]))
        first = np.flatnonzero(~goes_on)
        return first, np.append(first[1:], len(every)) - 1


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """An instance without the punctuation around it, but for a parenthesis that closes within."""
    while end > start and not text[end - 1].isalnum():
        end -= 1
    while start < end and not (text[start].isalnum() or text[start] in "+@" or (text[start] == "(" and ")" in text[start:end])):
        start += 1
    return start, end


def identifier(token: str) -> bool:
    """Does an instance look like one? A run of tokens needs ``DIGITS`` digits."""
    digits = sum(c.isdigit() for c in token)
    return digits >= DIGITS if _SPACE.search(token) else len(token) >= 5 and ("@" in token or digits >= 3)


def value(token: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(token.lower()) - 2**63


def _keyed(docs: DataFrame) -> DataFrame:
    own = pick(docs, "doc_id", "text")
    return own.select(F.col("doc_id").alias("id"), doc_key().alias("doc"), F.xxhash64("text").alias("ver"), F.col("text").cast("string").alias("text"))


def seeds(keyed: DataFrame) -> DataFrame:
    """``doc, ver, kind, start, end, value, patterns`` of the base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher()
        for b in batches:
            out = []
            for doc, ver, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                spans = base_spans(text) if text else []
                if not spans:
                    continue
                line = Line(h, text)
                first = np.searchsorted(line.ends, [s for _, s, _ in spans], "right")
                last = np.searchsorted(line.starts, [e for _, _, e in spans], "left") - 1
                for (kind, s, e), p in zip(spans, line.patterns(first, last).view(np.int64).tolist(), strict=True):
                    out.append({"doc": doc, "ver": ver, "kind": kind, "start": s, "end": e, "value": value(text[s:e]), "patterns": [x for x in p if x]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("doc", pa.int64()), ("ver", pa.int64()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))])
    return keyed.select("doc", "ver", "text").mapInArrow(run, "doc long, ver long, kind int, start long, end long, value long, patterns array<long>")


def matches(keyed: DataFrame, patterns: np.ndarray) -> DataFrame:
    """Written: where ``patterns`` stand, seeds aside: identifier-like tokens as ``pattern, value, doc, ver, start, end``, plain ones counted as ``pattern, n``."""
    shared = keyed.sparkSession.sparkContext.broadcast(np.sort(patterns.view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        h = hasher()
        for b in batches:
            out = []
            plain: dict[int, int] = {}
            for doc, ver, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not text:
                    continue
                line = Line(h, text)
                first, last = line.instances()
                p = line.patterns(first, last)
                some = maybe[(p & np.uint64((1 << 22) - 1)).astype(np.int64)]
                token, which = np.nonzero(some)
                if not len(token):
                    continue
                hit = p[token, which]
                real = (known[np.minimum(np.searchsorted(known, hit), len(known) - 1)] == hit) & (hit != 0)
                token, hit = token[real], hit[real].view(np.int64)
                if not len(token):
                    continue
                spans = base_spans(text)
                for i, x in zip(token.tolist(), hit.tolist(), strict=True):
                    s, e = trimmed(text, int(line.starts[first[i]]), int(line.ends[last[i]]))
                    if any(a < e and s < z for _, a, z in spans):
                        continue
                    if identifier(text[s:e]):
                        out.append({"pattern": x, "value": value(text[s:e]), "doc": doc, "ver": ver, "start": s, "end": e, "n": 0})
                    else:
                        plain[x] = plain.get(x, 0) + 1
            out += [{"pattern": x, "value": None, "doc": None, "ver": None, "start": None, "end": None, "n": n} for x, n in plain.items()]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([(k, pa.int64()) for k in ("pattern", "value", "doc", "ver", "start", "end", "n")])
    found = materialize(keyed.select("doc", "ver", "text").mapInArrow(run, "pattern long, value long, doc long, ver long, start long, end long, n long"), "matches")
    shared.destroy()
    return found


def confidences(known: DataFrame, found: DataFrame, support: int, rounds: int) -> DataFrame:
    """``pattern, kind, confidence`` after ``rounds`` over the graph of ``known`` (pattern, value, kind) and ``found`` matches."""
    plain = found.where("value is null").groupBy("pattern").agg(F.sum("n").alias("plain"))
    unseen = found.where("value is not null").select("pattern", "value").distinct().join(known.select("value").distinct(), "value", "left_anti")
    support_of = known.groupBy("pattern", "kind").agg(F.count_distinct("value").alias("support")).where(F.col("support") >= support)
    size = known.select("pattern", "value").distinct().union(unseen.select("pattern", "value")).groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    base = materialize(support_of.join(size, "pattern").join(plain, "pattern", "left").fillna(0, ["plain"]), "patterns")
    unseen = materialize(unseen, "instances")
    graph = base.withColumn("confidence", F.col("support") / (F.col("size") + F.col("plain")))
    for _ in range(rounds):
        doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999)))))
        # written first: a value or pattern that stands in very many places is then a skewed join, which Spark splits
        instances = materialize(unseen.join(graph, "pattern").groupBy("value", "kind").agg((F.lit(1.0) - doubt).alias("score")), "scores")
        vouched = unseen.join(instances, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("vouched"))
        known_part = F.col("support") + F.coalesce(F.col("vouched"), F.lit(0.0)) * F.col("confidence")
        graph = base.join(graph.select("pattern", "kind", "confidence"), ["pattern", "kind"]).join(vouched, ["pattern", "kind"], "left")
        graph = materialize(graph.select(*base.columns, F.least(F.lit(1.0), known_part / (F.col("size") + F.col("plain"))).alias("confidence")), "graph")
    return graph.select("pattern", "kind", "confidence")


def extract(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, part: int = PART) -> DataFrame:
    """Per row ``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256, spans, n_added``; ``spans`` lists base and added ones."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    base = materialize(seeds(keyed), "seeds")
    known = base.select(F.explode("patterns").alias("pattern"), "value", "kind").distinct()
    asked = materialize(known.groupBy("pattern", "kind").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= support).select("pattern").distinct(), "asked")
    parts = -(-asked.count() // part)
    added = None
    if parts:
        in_part = F.pmod(F.xxhash64("pattern"), F.lit(parts))
        found = None
        for i in range(parts):
            hashes = np.array([r.pattern for r in asked.where(in_part == i).collect()], np.int64)
            if len(hashes):
                one = matches(keyed, hashes)
                found = one if found is None else found.union(one)
        known = known.join(asked, "pattern", "left_semi")
        sure = confidences(known, found, support, rounds).where(F.col("confidence") >= confidence)
        best = sure.groupBy("pattern").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("kind"))).alias("best"))
        hits = found.where("value is not null").join(best, "pattern")
        added = hits.groupBy("doc", "ver", "start", "end").agg(F.max("best").alias("best")).select("doc", "ver", (-F.col("best.kind")).cast("int").alias("kind"), "start", "end", F.lit(False).alias("base"))
    every = base.select("doc", "ver", "kind", "start", "end", F.lit(True).alias("base"))
    every = every if added is None else every.union(added)
    span = F.struct("kind", "start", "end", "base")
    per_doc = every.groupBy("doc", "ver").agg(F.array_sort(F.collect_set(span)).alias("own"))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])
    joined = lambda col: F.concat_ws(",", F.transform(col, shown))
    out = keyed.select("id", "doc", "ver").join(per_doc, ["doc", "ver"], "left")
    own = F.coalesce(F.col("own"), F.array().cast(per_doc.schema["own"].dataType))
    first = F.filter(own, lambda x: x["base"])
    of_kind = lambda k: F.filter(first, lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(first), 256).alias("base_sha256"), joined(own).alias("spans"), (F.size(own) - F.size(first)).cast("long").alias("n_added"))
