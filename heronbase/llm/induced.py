"""External induced sorting of suffixes, with common-prefix values.

The text lies in a file.  Its leftmost S-type (LMS) substrings are sorted by one round of
induction and named; the string of names, in a file too, is sorted in turn, by the same
induction while it has more than ``NAMES`` names and by prefix doubling below.  A second
round induces all other suffixes from the LMS suffixes in their order.

A round has two passes over a monotone priority queue: a suffix that leaves the queue puts
the one before it in.  Keys are (symbol, rank of the source), and sources leave in order
of rank, so a queue is one first-in first-out run for each symbol, or for each range of
symbols where the alphabet is that of names.  Runs are on disk beyond ``memory`` entries and
are read back in chunks.  A tuple carries the common prefix with its predecessor in the
run: one more than the least of those between their sources.

Memory holds ``memory`` entries of the queue, a chunk or a range of it at work, the last
level's names, and nothing that grows with the text; that, names and orders are mapped
files.  Only the first
``depth`` symbols matter: prefix values are exact below ``depth`` and ``depth`` from there
on, and suffixes that agree so far stand in any order.  Behind the text's end stands a
symbol below all others.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np

#: Entries of a queue that stay in memory, names that are sorted in memory, and entries that are worked on at a time.
MEMORY, NAMES, CHUNK = 1 << 20, 1 << 21, 1 << 18
#: Bytes behind a text's end in its file, so that eight can be read from any place.
PAD = 16


@dataclass
class Counters:
    """What a sort has done beyond memory: entries written by its queues, and levels that were sorted by induction."""

    spilled: int = 0
    levels: int = 0


class Folder:
    """Mapped arrays and runs in one folder."""

    def __init__(self, path: str, memory: int = MEMORY, names: int = NAMES):
        self.path, self.memory, self.names, self.count, self.counters = path, memory, names, 0, Counters()

    def name(self) -> str:
        self.count += 1
        return os.path.join(self.path, f"{self.count}")

    def array(self, n: int, kind) -> np.ndarray:
        """A mapped array of zeros whose file goes with the last reference to it."""
        if not n:
            return np.empty(0, kind)
        path = self.name()
        found = np.memmap(path, kind, "w+", shape=(n,))
        os.remove(path)
        return found.view(np.ndarray)


def position_kind(n: int):
    return np.int32 if n < 2**31 else np.int64


class Runs:
    """First-in first-out runs of positions, with common prefixes if ``lcps``, one for each symbol or range, on disk beyond the folder's memory."""

    def __init__(self, folder: Folder, kind, lcps: bool):
        self.folder, self.kinds = folder, (kind, np.uint8)[: 1 + lcps]
        self.base = folder.name()
        self.parts: dict[int, list[tuple]] = {}
        self.on_disk: dict[int, int] = {}
        self.held = 0

    def _path(self, symbol: int, i: int) -> str:
        return f"{self.base}-{symbol}-{i}"

    def put(self, symbol: int, *arrays: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append(arrays)
        self.held += len(arrays[0])
        if self.held > self.folder.memory:
            self.spill()

    def spill(self) -> None:
        for symbol, parts in self.parts.items():
            for i, kind in enumerate(self.kinds):
                with open(self._path(symbol, i), "ab") as f:
                    for p in parts:
                        f.write(np.ascontiguousarray(p[i], kind).tobytes())
            self.on_disk[symbol] = self.on_disk.get(symbol, 0) + sum(len(p[0]) for p in parts)
        self.folder.counters.spilled += self.held
        self.parts, self.held = {}, 0

    def _read(self, symbol: int, lo: int, n: int) -> tuple:
        return tuple(np.fromfile(self._path(symbol, i), kind, n, offset=lo * np.dtype(kind).itemsize) for i, kind in enumerate(self.kinds))

    def scan(self, symbol: int) -> Iterator[tuple]:
        """The run in chunks, from its start, with whatever is put in meanwhile."""
        done = 0
        while True:
            disk, parts = self.on_disk.get(symbol, 0), self.parts.get(symbol, ())
            if done < disk:
                found = self._read(symbol, done, min(CHUNK, disk - done))
            else:
                skip, found = done - disk, None
                for p in parts:
                    if skip < len(p[0]):
                        found = tuple(x[skip : skip + CHUNK] for x in p)
                        break
                    skip -= len(p[0])
                if found is None:
                    return
                # small parts are taken together
                rest = [p for p in parts[next(i for i, q in enumerate(parts) if q is p) + 1 :]] if len(found[0]) < CHUNK and skip + len(found[0]) == len(p[0]) else []
                more, size = [found], len(found[0])
                for q in rest:
                    if size + len(q[0]) > CHUNK:
                        break
                    more.append(q)
                    size += len(q[0])
                if len(more) > 1:
                    found = tuple(np.concatenate([m[i] for m in more]) for i in range(len(self.kinds)))
            done += len(found[0])
            yield found

    def back(self, symbol: int) -> Iterator[tuple]:
        """The run in chunks, from its end, each in order; the run goes."""
        for p in reversed(self.parts.pop(symbol, ())):
            self.held -= len(p[0])
            yield p
        left = self.on_disk.pop(symbol, 0)
        if left:
            while left:
                n = min(CHUNK, left)
                yield self._read(symbol, left - n, n)
                left -= n
            for i in range(len(self.kinds)):
                os.remove(self._path(symbol, i))

    def drop(self, symbol: int) -> None:
        for _ in self.back(symbol):
            pass

    def symbols(self) -> set[int]:
        return self.on_disk.keys() | self.parts.keys()


def least_between(lcp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """min(lcp[i + 1 .. j]) for pairs i < j."""
    if not len(i):
        return np.empty(0, lcp.dtype)
    level = np.frexp((j - i).astype(np.float64))[1] - 1
    out = np.empty(len(i), lcp.dtype)
    table = lcp
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[i[at] + 1], table[j[at] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


class Keys:
    """Up to eight bytes, or one larger symbol, from any place as one number."""

    def __init__(self, text: np.ndarray, n: int):
        self.n, self.per = n, 8 if text.dtype == np.uint8 else 1
        self.view = np.ndarray((len(text) - 7,), ">u8", text.data, strides=(1,)) if self.per == 8 else text

    def at(self, p: np.ndarray) -> np.ndarray:
        if self.per == 8:
            return self.view[np.minimum(p, self.n)].astype(np.uint64)
        return np.where(p < self.n, self.view[np.minimum(p, self.n - 1)], -1).astype(np.int64).view(np.uint64)


def common(keys: Keys, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the suffixes of bytes at ``a`` and ``b``, exact below ``depth``."""
    out = np.zeros(len(a), np.int64)
    live, done = np.arange(len(a)), 0
    while len(live) and done < depth:
        x = keys.at(a[live] + done) ^ keys.at(b[live] + done)
        # leading equal bytes: from the highest set bit
        high = np.frexp((x >> np.uint64(11)).astype(np.float64))[1] + 11
        high = np.where(x >> np.uint64(11) == 0, np.frexp(x.astype(np.float64))[1], high)
        out[live] += np.where(x == 0, 8, (64 - high) // 8)
        live = live[x == 0]
        done += 8
    return np.minimum(out, depth)


def equal(keys: Keys, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are the ``size`` symbols at ``a`` and at ``b`` the same?"""
    out = np.ones(len(a), bool)
    live, done = np.arange(len(a)), 0
    while len(live):
        x = keys.at(a[live] + done) ^ keys.at(b[live] + done)
        left = size[live] - done
        if keys.per == 8:
            x >>= ((8 - np.clip(left, 0, 8)) * 8).clip(0, 63).astype(np.uint64)
            x = np.where(left <= 0, np.uint64(0), x)
        same = x == 0
        out[live[~same]] = False
        live = live[same & (left > keys.per)]
        done += keys.per
    return out


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first ``depth`` names; those that still have equals are sorted again, by twice as many."""
    n, step = len(names), 1
    order = np.argsort(names)
    rank = np.zeros(n + 1, np.int64)  # places before the group, from 1 on; behind the end stands the least
    some = order  # what is not alone in its group, group by group
    at = np.arange(n)  # its places in the order
    key = names[order].astype(np.int64)
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.flatnonzero(new)
        rank[some] = at[head][np.cumsum(new) - 1] + 1
        tied = np.repeat(np.diff(np.append(head, len(some))) > 1, np.diff(np.append(head, len(some))))
        some, at = some[tied], at[tied]
        if not len(some) or step >= depth:
            return order
        key = rank[some] * (n + 2) + rank[np.minimum(some + step, n)]
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[at] = some
        step *= 2


def lms_places(text: np.ndarray, n: int, folder: Folder) -> np.ndarray:
    """Positions of the LMS suffixes in order of the text."""
    out = folder.array(n // 2 + 1, position_kind(n))
    at = len(out)
    rises = False  # is the suffix behind the chunk of type S?  The last one is of type L
    for hi in range(n, 0, -CHUNK):
        lo = max(0, hi - CHUNK)
        x = text[lo : hi + (hi < n)].astype(np.int64)
        if hi == n:
            x = np.append(x, -1)
        step = np.sign(x[1:] - x[:-1])
        # a symbol equal to the next one is of its type
        known = np.flatnonzero(step)
        up = np.repeat(step[known] > 0, np.diff(np.concatenate(([-1], known)))) if len(known) else np.empty(0, bool)
        up = np.concatenate((up, np.full(len(step) - len(up), rises)))
        if rises and not up[-1]:
            at -= 1
            out[at] = hi
        found = np.flatnonzero(up[1:] & ~up[:-1]) + 1 + lo
        at -= len(found)
        out[at : at + len(found)] = found
        rises = bool(up[0])
    return out[at:]


class Names:
    """Names of LMS substrings, given out as they come in descending order."""

    def __init__(self, text: np.ndarray, n: int, lms: np.ndarray, folder: Folder):
        self.keys, self.n, self.lms = Keys(text, n), n, lms
        self.order = folder.array(len(lms), lms.dtype)  # descending
        self.name = folder.array(n // 2 + 1, np.int32 if n < 2**31 else np.int64)  # by half the position: no two LMS places are neighbours
        self.place = folder.array(n // 2 + 1, np.int32 if n < 2**31 else np.int64)
        for lo in range(0, len(lms), CHUNK):
            own = lms[lo : lo + CHUNK]
            self.place[own >> 1] = np.arange(lo, lo + len(own))
        self.done, self.last, self.names = 0, None, 0

    def size(self, at: np.ndarray) -> np.ndarray:
        """Symbols up to the next LMS place, that one's included; more than there are for the last."""
        after = self.place[at >> 1].astype(np.int64) + 1
        return np.where(after < len(self.lms), self.lms[np.minimum(after, len(self.lms) - 1)], self.n + 1) - at + 1

    def take(self, at: np.ndarray) -> None:
        if not len(at):
            return
        at = at.astype(np.int64)
        before = np.concatenate(([self.last if self.last is not None else at[0]], at[:-1]))
        a, b = self.size(before), self.size(at)
        new = np.ones(len(at), bool)
        # the last substring ends with the text and is equal to no other
        some = np.flatnonzero((a == b) & (at + b <= self.n) & (before + a <= self.n))
        new[some] = ~equal(self.keys, before[some], at[some], b[some])
        if self.last is None:
            new[0] = True
        self.name[at >> 1] = self.names + np.cumsum(new) - 1
        self.names += int(new.sum())
        self.order[self.done : self.done + len(at)] = at
        self.done += len(at)
        self.last = int(at[-1])


def sorted_lms(text: np.ndarray, n: int, depth: int, folder: Folder, level: int) -> np.ndarray:
    """Positions of the LMS suffixes in order of the first ``depth`` symbols."""
    folder.counters.levels = max(folder.counters.levels, level + 1)
    lms = lms_places(text, n, folder)
    if len(lms) < 2:
        return lms
    names = Names(text, n, lms, folder)
    if text.dtype == np.uint8:
        seeds, off = by_symbol(text, lms, folder)
        for at, _ in induced_bytes(text, n, seeds, off, 0, folder):
            # of type S here, and so LMS if the symbol before is larger
            names.take(at[(at > 0) & (text[np.maximum(at - 1, 0)] > text[at])] if len(at) else at)
    else:
        for _, at in induced_names(text, n, lms, True, folder):
            names.take(at)
    if names.names == len(lms):
        out = folder.array(len(lms), lms.dtype)
        for lo in range(0, len(lms), CHUNK):
            out[lo : lo + CHUNK] = names.order[len(lms) - lo - min(CHUNK, len(lms) - lo) : len(lms) - lo][::-1]
        return out
    reduced = folder.array(len(lms) + 1, np.int32 if n < 2**31 else np.int64)
    for lo in range(0, len(lms), CHUNK):
        reduced[lo : min(lo + CHUNK, len(lms))] = names.names - 1 - names.name[lms[lo : lo + CHUNK] >> 1]
    del names
    # a name spans two symbols at least
    order = sorted_names(reduced, depth // 2 + 1, folder, level + 1)
    out = folder.array(len(lms), lms.dtype)
    for lo in range(0, len(lms), CHUNK):
        out[lo : lo + CHUNK] = lms[order[lo : lo + CHUNK]]
    return out


def sorted_names(text: np.ndarray, depth: int, folder: Folder, level: int) -> np.ndarray:
    """Order of all suffixes of a string of names (one place less than ``text`` has) by their first ``depth`` names."""
    n = len(text) - 1
    if n <= folder.names:
        return doubled(text[:n], depth)
    seeds = sorted_lms(text, n, depth, folder, level)
    out, at = folder.array(n, position_kind(n)), n
    for some, _ in induced_names(text, n, seeds, False, folder):
        at -= len(some)
        out[at : at + len(some)] = some[::-1]
    return out


# -- names: a range of symbols at a time -------------------------------------------


def ranges(text: np.ndarray, n: int, most: int, folder: Folder) -> np.ndarray:
    """First symbols of ranges that hold about ``most`` suffixes each, and one symbol more than there are."""
    top = 0
    for lo in range(0, n, CHUNK):
        top = max(top, int(text[lo : min(n, lo + CHUNK)].max()))
    counts = folder.array(top + 1, position_kind(n))
    for lo in range(0, n, CHUNK):
        s, k = np.unique(text[lo : min(n, lo + CHUNK)], return_counts=True)
        counts[s] += k.astype(counts.dtype)
    cuts, held = [0], 0
    for lo in range(0, top + 1, CHUNK):
        ends = held + np.cumsum(counts[lo : lo + CHUNK], dtype=np.int64)
        cell = ends // most
        cuts += (np.flatnonzero(cell[1:] != cell[:-1]) + lo + 1).tolist()
        held = int(ends[-1])
    return np.array([*dict.fromkeys(cuts), top + 1])


def induced_names(text: np.ndarray, n: int, lms: np.ndarray, naming: bool, folder: Folder) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, a range of symbols at a time, and the LMS ones among them, from LMS places (sorted unless ``naming``)."""
    kind = position_kind(n)
    cuts = ranges(text, n, max(1, folder.memory // 8), folder)
    of = lambda t: np.searchsorted(cuts, t, "right") - 1
    symbol = memoryview(text)
    falling, rising, seeds = Runs(folder, kind, False), Runs(folder, kind, False), Runs(folder, kind, False)

    def dealt(runs: Runs, at: np.ndarray) -> None:
        for lo in range(0, len(at), CHUNK):
            some = np.asarray(at[lo : lo + CHUNK], kind)
            r = of(text[some])
            order = np.argsort(r, kind="stable")
            some, r = some[order], r[order]
            edge = np.concatenate(([0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)]))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b > a:
                    runs.put(int(r[a]), some[a:b])

    def buckets(runs: Runs, r: int, lo: int, hi: int) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(hi - lo)]
        if parts := [at for (at,) in runs.scan(r)]:
            at = np.concatenate(parts)
            s = text[at] - lo
            order = np.argsort(s, kind="stable")
            s, flat = s[order], at[order].tolist()
            edge = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1))
            for k, a, b in zip(s[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(s)], strict=True):
                out[k] = flat[a:b]
        runs.drop(r)
        return out

    dealt(seeds, lms)
    dealt(falling, np.array([n - 1], kind))
    symbol[n] = -1  # stands before the first symbol: puts nothing in
    for r in range(len(cuts) - 1):
        lo, hi = int(cuts[r]), int(cuts[r + 1])
        own, first, out = buckets(falling, r, lo, hi), buckets(seeds, r, lo, hi), []
        far = out.append
        for c, run, seed in zip(range(lo, hi), own, first, strict=True):
            for p in run:  # the run grows meanwhile
                t = symbol[p - 1]
                if t >= c:
                    if t < hi:
                        own[t - lo].append(p - 1)
                    else:
                        far(p - 1)
            for p in seed:
                t = symbol[p - 1]
                if t < hi:
                    own[t - lo].append(p - 1)
                else:
                    far(p - 1)
        whole = np.fromiter(chain.from_iterable(own), kind)
        if len(whole):
            falling.put(r, whole)
        dealt(falling, np.array(out, kind))
    symbol[n] = np.iinfo(text.dtype).max
    for r in range(len(cuts) - 2, -1, -1):
        lo, hi = int(cuts[r]), int(cuts[r + 1])
        fell, own, out, whole, found = buckets(falling, r, lo, hi), buckets(rising, r, lo, hi), [], [], []
        far, lms_at = out.append, found.append
        for s in range(hi - lo - 1, -1, -1):
            c, run, last = lo + s, own[s], fell[s]
            for p in run:  # the run grows meanwhile
                t = symbol[p - 1]
                if t > c:
                    lms_at(p)
                elif t >= lo:
                    own[t - lo].append(p - 1)
                else:
                    far(p - 1)
            last.reverse()
            for p in last:
                t = symbol[p - 1]
                if t < c:
                    if t >= lo:
                        own[t - lo].append(p - 1)
                    else:
                        far(p - 1)
            if not naming:
                whole += run
                whole += last
        dealt(rising, np.array(out, kind))
        some = np.array(found, kind)
        yield np.array(whole, kind), some[some > 0]


# -- bytes: a symbol at a time, with common prefixes ---------------------------------


def by_symbol(text: np.ndarray, lms: np.ndarray, folder: Folder) -> tuple[np.ndarray, np.ndarray]:
    """LMS places dealt by their symbols, and where each symbol's begin."""
    counts = np.zeros(256, np.int64)
    for lo in range(0, len(lms), CHUNK):
        counts += np.bincount(text[lms[lo : lo + CHUNK]], minlength=256)
    off = np.concatenate(([0], np.cumsum(counts)))
    out, at = folder.array(len(lms), lms.dtype), off[:-1].copy()
    for lo in range(0, len(lms), CHUNK):
        own = lms[lo : lo + CHUNK]
        s = text[own]
        order = np.argsort(s, kind="stable")
        own, s = own[order], s[order]
        edge = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            c = int(s[a])
            out[at[c] : at[c] + b - a] = own[a:b]
            at[c] += b - a
    return out, off


class Sweep:
    """What one pass has put into the runs so far: for each symbol the least common prefix since its last source."""

    def __init__(self, text: np.ndarray, runs: Runs, depth: int):
        self.text, self.runs, self.depth = text, runs, depth
        self.low, self.begun = np.full(256, 255, np.uint8), np.zeros(256, bool)

    def take(self, at: np.ndarray, lcp: np.ndarray | None, c: int, up: bool, same: bool) -> None:
        """Sources of symbol ``c`` in order; they put in what is before them, if its symbol is larger (``up``) or smaller, or ``same``."""
        before = np.maximum(at - 1, 0)
        symbol = self.text[before]
        fits = (symbol > c) if up else (symbol < c)
        if same:
            fits |= symbol == c
        src = np.flatnonzero(fits & (at > 0))
        to = symbol[src]
        order = np.argsort(to, kind="stable")
        src, to = src[order], to[order]
        edge = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)])) if len(to) else np.zeros(1, np.int64)
        found = before[src]
        if self.depth:
            near = np.empty(len(src), np.uint8)
            heads, tails, kinds = edge[:-1], edge[1:] - 1, to[edge[:-1]] if len(to) else to
            inner = np.ones(len(src), bool)
            inner[heads] = False
            inner = np.flatnonzero(inner)
            near[inner] = least_between(lcp, src[inner - 1], src[inner])
            forth = np.minimum.accumulate(lcp)
            near[heads] = np.minimum(self.low[kinds], forth[src[heads]])
            near = np.minimum(near, self.depth - 1) + np.uint8(1)
            near[heads[~self.begun[kinds]]] = 0
            self.begun[kinds] = True
            self.low = np.minimum(self.low, forth[-1])
            behind = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
            self.low[kinds] = behind[src[tails] + 1]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            self.runs.put(int(to[a]), *((found[a:b], near[a:b]) if self.depth else (found[a:b],)))


def induced_bytes(text: np.ndarray, n: int, seeds: np.ndarray, off: np.ndarray, depth: int, folder: Folder) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Suffixes in descending order, in chunks of one symbol and type, with the common prefix with the one before (up to ``depth``); without, and S-type ones alone, if ``depth`` is 0."""
    kind, keys = position_kind(n), Keys(text, n)
    falling, rising = Runs(folder, kind, bool(depth)), Runs(folder, kind, bool(depth))
    down, up = Sweep(text, falling, depth), Sweep(text, rising, depth)
    first = (np.array([n - 1], kind), np.zeros(1, np.uint8))
    falling.put(int(text[n - 1]), *first[: 1 + bool(depth)])
    down.begun[text[n - 1]] = True
    down.low[text[n - 1]] = 0
    present = np.zeros(256, bool)
    for lo in range(0, n, CHUNK):
        present[text[lo : min(n, lo + CHUNK)]] = True
    symbols = np.flatnonzero(present).tolist()

    def prefix(a: int, b: int) -> int:
        return int(common(keys, np.array([a]), np.array([b]), depth)[0])

    for c in symbols:
        last = None
        for at, *lcp in falling.scan(c):
            down.take(at, lcp[0] if depth else None, c, True, True)
            last = int(at[-1])
        for lo in range(int(off[c]), int(off[c + 1]), CHUNK):
            at, near = seeds[lo : min(lo + CHUNK, int(off[c + 1]))], None
            if depth:
                near = np.empty(len(at), np.uint8)
                near[0] = prefix(last, int(at[0])) if last is not None else 0
                near[1:] = common(keys, at[:-1].astype(np.int64), at[1:].astype(np.int64), depth)
            down.take(at, near, c, True, False)
            last = int(at[-1])
    for c in reversed(symbols):
        last, ahead = None, 0
        for at, *lcp in rising.scan(c):
            up.take(at, lcp[0] if depth else None, c, False, True)
            last = int(at[-1])
            yield at, lcp[0] if depth else None
        rising.drop(c)
        for at, *lcp in falling.back(c):
            at, near = at[::-1], None
            if depth:
                near = np.concatenate(([ahead], lcp[0][:0:-1])).astype(np.uint8)
                if last is not None:
                    near[0] = prefix(last, int(at[0]))
                    last = None
                ahead = lcp[0][0]
            up.take(at, near, c, False, False)
            if depth:
                yield at, near


def suffixes(text: np.ndarray, n: int, depth: int, folder: Folder) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffix positions in descending order, in chunks, each with its common prefix with the one before it; 1 <= ``depth`` < 255.

    ``text`` holds ``n`` bytes and ``PAD`` more.
    """
    if not n:
        return
    seeds = sorted_lms(text, n, depth, folder, 0)
    off = np.zeros(257, np.int64)
    for lo in range(0, len(seeds), CHUNK):
        off[1:] += np.bincount(text[seeds[lo : lo + CHUNK]], minlength=256)
    yield from induced_bytes(text, n, seeds, np.cumsum(off), depth, folder)
