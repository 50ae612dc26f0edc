"""Hashed text features: word n-grams, skip-grams and word shapes, whole batches at a time."""

from __future__ import annotations

import numpy as np

from heronbase.llm.pieces import STRETCH, Hasher, mixed

_KEEP = set(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Lower-cases A-Z; all but letters, digits and bytes of other scripts becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP or b >= 128 else 32 for b in range(256))
#: Classes of bytes for shapes; white space as it is.
SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def laid_out(h: Hasher, texts: list[bytes], folding: bytes) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Word hashes, the text each word is of, the joined text and the words' ends in it."""
    joined = b"\n".join(texts).translate(folding)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts, ends, hashes = h.words(joined)
    return hashes, np.searchsorted(np.cumsum(size), starts, "right"), joined, starts, ends


def word_features(h: Hasher, texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``text, feature``: unigrams, bigrams and skip-grams over one word, with repeats."""
    w, own, *_ = laid_out(h, texts, FOLD)
    down = np.uint64(64 - bits)
    out_own, out = [own], [w >> down]
    for gap, salt in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        if len(w) > gap:
            same = own[gap:] == own[:-gap]
            pair = mixed(w[:-gap] * np.uint64(salt) + w[gap:])[same]
            out_own.append(own[gap:][same])
            out.append(pair >> down)
    return np.concatenate(out_own), np.concatenate(out).astype(np.int64)


def shape_features(h: Hasher, texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``text, feature``: words as shapes (``Ab``, ``AB!``, ``a%``: runs of a class count once)."""
    folded = []
    for t in texts:
        b = np.frombuffer(t.translate(SHAPE), np.uint8)
        folded.append(b[np.concatenate(([True], b[1:] != b[:-1]))].tobytes() if len(b) else b"")
    w, own, *_ = laid_out(h, folded, bytes(range(256)))
    return own, (mixed(w ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - bits)).astype(np.int64)


def hasher() -> Hasher:
    return Hasher(STRETCH)


def distinct(own: np.ndarray, features: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    """The distinct features of each text."""
    both = np.unique((own.astype(np.int64) << bits) | features)
    cut = np.searchsorted(both, np.arange(1, n, dtype=np.int64) << bits)
    return [x & ((1 << bits) - 1) for x in np.split(both, cut)] if n else []
