"""Token ids of whole texts with a public tokenizer, a word at a time.

The tokenizer's pre-tokenization never joins what ASCII white space parts, its
normalization treats each side alone and folds case, so a text's ids are those of its
words in turn.  Words recur: each worker keeps the ids of those it has met, up to a
bounded number, and the library encodes each word once.  Special tokens' strings are
left to the library, whole.

This holds for the normalization, pre-tokenization and kind of model in ``WORDS`` alone;
with any other file the library encodes whole texts.
"""

from __future__ import annotations

import ctypes
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a tokenizer's file must say for its texts to be taken a word at a time.
WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
#: Words that are kept at most, and those that may stay in an idle worker.
MOST_WORDS, FEW_WORDS = 640_000, 250_000
#: Words that normalization leaves as they are but for case: ASCII and the letters of Latin-1.
PLAIN = re.compile(r"[!-~\u00df-\u00f6\u00f8-\u00ff]+")
#: The vocabulary's own pre-tokenization, for such words.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-@\[-`{-~]+")
#: How byte-level vocabularies show bytes: printable Latin-1 as itself, the rest from U+0100 on; spaces part pieces here.
SHOWN = np.arange(256, dtype="<u4")
SHOWN[[*range(33), *range(127, 161), 173]] = np.arange(256, 256 + 68)
SHOWN[32] = 32


def by_words(path: str) -> bool:
    """May texts be taken a word at a time with this file?"""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model = {k: v for k, v in found["model"].items() if k not in ("vocab", "merges")}
    plain = all(t["content"].startswith("<|") and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in found["added_tokens"])
    return plain and not found.get("truncation") and not found.get("padding") and WORDS == {"normalizer": found["normalizer"], "pre_tokenizer": found["pre_tokenizer"], "model": model}


def give_back() -> None:
    """Returns free memory to the machine, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def listed(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class TextEncoder:
    """Whole texts, by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def rest(self) -> None:
        give_back()

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        return [np.array(x.ids, np.int64) for x in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.offsets = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, self.kind)
        self._add([b""], np.empty(0, np.int64), np.zeros(1, np.int64))  # before leading and behind trailing white space

    def rest(self) -> None:
        """Lets go of most memory: a worker stays for a while when its task has ended, beside others."""
        if len(self.index) > FEW_WORDS:
            self.clear()
        give_back()

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Takes in ``words`` with ``sizes`` of ``ids`` each."""
        n = len(self.index)
        while n + len(words) + 1 > len(self.offsets):
            self.offsets = np.concatenate((self.offsets, np.zeros_like(self.offsets)))
        lo = self.offsets[n]
        hi = lo + len(ids)
        while hi > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[lo:hi] = ids
        self.offsets[n + 1 : n + 1 + len(words)] = lo + np.cumsum(sizes)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries ``at`` in a row, and how many each has."""
        lo = self.offsets[at]
        size = self.offsets[at + 1] - lo
        ends = np.cumsum(size)
        return self.flat[np.repeat(lo - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces by the vocabulary's merges alone, a line of pieces at a time."""
        lines = [pieces[lo : lo + 256] for lo in range(0, len(pieces), 256)]
        shown = [SHOWN[np.frombuffer(b" ".join(x), np.uint8)].tobytes().decode("utf-32-le") for x in lines]
        got = self.merges.encode_batch(shown, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in got), np.int64)
        of = [np.array(e.word_ids, np.int64) for e in got]
        sizes = [np.bincount(w, minlength=len(line)) for w, line in zip(of, lines, strict=True)]
        return ids, np.concatenate(sizes) if sizes else np.empty(0, np.int64)

    def learn(self, words: pa.Array) -> None:
        """Takes in words that are not known yet."""
        letters = pc.and_(pc.ascii_is_alpha(words), pc.ascii_is_lower(words))
        ended = pc.match_substring_regex(words, "^[a-z]+[,.]$")
        whole, other = listed(words.filter(letters)), []
        parted = {w: (w[:-1], w[-1:]) for w in listed(words.filter(ended))}
        for w in listed(words.filter(pc.invert(pc.or_(letters, ended)))):
            text = w.decode().lower()
            # special tokens are the library's to find
            if b"<|" in w or not PLAIN.fullmatch(text):
                other.append(w)
                continue
            parts = [x.encode() for x in PIECE.findall(text)]
            if parts == [w]:
                whole.append(w)
            else:
                parted[w] = parts
        known, new = self.index, dict.fromkeys(whole)
        new.update(dict.fromkeys(x for x in chain.from_iterable(parted.values()) if x not in known))
        self._add([*new], *self._encoded([*new]))
        if parted:
            at = np.fromiter(map(known.__getitem__, chain.from_iterable(parted.values())), np.int64)
            ids, size = self._gathered(at)
            self._add([*parted], ids, np.add.reduceat(size, np.cumsum([0, *map(len, parted.values())])[:-1]))
        if other:
            own = [x.ids for x in self.tokenizer.encode_batch([w.decode() for w in other], add_special_tokens=False)]
            self._add(other, np.fromiter(chain.from_iterable(own), np.int64), np.array([*map(len, own)], np.int64))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty.  Arrow splits the texts and folds equal words, so that each is looked up once a batch."""
        if len(self.index) > MOST_WORDS:
            self.clear()
        texts = pc.fill_null(texts, "")
        # a special token's string is only one in lower case, so texts that may hold it keep theirs
        special = pc.match_substring(texts, "<|")
        folded = pc.if_else(special, texts, pc.ascii_lower(texts)) if pc.any(special).as_py() else pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(folded)
        words = split.flatten().dictionary_encode()
        every = listed(words.dictionary)
        at = list(map(self.index.get, every))
        if None in at:
            missing = [i for i, x in enumerate(at) if x is None]
            self.learn(words.dictionary.take(pa.array(missing)))
            for i in missing:
                at[i] = self.index[every[i]]
        ids, size = self._gathered(np.array(at, np.int64)[words.indices.to_numpy()])
        ends = np.cumsum(split.value_lengths().to_numpy())
        cuts = np.concatenate(([0], np.cumsum(size)))[ends] if len(ends) else []
        return np.split(ids, cuts[:-1]) if len(texts) else []


def encoder(path: str) -> WordEncoder | TextEncoder:
    """One per worker process and vocabulary."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_heronbase_encoders", {})
    if path not in kept:
        kept[path] = (WordEncoder if by_words(path) else TextEncoder)(path)
    return kept[path]
