"""Exact ids of a word-level BPE vocabulary, many words at a time.

The tokenizer library tokenizes running text at about a megabyte a second, much of it spent on
words that it has seen. Here a batch's texts are normalised and split as the vocabulary file
says; each distinct chunk between white space is split into runs and encoded once, and its ids are
kept as bytes, so that a document's ids are one join of byte strings. Runs that aren't known yet
are encoded together: all of them take their lowest-ranked merge in step, as array operations. The library itself stays the
judge: it encodes whatever is outside the fast path, and tests compare both.
"""

from __future__ import annotations

import json
import re as std_re
import unicodedata
from collections.abc import Iterable

import numpy as np

#: Runs of more bytes than this, or with merges outside the file's form, go to the library.
LONG = 40
#: Beyond this many known chunks, those that a batch doesn't hold are forgotten.
KNOWN = 250_000
#: Outside these, Unicode versions of the regular expression engines may differ.
UNSURE = std_re.compile("[^\u0000-\u052f\u2000-\u206f]")
#: Beyond any pair's number.
NONE = np.int64(1 << 62)
#: Where str.split() divides and the vocabulary's white space doesn't.
NO_BLANK = std_re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet of such vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBPE:
    """Encoder for a vocabulary file of the kind `BPE with word ends; lower case, white space dropped`."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split).findall
        self.specials = [t["content"] for t in spec["added_tokens"]]
        vocab = model["vocab"]
        names = _byte_letters()
        self.first = np.array([vocab[names[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[names[b] + self.suffix] for b in range(256)], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self._table(left * (1 << 17) + right, np.array([vocab[a + b] for a, b in merges], np.int64))
        self.known: dict[str, bytes] = {}

    def _table(self, keys: np.ndarray, results: np.ndarray) -> None:
        """Open addressing: a slot has a pair's key, its rank and what it merges to."""
        self.bits = 20
        size = 1 << self.bits
        self.keys, self.ranks, self.made = np.full(size, -1, np.int64), np.full(size, 1 << 30, np.int32), np.zeros(size, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            free = self.keys[at] < 0
            one = np.zeros(len(todo), bool)
            one[np.unique(at, return_index=True)[1]] = True
            put = todo[free & one]
            self.keys[slot[put]], self.ranks[slot[put]], self.made[slot[put]] = keys[put], put, results[put]
            todo = todo[~(free & one)]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, slot) of pairs; a pair that no merge has gets rank 2**30."""
        slot = self._slot(keys)
        rank = np.where(self.keys[slot] == keys, self.ranks[slot], np.int32(1 << 30))
        seek = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        for _ in range(self.probes):
            if not len(seek):
                break
            slot[seek] = (slot[seek] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot[seek]] == keys[seek]
            rank[seek[hit]] = self.ranks[slot[seek[hit]]]
            seek = seek[~hit & (self.keys[slot[seek]] >= 0)]
        return rank, slot

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of each run as little-endian unsigned 32-bit integers."""
        raw = [r.encode("utf-8") for r in runs]
        out: list[bytes] = [b""] * len(raw)
        sizes = np.array([len(r) for r in raw])
        for width in (8, 16, LONG):
            pick = np.flatnonzero((sizes <= width) & (sizes > (0 if width == 8 else width // 2 if width == 16 else 16))).tolist()
            if pick:
                for i, b in zip(pick, self._merge([raw[i] for i in pick], width), strict=True):
                    out[i] = b
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self._by_library(runs[i])
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For pairs of ids, one number that grows with the merge's rank and holds what it makes and the left id's place; NONE without a merge."""
        rank, slot = self._lookup(left * (1 << 17) + right)
        return np.where(rank < 1 << 30, rank.astype(np.int64) << 32 | self.made[slot] << 8 | place, NONE)

    def _merge(self, raw: list[bytes], width: int) -> list[bytes]:
        """A column a run: its ids, each one's neighbours, and each pair's number; merges free places, nothing moves."""
        n = len(raw)
        size = np.array([len(r) for r in raw])
        text = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(n, width).T
        ids, live = self.first[text], np.arange(n)
        ids[size - 1, live] = self.last[text[size - 1, live]]
        places = np.arange(width)[:, None]
        ids[places >= size] = -1
        after, before = np.repeat(places + 1, n, 1), np.repeat(places - 1, n, 1)
        pair = np.full((width, n), NONE)
        at, run = np.nonzero(ids[1:] >= 0)
        pair[at, run] = self._pairs(ids[at, run], ids[at + 1, run], at)
        while len(live):
            low = pair[:, live].min(0)
            live, low = live[low < NONE], low[low < NONE]
            at, made = low & 255, low >> 8 & 0xFFFFFF
            gone = after[at, live]
            right, left = after[gone, live], before[at, live]
            ids[at, live], ids[gone, live], after[at, live] = made, -1, right
            pair[at, live] = pair[gone, live] = NONE
            r, l = np.flatnonzero(right < size[live]), np.flatnonzero(left >= 0)
            before[right[r], live[r]] = at[r]
            # the pairs right and left of the new id
            a, where = np.concatenate([at[r], left[l]]), np.concatenate([live[r], live[l]])
            pair[a, where] = self._pairs(ids[a, where], np.concatenate([ids[right[r], live[r]], made[l]]), a)
        kept = ids.T >= 0
        flat = ids.T[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def chunks(self, text: str) -> list[str] | None:
        """The text's chunks between white space, normalised; None if it has characters or special tokens that only the library should judge."""
        if any(s in text for s in self.specials):
            return None
        if not text.isascii():
            if UNSURE.search(text):
                return None
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # the library lower-cases letter by letter
        text = text.lower()
        # no run holds white space, and none depends on what stands before or behind it
        return self.find(text) if NO_BLANK.search(text) else text.split()

    def _learn(self, chunks: set[str]) -> None:
        """Puts the chunks' ids among the known ones; runs that aren't known as chunks themselves are encoded together."""
        # letters are one run, and so is what stands alone behind them
        alone = [c for c in chunks if c.isalpha()]
        split = {c: (c[:-1], c[-1]) if c[:-1].isalpha() else self.find(c) for c in chunks.difference(alone)}
        runs = list(set(alone).union(*split.values()).difference(self.known))
        ids = dict(zip(runs, self.encode_runs(runs), strict=True))
        own, known = ids.get, self.known.get
        self.known.update({c: b"".join([own(r) or known(r) for r in some]) for c, some in split.items()})
        self.known.update(zip(alone, map(ids.__getitem__, alone), strict=True))

    def encode_bytes(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; none are added at its ends."""
        texts = list(texts)
        split = [self.chunks(t) for t in texts]
        met = set().union(*[s for s in split if s is not None])
        new = met.difference(self.known)
        if len(self.known) + len(new) > KNOWN:
            self.known = {c: self.known[c] for c in met.difference(new)}
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [self._by_library(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
