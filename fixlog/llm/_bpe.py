"""Exact ids of the public byte-level BPE tokenizers, a batch of texts at a time.

The two tokenizers split a text into pre-tokens that never reach across blanks,
so its ids are those of its pieces (blanks and the word after them) on end.
Each distinct piece is encoded once per worker and kept by fingerprint; texts
are then assembled from pieces by numpy. Pre-tokens come from the tokenizers
library's own normaliser and pre-tokenizer; merges of all new pre-tokens are
applied side by side with the merge list of the same file. Texts that hold a
blank outside ASCII, a control separator or a special token's string go to the
library whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pandas as pd

from ._arrays import BLANK, CACHES, Texts, owner

#: Pieces a worker keeps before it lets those go that it met once: bounds its memory, not its results.
KEPT_PIECES = 2_000_000
#: Of them those that wait in a dictionary before they are sorted in.
FRESH = 50_000
_BIG = np.int32(2**31 - 1)


class Merges:
    """The merge list of a BPE model, applied to many pre-tokens at once."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.width = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = 20
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _BIG, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[slot] >= 0 and self.keys[slot] != key:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            if self.keys[slot] < 0:
                self.keys[slot], self.ranks[slot] = key, rank
        size = max(ord(c) for c in vocab if len(c) == 1) + 1
        self.inner, self.last = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for c in range(size):
            self.inner[c], self.last[c] = vocab.get(chr(c), -1), vocab.get(chr(c) + self.suffix, -1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.ranks[slot], _BIG)
        left = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        while len(left):
            at = slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            here = self.keys[at]
            hit = here == keys[left]
            found[left[hit]] = self.ranks[at[hit]]
            left = left[~hit & (here >= 0)]
        return found

    def apply(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens on end, and the position of each one's first."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        code = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths) - 1
        sym = self.inner[code]
        sym[ends] = self.last[code[ends]]
        word = np.repeat(np.arange(len(tokens)), lengths)
        done_sym, done_word = [], []
        while len(sym):
            pair = word[:-1] == word[1:]
            rank = np.full(len(sym), _BIG, np.int32)
            at = np.flatnonzero(pair)
            rank[at] = self.rank(sym[at].astype(np.int64) * self.width + sym[at + 1])
            heads = np.flatnonzero(np.concatenate([[True], ~pair]))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(sym)))
            least = np.repeat(least, sizes)
            over = least == _BIG
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank, least = sym[keep], word[keep], rank[keep], least[keep]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            # of overlapping places take every second, from the left
            run = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))
            nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[nth % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        count = np.bincount(word, minlength=len(tokens)) if len(tokens) else np.zeros(0, np.int64)
        return (np.concatenate(done_sym)[order] if done_sym else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(count)])


class Encoder:
    def __init__(self, path: str, kept: int = KEPT_PIECES):
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path) as f:
            conf = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Merges(conf["model"])
        self.size = self.merges.width
        self.special = [t["content"].encode() for t in conf["added_tokens"]]
        self.with_blanks = conf["pre_tokenizer"]["type"] == "ByteLevel"  # blanks are part of pre-tokens
        self.reset()

    def reset(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.fresh: dict[int, int] = {}
        self.n = 0
        self.ids, self.used = np.zeros(1 << 20, np.uint16 if self.size <= 1 << 16 else np.int32), 0
        self.start, self.length, self.again = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32), np.zeros(1 << 18, bool)

    def thin(self) -> None:
        """Keeps only the pieces met again since the last time; none if they'd fill half of the room."""
        self._sort_in()
        keep = self.again[self.slots]
        keys, slots = self.keys[keep], self.slots[keep]
        start, length = self.start[slots], self.length[slots]
        before = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        ids = self.ids[np.repeat(start - before[:-1], length) + np.arange(before[-1])]
        self.reset()
        if len(keys) <= min(self.kept, KEPT_PIECES) // 2:
            self.slots = self._add(ids, before).astype(np.int32)
            self.keys = keys

    def _add(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """New slots for the pieces whose ids lie between ``bounds``."""
        n, need = len(bounds) - 1, self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need - len(self.ids), len(self.ids) // 2), self.ids.dtype)])
        self.ids[self.used : need] = ids
        if self.n + n > len(self.start):
            grow = max(n, len(self.start) // 2)
            self.start, self.length, self.again = (np.concatenate([x, np.zeros(grow, x.dtype)]) for x in (self.start, self.length, self.again))
        slots = np.arange(self.n, self.n + n)
        self.start[slots], self.length[slots] = self.used + bounds[:-1], np.diff(bounds)
        self.used, self.n = need, self.n + n
        return slots

    def _sort_in(self) -> None:
        keys, slots = np.fromiter(self.fresh, np.uint64, len(self.fresh)), np.fromiter(self.fresh.values(), np.int32, len(self.fresh))
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.slots, self.fresh = np.insert(self.keys, at, keys[order]), np.insert(self.slots, at, slots[order]), {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _odd(self, t: Texts) -> np.ndarray:
        """Texts that can't be taken apart at ASCII blanks."""
        b = t.buf
        at = [np.flatnonzero((b >= 0x1C) & (b <= 0x1F))]
        for lead, rest in ((0xC2, (b"\x85", b"\xa0")), (0xE1, (b"\x9a\x80", b"\xa0\x8e")), (0xE2, tuple(bytes([0x80, x]) for x in (*range(0x80, 0x8C), 0xA8, 0xA9, 0xAF)) + (b"\x81\x9f", b"\x81\xa0")), (0xE3, (b"\x80\x80",)), (0xEF, (b"\xbb\xbf",))):
            found = np.flatnonzero(b == lead)
            for tail in rest:
                some = found[found + len(tail) < len(b)]
                for k, x in enumerate(tail):
                    some = some[b[some + 1 + k] == x]
                at.append(some)
        for s in self.special:
            some = np.flatnonzero(b == s[0])
            some = some[some + len(s) <= len(b)]
            for k, x in enumerate(s[1:], 1):
                some = some[b[some + k] == x]
            at.append(some)
        odd = np.zeros(t.n, bool)
        odd[np.searchsorted(t.at, np.concatenate(at), "right") - 1] = True
        return odd

    def _pieces(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.with_blanks:
            return t.words()
        blank = BLANK[t.buf]
        head = blank.copy()
        head[1:] &= ~blank[:-1]
        edge = t.at[:-1]
        head[edge[edge < len(head)]] = True
        start = np.flatnonzero(head)
        return start, np.append(start[1:], len(t.buf)) if len(start) else start, np.searchsorted(start, t.at)

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts on end, and the number of each text's ids."""
        if not len(t.buf):
            return np.zeros(0, self.ids.dtype), np.zeros(t.n, np.int64)
        start, end, at = self._pieces(t)
        odd = self._odd(t)
        if odd.any():
            own = ~odd[owner(at)]
            start, end = start[own], end[own]
            at = np.searchsorted(start, t.at)
        codes, unique = pd.factorize(t.prints(start, end)) if len(start) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        first = np.zeros(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        if self.n + len(unique) > min(self.kept, KEPT_PIECES):
            self.thin()
        slot = self._lookup(unique)
        self.again[slot[slot >= 0]] = True
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = self._learn(t, unique[new], start[first[new]], end[first[new]])
        slot = slot[codes]
        length = self.length[slot].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.repeat(self.start[slot] - before[:-1], length) + np.arange(before[-1])]
        bounds = before[at]
        if odd.any():
            parts, sizes, done = [], np.diff(bounds), 0
            for i in np.flatnonzero(odd).tolist():
                own = np.array(self.whole(t.buf[t.at[i] : t.at[i + 1]].tobytes().decode()), ids.dtype)
                parts += [ids[done : bounds[i]], own]
                sizes[i], done = len(own), bounds[i + 1]
            return np.concatenate([*parts, ids[done:]]), sizes
        return ids, np.diff(bounds)

    def _lookup(self, prints: np.ndarray) -> np.ndarray:
        slot = np.full(len(prints), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, prints), len(self.keys) - 1)
            hit = self.keys[at] == prints
            slot[hit] = self.slots[at[hit]]
        left = np.flatnonzero(slot < 0)
        get = self.fresh.get
        slot[left] = [get(x, -1) for x in prints[left].tolist()]
        return slot

    def _learn(self, t: Texts, prints: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = t.buf.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        ids, bounds = self._split(pieces)
        slots = self._add(ids, bounds)
        self.fresh.update(zip(prints.tolist(), slots.tolist(), strict=True))
        if len(self.fresh) > FRESH:
            self._sort_in()
        return slots

    def _split(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces on end, and their bounds."""
        if self.with_blanks:
            # those without a leading blank, or of blanks alone, stand at an end of their text
            plain = [i for i, p in enumerate(pieces) if p[0] in " \t\n\v\f\r" and not p.isspace()]
            rest = [i for i, p in enumerate(pieces) if not (p[0] in " \t\n\v\f\r" and not p.isspace())]
            text = "".join(pieces[i] for i in plain)
            ends = np.cumsum([len(pieces[i]) for i in plain])
        else:
            plain, rest = list(range(len(pieces))), []
            text = self.tokenizer.normalizer.normalize_str(" ".join(pieces))
            parts = text.split(" ")
            assert len(parts) == len(pieces)
            ends = np.cumsum([len(p) + 1 for p in parts])
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        index: dict[str, int] = {}
        nth = np.fromiter((index.setdefault(tok, len(index)) for tok, _ in found), np.int64, len(found))
        at = np.fromiter((o[0] for _, o in found), np.int64, len(found))
        ids, bounds = self.merges.apply(list(index))
        size = np.diff(bounds)[nth]
        own = np.searchsorted(ends, at, "right")  # the plain piece of each pre-token
        per = np.bincount(own, size, len(plain)).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.repeat(bounds[:-1][nth] - before[:-1], size) + np.arange(before[-1])]
        if not rest:
            return flat, np.concatenate([[0], np.cumsum(per)])
        lengths = np.zeros(len(pieces), np.int64)
        lengths[plain] = per
        singles = [self.whole(pieces[i]) for i in rest]
        lengths[rest] = [len(s) for s in singles]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(bounds[-1], np.int32)
        mask = np.zeros(len(pieces), bool)
        mask[plain] = True
        out[np.repeat(mask, lengths)] = flat
        out[~np.repeat(mask, lengths)] = [x for s in singles for x in s]
        return out, bounds


@lru_cache(maxsize=2)
def encoder(path: str, kept: int = KEPT_PIECES) -> Encoder:
    """One encoder per worker process and file, which keeps ``kept`` pieces at most."""
    return Encoder(path, kept)


CACHES.append(encoder.cache_clear)


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by ``end``, as little-endian 32-bit numbers, and where each text begins."""
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(at[-1], end, "<u4")
    mask = np.ones(at[-1], bool)
    mask[at[1:] - 1] = False
    out[mask] = ids
    return out, at
