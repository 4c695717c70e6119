"""Ids of whole texts from public tokenizers, each distinct stretch of text encoded once.

A text is cut only where the tokenizer's own rules never join what stands on both
sides, so that the ids of the stretches, put together, are those of the whole text:

* words: at white space, for a tokenizer that drops it;
* spaced: before a run of ASCII white space that follows a character which is no
  white space, for byte-level tokenizers whose pieces have white space in front only;
* blanks: before a run of spaces, for pieces that hold spaces in front only.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from .wordscan import IS_SPACE, U, buffers, runs, scan, span_hashes

#: Distinct stretches that a worker remembers, and bytes of text looked up at a time.
REMEMBERED, STRETCH_BYTES = 1 << 21, 2 << 20
#: Stretches in one call of the tokenizer.
GROUP = 512


def cut_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = scan(data, bounds)
    return w.start, w.end


def cut_spaced(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = IS_SPACE[data]
    last, before = data[:-1], np.r_[np.uint8(0), data[:-2]]
    found = np.flatnonzero(space[1:] & ~space[:-1])
    last, before = last[found], before[found]
    far = ((before == 0xC2) & ((last == 0x85) | (last == 0xA0))) | (before == 0x80) | (before == 0x81) | (before == 0x9A)  # may end a wider space
    return _from_starts(found[np.where(last < 0x80, (last < 0x1C) | (last > 0x1F), ~far)] + 1, data, bounds)


def cut_blanks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _from_starts(np.flatnonzero((data[1:] == 32) & (data[:-1] != 32)) + 1, data, bounds)


def _from_starts(found: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(len(data) + 1, bool)
    first[found] = True
    first[bounds[:-1]] = True
    start = np.flatnonzero(first[:-1])
    return start, np.append(start[1:], len(data)) if len(start) else start


def _proof(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second 64 bits of each stretch, from its size and its first and last eight bytes, made in another way than the hash."""
    wide = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(wide) - 7,), "<u8", wide, 0, (1,))
    size = (end - start).astype(U)
    drop = U(64) - (np.minimum(size, U(8)) << U(3))  # bits of what stands around a short one
    return (eight[start + 8] << drop) * U(0x9FB21C651E98DF25) + (eight[end] >> drop) + size


class Stretches:
    """Ids of stretches by their hash. A second 64 bits are compared on each hit, so a stretch is taken for another with a chance of 2^-128 a pair.

    encode takes texts and their sizes in bytes, and gives parts: places in the texts, all
    ids of these texts in order, and how many each has.
    """

    def __init__(self, encode: Callable[[list[str], np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], cut: Callable):
        self.encode, self.cut = encode, cut
        self._clear()

    def _clear(self) -> None:
        self.hash, self.entry = np.zeros(0, U), np.zeros(0, np.int64)
        self.proof = np.zeros(0, U)
        self.at, self.flat, self.used, self.entries = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0, 0

    def _learn(self, h: np.ndarray, proof: np.ndarray, texts: list[str], bytes_of: np.ndarray) -> np.ndarray:
        """The entries of new stretches, given by rising hash."""
        places, ids, sizes = zip(*self.encode(texts, bytes_of), strict=True)
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(flat), len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.at = np.concatenate([self.at, self.used + np.cumsum(size)])
        self.used += len(flat)
        entry = np.empty(len(h), np.int64)
        entry[np.concatenate(places)] = self.entries + np.arange(len(h))
        place = np.searchsorted(self.hash, h)
        self.entry = np.insert(self.entry, place, entry)
        self.hash = np.insert(self.hash, place, h)
        self.proof = np.insert(self.proof, place, proof)
        self.entries += len(h)
        return entry

    def _look(self, h: np.ndarray, proof: np.ndarray) -> np.ndarray:
        """The entry of each stretch; -1: unknown, -2: another text has its hash."""
        if not len(self.hash):
            return np.full(len(h), -1)
        place = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[place] != h, -1, np.where(self.proof[place] == proof, self.entry[place], -2))

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of documents, and their bounds by document."""
        start, end = self.cut(data, bounds)
        names = span_hashes(data, start, end)
        back, h = pd.factorize(names)  # without a sort of all; numbered as they first stand
        first = np.flatnonzero(np.diff(np.maximum.accumulate(back), prepend=-1))
        order = np.argsort(h)
        proof = _proof(data, start, end)
        of_first = proof[first]
        if self.entries + len(h) > REMEMBERED:
            self._clear()
        found = np.empty(len(h), np.int64)
        found[order] = self._look(h[order], of_first[order])
        if (proof != of_first[back]).any() or (found == -2).any():  # equal hashes of different texts
            raw = data.tobytes()
            parts = self.encode([raw[x:y].decode() for x, y in zip(start.tolist(), end.tolist(), strict=True)], end - start)
            own: list = [None] * len(start)
            for place, ids, size in parts:
                for k, x in zip(place.tolist(), np.split(ids, np.cumsum(size)[:-1]), strict=True):
                    own[k] = x
            before = np.cumsum([0, *map(len, own)])
            return np.concatenate(own).astype(np.uint32), before[np.searchsorted(start, bounds)]
        new = order[found[order] < 0]
        if len(new):
            raw = data.tobytes()
            a, b = start[first[new]], end[first[new]]
            found[new] = self._learn(h[new], of_first[new], [raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)], b - a)
        at = self.at[found]
        size = (self.at[found + 1] - at)[back]
        before = np.concatenate([[0], np.cumsum(size)])
        step = np.repeat(at[back] - before[:-1], size)
        step += np.arange(len(step))
        out = self.flat[step]
        return out, before[np.searchsorted(start, bounds)]

    def batches(self, arr: pa.Array):
        """For each run of documents: its first place, ids and bounds."""
        data, bounds = buffers(arr)
        for i, j in runs(bounds, STRETCH_BYTES):
            ids, at = self.ids(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            yield i, ids, at


def one_by_one(encode: Callable[[list[str]], list[list[int]]]):
    """An encoder of stretches from one of lists of texts."""

    def run(texts: list[str], _: np.ndarray):
        ids = encode(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        yield np.arange(len(texts)), np.fromiter((x for one in ids for x in one), np.uint32, int(size.sum())), size

    return run


def _joined(tok, spaced: bool):
    """An encoder that puts GROUP stretches into one text, where cuts hold as well, and finds them again by the tokens' bytes.

    Without white space between them words are joined by spaces; those with other than ASCII
    letters can change their size in normalisation, so it is taken from the normalised text.
    """
    widths = np.zeros(max(tok.get_vocab().values()) + 1, np.int64)
    for piece, i in tok.get_vocab().items():
        widths[i] = len(piece.removesuffix("</w>")) if not spaced else len(piece)  # a character stands for a byte
    white = set(" \t\n\r\v\f")

    def easy(s: str) -> bool:
        return s[0] in white and (s[-1].isalnum() or (s[-1].isascii() and s[-1] > " "))

    def normal(texts: list[str]) -> np.ndarray | None:
        """Sizes in bytes of words after normalisation; none if it changes their number."""
        parts = tok.normalizer.normalize_str(" ".join(texts)).split(" ")
        return np.array([len(x.encode()) for x in parts]) if len(parts) == len(texts) else None

    def run(texts: list[str], sizes: np.ndarray):
        plain = np.fromiter(map(str.isascii, texts), bool, len(texts))
        simple = np.fromiter(map(easy, texts), bool, len(texts)) if spaced else np.full(len(texts), tok.normalizer is not None) | plain
        rest = [np.flatnonzero(~simple)]
        groups = [places[i : i + GROUP] for kind in ((simple,) if spaced else (simple & plain, simple & ~plain)) for places in [np.flatnonzero(kind)] for i in range(0, len(places), GROUP)]
        glue = "" if spaced else " "
        for g, found in zip(groups, tok.encode_batch_fast([glue.join([texts[k] for k in g.tolist()]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            own = sizes[g] if spaced or plain[g[0]] else normal([texts[k] for k in g.tolist()])
            if own is not None:
                stop, want = np.cumsum(widths[ids]), np.cumsum(own)
                cut = np.searchsorted(stop, want) + 1
                if len(stop) and cut[-1] == len(ids) and np.array_equal(stop[np.minimum(cut, len(stop)) - 1], want):
                    yield g, ids, np.diff(cut, prepend=0)
                    continue
            rest.append(g)
        left = np.concatenate(rest)
        if len(left):
            single = one_by_one(lambda t: [x.ids for x in tok.encode_batch_fast(t, add_special_tokens=False)])
            for _, ids, size in single([texts[k] for k in left.tolist()], sizes[left]):
                yield left, ids, size

    return run


@lru_cache(4)
def byte_level(path: str, spaced: bool) -> Stretches:
    """Stretches of a file of the tokenizers library, without added special tokens; one for each worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Stretches(_joined(Tokenizer.from_file(path), spaced), cut_spaced if spaced else cut_words)
