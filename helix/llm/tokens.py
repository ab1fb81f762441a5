"""Token ids of whole texts, by a tokenizer of the tokenizers library, with a cache of the pieces between which it always cuts.

A byte-level BPE with the usual pattern cuts between a character that isn't white space and white space, and between an ASCII
letter and one of .,;:!? after it, whatever stands around. A text's ids are therefore the ids of those pieces in a row; each
distinct piece is encoded once and kept (by a 64-bit hash of its bytes) until the cache is full.
"""

from __future__ import annotations

import os

import numpy as np

from helix.llm import words as W

SPACE = ~W.NONSPACE
_LETTER = np.array([65 <= b < 91 or 97 <= b < 123 for b in range(256)])
_POINT = np.array([b in b".,;:!?" for b in range(256)])
#: The last byte of a character that can't be white space in any script, as far as this byte alone shows.
_ASCII_INK = np.array([33 <= b < 127 for b in range(256)])
_AS_IS = np.arange(256, dtype=np.uint8)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces, and the rows' offsets in them."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        here, before = data[1:], data[:-1]
        high = before >= 128
        # C2 85, C2 A0 and some of E1.., E2.., E3.. are white space: no cut after what might be one
        second, third = np.zeros(n - 1, np.uint8), np.zeros(n - 1, np.uint8)
        second[1:], third[2:] = data[:-2], data[: max(0, n - 3)]
        ink = _ASCII_INK[before] | (high & (second != 0xC2) & ((third < 0xE1) | (third > 0xE3)))
        cut[1:-1] = (SPACE[here] & ink) | (_POINT[here] & _LETTER[before])
    cut[offsets[offsets < n]] = True
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, offsets)


class Encoder:
    """Encodes runs of texts; keeps up to most pieces. plain: added tokens such as <|endoftext|> in a text are encoded as any other letters.

    Otherwise they are tokens, as by default: no piece ends inside one, as they have no white space and no letter before a point.
    """

    def __init__(self, path: str, most: int = 400_000, plain: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.most = most
        self._empty()

    def _empty(self) -> None:
        self.keys, self.at, self.length = np.zeros(0, W.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _learn(self, texts: list[str], keys: np.ndarray) -> None:
        """keys are in order, and none of them is known."""
        got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        length = np.array([len(x) for x in got], np.int64)
        flat = np.array([i for x in got for i in x], np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = self.used + np.cumsum(length) - length
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.length = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.length, where, length)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in a row, and the rows' offsets in them."""
        starts, ends, rows = pieces(data, offsets)
        keys, first, inverse = np.unique(W.hashes(data, starts, ends, _AS_IS), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most:
            self._empty()
        place = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(place, max(0, len(self.keys) - 1))] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = first[~known]
            raw = data.tobytes()
            self._learn([raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], keys[~known])
            place = np.searchsorted(self.keys, keys)
        at, length = self.at[place][inverse], self.length[place][inverse]
        after = np.cumsum(length)
        total = int(after[-1]) if len(after) else 0
        ids = self.ids[np.repeat(at - (after - length), length) + np.arange(total)]
        return ids, np.concatenate([[0], after])[rows]


def encoder(path: str) -> Encoder:
    """The Python worker's own, kept from task to task as long as these encode."""
    if path not in W.KEPT:
        W.KEPT[path] = Encoder(path, plain=False)
    return W.KEPT[path]
