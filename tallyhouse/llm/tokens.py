"""Token ids of whole texts by a public tokenizer file, with a cache of pieces.

The tokenizers library encodes every distinct piece of text once per worker; the
rest is looked up. Pieces are cut only where no pre-token of the two supported
byte-pair patterns can cross:

* before white space that follows something else,
* between an ASCII or Latin-1 letter and an ASCII character that is neither letter
  nor white space, in either order, unless an apostrophe opens a contraction,
* after a single tab or line end.

A text with special tokens, other white space or control characters goes to the library whole, so
ids are those of the library for every text. Pieces are told apart by a 64-bit hash
of their bytes. The cache holds at most ``CACHE`` pieces and starts anew beyond.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from tallyhouse.llm.text import BLOCK, Spans, bytes_and_offsets

CACHE = 1_000_000
#: Pieces of letters that are encoded in one string.
_JOIN = 256
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Special tokens, and what may count as white space.
_ODD = re.compile(
    r"<\||[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
)


def _shifted(data: np.ndarray, by: int) -> np.ndarray:
    """The byte ``by`` places before each one, 0 where there is none."""
    out = np.zeros_like(data)
    if by < len(data):
        out[by:] = data[: len(data) - by]
    return out


def piece_starts(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places where a piece may start, with the starts of all values among them."""
    one, two = _shifted(data, 1), _shifted(data, 2)
    after = np.zeros_like(data)
    after[:-1] = data[1:]

    def blank(x):
        return (x == 32) | (x == 9) | (x == 10) | (x == 13)

    def ascii_letter(x):
        return ((x | 32) >= 97) & ((x | 32) <= 122)

    def other(x):
        return (x < 128) & ~ascii_letter(x) & ~blank(x)

    left = ascii_letter(one) | ((two == 0xC3) & (one >= 128) & (one != 0x97) & (one != 0xB7))
    right = ascii_letter(data) | ((data == 0xC3) & (after != 0x97) & (after != 0xB7))
    cut = (blank(data) & ~blank(one)) | (left & other(data)) | (other(one) & (one != 39) & right)
    cut |= blank(one) & (one != 32) & ~blank(two) & ~blank(data)
    cut[values[values < len(data)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """One per Python worker and file; see ``encoder``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        names = self._tokenizer.get_vocab()
        self._closes = np.zeros(max(names.values()) + 1, dtype=bool)  # ids that end a word
        self._opens = np.zeros_like(self._closes)  # ids that start with a space
        for name, i in names.items():
            self._closes[i] = name.endswith("</w>")
            self._opens[i] = name.startswith("\u0120")
        self._reset()

    def _reset(self) -> None:
        self._place: dict[int, int] = {}
        self._ids = np.zeros(1 << 16, dtype=np.uint32)
        self._start = np.zeros(1 << 14, dtype=np.int64)
        self._used = 0

    def _encoded(self, pieces: list[str]) -> list:
        """The ids of every piece. Words of letters go many to a call, told apart
        by the ids that end a word or start with a space."""
        out: list = [None] * len(pieces)
        ends = bool(self._closes.any())
        words = [i for i, p in enumerate(pieces) if _LETTERS.fullmatch(p.strip(" \t\r\n") if ends else p[1:]) and (ends or p[0] == " ")]
        joined = [words[k : k + _JOIN] for k in range(0, len(words), _JOIN)]
        texts = [" ".join(pieces[i] for i in part) if ends else "".join(pieces[i] for i in part) for part in joined]
        for part, coded in zip(joined, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype=np.uint32)
            cuts = np.flatnonzero(self._closes[ids])[:-1] + 1 if ends else np.flatnonzero(self._opens[ids])[1:]
            if len(cuts) + 1 == len(part):
                for i, own in zip(part, np.split(ids, cuts), strict=True):
                    out[i] = own
        rest = [i for i, x in enumerate(out) if x is None]
        coded = self._tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)
        for i, x in zip(rest, coded, strict=True):
            out[i] = x.ids
        return out

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        coded = self._encoded(pieces)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        n, end = len(self._place), self._used + int(sizes.sum())
        if end > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(max(len(self._ids), end), np.uint32)])
        if n + len(coded) >= len(self._start):
            self._start = np.concatenate([self._start, np.zeros(max(len(self._start), len(coded) + 1), np.int64)])
        if coded:
            self._ids[self._used : end] = np.concatenate(coded)
        self._start[n + 1 : n + 1 + len(coded)] = self._used + np.cumsum(sizes)
        self._place.update(zip(hashes, range(n, n + len(coded)), strict=True))
        self._used = end

    def _block(self, data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block and how many each of its values has; values: their starts."""
        starts = piece_starts(data, values)
        ends = np.append(starts[1:], len(data))
        keys, first, of = np.unique(Spans(data).hash(starts, ends), return_index=True, return_inverse=True)
        if len(self._place) + len(keys) > CACHE:
            self._reset()
        names, raw = keys.tolist(), data.tobytes()
        place = self._place
        new = [i for i, key in enumerate(names) if key not in place]
        self._learn([names[i] for i in new], [raw[starts[first[i]] : ends[first[i]]].decode() for i in new])
        at = np.fromiter(map(place.__getitem__, names), np.int64, len(names))[of]
        begin, size = self._start[at], self._start[at + 1] - self._start[at]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self._ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        edges = np.searchsorted(starts, np.append(values, len(data)))
        return ids, np.diff(total[edges])

    def encode(self, column) -> list[np.ndarray]:
        """The ids of every text; a null text has none."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n, out = len(column), []
        data, offsets = bytes_and_offsets(column)
        plain: list[int] = []
        for i in range(n):
            low, high = int(offsets[i]), int(offsets[i + 1])
            out.append(None)
            if high == low:
                out[i] = np.zeros(0, np.uint32)
            elif _ODD.search(text := column[i].as_py()) or high - low > 8 * BLOCK and " " not in text:
                out[i] = np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            elif high - low > BLOCK:
                out[i] = np.concatenate([self._block(part, np.zeros(1, np.int64))[0] for part in _parts(data[low:high])])
            else:
                plain.append(i)
        while plain:
            size, k = 0, 0
            while k < len(plain) and (k == 0 or size + offsets[plain[k] + 1] - offsets[plain[k]] <= BLOCK):
                size += int(offsets[plain[k] + 1] - offsets[plain[k]])
                k += 1
            take, plain = plain[:k], plain[k:]
            block = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in take])
            sizes = np.array([offsets[i + 1] - offsets[i] for i in take])
            ids, counts = self._block(block, np.concatenate(([0], np.cumsum(sizes)[:-1])))
            for i, part in zip(take, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[i] = part
        return out


def _parts(data: np.ndarray) -> list[np.ndarray]:
    """A long text in blocks, cut before white space that follows something else."""
    blank = (data == 32) | (data == 9) | (data == 10) | (data == 13)
    cuts = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    chosen, at = [0], BLOCK
    while at < len(data) and (k := int(np.searchsorted(cuts, at))) < len(cuts):
        chosen.append(int(cuts[k]))
        at = chosen[-1] + BLOCK
    return [data[a:b] for a, b in zip(chosen, [*chosen[1:], len(data)], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
