"""Tokenizing whole texts inside Spark tasks."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .frames import kept_by_worker, text_buffers

MEMO_PIECES, MEMO_LENGTH = 300_000, 48

# Kinds of bytes. Texts are cut before white space that follows a visible character and between a Latin letter and one of these marks: no pre-token of
# the tokenizers used here spans such a place, so the ids of a text are the ids of its pieces in a row. A place that isn't cut does no harm.
OTHER, SPACE, LETTER, MARK = range(4)
_KIND = np.zeros(256, np.uint8)
_KIND[[32, *range(9, 14)]] = SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[[ord(c) for c in ".,!|$%&*#?;:"]] = MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# First two of the three bytes of the white space beyond Latin-1 (and of some characters that are none).
_WIDE_SPACE = np.array([0xE19A, 0xE280, 0xE281, 0xE380], np.uint16)


def _cut_places(data: np.ndarray) -> np.ndarray:
    """For each byte whether a piece may start there, whatever text it lies in."""
    kind = _KIND[data]
    cut = np.zeros(len(data), bool)
    space = kind == SPACE
    cut[1:] = space[1:] & ~space[:-1]
    wide = np.flatnonzero(cut[1:] & (data[:-1] >= 128)) + 1  # behind a character of several bytes, which may be white space too
    pair = data[wide - 3].astype(np.uint16) << 8 | data[wide - 2]
    cut[wide[(data[wide - 2] == 0xC2) | np.isin(pair, _WIDE_SPACE)]] = False
    marks = np.flatnonzero(kind[1:] == MARK) + 1
    before = data[marks - 1]
    latin = (data[marks - 2] == 0xC3) & (before >= 128) & (before != 0x97) & (before != 0xB7)  # from À to ÿ but for two signs
    cut[marks[(kind[marks - 1] == LETTER) | latin]] = True
    return cut


class Encoder:
    """Encodes texts with a tokenizer file as it is loaded. Pieces repeat, so their ids are kept in two dictionaries of bounded size (a full one becomes
    the old one, from which what is used again is carried over) and the tokenizer only sees new pieces. A text that holds the string of a special token
    is one piece."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        upper, lower = ([x.ids for x in self.tokenizer.encode_batch([chr(c) for c in range(a, a + 26)], add_special_tokens=False)] for a in (65, 97))
        self.folds_case = upper == lower
        self.drops_space = not self.tokenizer.encode(" \t\n\x0b\x0c\r", add_special_tokens=False).ids
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces as little-endian 32-bit bytes."""
        if len(self.now) > MEMO_PIECES:
            self.old, self.now = self.now, {}
        now, old = self.now, self.old
        out = list(map(now.get, pieces))
        fresh: list[int] = []
        for i in [i for i, known in enumerate(out) if known is None]:
            known = old.get(pieces[i])
            if known is None:
                fresh.append(i)
            else:
                out[i] = now[pieces[i]] = known
        for lo in range(0, len(fresh), 20_000):
            part = fresh[lo : lo + 20_000]
            for i, coded in zip(part, self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)):
                out[i] = array("I", coded.ids).tobytes()
                if len(pieces[i]) <= MEMO_LENGTH:
                    now[pieces[i]] = out[i]
        return out

    def _pieces(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts in a row, and for each text and the end the number of pieces before it."""
        data, offsets = text_buffers(column)
        cut = _cut_places(data)
        whole = np.flatnonzero(pc.match_substring_regex(column, self.special, ignore_case=True).to_numpy(zero_copy_only=False)) if self.special else []
        for k in whole:
            cut[offsets[k] : offsets[k + 1]] = False
        cut[offsets[offsets < len(data)]] = True
        starts = np.flatnonzero(cut)
        before = np.searchsorted(starts, offsets)
        bounds = np.append(starts, len(data))
        if not len(whole):
            if self.drops_space:
                # white space at the start of a piece
                space = _KIND[data] == SPACE
                first = space & cut
                first[1:] |= space[1:] & ~space[:-1]
                gone = space & np.append(cut[first], False)[np.cumsum(first) - 1]
                bounds = np.concatenate(([0], np.cumsum(~gone)))[bounds]
                data = data[~gone]
            # a letter may be lowered beforehand unless it is to be composed with an accent behind it (whose bytes begin with CC or CD)
            if self.folds_case and not ((data == 0xCC) | (data == 0xCD)).any():
                data = _LOWER[data]
        buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        return pa.Array.from_buffers(pa.large_string(), len(starts), buffers), before

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column without nulls in a row, and the n + 1 offsets of the texts among them."""
        pieces, before = self._pieces(column)
        coded = pieces.dictionary_encode()
        own = coded.indices.to_numpy()
        known = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())  # faster than to_pylist
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        table = np.frombuffer(b"".join(known), "<u4")
        ends = np.concatenate(([0], np.cumsum(length[own])))
        at = np.repeat((np.cumsum(length) - length)[own] - ends[:-1], length[own]) + np.arange(ends[-1])
        return table[at], ends[before]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id behind each text."""
    return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))


_ENCODERS: dict[str, Encoder] = {}
KEPT = "ids of pieces"


def _forget() -> None:
    """Lets go of the dictionaries; the tokenizers stay, since loading them again and again takes more memory."""
    for held in _ENCODERS.values():
        held.now, held.old = {}, {}


kept_by_worker(KEPT, _forget)


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
