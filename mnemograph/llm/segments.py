"""Token ids of whole texts from a byte-level tokenizer, one encoding for each distinct segment.

A text is cut before white space that follows other characters. The pre-tokenizer's pattern
never continues a match over such a place and doesn't look back, so the ids of a text are the
ids of its segments in order. Segments repeat, so a worker encodes each once and looks up the
rest. For the same reason new segments are encoded many in one text: the bytes its tokens stand
for tell which ids belong to which segment.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from mnemograph.llm.words import BLANK, span_hashes


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the segments of all rows, in order.

    White space outside ASCII starts no segment. After a multi-byte character that may be white
    space (U+0085, U+00A0, U+1680, U+2000-U+206F, U+3000 and neighbours) there is no cut either.
    """
    n = len(data)
    cut = np.zeros(n, bool)
    cut[1:] = BLANK[data[1:]] & ~BLANK[data[:-1]]
    if n > 2:
        cut[2:] &= ~((data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0)))
    if n > 3:
        cut[3:] &= ~((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3) & (data[1:-2] >= 0x80))
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


def _after_other(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether white space after each end starts a segment, whatever text it comes from."""
    last, before, third = (data[np.maximum(ends - k, 0)] for k in (1, 2, 3))
    maybe = ((before == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((third >= 0xE1) & (third <= 0xE3) & (before >= 0x80))
    return ~BLANK[last] & ~maybe


def token_bytes(tokenizer: Tokenizer) -> np.ndarray:
    """Number of bytes of text that each id of a byte-level tokenizer stands for."""
    out = np.zeros(max(tokenizer.get_vocab(True).values(), default=-1) + 1, np.int64)
    for token, i in tokenizer.get_vocab(True).items():
        out[i] = len(token)
    for i, token in tokenizer.get_added_tokens_decoder().items():
        out[i] = len(token.content.encode())
    return out


@lru_cache(maxsize=1)
def encoder(path: str) -> SegmentEncoder:
    """The encoder of a worker process, kept from task to task."""
    return SegmentEncoder(path)


class SegmentEncoder:
    """Ids of the rows of a byte array; what was encoded before is remembered, up to ``most`` segments."""

    def __init__(self, path: str, most: int = 1_000_000, together: int = 1 << 14):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.most, self.together = most, together
        self.bytes = token_bytes(self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids before each row and at the end)."""
        starts = segment_starts(data, offsets)
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        hashes = span_hashes(data, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > self.most:
            self._forget()
        self._learn(data, starts, ends, distinct, first)
        at = np.searchsorted(self.known, distinct)
        count, begin = self.count[at][which], self.begin[at][which]
        upto = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=upto[1:])
        ids = self.ids[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, offsets)]

    def _learn(self, data, starts, ends, distinct, first) -> None:
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if not new.any():
            return
        where = first[new]
        found, count = self._encode(data, starts[where], ends[where])
        begin = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, found])
        known = np.concatenate([self.known, distinct[new]])
        order = np.argsort(known, kind="stable")
        self.known, self.begin, self.count = known[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order]

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each segment); neighbours that a text may hold side by side are encoded as one text."""
        n = len(starts)
        open_ = np.zeros(n, bool)  # whether a segment may follow the one before it
        open_[1:] = BLANK[data[starts[1:]]] & _after_other(data, ends[:-1])
        size = np.cumsum(ends - starts)
        open_[1:] &= size[1:] // self.together == size[:-1] // self.together
        heads = np.append(np.flatnonzero(~open_), n).tolist()
        raw = data.tobytes()
        cuts = list(zip(starts.tolist(), ends.tolist(), strict=True))
        texts = ["".join(raw[a:b].decode() for a, b in cuts[x:y]) for x, y in zip(heads, heads[1:], strict=False)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter((i for x in found for i in x), np.uint32, sum(map(len, found)))
        upto = np.cumsum(self.bytes[ids])
        at = np.searchsorted(upto, size)
        if len(ids) and at[-1] < len(ids) and np.array_equal(upto[at], size) and upto[-1] == size[-1]:
            return ids, np.diff(at, prepend=-1)
        # ids that don't stand for all bytes: each segment by itself
        found = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in cuts], add_special_tokens=False)]
        count = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.uint32, int(count.sum())), count
