"""Passages that repeat across documents, found by collinear chaining.

Seeds are hashes of ``K`` words that are smallest in a window of ``SPAN`` such hashes, so equal
stretches of ``K + SPAN - 1`` words share a seed whatever surrounds them. An occurrence of a seed
is matched with its first occurrence in the corpus only: a passage in a million documents gives
a million matches.

A passage whose parts occur earlier in different documents has no such match that is long enough.
So whole windows of the least length are compared too, in the regions of a text where all seeds
repeat: every window that no passage covers is matched with its first occurrence, which has all its words, and
of those matches as many are given as cover all their words.

A fuzzy passage can lose its matches that way too: two of its seeds may first occur in different
documents, or far apart in one. Such pairs of neighbouring seeds, where no passage covers both, are matched with
every earlier document that has both in reach: the words around them decide in the group of the pair
which of those matches grow to a passage, and only those that go on further than another one
are chained and aligned. Again as many of the passages are given as cover all their words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.scratch import Scratch, only
from mnemograph.llm.words import BLANK, joined_hashes, lowered_words, mix, slices, text_bytes, word_spans

K, SPAN = 5, 8
MARGIN, WIDER = 64, 16
MOST_GAP = 64
REACH = MOST_GAP + K + SPAN - 1  # places from one seed of a pair to the other
BLOCK = 1024  # rows of a pair of seeds that meet as many others in one task
GAP_COST = 0.25
MISS = 4

CHAIN = "doc_id long, first_id long, at array<int>, first_at array<int>, size array<int>"
PASSAGE = "doc_id long, first_id long, start int, stop int, first_start int, first_stop int, matched int"


def seeds_of(words: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, word position) of the seeds of all rows with ``least`` words or more."""
    grams = joined_hashes(words, K)
    n = len(grams)
    if n < SPAN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = grams[: n - SPAN + 1].copy()
    for j in range(1, SPAN):
        np.minimum(low, grams[j : n - SPAN + 1 + j], out=low)
    inside = rows[: n - SPAN + 1] == rows[K + SPAN - 2 : K + SPAN - 2 + n - SPAN + 1]
    low[~inside] = 0
    high = np.zeros(n, np.uint64)
    for j in range(SPAN):
        np.maximum(high[j : j + len(low)], low, out=high[j : j + len(low)])
    count = np.bincount(rows)
    first = np.cumsum(count) - count
    picked = np.flatnonzero((high == grams) & (count[rows[:n]] >= least))
    return grams[picked], rows[picked], picked - first[rows[picked]]


def _seeds(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets):
                words, rows = lowered_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                seed, row, at = seeds_of(words, rows, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)), pa.array(names[a + row].astype(np.int64)), pa.array(at.astype(np.int32))], names=["seed", "doc_id", "at"]
                )

    return run


def best_chains(at: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Disjoint chains of anchors, best first; an anchor is an equal stretch (at, first, size), ordered by ``at``.

    A chain gains the words of its anchors and pays ``GAP_COST`` a word between two of them, on
    either side; no gap exceeds ``MOST_GAP``. The best chain that ends before an anchor on both sides is a maximum over the
    ends up to its place in the other document: a Fenwick tree of prefix maxima. Where that one is out of
    reach, the best of the chains that end in reach is taken.
    """
    n = len(at)
    if n == 1:
        return [np.zeros(1, np.int64)]
    ends = sorted({int(x) for x in (first + size - K)})
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ends) + 1)
    score, back = [0.0] * n, [-1] * n
    waiting = sorted(range(n), key=lambda i: at[i] + size[i])
    in_reach = lambda i, j: at[j] - at[i] - size[i] <= MOST_GAP and first[j] - first[i] - size[i] <= MOST_GAP
    done = 0
    for j in range(n):
        while done < n and at[waiting[done]] + size[waiting[done]] - K <= at[j] and waiting[done] < j:
            i = waiting[done]
            value = (score[i] + GAP_COST * float(at[i] + size[i] + first[i] + size[i]), i)
            k = bisect_left(ends, int(first[i] + size[i] - K)) + 1
            while k < len(tree):
                tree[k] = max(tree[k], value)
                k += k & -k
            done += 1
        k, best = bisect_left(ends, int(first[j]) + 1), (-np.inf, -1)
        while k:
            best = max(best, tree[k])
            k -= k & -k
        gain = best[0] - GAP_COST * float(at[j] + first[j])
        i = best[1]
        if i >= 0 and gain > 0 and not in_reach(i, j):
            best = (-np.inf, -1)
            for i in reversed(waiting[:done]):
                if at[j] - at[i] - size[i] > MOST_GAP:
                    break
                if in_reach(i, j) and first[i] + size[i] - K <= first[j]:
                    best = max(best, (score[i] + GAP_COST * float(at[i] + size[i] + first[i] + size[i]), i))
            gain, i = best[0] - GAP_COST * float(at[j] + first[j]), best[1]
        if i >= 0 and gain > 0:
            score[j], back[j] = float(size[j]) + min(gain, score[i]), i
        else:
            score[j] = float(size[j])
    chains, used = [], set()
    for j in sorted(range(n), key=lambda i: (-score[i], -i)):
        chain = []
        while j >= 0 and j not in used:
            chain.append(j)
            used.add(j)
            j = back[j]
        if chain:
            chains.append(np.array(chain[::-1]))
    return chains


def _chains(least: int):
    """Chains of ``least`` words or more, those between their anchors included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id").to_numpy()
            hits = batch.column("hits")
            owner = np.repeat(np.arange(len(batch)), np.diff(hits.offsets.to_numpy()))
            flat = hits.flatten()
            ref, at, first = (flat.field(i).to_numpy() for i in range(3))
            order = np.lexsort((first, at, first - at, ref, owner))
            order = order[ref[order] != names[owner[order]]]
            if not len(order):
                continue
            owner, ref, at, first = (x[order] for x in (owner, ref, at, first))
            slope = at.astype(np.int64) - first
            new = np.ones(len(at), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (ref[1:] != ref[:-1]) | (slope[1:] != slope[:-1]) | (at[1:] - at[:-1] > K + SPAN - 1)
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(at))[: len(begin)] - 1
            owner, ref, a, f, s = owner[begin], ref[begin], at[begin], first[begin], at[last] - at[begin] + K
            order = np.lexsort((f, a, ref, owner))
            owner, ref, a, f, s = (x[order].astype(np.int64) for x in (owner, ref, a, f, s))
            pair = np.ones(len(a), bool)
            pair[1:] = (owner[1:] != owner[:-1]) | (ref[1:] != ref[:-1])
            edges = [*np.flatnonzero(pair).tolist(), len(a)]
            out: list[list] = [[], [], [], [], []]
            for x, y in zip(edges, edges[1:], strict=False):
                if (a[x:y] + s[x:y]).max() - a[x] < least:
                    continue
                for chain in best_chains(a[x:y], f[x:y], s[x:y]):
                    i, j = x + chain[0], x + chain[-1]
                    if a[j] + s[j] - a[i] >= least:
                        for column, value in zip(out, (names[owner[i]], ref[i], a[x + chain], f[x + chain], s[x + chain]), strict=True):
                            column.append(value)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), ints, ints, ints), strict=True)],
                names=["doc_id", "first_id", "at", "first_at", "size"],
            )

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, at, next, wanted) of two repeated seeds in reach of each other that first occur out of it; a wanted one isn't covered and may have an earlier document."""
    for batch in batches:
        names, hits, covered = batch.column("doc_id").to_numpy(), batch.column("hits"), batch.column("covered")
        owner, flat = np.repeat(np.arange(len(batch)), np.diff(hits.offsets.to_numpy())), hits.flatten()
        ref, at, first = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
        order = np.lexsort((first, ref, at, owner))
        owner, ref, at, first = (x[order] for x in (owner, ref, at, first))
        free, edges = ref != names[owner], np.searchsorted(owner, np.arange(len(batch) + 1))
        inside = np.zeros(len(at), bool)
        for i in np.flatnonzero(covered.is_valid().to_numpy(zero_copy_only=False)).tolist():
            spans = sorted((s["start"], s["stop"]) for s in covered[i].as_py())
            starts, stops = (np.array(x) for x in zip(*spans, strict=True))
            own = at[edges[i] : edges[i + 1]]
            last = np.searchsorted(starts, own, "right") - 1
            inside[edges[i] : edges[i + 1]] = (last >= 0) & (np.maximum.accumulate(stops)[last] >= own + K)
        seed = mix(mix(ref.view(np.uint64)) + first.view(np.uint64))
        for step in count(1):
            apart = at[step:] - at[:-step]
            near = (owner[step:] == owner[:-step]) & (apart <= REACH)
            if not near.any():
                break
            further = first[step:] - first[:-step]
            picked = np.flatnonzero(near & (apart > 0) & (seed[step:] != seed[:-step]) & ((ref[step:] != ref[:-step]) | (further <= 0) | (further > REACH)))
            key = mix(seed[picked] * np.uint64(3) + seed[picked + step])
            order = np.lexsort((at[picked], key, owner[picked]))
            picked, key = picked[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[picked[1:]] != owner[picked[:-1]]) | (at[picked[1:]] // REACH != at[picked[:-1]] // REACH)
            picked, key = picked[new], key[new]
            wanted = free[picked] & free[picked + step] & ~(inside[picked] & inside[picked + step])
            columns = (key.view(np.int64), names[owner[picked]].astype(np.int64), at[picked].astype(np.int32), at[picked + step].astype(np.int32), wanted)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "doc_id", "at", "next", "wanted"])


def _around(least: int):
    """The pairs of each text with its 32-bit word hashes from ``least`` words before them to ``least`` behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            pairs = batch.column("pairs")
            for a, b in slices(offsets):
                words, rows = lowered_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                bounds = np.searchsorted(rows, np.arange(b - a + 1)).tolist()
                for i in range(a, b):
                    own, of = words[bounds[i - a] : bounds[i - a + 1]].astype(np.uint32), pairs[i].values
                    kept = of.filter(pa.array(of.field("next").to_numpy() + K <= len(own)))
                    at, last = kept.field("at").to_pylist(), kept.field("next").to_pylist()
                    before = [own[max(0, x - least) : x][::-1].tobytes() for x in at]
                    behind = [own[y + K : y + K + least].tobytes() for y in last]
                    between = [own[x : y + K].tobytes() for x, y in zip(at, last, strict=True)]
                    fields = [*(kept.field(c) for c in ("key", "at", "next", "wanted")), pa.array(between, pa.binary())]
                    name = pa.array(np.full(len(kept), batch.column("doc_id")[i].as_py(), np.int64))
                    yield pa.RecordBatch.from_arrays([*fields, name, pa.array(before, pa.binary()), pa.array(behind, pa.binary())], names=["key", "at", "next", "wanted", "between", "doc_id", "before", "behind"])

    return run


def _padded(column: pa.Array, least: int, pad: int) -> np.ndarray:
    out = np.full((len(column), least), pad, np.int64)
    for i, value in enumerate(column.to_pylist()):
        own = np.frombuffer(value, np.uint32)
        out[i, : len(own)] = own
    return out


def _reaches(x: np.ndarray, y: np.ndarray, head: int = 8) -> np.ndarray:
    """Words by which a match of each row of ``x`` with each of ``y`` goes on, as ``_reach`` finds them.

    Few go on beyond the first ``head`` words, so only those are compared further.
    """

    def reach(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.cumsum(np.where(same, 1, -MISS).astype(np.int16), axis=-1, dtype=np.int16)
        held = np.logical_and.accumulate(np.maximum(np.maximum.accumulate(score, axis=-1), 0) - score <= 2 * MISS, axis=-1)
        score[~held] = 0
        return np.where(score.max(axis=-1) > 0, score.argmax(axis=-1) + 1, 0), held[..., -1]

    out, held = reach(x[:, None, :head] == y[None, :, :head])
    row, col = np.nonzero(held)
    for lo in range(0, len(row), 65536):
        r, c = row[lo : lo + 65536], col[lo : lo + 65536]
        out[r, c] = reach(x[r] == y[c])[0]
    return out


def _met(least: int):
    """Matches of the later documents of a pair (side 0) with the earlier ones (side 1) that grow to ``least`` words, two hits each.

    An earlier document has the pair where it comes first in it. Of the earlier documents one is left out if another goes on as far before and behind the pair. How far that is, and how
    many words between the seeds can be equal, bounds a passage; what the bound leaves is aligned.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("key", "ascending"), ("side", "ascending"), ("doc_id", "ascending"), ("at", "ascending")])
        key, side, names, at, last = (table[c].to_numpy() for c in ("key", "side", "doc_id", "at", "next"))
        before, between, behind = (table[c].combine_chunks() for c in ("before", "between", "behind"))
        text = lambda i: [np.frombuffer(c[i].as_py(), np.uint32) for c in (before, between, behind)]
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        out: list[tuple[int, int]] = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            if not (lo < mid < hi and names[mid - 1] > names[mid]):
                continue
            words, number = [text(i) for i in range(lo, hi)], {}
            alike = [number.setdefault(tuple(z.tobytes() for z in x), len(number)) for x in words]
            own = mid + np.unique(names[mid:hi], return_index=True)[1]
            seen = {alike[i - lo]: i for i in own[::-1].tolist()}  # the first of those with the same words
            early = np.array(sorted(seen.values()))
            gap = {i: words[i - lo][1].tobytes() for i in early.tolist()}
            around = [_padded(c.take(pa.array(early)), least, -1) for c in (before, behind)]
            known: dict[tuple[int, int], bool] = {}
            inner = [x[1][K:-K] for x in words]
            gaps = np.array([len(x) for x in inner])
            words_in = np.stack([np.bincount(x % 64, minlength=64) for x in inner]).astype(np.int16)
            step = max(16, 16384 // len(early))
            for p in range(lo, mid, step):
                late = slice(p, min(p + step, mid))
                grown = [_reaches(_padded(c.slice(p, late.stop - p), least, -2), e) for c, e in zip((before, behind), around, strict=True)]
                able = (sum(grown) + (last - at)[late, None] + K >= least) & (names[late, None] > names[early])
                row, col = np.nonzero(able)
                for some in np.array_split(np.arange(len(row)), 1 + len(row) // 65536):
                    r, c = row[some], col[some]
                    equal = np.minimum(words_in[r + p - lo], words_in[early[c] - lo]).sum(axis=1)
                    score = equal - MISS * (np.maximum(gaps[r + p - lo], gaps[early[c] - lo]) - equal)
                    able[r, c] = (grown[0][r, c] + K + score > 0) | (np.maximum(grown[0][r, c], grown[1][r, c]) + K >= least)
                for i in np.flatnonzero(able.any(axis=1)).tolist():
                    others = np.flatnonzero(able[i])
                    low, high = (x[i, others] for x in grown)
                    x, failed, held = words[p + i - lo], {}, []
                    for n in np.lexsort((others, -(low + high))).tolist():
                        j, a, b = int(early[others[n]]), int(low[n]), int(high[n])
                        if any(a <= c and b <= d for c, d in (*held, *failed.get(gap[j], ()))):
                            continue
                        pair = (alike[p + i - lo], alike[j - lo])
                        if pair not in known:
                            parts = [(np.concatenate([z[0][::-1], z[1], z[2]]), np.array([len(z[0]), len(z[0]) + len(z[1]) - K])) for z in (x, words[j - lo])]
                            known[pair] = grows(*parts[0], *parts[1], least)
                        if known[pair]:
                            held.append((a, b))
                            out.append((p + i, j))
                        else:
                            failed.setdefault(gap[j], []).append((a, b))
        row, col = np.array(out, np.int64).reshape(-1, 2).T
        columns = (np.concatenate(c) for c in ((names[row], names[row]), (names[col], names[col]), (at[row], last[row]), (at[col], last[col])))
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "ref", "at", "first_at"])

    return run


def grows(x: np.ndarray, at: np.ndarray, y: np.ndarray, first: np.ndarray, least: int) -> bool:
    """Whether two equal seeds at the places ``at`` and ``first`` lie in a passage of ``least`` words."""
    size = np.full(2, K)
    if at[1] - at[0] == first[1] - first[0] and at[1] - at[0] <= K:
        at, first, size = at[:1], first[:1], size[:1] + at[1] - at[0]
    return any(e - b >= least for b, e, *_ in align(x, y, at, first, size))


def _regions(least: int):
    """Stretches [low, high) of each document that can be in another one too: in a shared window all sure seeds repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits")
            owner, at = np.repeat(np.arange(len(batch)), np.diff(hits.offsets.to_numpy())), hits.flatten().field(1).to_numpy().astype(np.int64)
            if not len(at):
                continue
            order = np.lexsort((at, owner))
            owner, at = owner[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > SPAN)
            begin = np.flatnonzero(new)
            low, high = np.maximum(at[begin] - (SPAN - 1), 0), at[np.append(begin[1:], len(at)) - 1] + K + SPAN - 1
            kept = high - low >= least
            owner, low, high = owner[begin][kept], low[kept], high[kept]
            docs, counts = np.unique(owner, return_counts=True)
            edges = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (low, high)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(docs)), *lists], names=["doc_id", "low", "high"])

    return run


def window_hashes(words: np.ndarray, least: int) -> np.ndarray:
    """Hash of each ``least`` words in a row."""
    step = min(10, least)
    parts, n = joined_hashes(words, step), len(words) - least + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for at in (*range(0, least - step, step), least - step):
        out = mix(out * np.uint64(3) + parts[at : at + n] + np.uint64(1))
    return out


def _windows(least: int):
    """(key, doc_id, at, wanted) of all windows in the regions of each text; a wanted one lies in no passage of ``covered``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            names, low, high, covered = (batch.column(c) for c in ("doc_id", "low", "high", "covered"))
            for a, b in slices(offsets):
                words, rows = lowered_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                bounds = np.searchsorted(rows, np.arange(b - a + 1)).tolist()
                for i in range(a, b):
                    keys = window_hashes(words[bounds[i - a] : bounds[i - a + 1]], least)
                    inside, free = np.zeros(len(keys), bool), np.ones(len(keys), bool)
                    for x, y in zip(low[i].as_py(), high[i].as_py(), strict=True):
                        inside[x : max(x, y - least + 1)] = True
                    for span in covered[i].as_py() or ():
                        free[span["start"] : max(span["start"], span["stop"] - least + 1)] = False
                    at = np.flatnonzero(inside)
                    if len(at):
                        name = pa.array(np.full(len(at), names[i].as_py(), np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[at].view(np.int64)), name, pa.array(at.astype(np.int32)), pa.array(free[at])], names=["key", "doc_id", "at", "wanted"]
                        )

    return run


def cover(start: list[int], stop: list[int]) -> list[int]:
    """Few of the stretches, given in the order of their starts, that have all words of all of them."""
    out: list[int] = []
    end, best = 0, -1
    for i, at in enumerate(start):
        while at > end:
            if best >= 0 and stop[best] > end:
                out.append(best)
                end, best = stop[best], -1
            else:
                end = at
        if best < 0 or stop[i] > stop[best]:
            best = i
    return [*out, best] if best >= 0 and stop[best] > end else out


def _covering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few of all passages of each document that cover them all."""
    for batch in batches:
        out = []
        for name, spans in zip(batch.column("doc_id").to_pylist(), batch.column("all").to_pylist(), strict=True):
            out += [{"doc_id": name, **spans[i]} for i in cover([s["start"] for s in spans], [s["stop"] for s in spans])]
        names = ["doc_id", "first_id", "start", "stop", "first_start", "first_stop", "matched"]
        kinds = [pa.int64()] * 2 + [pa.int32()] * 5
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in zip(names, kinds, strict=True)], names=names)


def _joined(least: int):
    """Passages of equal words from the windows of each document that have a first occurrence elsewhere: few that cover them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits")
            owner, flat = np.repeat(np.arange(len(batch)), np.diff(hits.offsets.to_numpy())), hits.flatten()
            ref, at, first = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
            if not len(at):
                continue
            order = np.lexsort((at, first - at, ref, owner))
            owner, ref, at, first = (x[order] for x in (owner, ref, at, first))
            new = np.ones(len(at), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (ref[1:] != ref[:-1]) | (np.diff(first - at) != 0) | (np.diff(at) > least)
            begin = np.flatnonzero(new)
            stop = at[np.append(begin[1:], len(at)) - 1] + least
            owner, ref, start, first = (x[begin] for x in (owner, ref, at, first))
            order = np.lexsort((stop, start, owner))
            owner, ref, start, stop, first = (x[order] for x in (owner, ref, start, stop, first))
            edges = np.searchsorted(owner, np.arange(len(batch) + 1)).tolist()
            kept = np.array([a + i for a, b in zip(edges, edges[1:], strict=False) for i in cover(start[a:b].tolist(), stop[a:b].tolist())], np.int64)
            size = (stop - start)[kept]
            ints = (pa.array(x, pa.int32()) for x in (start[kept], stop[kept], first[kept], first[kept] + size, size))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner[kept])), pa.array(ref[kept]), *ints],
                names=["doc_id", "first_id", "start", "stop", "first_start", "first_stop", "matched"],
            )

    return run


def _spans(batch: pa.RecordBatch, place: str, margin: int) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """(row, first word, 32-bit word hashes, words behind them) of the stretch that each row's chain touches, with margins."""
    data, offsets = text_bytes(batch.column("text"))
    at, size = batch.column(place), batch.column("size")
    for a, b in slices(offsets):
        words, rows = lowered_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        bounds = np.searchsorted(rows, np.arange(b - a + 1)).tolist()
        for i in range(b - a):
            own, length = at[a + i].values.to_numpy(), size[a + i].values.to_numpy()
            low, high = max(0, int(own[0]) - margin), bounds[i] + int(own[-1] + length[-1]) + margin
            yield a + i, low, words[bounds[i] + low : min(bounds[i + 1], high)].astype(np.uint32), high < bounds[i + 1]


def _cut(margin: int):
    """Chains with the words of the first document that they touch, in place of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = list(_spans(batch, "first_at", margin))
                kept = batch.select(["doc_id", "first_id", "at", "first_at", "size"])
                more = [pa.array([x[1] for x in found], pa.int32()), pa.array([x[2].tobytes() for x in found], pa.binary()), pa.array([x[3] for x in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*kept.schema.names, "low", "words", "more"])

    return run


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of ``x``."""
    where: dict[int, int] = {}
    for i, w in enumerate(x.tolist()):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(x)) - 1
    row = full
    for w in y.tolist():
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def _reach(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """(words, equal words) by which a match goes on: the best score before it falls ``2 * MISS`` below the best."""
    n = min(len(x), len(y))
    score = np.cumsum(np.where(x[:n] == y[:n], 1, -MISS))
    if not n:
        return 0, 0
    fallen = np.flatnonzero(np.maximum(np.maximum.accumulate(score), 0) - score > 2 * MISS)
    score = score[: fallen[0]] if len(fallen) else score
    if not len(score) or score.max() <= 0:
        return 0, 0
    words = int(score.argmax()) + 1
    return words, int((x[:words] == y[:words]).sum())


def _goes_on(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether a match still goes on at the last word that both have."""
    n = min(len(x), len(y))
    score = np.cumsum(np.where(x[:n] == y[:n], 1, -MISS))
    return not (np.maximum(np.maximum.accumulate(score), 0) - score > 2 * MISS).any()


def align(x: np.ndarray, y: np.ndarray, at: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, stop, first_start, first_stop, equal words) along a chain over the words ``x`` and ``y``.

    Gaps between anchors are aligned word by word where both sides are equally long, else by
    their longest common subsequence. A passage is a stretch of the alignment that gains one a
    word and loses ``MISS`` a missing word and never falls to zero: four of five words are equal.
    """
    steps: list[tuple[int, int, int]] = []  # (words of x, words of y, equal words)

    def diagonal(i: int, j: int, n: int) -> None:
        same = x[i : i + n] == y[j : j + n]
        edges = [0, *(np.flatnonzero(same[1:] != same[:-1]) + 1).tolist(), n] if n else [0]
        steps.extend((b - a, b - a, (b - a) * int(same[a])) for a, b in zip(edges, edges[1:], strict=False))

    i, j = int(at[0]), int(first[0])
    back, _ = _reach(x[:i][::-1], y[:j][::-1])
    start = (i - back, j - back)
    i, j = start
    for a, f, s in zip(at.tolist(), first.tolist(), size.tolist(), strict=True):
        over = max(0, i - a, j - f) if steps else 0
        a, f, s = a + over, f + over, s - over
        if s <= 0:
            continue
        if a - i == f - j:
            diagonal(i, j, a - i)
        else:
            equal = common(x[i:a], y[j:f])
            steps.append((a - i, f - j, equal))
        diagonal(a, f, s)
        i, j = a + s, f + s
    ahead, _ = _reach(x[i:], y[j:])
    diagonal(i, j, ahead)

    out, (i, j) = [], start
    score = best = 0.0
    here: tuple[int, int, int] | None = None
    equal, top = 0, (0, 0, 0)
    for dx, dy, same in [*steps, (10**9, 10**9, 0)]:
        if here is None and same:
            here, score, best, equal = (i, j, 0), 0.0, 0.0, 0
        i, j = i + dx, j + dy
        if here is None:
            continue
        score += same - MISS * (max(dx, dy) - same)
        equal += same
        if score > best:
            best, top = score, (i, j, equal)
        if score <= 0:
            if best > 0:
                out.append((here[0], top[0], here[1], top[1], top[2]))
            here = None
    return out


def _align(least: int, margin: int):
    """Passages along chains. A chain that goes on where its margins end comes back as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            out: list[tuple] = []
            docs, refs = batch.column("doc_id").to_pylist(), batch.column("first_id").to_pylist()
            at, first, size = (batch.column(c) for c in ("at", "first_at", "size"))
            lows, words, more = batch.column("low").to_pylist(), batch.column("words"), batch.column("more").to_pylist()
            for row, low, x, behind in _spans(batch, "at", margin):
                y = np.frombuffer(words[row].as_py(), np.uint32)
                a, f, s = (c[row].values.to_numpy() for c in (at, first, size))
                b, e, fb, fe = (int(n) for n in (a[0] - low, a[-1] + s[-1] - low, f[0] - lows[row], f[-1] + s[-1] - lows[row]))
                if (low and lows[row] and _goes_on(x[:b][::-1], y[:fb][::-1])) or (behind and more[row] and _goes_on(x[e:], y[fe:])):
                    out.append((docs[row], refs[row], *[None] * 5, *(c[row].as_py() for c in (at, first, size))))
                    continue
                for b, e, fb, fe, equal in align(x, y, a - low, f - lows[row], s):
                    if e - b >= least:
                        out.append((docs[row], refs[row], b + low, e + low, fb + lows[row], fe + lows[row], equal, *[None] * 3))
            cols = list(zip(*out, strict=True)) or [[]] * 10
            kinds = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.list_(pa.int32())] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["doc_id", "first_id", "start", "stop", "first_start", "first_stop", "matched", "at", "first_at", "size"],
            )

    return run


def _aligned(docs: DataFrame, chains: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """Passages along the written ``chains``, with wider margins for those that go on where they end, until none does."""
    found, margin = None, MARGIN
    while True:
        texts = only(docs, "doc_id", chains.select("first_id")).dropDuplicates(["doc_id"])
        near = chains.join(texts.withColumnRenamed("doc_id", "first_id"), "first_id").select(*chains.columns, "text")
        near = scratch.keep(near.mapInArrow(_cut(margin), CHAIN + ", low int, words binary, more boolean"), "spans")
        texts = only(docs, "doc_id", chains.select("doc_id")).dropDuplicates(["doc_id"])
        met = scratch.keep(near.join(texts, "doc_id").select(*near.columns, "text").mapInArrow(_align(least, margin), f"{PASSAGE}, at array<int>, first_at array<int>, size array<int>"), "found")
        here = met.where("at is null").drop("at", "first_at", "size")
        found = here if found is None else found.union(here)
        chains, margin = met.where("at is not null").select(*chains.columns), margin * WIDER
        if chains.isEmpty():
            return found


def _paired(docs: DataFrame, hits: DataFrame, found: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(doc_id, hits) of the pairs of seeds with all earlier documents in which they can belong to a passage."""
    covered = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("covered"))
    pairs = scratch.keep(hits.join(covered, "doc_id", "left").mapInArrow(_pairs, "key long, doc_id long, at int, next int, wanted boolean"), "pairs")
    keys = pairs.groupBy("key").agg(F.min("doc_id").alias("low"), F.max(F.when(F.col("wanted"), F.col("doc_id"))).alias("high"), F.count("*").alias("n"))
    keys = scratch.keep(keys.where("high > low").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "keys")
    groups = max(1, keys.count() // 64)
    held = only(pairs, "key", keys.select("key")).groupBy("doc_id").agg(F.collect_list(F.struct("key", "at", "next", "wanted")).alias("pairs"))
    held = scratch.keep(held, "held")
    texts = only(docs, "doc_id", held.select("doc_id")).dropDuplicates(["doc_id"])
    rows = held.join(texts, "doc_id").mapInArrow(_around(least), "key long, at int, next int, wanted boolean, between binary, doc_id long, before binary, behind binary")
    rows = rows.join(F.broadcast(keys) if groups <= 10_000 else keys, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cell = lambda late, early: F.when(F.col("blocks") == 1, F.pmod("key", F.lit(groups))).otherwise(F.xxhash64("key", late, early)).alias("cell")
    columns = ("key", "doc_id", "at", "next", "between", "before", "behind")
    side = lambda n, kept, *place: kept.select("*", each).select(cell(*place), F.lit(n).alias("side"), *columns)
    both = side(0, rows.where("wanted"), "block", "other").union(side(1, rows, "other", "block"))
    met = both.groupBy("cell").applyInArrow(_met(least), "doc_id long, ref long, at int, first_at int").distinct()
    return met.groupBy("doc_id").agg(F.collect_list(F.struct("ref", "at", "first_at")).alias("hits"))


def passages(docs: DataFrame, least: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that an earlier document (a smaller doc_id) has too.

    One row a passage: doc_id, first_id, word positions start, stop, first_start, first_stop
    (ends excluded) and the number of equal words. A passage has ``least`` words or more, and
    four of five are equal and in order; words are compared with A-Z read as a-z. A copy of a
    whole text of that length is one passage. Equal stretches of ``least`` words (no fewer than
    ``K + SPAN - 1``) are sure to lie in passages, each with an earlier document. Fuzzy passages are found
    by two or more equal stretches of ``K + SPAN - 1`` words, in whichever earlier document they are and
    whichever has them first, or by one of half the length in the first document that has its seeds.

    Null and short texts and rows without doc_id have no passages. Rows with one doc_id are one
    document, read from one of its texts. Repeats inside one document are not reported.
    Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "chaining")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    marked = scratch.keep(docs.select("doc_id", F.xxhash64("text").alias("a"), F.md5("text").substr(1, 16).alias("b"), F.length("text").alias("n")), "texts")
    firsts = marked.groupBy("a", "b", "n").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    copies = scratch.keep(marked.join(firsts, ["a", "b", "n"]).where("doc_id <> first_id").select("doc_id", "first_id").distinct(), "copies")
    again = copies.select("doc_id")
    again = F.broadcast(again) if again.count() <= 1_000_000 else again
    single = docs.join(again, "doc_id", "left_anti")

    seeds = single.mapInArrow(_seeds(least), "seed long, doc_id long, at int")
    first = seeds.groupBy("seed").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("most")).where("most > first.doc_id")
    first = scratch.keep(first.select("seed", "first"), "first")
    hits = seeds.join(first, "seed")
    hits = hits.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("first.doc_id").alias("ref"), "at", F.col("first.at").alias("first_at"))).alias("hits"))
    hits = scratch.keep(hits, "hits")
    chains = scratch.keep(hits.mapInArrow(_chains(least // 2), CHAIN), "chains")
    found = _aligned(docs, chains, least, scratch)
    paired = _paired(docs, hits, found, least, scratch)
    more = _aligned(docs, scratch.keep(paired.mapInArrow(_chains(K), CHAIN), "chains"), least, scratch)
    more = more.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop", *more.columns[1:2], *more.columns[4:]))).alias("all"))
    found = scratch.keep(found.union(more.mapInArrow(_covering, PASSAGE)), "passages")

    regions = scratch.keep(hits.mapInArrow(_regions(least), "doc_id long, low array<int>, high array<int>"), "regions")
    covered = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("covered"))
    texts = only(docs, "doc_id", regions.select("doc_id")).dropDuplicates(["doc_id"])
    windows = regions.join(covered, "doc_id", "left").join(texts, "doc_id").mapInArrow(_windows(least), "key long, doc_id long, at int, wanted boolean")
    windows = scratch.keep(windows, "windows")
    first = windows.groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max(F.when(F.col("wanted"), F.col("doc_id"))).alias("most"))
    hits = windows.where("wanted").join(first.where("most > first.doc_id"), "key").where("doc_id <> first.doc_id")
    hits = hits.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("first.doc_id").alias("ref"), "at", F.col("first.at").alias("first_at"))).alias("hits"))
    found = found.union(hits.mapInArrow(_joined(least), PASSAGE))

    whole = only(docs, "doc_id", copies.select("doc_id")).dropDuplicates(["doc_id"]).select("doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    whole = copies.join(whole.where(F.col("n") >= least), "doc_id")
    zero = F.lit(0).alias
    whole = whole.select("doc_id", "first_id", zero("start"), F.col("n").alias("stop"), zero("first_start"), F.col("n").alias("first_stop"), F.col("n").alias("matched"))
    return scratch.keep(found.union(whole), "passages")


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the passages of the table ``found`` taken out of their texts.

    The first document that has a passage keeps it. n_chars, where there is such a column,
    follows the text. A document of which no word is left goes; texts without passages stay
    as they are, null texts included.
    """
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))
    spans = F.broadcast(spans) if spans.count() <= 200_000 else spans
    joined = docs.join(spans, "doc_id", "left").select(*docs.columns, "_spans")
    clean = joined.where("_spans is null").drop("_spans")
    where = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text"), batch.column("_spans").to_pylist(), strict=True):
                texts.append(cut_words(text.as_py(), [(s["start"], s["stop"]) for s in spans]))
            columns = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in where]
            yield pa.RecordBatch.from_arrays(columns, names=where)

    changed = joined.where("_spans is not null").mapInArrow(run, docs.schema).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.union(changed)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words [start, stop) of each span and the blanks before them."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    gone = np.zeros(len(starts) + 1, np.int64)
    for a, b in spans:
        gone[min(a, len(starts))] += 1
        gone[min(b, len(starts))] -= 1
    drop = np.cumsum(gone[:-1]) > 0
    keep = np.ones(len(data), bool)
    before = np.append(0, ends[:-1]) if len(ends) else ends
    for i in np.flatnonzero(drop).tolist():
        keep[before[i] : ends[i]] = False
    out = data[keep]
    full = np.flatnonzero(~BLANK[out])
    if drop[:1].any() and len(full):
        out = out[full[0] :]
    return out.tobytes().decode()
