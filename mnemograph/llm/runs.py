"""Periodic runs of words: a suffix automaton whose suffix links form a link-cut tree.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least ``max(least, 2 * q)`` words long, that no neighbouring word extends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of collapsed text in one batch that leaves a task.
BATCH = 8 << 20
#: Times a stretch is looked at again for words that repeat nowhere in it.
LOOKS = 4

_MULTIPLIERS = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def squares_to_runs(words: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``words``, in the order of their last words.

    Word i is appended to the automaton and the path from its state to the root is accessed.
    A preferred path of the link-cut tree holds the states whose strings ended last at one
    word j, so the access meets each colour j once, at the deepest state that has it: the
    longest string, of L words, that ends both at j and at i. With d = i - j at most L
    the two occurrences touch, and words i - L - d + 1 to i have the period d. It is the smallest
    period, as j is the last occurrence, and the start cannot move to the left, as L is
    greatest. The run is written at its last word. All paths together have O(n log n) pieces.
    """
    n = len(words)
    # State 0 stands for "none", state 1 is the root. up[x] is the parent in the splay tree,
    # or, at the top of a splay tree, the state above the preferred path.
    length, link, nexts = [0, 0], [0, 0], [{}, {}]
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [-1, -1]

    def rotate(x: int, p: int) -> None:
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[x], up[p] = g, x
        colour[x] = colour[p]

    def splay(x: int) -> None:
        p = up[x]
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                if (left[g] == p) == (left[p] == x):
                    rotate(p, g)
                else:
                    rotate(x, p)
            rotate(x, up[x])
            p = up[x]

    def state(size: int, above: int, moves: dict) -> int:
        length.append(size)
        link.append(above)
        nexts.append(moves)
        left.append(0)
        right.append(0)
        up.append(above)
        colour.append(-1)
        return len(length) - 1

    found, end = [], 1
    for i, word in enumerate(words):
        new, p = state(i + 1, 1, {}), end
        while p and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p:
            q = nexts[p][word]
            if length[q] != length[p] + 1:
                copy = state(length[p] + 1, link[q], dict(nexts[q]))
                while p and nexts[p].get(word) == q:
                    nexts[p][word] = copy
                    p = link[p]
                # The copy takes its place right above q, on q's path and with its colour.
                splay(q)
                above = left[copy] = left[q]
                if above:
                    up[above] = copy
                left[q], up[copy], link[q] = copy, q, copy
                q = copy
            link[new] = up[new] = q
        end = new

        below, at = new, up[new]
        while at:
            splay(at)
            j, most = colour[at], length[at]
            d = i - j
            if d <= most and most + d >= least and (i + 1 == n or words[i + 1] != words[i + 1 - d]):
                found.append((i - most - d + 1, most + d, d))
            if right[at]:
                colour[right[at]] = j
            right[at] = below
            below, at = at, up[at]
        splay(new)
        colour[new] = i
    return found


def repeating(words: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Stretches of word numbers outside which no run has a word, each holding its runs whole.

    In a run of ``max(least, 2 * q)`` words at least half of them are followed, q later, by
    the same words; so each word of a run lies in ``least / 2`` words in a row that the text
    holds twice. Equal sums of different words only make a stretch longer.
    """
    k = min(max(1, (least + 1) // 2), len(_MULTIPLIERS))
    n = len(words)
    if n < max(least, 2):
        return
    sums = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        sums += words[j : n - k + 1 + j] * _MULTIPLIERS[j]
    todo = [(0, n, 0)]
    while todo:
        a, b, looks = todo.pop()
        part = sums[a : b - k + 1]
        order = np.argsort(part, kind="stable")
        same = part[order[1:]] == part[order[:-1]]
        marked = np.zeros(len(part) + 1, bool)
        marked[order[1:][same]] = marked[order[:-1][same]] = True
        edges = np.zeros(b - a + 1, np.int64)
        edges[:len(part)] += marked[:-1]
        edges[k : k + len(part)] -= marked[:-1]
        inside = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(edges[:-1]) > 0).view(np.int8), [0]))))
        for s, e in zip((inside[::2] + a).tolist(), (inside[1::2] + a).tolist(), strict=True):
            if e - s < least:
                continue
            if (s, e) == (a, b) or looks == LOOKS:
                yield s, e
            else:
                todo.append((s, e, looks + 1))


def runs_of(words: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    if len(words) < max(least, 2):
        return []
    codes: dict[bytes, int] = {}
    numbers = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.uint64, len(words))
    if len(codes) == len(words):
        return []
    found = []
    for a, b in repeating(numbers, least):
        found += [(a + s, size, q) for s, size, q in squares_to_runs(numbers[a:b].tolist(), least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, size, q in runs:
        edges[start + q] += 1
        edges[start + size] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """(key, n_words, runs, collapsed) of each row of ``docs``.

    ``runs`` lists (start, length, period) of all runs by start, then period; ``collapsed`` is
    the text without what repeats, its words joined by one space. Words are
    ``[^\\x20\\x09-\\x0D]+``, numbered from 0 and compared as bytes.

    A row is a row of the result: repeated rows and equal or null keys stay as they are. A null or
    empty text has no words, no runs and an empty collapsed text. Whole texts are
    used; words outside repeated stretches are left to numpy, the automaton takes some
    600 bytes a word of the longest stretch. Other columns aren't read, whatever their names.
    Nothing is shuffled, so a lost executor repeats its own tasks only.
    """
    kind = docs.schema[key].dataType
    schema = f"key {kind.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1), 0
            out, held = [], 0
            for i in range(len(texts)):
                words = (texts[i].as_py() or "").encode().split()
                runs = runs_of(words, least)
                left = collapsed(words, runs).decode()
                out.append((len(words), [{"start": s, "length": z, "period": q} for s, z, q in runs], left))
                held += len(left)
                if held >= BATCH or i + 1 == len(texts):
                    counts, lists, lefts = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(at, len(out)), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(run)), pa.array(lefts, pa.string())],
                        ["key", "n_words", "runs", "collapsed"],
                    )
                    at, out, held = i + 1, [], 0

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, schema)
    return found.withColumnRenamed("key", key)
