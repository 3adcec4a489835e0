"""Wildcard rules over canonical URLs, all at once, in a bit-parallel Shift-And automaton.

A canonical URL is ``.host`` followed by the path. A rule is a glob: ``*`` stands for
characters other than ``/``, ``**`` for any characters, ``?`` for one character other than
``/``; it must cover the whole URL. Each rule owns one bit a character in a row of 64-bit
words; one step shifts all rules' states together, lets wildcard bits stay, and clears the
bits whose character doesn't fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.words import slices, text_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: After the first ``://``: the host up to ``/``, ``?`` or ``#``, then the path up to ``?`` or ``#``.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for hosts equal to or below ``host`` whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> list[str]:
        literal = "".join(c if c not in "*?\\" else "\\" + c for c in self.name)
        return [f"*.{literal}**"] if self.path else [f"*.{literal}", f"*.{literal}/**"]


class Automaton:
    """The packed rules: masks of the bits that a byte may enter or stay in."""

    def __init__(self, globs: list[str]):
        moves: list[tuple[str, int | None]] = []  # one bit each: (literal, byte), (any, None) or (gap kind, None)
        starts, ends = [], []
        for glob in globs:
            starts.append(len(moves))
            moves.append(("start", None))
            moves += _parse(glob)
            ends.append(len(moves) - 1)
        self.words = len(moves) // 64 + 1
        bits = self.words * 64
        enter, stay, skip = np.zeros((256, bits), bool), np.zeros((256, bits), bool), np.zeros(bits, bool)
        tail = np.arange(256) >= 0x80
        tail &= np.arange(256) < 0xC0
        for i, (kind, byte) in enumerate(moves):
            if kind == "literal":
                enter[byte, i] = True
            elif kind == "any":
                enter[:, i] = ~tail
                enter[ord("/"), i] = False
                stay[tail, i] = True
            elif kind in ("run", "deep"):
                stay[:, i] = True
                if kind == "run":
                    stay[ord("/"), i] = False
                enter[:, i] = stay[:, i]
                skip[i] = True
        self.enter, self.stay = _packed(enter), _packed(stay)
        self.skip = _packed(skip[None, :])[0]
        self.start = _packed(np.isin(np.arange(bits), starts)[None, :])[0]
        self.start = self._skips(self.start[None, :])[0]
        self.ends = np.array(ends)

    def _shifted(self, state: np.ndarray) -> np.ndarray:
        out = state << np.uint64(1)
        out[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return out

    def _skips(self, state: np.ndarray) -> np.ndarray:
        """Also the states that follow over wildcards of no characters."""
        while True:
            more = state | (self._shifted(state) & self.skip)
            if (more == state).all():
                return state
            state = more

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, rules): whether each glob covers each row."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        begin, ordered = offsets[:-1][order], sizes[order]
        state = np.repeat(self.start[None, :], len(order), axis=0)
        for at in range(int(ordered[0]) if len(ordered) else 0):
            live = int(np.searchsorted(-ordered, -at, "left"))
            byte = data[begin[:live] + at]
            now = state[:live]
            state[:live] = self._skips((self._shifted(now) & self.enter[byte]) | (now & self.stay[byte]))
        hit = (state[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64)) & np.uint64(1)
        out = np.empty(hit.shape, bool)
        out[order] = hit > 0
        return out


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8").astype(np.uint64)


def _parse(glob: str) -> list[tuple[str, int | None]]:
    out: list[tuple[str, int | None]] = []
    i = 0
    while i < len(glob):
        if glob[i] == "*":
            deep = glob[i : i + 2] == "**"
            out.append(("deep" if deep else "run", None))
            i += 2 if deep else 1
        elif glob[i] == "?":
            out.append(("any", None))
            i += 1
        else:
            i += glob[i] == "\\"
            out += [("literal", b) for b in glob[i].encode()]
            i += 1
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for a null or a URL without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, PARTS, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def judge(pages: DataFrame, rules: list[Rule], blocked: list[str]) -> DataFrame:
    """``pages`` with host, path, rule and verdict of column ``url``.

    Of the ``rules`` that fit, the one with the longest host and path decides (block wins a
    tie); rule is its host and path. Where none fits, rule is null and the verdict is block if
    one of the ``blocked`` globs covers the canonical URL, else allow. A row is judged alone:
    nulls, empty and very long URLs and repeated rows are rows like others, no row is lost.
    Columns host, path, rule and verdict of the input are replaced.
    """
    first = [(-len(r.name), r.verdict != "block", i) for i, r in enumerate(rules)]
    ranked = [rules[i] for _, _, i in sorted(first)]
    globs = [(g, k) for k, r in enumerate(ranked) for g in r.globs]
    owners = np.array([k for _, k in globs], np.int64)
    texts = [g for g, _ in globs] + list(blocked)
    names, verdicts = [r.name for r in ranked], [r.verdict for r in ranked]

    @F.arrow_udf("rule string, verdict string")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton(texts)
        for column in batches:
            data, offsets = text_bytes(column)
            rule: list[str | None] = []
            verdict: list[str] = []
            for a, b in slices(offsets):
                hit = automaton.matches(data, offsets[a : b + 1])
                fits = np.zeros((b - a, len(ranked) + 1), bool)
                for j, k in enumerate(owners.tolist()):
                    fits[:, k] |= hit[:, j]
                fits[:, -1] = True
                best, bad = fits.argmax(axis=1).tolist(), hit[:, len(owners) :].any(axis=1).tolist()
                rule += [names[k] if k < len(names) else None for k in best]
                verdict += [verdicts[k] if k < len(names) else "block" if x else "allow" for k, x in zip(best, bad, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["rule", "verdict"])

    host, path = url_parts(F.col("url"))
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    out = out.withColumn("_judged", judged(F.concat(F.lit("."), "host", "path")))
    return out.withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}).drop("_judged")
