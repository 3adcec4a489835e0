"""Cheapest edits that give a piece of a conversation a legal order of roles.

The lattice has a node for each number of messages read and each state of the
pattern ``(s?(ua)+)?``: nothing yet, after the system message, after a user, after
an assistant. Edges are edits: Keep, Rerole (to the role the state asks for), Delete, and
Insert, which reads no message. From a node each initial leads to one node, so a path and its
audit (the initials) name each other, and of two parts between the same ends none begins with the other.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: State after a message of the role that the state asks for, and that role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: State after keeping a message of a role initial.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Cost of what ends a conversation in each state: pairs are closed by inserts.
CLOSING = {START: 0, ASSISTANT: 0}


@dataclass(frozen=True)
class Message:
    """What the edits need to know of a message and its ``copies`` in a row (the others are always deleted)."""

    initial: str
    doomed: bool = False
    cut: bool = False
    copies: int = 1


@dataclass(frozen=True)
class Path:
    """Cost up to the exit (without what the exit costs itself), one initial an edit, and the exit's state."""

    cost: int
    audit: str
    exit: int


class Lattice:
    def __init__(self, messages: list[Message], closes: bool):
        """``closes``: inserts may follow the last message (it is the last of its conversation)."""
        self.messages, self.closes, self.n = messages, closes, len(messages)

    def after(self, i: int, state: int):
        """(initial, cost, node) of all edits at a node."""
        if i < self.n or self.closes:
            yield "I", INSERT, (i, NEXT[state])
        if i < self.n:
            m = self.messages[i]
            rest = DELETE * (m.copies - 1)
            yield "D", DELETE + rest, (i + 1, state)
            if not m.doomed:
                cut = CUT if m.cut else 0
                yield "R", REROLE + cut + rest, (i + 1, NEXT[state])
                if m.initial in KEPT[state]:
                    yield "K", KEEP + cut + rest, (i + 1, KEPT[state][m.initial])

    def before(self, i: int, state: int):
        """(initial, cost, node) of all edits that lead to a node."""
        for at in (i - 1, i):
            if at >= 0:
                for old in range(4):
                    for initial, cost, node in self.after(at, old):
                        if node == (i, state):
                            yield initial, cost, (at, old)

    def cheapest(self, entry: int, exits: dict[int, int]) -> Path | None:
        """The cheapest path from ``entry`` to an exit state, whose further cost ``exits`` tells; ties by audit.

        Two heaps grow from both ends. The search ends when their least costs together exceed the best
        sum met: then each node of each best path is settled from one end, so all crossings of equal cost
        are known and the least concatenated audit is among them. Entries of equal cost leave a heap in
        the order of the messages, so a node has all its best predecessors before it is settled
        and takes the least audit of them.
        """
        n = self.n
        ahead = [(0, 0, "", (0, entry))]
        back = []
        for state, cost in exits.items():
            heappush(back, (cost, -n, "", (n, state)))
        settled: dict[tuple, tuple[int, str]] = {}
        reached: dict[tuple, tuple[int, str]] = {}
        best = None
        while (ahead or back) if best is None else (ahead and back and ahead[0][0] + back[0][0] <= best):
            if ahead and (not back or ahead[0][0] <= back[0][0]):
                cost, _, audit, node = heappop(ahead)
                if node in settled:
                    continue
                settled[node] = cost, audit
                if node[0] == n and node[1] in exits:
                    best = _least(best, cost + exits[node[1]])
                for initial, step, to in self.after(*node):
                    if to in reached:
                        best = _least(best, cost + step + reached[to][0])
                    if to not in settled:
                        heappush(ahead, (cost + step, to[0], audit + initial, to))
            else:
                cost, _, audit, node = heappop(back)
                if node in reached:
                    continue
                reached[node] = cost, audit
                for initial, step, source in self.before(*node):
                    if source in settled:
                        best = _least(best, settled[source][0] + step + cost)
                    if source not in reached:
                        heappush(back, (cost + step, -source[0], initial + audit, source))
        if best is None:
            return None
        crossings = []
        for node, (cost, audit) in settled.items():
            if node[0] == n and node[1] in exits and cost + exits[node[1]] == best:
                crossings.append(audit)
            for initial, step, to in self.after(*node):
                if to in reached and cost + step + reached[to][0] == best:
                    crossings.append(audit + initial + reached[to][1])
        audit = min(crossings)
        end = self.walk(entry, audit)[-1][1] if audit else entry
        return Path(best - exits[end], audit, end)

    def walk(self, entry: int, audit: str) -> list[tuple[str, int, int]]:
        """(initial, state after it, messages read before it) of each edit of a path."""
        i, state, steps = 0, entry, []
        for letter in audit:
            at = i
            for initial, _, node in self.after(i, state):
                if initial == letter:
                    i, state = node
                    break
            steps.append((letter, state, at))
        return steps


def _least(a: int | None, b: int) -> int:
    return b if a is None or b < a else a
