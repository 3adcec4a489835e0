import hashlib
import random
import re
import zlib

import pytest

from mnemograph.llm import op13
from mnemograph.llm.lattice import CLOSING, Lattice, Message
from mnemograph.llm.repair import repair
from mnemograph.llm.scratch import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int, mid string, chunk int"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows):
    """(cost, audit, repaired) by a dynamic program from the end: rows are (role, text, fault)."""
    states = {"": ("u", "s"), "s": ("u",), "u": ("a",), "a": ("u",)}
    role = {"u": "user", "a": "assistant"}
    n = len(rows)
    best = {}
    for i in range(n, -1, -1):
        for state in states:
            if i == n and state in ("", "a"):
                best[i, state] = (0, "", ())
        for _ in range(4):
            for state, asked in states.items():
                options = [best[i, state]] if (i, state) in best else []

                def add(cost, letter, to, kept, options=options):
                    if to in best:
                        options.append((best[to][0] + cost, letter + best[to][1], kept + best[to][2]))

                add(3, "I", (i, asked[0]), (f"{role[asked[0]]}:",))
                if i < n:
                    who, text, fault = rows[i]
                    add(4, "D", (i + 1, state), ())
                    if fault not in ("blank", "duplicate"):
                        more = 3 if fault == "truncated" else 0
                        add(3 + more, "R", (i + 1, asked[0]), (f"{role[asked[0]]}:{text}",))
                        if who[:1] in asked and who:
                            add(more, "K", (i + 1, who[:1]), (f"{who}:{text}",))
                if options:
                    best[i, state] = min(options)
    return best[0, ""]


def expected(given):
    out = {}
    for conv in {r[0] for r in given}:
        rows = []
        for _, turn, role, text in (r for r in given if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if how == 0:
                continue
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            rows += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in rows if r[0] is not None]
        faults, seen = [], set()
        for _, role, text in rows:
            kind = "" if not WORD.search(text) else WORD.findall(text)[-1]
            faults.append("blank" if not kind else "duplicate" if (role, text) in seen else "truncated" if kind not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
        cost, audit, kept = plain([(r[1], r[2], f) for r, f in zip(rows, faults, strict=True)])
        out[conv] = {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        }
    return out


def some(rng, conv, n):
    texts = ["Yes.", "No!", "why", "", " \t", None, "Well, e.g. this", "So?\n", "À.", "x" * 5]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", None, "", "tool", "User", "user2"]
    turns = [rng.choice([None, *range(n + 2)]) if rng.random() < 0.2 else i for i in range(n)]
    rows = [(conv, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.3 else f"{rng.random()}{rng.choice('.!?a ')}") for t in turns]
    return rows + rng.sample(rows, min(len(rows), rng.randint(0, 2)))


def check(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "c", 1, "m", 2) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [r.asDict() for r in op13.query(spark, str(tmp_path)).collect()]
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert r == want[r["conv_id"]], rows if len(rows) < 20 else r["conv_id"]


def test_against_a_plain_program(spark, tmp_path):
    rng = random.Random(4)
    rows = [r for conv in [*range(120), None, 2**60] for r in some(rng, conv, rng.randint(1, 9))]
    rows += [(500, 3, "user", "y" * 300_000 + "."), (500, 4, "assistant", "word " * 60_000)]
    check(spark, tmp_path, rows)


def test_one_large_conversation(spark, tmp_path):
    rng = random.Random(8)
    rows = some(rng, 7, 1500) + [(8, 0, "user", "Same.")] * 700 + some(rng, None, 600) + some(rng, 9, 4)
    check(spark, tmp_path, rows)


def test_chunks_of_four(spark):
    """Small chunks give what one chunk gives."""
    rng = random.Random(2)
    rows = [(*r, "c", 1, "m", 2) for conv in range(25) for r in some(rng, conv, rng.randint(1, 40))]
    df = spark.createDataFrame(rows, SCHEMA)
    small, large = (repair(df, Scratch(spark, "t"), bits) for bits in (2, 8))
    read = lambda r: sorted(map(tuple, r.conversations.collect()))
    assert read(small) == read(large)
    lines = lambda r: [(m.conv_id, m.edit, m.role, m.text) for m in r.messages.orderBy("conv_id", "mid", "place").collect()]
    assert lines(small) == lines(large)


def test_all_edits_of_short_conversations():
    """Every string of edits is tried."""
    rng = random.Random(6)

    def tried(lattice, node, exits, left):
        if node[0] == lattice.n and node[1] in exits:
            yield exits[node[1]], ""
        if left:
            for letter, cost, to in lattice.after(*node):
                for more, rest in tried(lattice, to, exits, left - 1):
                    yield cost + more, letter + rest

    for _ in range(60):
        messages = [Message(rng.choice("uas "), rng.random() < 0.2, rng.random() < 0.3, rng.choice([1, 1, 2])) for _ in range(rng.randint(0, 3))]
        closes = rng.random() < 0.5
        exits = CLOSING if closes else {s: rng.randint(0, 8) for s in range(4)}
        entry, lattice = rng.randint(0, 3), Lattice(messages, closes)
        path = lattice.cheapest(entry, exits)
        assert (path.cost + exits[path.exit], path.audit) == min(tried(lattice, (0, entry), exits, len(messages) + 4))


@pytest.mark.parametrize("rows", [[], [(1, 11, None, None)]])
def test_nothing_left(spark, tmp_path, rows):
    check(spark, tmp_path, rows)
