import re

import numpy as np

from mnemograph.llm import hyperminhash as hmh

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a & b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_registers_hold_leading_zeros_and_mantissa():
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 2**64, 700, dtype=np.uint64))
    row, least = hmh.registers([hashes])[0], {}
    for x in hashes.tolist():
        least[x >> 56] = min(x & (2**56 - 1), least.get(x >> 56, 2**56))
    for bucket in range(256):
        if bucket not in least:
            assert row[bucket] == 0
            continue
        bits = f"{least[bucket]:056b}"
        zeros = len(bits) - len(bits.lstrip("0"))
        assert row[bucket] == ((zeros + 1) << 10 | int(bits[zeros + 1 : zeros + 11].ljust(10, "0"), 2))


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, 20_000, dtype=np.uint64)) for _ in range(2)]
    mixed = np.unique(np.concatenate([sets[0][:18_000], sets[1][:2_000]]))
    codes = hmh.registers([*sets, mixed])
    n = np.full(2, 20_000)
    found, used = hmh.jaccard(codes[[0, 0]], codes[[1, 2]], n, n)
    assert used.tolist() == [256, 256] and found[0] < 0.01 and abs(found[1] - 18 / 22) < 0.1


def test_classes_equal_brute_force(spark, docs, prose):
    rng = np.random.default_rng(2)
    texts = []
    for n in (6, 7, 12, 40, 150, 400):
        for _ in range(4):
            base = prose(n)
            texts.append(base)
            for edits in (0, 1, 1, 2, 4, 9):
                words = base.split()
                for k in rng.integers(0, len(words), edits).tolist():
                    words[k] = words[k] + "x"
                texts.append(" ".join(words).upper() if edits == 0 else " ".join(words))
    passage = prose(60)
    texts += [f"{prose(10)} {passage} {prose(10)}" for _ in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hmh.near_duplicates(docs(texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_crowded_group_of_unlinked_variants(spark, docs, prose):
    rng = np.random.default_rng(3)
    base, texts = prose(120).split(), []
    for i in range(150):
        words = list(base)
        for k in rng.integers(0, len(words), 1 if i % 10 == 0 else 5).tolist():
            words[k] = f"v{i}"
        texts.append(" ".join(words))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hmh.near_duplicates(docs(texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_odd_rows(spark, docs, prose):
    long = prose(30_000)
    texts = [None, "", " \n\t", "one", "ONE", "one two", long, long + " end", "one", None]
    out = hmh.near_duplicates(docs(texts, ids=[0, 1, 2, 3, 4, 5, 6, 7, 3, None])).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out), key=repr)
    assert got == sorted(
        [(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True),
         (6, len(shingles(long)), 6, True), (7, len(shingles(long + " end")), 6, False), (3, 1, 3, True), (None, 0, None, True)], key=repr)


def test_no_rows(spark, docs):
    out = hmh.near_duplicates(docs([]))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


def test_bands_follow_the_threshold():
    assert (hmh.band_rows(85, hmh.BUCKETS), hmh.band_rows(85, hmh.FINE_BUCKETS)) == (8, 20)
    for percent in (50, 70, 80, 85, 90):
        for width in (hmh.BUCKETS, hmh.FINE_BUCKETS):
            rows = hmh.band_rows(percent, width)
            assert (1 - (percent / 100) ** rows) ** (width // rows) <= 1 / 20_000


def _missed(pairs, keys):
    both = [keys([p[i] for p in pairs]) for i in (0, 1)]
    return int((~(both[0] == both[1]).any(axis=1)).sum())


def test_short_sets_are_not_missed():
    rng = np.random.default_rng(6)
    for union, n, n_fine in ((20, 3000, 200), (60, 3000, 200)):
        pairs = []
        for _ in range(n):
            x, gone = rng.integers(0, 2**64, union, dtype=np.uint64), union * 15 // 100
            pairs.append((np.sort(x[gone // 2 :]), np.sort(x[: union - (gone - gone // 2)])))  # J = 0.85
        assert _missed(pairs, lambda sets: hmh.band_keys(hmh.filled(hmh.registers(sets), sets), hmh.band_rows(85, hmh.BUCKETS))) <= 2
        assert _missed(pairs[:n_fine], lambda sets: hmh.band_keys(hmh.fine_codes(sets), hmh.band_rows(85, hmh.FINE_BUCKETS))) <= 1
