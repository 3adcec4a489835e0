import numpy as np

from mnemograph.llm import chaining


def found(df):
    return sorted((r.doc_id, r.first_id, r.start, r.stop, r.first_start, r.first_stop, r.matched) for r in df.collect())


def test_planted_passages(docs, prose):
    shared, fuzzy = prose(70), prose(120)
    words = fuzzy.split()
    for k in range(0, 120, 14):
        words[k] = "changed"
    del words[40]
    texts = [prose(200), f"{prose(30)} {shared} {prose(40)}", f"{shared.upper()} {prose(90)}", f"{prose(100)}\n{shared}", prose(300),
             f"{prose(50)} {fuzzy}", f"{prose(15)} {' '.join(words)} {prose(60)}", prose(49), prose(49)]
    got = found(chaining.passages(docs(texts)))
    assert [g for g in got if g[1] == 1] == [(2, 1, 0, 70, 30, 100, 70), (3, 1, 100, 170, 30, 100, 70)]
    near = [g for g in got if g[1] == 5]
    assert {g[0] for g in near} == {6} and all(g[6] >= 0.8 * (g[3] - g[2]) for g in near)
    assert sum(g[3] - g[2] for g in near) >= 100
    assert {g[0] for g in got} == {2, 3, 6}


def test_copies_near_copies_and_removal(docs, prose):
    base, other = prose(150), prose(80)
    words = base.split()
    words[75] = "x"
    table = docs([base, base, " ".join(words), f"{other} {base}", other, None, "", base], ids=[0, 1, 2, 3, 4, 5, 6, None])
    got = chaining.passages(table)
    assert {(g[0], g[1]) for g in found(got)} == {(1, 0), (2, 0), (3, 0), (4, 3)}
    left = {r.doc_id: (r.text, r.n_chars) for r in chaining.without(table, got).collect()}
    assert set(left) == {0, 3, 5, 6, None} and left[3] == (other, len(other)) and left[0] == (base, len(base)) and left[5] == (None, None)


def test_repetitive_short_and_long_texts(docs, prose):
    long = prose(20_000)
    table = docs(["a " * 400, "a " * 300 + "b", "one two", long, prose(10) + " " + long, "one two"])
    got = found(chaining.passages(table))
    assert (4, 3, 10, 20_010, 0, 20_000, 20_000) in got and {g[0] for g in got} <= {1, 4}
    assert chaining.passages(docs([])).count() == 0
    assert chaining.without(docs(["x"]), chaining.passages(docs(["x"]))).count() == 1


def test_equal_stretches_lie_in_passages_whatever_occurs_earlier(docs, prose):
    rng = np.random.default_rng(3)
    pool = [prose(int(rng.integers(10, 30))) for _ in range(8)]
    texts = []
    for _ in range(60):
        picked = " ".join(pool[i] for i in rng.integers(0, 8, 5))
        texts.append(f"{prose(int(rng.integers(5, 40)))} {picked} {prose(int(rng.integers(5, 40)))}")
    got = found(chaining.passages(docs(texts)))
    seen = set()
    for n, text in enumerate(texts):
        words = text.split()
        windows = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
        for i, window in enumerate(windows):
            if window in seen:
                assert set(range(i, i + 50)) <= {w for g in got if g[0] == n for w in range(g[2], g[3])}
        seen.update(windows)


def test_fuzzy_passage_whose_parts_occur_first_in_different_documents(docs, prose):
    lines = [prose(20) for _ in range(3)]
    shared = " ".join(lines).split()
    changed = list(shared)
    changed[20] = changed[40] = "changed"
    texts = [f"{prose(40)} {line} {prose(40)}" for line in lines]
    texts += [f"{prose(30)} {' '.join(shared)} {prose(30)}", f"{prose(25)} {' '.join(changed)} {prose(35)}", f"{prose(10)} {' '.join(changed)} {prose(50)}"]
    got = found(chaining.passages(docs(texts)))
    assert {(g[0], g[1], g[2], g[3], g[6]) for g in got} >= {(4, 3, 25, 85, 58), (5, 3, 10, 70, 58)}
    assert {g[0] for g in got} == {4, 5}


def test_pair_held_by_more_documents_than_a_block(docs, prose, monkeypatch):
    monkeypatch.setattr(chaining, "BLOCK", 2)
    one, two = prose(26), prose(26)
    texts = [f"{prose(40)} {one} {prose(40)}", f"{prose(40)} {two} {prose(40)}"]
    gaps = [prose(60) for _ in range(6)] + ["x y z", prose(60), "x u z"]
    texts += [f"{prose(20)} {one} {gap} {two} {prose(20)}" for gap in gaps]
    got = found(chaining.passages(docs(texts)))
    assert (10, 8, 20, 75, 20, 75, 54) in got and {g[0] for g in got} == {10}


def test_passage_goes_on_beyond_the_margins(docs, prose):
    first = prose(30 + 300).split()
    later = [w if n < 30 or n % 6 else "changed" for n, w in enumerate(first)]
    texts = [f"{prose(20)} {' '.join(first)} {prose(300)}", f"{prose(30)} {' '.join(later)} {prose(300)}"]
    got = found(chaining.passages(docs(texts)))
    assert max(g[3] for g in got) - min(g[2] for g in got) >= 320


def test_chain_takes_the_predecessor_in_reach():
    at, first, size = (np.array(x) for x in ([0, 400, 440], [0, 400, 440], [300, 30, 30]))
    assert sorted(c.tolist() for c in chaining.best_chains(at, first, size)) == [[0], [1, 2]]


def test_chains_skip_crossing_anchors():
    at, first, size = (np.array(x) for x in ([0, 30, 60, 90], [100, 130, 20, 190], [20, 20, 25, 20]))
    chains = [c.tolist() for c in chaining.best_chains(at, first, size)]
    assert chains[0] == [0, 1, 3] and [2] in chains


def test_common_subsequence_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, y = rng.integers(0, 6, rng.integers(1, 90)), rng.integers(0, 6, rng.integers(1, 90))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
        assert chaining.common(x, y) == table[-1, -1]


def test_cut_words_keeps_the_rest_as_it_is():
    assert chaining.cut_words("a  b\nc d", [(1, 3)]) == "a d"
    assert chaining.cut_words(" é b\nc", [(0, 1)]) == "b\nc"
    assert chaining.cut_words("a b", [(0, 2)]) == "" and chaining.cut_words("a b", [(1, 9)]) == "a"
