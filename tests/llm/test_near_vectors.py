import numpy as np

from mnemograph.llm import descent
from mnemograph.llm.scratch import Scratch

SCHEMA = "vec_id long, embedding array<double>, label int, n int, rep string"


def brute(rows):
    usable = [(i, np.array(v)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)]
    count, up = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(usable):
        for j, b in usable[k + 1 :]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                count[i] += 1
                count[j] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (count[i], root(i)) for i, _ in rows}


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [rng.standard_normal(16) for _ in range(500)]
    for size, noise in ((2, 0.05), (30, 0.05), (90, 0.02), (8, 0.08)):
        base = rng.standard_normal(16)
        rows += [base + noise * rng.standard_normal(16) for _ in range(size)]
    rows += [rows[0]] * 15 + [rows[1] * 3] + [rng.standard_normal(5)] * 2
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    table = spark.createDataFrame([(i, v, 1, 2, "r") for i, v in rows], SCHEMA)
    out = descent.near_vectors(table)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (8, [1.0, 2.0]), (9, [-0.0, 1e-200]), (10, [0.0, 1e200])]
    table = spark.createDataFrame([(i, v, 1, 2, "r") for i, v in [*rows, (None, [1.0, 2.0])]], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in descent.near_vectors(table).collect()}
    assert got[6] == (2, 6, True) and got[7] == (2, 6, False) and got[8] == (2, 6, False) and got[9] == (1, 9, True) and got[10] == (1, 9, False)
    assert all(got[i] == (0, i, True) for i in range(6)) and got[None] == (0, None, True)
    assert descent.near_vectors(table.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 2.0], 1, 2, "r")] * 2, SCHEMA)
    assert [tuple(r) for r in descent.near_vectors(twice).collect()] == [(1, 1, 1, True)] * 2


def test_tight_subgroups_near_each_other_are_one_group(spark):
    rng = np.random.default_rng(4)

    def tight(centre, size):
        off = rng.standard_normal((size, 32))
        off -= np.outer(off @ centre, centre)
        return centre + 0.05 * off / np.linalg.norm(off, axis=1)[:, None]

    def beside(centre, cos):
        side = rng.standard_normal(32)
        side -= (side @ centre) * centre
        return cos * centre + np.sqrt(1 - cos * cos) * side / np.linalg.norm(side)

    one = rng.standard_normal(32)
    one /= np.linalg.norm(one)
    rows = [*tight(one, 60), *tight(beside(one, 0.945), 60), *tight(beside(one, 0.7), 60)]
    units = np.array([v / np.linalg.norm(v) for v in rows])
    vectors = spark.createDataFrame([(i, 32, 1, bytearray(v.tobytes())) for i, v in enumerate(units)], "rep long, dim int, n long, vec binary")
    top = spark.createDataFrame([(i, i - i % 60) for i in range(180)], "rep long, component long")
    got = descent._bridges(top, vectors, 0.95, Scratch(spark, "bridges")).collect()
    assert (units[:60] @ units[60:120].T >= 0.95).any() and (units[:120] @ units[120:].T).max() < 0.95
    assert {(r.a // 60, r.b // 60) for r in got} == {(0, 1)} and all(units[r.a] @ units[r.b] >= 0.95 for r in got)


def test_lists_once_grown_stay_long(spark):
    lists, full = (spark.createDataFrame(x, "u long, k int") for x in ([(1, 20), (2, 20)], [(2, 40), (3, 40)]))
    assert sorted(map(tuple, descent._longer(lists, full).collect())) == [(1, 20), (2, 40), (3, 40)]
