from collections import defaultdict

from mnemograph.llm import mixing, op05


def table(docs, prose):
    out = None
    for k, (source, n) in enumerate([("a", 90), ("b", 30), ("B", 12), (None, 40), ("é", 5), ("z", 1)]):
        part = docs([prose(20 + 37 * i % 400) for i in range(n)], ids=range(1000 * k, 1000 * k + n), source=source)
        out = part if out is None else out.union(part)
    return out.union(docs([None, "", " "], ids=[9000, 9001, None], source="empty"))


def test_takes_follow_targets_and_the_twin(spark, docs, prose, tmp_path, twin):
    mixed = table(docs, prose)
    mixed.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op05.query(spark, str(tmp_path)).collect()
    want = twin(op05.SQL, documents=mixed)
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    for r, w in zip(sorted((r.asDict() for r in rows), key=key), sorted(want, key=key), strict=True):
        assert r.pop("target") - w.pop("target") < 1e-6 and r == w
    total, goal = defaultdict(int), {}
    for r in rows:
        total[r.source_size] += r.taken
        goal[r.source_size] = r.target
        assert r.taken <= 2 * r.size
    for k, t in goal.items():
        assert abs(total[k] - t) <= 1
    assert abs(sum(goal.values()) - 1.5 * sum(r.size for r in rows)) < 1
    assert sorted(map(tuple, op05.query(spark, str(tmp_path)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_every_stretch_of_the_schedule_holds_the_weights(docs, prose):
    rows = mixing.schedule(table(docs, prose), block=64).collect()
    slots = defaultdict(set)
    for r in rows:
        slots[r.slot].add(r.source)
    assert all(len(s) == 1 for n, s in slots.items() if n < max(slots))
    order = [next(iter(slots[n])) for n in sorted(slots)]
    share = order.count("a") / len(order)
    for i in range(0, len(order) - 100, 50):
        assert abs(order[i : i + 100].count("a") / 100 - share) < 0.08
    parts = defaultdict(int)
    for r in rows:
        parts[r.doc_id] += r.words
    taken = {r.doc_id: r.taken for r in mixing.mix(table(docs, prose), block=64).collect() if r.taken}
    assert parts == taken


def test_one_source_repeated_rows_and_no_rows(docs):
    got = sorted((r.doc_id, r.size, r.taken, r.copies) for r in mixing.mix(docs(["a b", "a b", "c d e"], ids=[1, 1, 2])).collect())
    assert [g[:2] for g in got] == [(1, 2), (1, 2), (2, 3)] and sum(g[2] for g in got) == 11
    assert mixing.mix(docs([])).count() == 0
    assert [r.taken for r in mixing.mix(docs([None, ""])).collect()] == [0, 0]
