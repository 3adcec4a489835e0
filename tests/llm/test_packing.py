import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from mnemograph.llm import packing, segments

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_plan_uses_each_piece_once_and_fills_gaps_exactly():
    rng = np.random.default_rng(1)
    for high in (2048, 900, 2047):
        counts = Counter(rng.integers(1, high + 1, 6000).tolist())
        planned = packing.plan(dict(counts))
        used = Counter()
        for lengths, times in planned:
            assert times > 0 and sum(lengths) <= packing.CAPACITY
            for x in lengths:
                used[x] += times
        assert used == counts
        total = sum(k * n for k, n in counts.items())
        assert sum(t for _, t in planned) <= 1.014 * -(-total // packing.CAPACITY) + 1


def test_plan_prefers_exact_complements():
    assert sorted(packing.plan({1000: 4, 1048: 2, 524: 4})) == sorted([((1048, 1000), 2), ((1000, 524, 524), 2)])
    assert packing.plan({}) == [] and packing.plan({2048: 3}) == [((2048,), 3)]
    assert packing.plan({1: 5000}) == [((1,) * 2048, 2), ((1,) * 904, 1)] or sum(len(a) * n for a, n in packing.plan({1: 5000})) == 5000


def test_segments_encoded_together_have_their_own_ids():
    rng = np.random.default_rng(4)
    parts = ["word", "Ünï", "日本", "  ", "\n", "\u00a0x", "x\u00a0", "\u3000", "12,5", "it's", "<|endoftext|>", " ", "\t a", "\u0085", "e\u2003", "!?"]
    rows = ["".join(rng.choice(parts, rng.integers(0, 60))) for _ in range(150)]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(r.encode()) for r in rows)])
    whole = Tokenizer.from_file(BPE)
    for together in (1, 40, 1 << 14):
        ids, upto = segments.SegmentEncoder(BPE, most=200, together=together)(data, offsets)
        for i, r in enumerate(rows):
            assert ids[upto[i] : upto[i + 1]].tolist() == whole.encode(r, add_special_tokens=False).ids


def test_pieces_and_places(spark, docs, prose):
    texts = [None, "", "a", "a", prose(9000), *(prose(20 + 13 * i) for i in range(80)), "<|endoftext|> x"]
    ids = [*range(len(texts) - 1), None]
    rows = packing.pack(docs(texts + [texts[4]], ids=ids + [4]), BPE).collect()
    whole = Tokenizer.from_file(BPE)
    want = []
    for i, t in zip(ids + [4], texts + [texts[4]], strict=True):
        own = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(own) % 2048 or 2048
        edges = [0, *range(first, len(own) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs([]), BPE).count() == 0
