import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from mnemograph.llm import segments, tokens
from mnemograph.llm.words import text_bytes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
POOLS = ["abcdefghij   \n", "thea in ing st  ", "漢字éüñ😀 aab\t", "aaaaaab", "   ", "  　 \x85x", "'s 't1 2,;"]


def invented(rng, n):
    pools = rng.sample(POOLS, rng.randint(1, len(POOLS)))
    return "".join(rng.choice(rng.choice(pools)) for _ in range(n))


def test_splices_equal_whole_encodings():
    tokenizer, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(3)
    for _ in range(200):
        text = invented(rng, rng.randint(1, 900))
        cut = list(tokens.chunks(text.encode(), 64, 16))
        found = [tokens.sides(tokenizer, k, begin, part, 64, 16, k + 1 == len(cut)) for k, begin, part in cut]
        total = sum(f[0] for f in found)
        for (n, _, tail), (_, head, _) in zip(found, found[1:], strict=False):
            upto = {(p, i): k for p, i, k in tail}
            seams = [(upto[p, i], k) for p, i, k in head if (p, i) in upto]
            if not seams:
                break
            left, right = seams[0]
            total -= n - left + right
        else:
            assert total == len(tokenizer.encode(text))


def test_counts_of_short_and_huge_texts(docs, prose):
    rng = random.Random(4)
    texts = [None, "", " ", "a", "<s> a </s> <unk>", prose(3000), prose(3000) + "\n", "a" * 9000, invented(rng, 20_000), "漢字" * 3000, prose(3000)]
    texts += [texts[5]]
    tokenizer = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for chunk, overlap in ((2048, 64), (256, 2)):
        got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs(texts), MODEL, chunk, overlap).collect())
        assert got == [(i, len((t or "").encode()), len(tokenizer.encode(t or ""))) for i, t in enumerate(texts)]
    assert tokens.count_tokens(docs([]), MODEL).count() == 0
    again = tokens.count_tokens(docs([texts[5], texts[5], None], ids=[1, 1, None]), MODEL, 2048, 64).collect()
    assert len(again) == 3 and len({r.n_tokens for r in again if r.doc_id == 1}) == 1


def test_segments_give_the_tokenizers_ids():
    import pyarrow as pa

    rng, whole, encode = random.Random(6), Tokenizer.from_file(BPE), segments.SegmentEncoder(BPE, most=300)
    for _ in range(60):
        texts = [invented(rng, rng.randint(0, 200)) for _ in range(8)] + ["a <|endoftext|> b<|endoftext|>", None, "\x1c \x1f x"]
        ids, upto = encode(*text_bytes(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[upto[i] : upto[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids
    assert isinstance(ids, np.ndarray)
