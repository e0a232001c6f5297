import itertools
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rulewright.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tool():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_words_give_the_tokenizers_ids(tool, corpus):
    texts = [t or "" for _, t in corpus] + ["don't İstanbul ΣΑΣ 1²½ café naïve — “q” x", "á é  b\x85c\x1cd", "<|endoftext|> it's we'll'D 'S ''s", "Á x​", "…a–b€5 'twas 've"]
    mine = packing.WordTokens(open(PATH, encoding="utf-8").read())
    for got, text in zip(mine(texts), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids, text


def test_words_that_are_used_most_stay_known(tool, monkeypatch):
    """A flood of rare words makes no frequent word be encoded again, and ids stay right while words go."""
    monkeypatch.setattr(packing, "MEMO", 100)
    mine = packing.WordTokens(open(PATH, encoding="utf-8").read())
    encoded, encode = [], mine._encode_words
    monkeypatch.setattr(mine, "_encode_words", lambda words: encoded.extend(words) or encode(words))
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["often é often often often " * 50, *[" ".join("q" + letters[k] + a + b for a in letters[:8] for b in letters) for k in range(6)], "é often qaaa", ""]
    for text in texts:
        assert np.frombuffer(mine([text])[0], "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids
    assert encoded.count("often") == encoded.count("é") == 1 and encoded.count("qaaa") == 2


@lru_cache(None)
def optimum(items, capacity):
    """Least bins, by trying all."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    for k in range(len(rest) + 1):
        for some in set(itertools.combinations(range(len(rest)), k)):
            if first + sum(rest[i] for i in some) <= capacity:
                best = min(best, 1 + optimum(tuple(x for i, x in enumerate(rest) if i not in some), capacity))
    return best


def test_dominance_loses_no_optimum():
    r = random.Random(4)
    for _ in range(150):
        capacity = r.choice([10, 13, 20])
        items = tuple(sorted((r.randint(1, capacity) for _ in range(r.randint(0, 7))), reverse=True))
        count = [items.count(w) for w in range(capacity + 1)]
        fixed = packing.reduce_by_dominance(count, capacity)
        left = tuple(w for w in range(capacity, 0, -1) for _ in range(count[w]))
        assert sum(n for _, n in fixed) + optimum(left, capacity) == optimum(items, capacity)
        assert all(sum(b) <= capacity for b, _ in fixed)
        assert sorted(left + tuple(w for b, n in fixed for w in b * n)) == sorted(items)


def test_plan_is_whole_and_gapless():
    r = random.Random(5)
    for _ in range(50):
        count = {r.randint(1, 64): r.randint(1, 50) for _ in range(r.randint(0, 20))}
        where = {}
        for w, first, n, sequence, offset in packing.plan(count, 64).tolist():
            for i in range(n):
                where.setdefault(sequence + i, []).append((offset, w, first + i))
        assert sorted((w, i) for s in where.values() for _, w, i in s) == [(w, i) for w in sorted(count) for i in range(count[w])]
        for pieces in where.values():
            at = 0
            for offset, w, _ in sorted(pieces):
                assert offset == at
                at += w
            assert at <= 64


def test_documents_are_packed_whole(docs, corpus, tool):
    rows = packing.pack_documents(docs, PATH, 256).collect()
    for i, text in corpus:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in mine] == [(a, min(256, len(ids) - a)) for a in range(0, len(ids), 256)]
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine]
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(pieces)) and pieces[0][0] == 0 and sum(pieces[-1]) <= 256
    assert len(used) <= 1.03 * sum(r.length for r in rows) / 256


def test_odd_rows(odd, none):
    assert len(packing.pack_documents(odd, PATH).collect()) == 5
    assert packing.pack_documents(none, PATH).collect() == []
