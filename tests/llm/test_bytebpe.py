import base64
import random

import public_tokenizers
import tiktoken

from rulewright.llm import bytebpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DATA = open(PATH, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_hash_is_perfect_and_minimal():
    for keys in ([], [b""], [b"a", b"b"], [str(i).encode() for i in range(3000)]):
        h = bytebpe.PerfectHash(keys)
        assert sorted(h(keys).tolist()) == list(range(len(keys)))


def test_ids_are_the_librarys(corpus):
    r = random.Random(1)
    texts = [t or "" for _, t in corpus] + ["x" * 3000, " " * 500 + "a", "abcabc" * 200, "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x3000), 0x1F600])) for _ in range(2000)), "\x00\x01", "it's  a\n\n b\t"]
    tool = bytebpe.codec(DATA, PATTERN)
    for got, text in zip(tool.encode_batch(texts), texts, strict=True):
        assert got == LIBRARY.encode_ordinary(text)
        assert tool.decode(got) == text.encode()


def test_columns(docs, corpus, odd, none):
    rows = {r.doc_id: r for r in bytebpe.decode(bytebpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()}
    assert all(rows[i].ids == LIBRARY.encode_ordinary(t or "") and bytes(rows[i].decoded) == (t or "").encode() for i, t in corpus)
    assert sorted(len(r.ids) for r in bytebpe.encode(odd, PATH, PATTERN).collect())[:2] == [0, 0]
    assert bytebpe.encode(none, PATH, PATTERN).collect() == []
