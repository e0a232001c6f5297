"""Every query of the subpackage over a small written corpus, against its contract."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from test_passages import expected as removed
from test_setjoin import brute as joined

import __spark_entry__ as entry

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def types(df):
    return dict(df.dtypes)


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    extra = [(900, "same line\nsame line\nother\n" * 9 + "x # y", "en"), (901, "word " * 40, "en"), (902, "Hello, I\'m 12345 years  old\u00a0\u2028!", "de"), (903, "z" * 5000 + " tail", "de")]
    rows = [(i, t, ("en", "de")[i % 2], "s", len(t or "")) for i, t in corpus] + [(i, t, lang, "s", len(t)) for i, t, lang in extra]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 3 > 0), int(r[0] % 5 == 0)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, f"http://x/{i}", f"<p>page {i}") for i in range(5)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, {r[0]: r[1] for r in rows}


def run(spark, tables, name):
    df = entry.queries()[name](spark, tables[0])
    rows = [r.asDict() for r in df.collect()]
    if name not in ("op3_packing", "op8_warc"):
        assert sorted(r["doc_id"] for r in rows) == sorted(tables[1])
    return types(df), rows


def data(tables, doc_id):
    return (tables[1][doc_id] or "").encode()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(spark, tables):
    kinds, rows = run(spark, tables, "op1_sharding")
    assert kinds | {"size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"} == kinds
    for r in rows:
        assert r["size"] == len(data(tables, r["doc_id"])) + 8 and r["text_crc32"] == zlib.crc32(data(tables, r["doc_id"])) and r["law"] == "rows" and r["grown_shard"] is None
    held = Counter(r["shard"] for r in rows)
    assert set(held) <= set(range(24)) and max(held.values()) - min(held[s] for s in range(24)) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in held.items())


def test_op2(spark, tables):
    _, rows = run(spark, tables, "op2_media")
    for r in rows:
        payload = data(tables, r["doc_id"])
        payload += bytes(max(64, -(-len(payload) // 64) * 64) - len(payload))
        media = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data(tables, r["doc_id"])), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
    features = defaultdict(set)
    for r in rows:
        features[r["payload_sha256"]].add(r["feature"])
    assert all(len(f) == 1 for f in features.values())


def test_op3(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    _, rows = run(spark, tables, "op3_packing")
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert sorted(by) == sorted(tables[1])
    for doc_id, pieces in by.items():
        ids = [*tokenizer.encode(tables[1][doc_id] or "", add_special_tokens=False).ids, 0]
        pieces.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in pieces] == [(i, a, min(2048, len(ids) - a)) for i, a in enumerate(range(0, len(ids), 2048))]
        assert all(r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r["start"] : r["start"] + r["length"]])) for r in pieces)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        held.sort()
        assert sum(n for _, n in held) <= 2048 and [a for a, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]


def test_op4(spark, tables):
    kinds, rows = run(spark, tables, "op4_toxicity")
    assert (kinds["held_out"], kinds["score"], kinds["predicted"]) == ("boolean", "double", "int")
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_op5(spark, tables):
    _, rows = run(spark, tables, "op5_passages")
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=repr) == removed(list(tables[1].items()), 400)


def test_op6(spark, tables):
    _, rows = run(spark, tables, "op6_quality")
    for r in rows:
        text = tables[1][r["doc_id"]] or ""
        words = WORD.findall(text.encode())
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x.encode())]
        counts = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r["base_failed"] and r["kept"])


def test_op7(spark, tables):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    _, rows = run(spark, tables, "op7_bytebpe")
    for r in rows:
        ids = coder.encode_ordinary(tables[1][r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(data(tables, r["doc_id"])).hexdigest()


def test_op8(spark, tables):
    _, rows = run(spark, tables, "op8_warc")
    assert Counter(r["kind"] for r in rows) == {"response": 5, "conversion": 5, "metadata": 5} and len({r["record_id"] for r in rows}) == 15


def test_op9(spark, tables):
    _, rows = run(spark, tables, "op9_setjoin")
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr) == joined(list(tables[1].items()), 3, 90)


def test_op10(spark, tables):
    kinds, rows = run(spark, tables, "op10_language")
    assert (kinds["held_out"], kinds["lang_pred"], kinds["score"]) == ("boolean", "string", "double")
    for r in rows:
        letter = any(map(str.isalpha, tables[1][r["doc_id"]] or ""))
        assert r["held_out"] == (fold(r["doc_id"], 4) == 2) and (r["lang_pred"] in ("en", "de") if letter else r["lang_pred"] == "und") and 0 <= r["score"] <= 1
