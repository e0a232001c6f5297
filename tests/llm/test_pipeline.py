import random
from pathlib import Path

import __spark_entry__
import corpus_pipeline
from rulewright.llm import queries
from rulewright.llm.common import shared_dir


def test_stages_on_a_small_corpus(spark, tmp_path):
    r = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bcd" for b in "aeiou" for c in ("n", "t", "ra", "lo")]
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(99)) for _ in range(n))
    rows = [(i, prose(r.randint(60, 200)), "en", "s", 0) for i in range(40)]
    copy = rows[0][1].split()
    copy[5] = "changed"
    passage = prose(120)
    rows += [(50, rows[1][1], "en", "s", 0), (51, " ".join(copy), "en", "s", 0), (52, None, None, None, None), (53, "12 34", "en", "s", 0), (54, "too short", "en", "s", 0), (55, "a b c d e f g h " * 30, "en", "s", 0)]
    rows += [(60 + i, prose(150) + " " + passage + " " + prose(150), "en", "s", 0) for i in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen.append({row.doc_id: row for row in docs.collect()})
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(40)) | {60, 61}
    assert set(seen[0]) == clean | {50, 51, 54, 55} and set(seen[1]) == clean | {50, 51}
    assert set(seen[2]) == clean and set(seen[3]) == clean and set(seen[4]) == clean
    assert passage not in seen[3][60].text and passage not in seen[3][61].text and seen[3][60].n_chars == len(seen[3][60].text)
    assert all(seen[3][i].text == seen[0][i].text for i in range(40))
    pieces = docs.collect()
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in queries.QUERIES} and "pipeline" in names


def test_no_documents_and_further_columns(spark, odd, tmp_path):
    """Empty tables go through all stages; columns named as operators name theirs stay until the last stage."""
    odd.where("false").write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "empty" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []
    r = random.Random(4)
    texts = [" ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnr')}{r.randrange(9)}" for _ in range(80)) for _ in range(12)]
    more = [c for c in odd.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    rows = [(i, t, "en", None, None, *["x"] * len(more)) for i, t in enumerate([*texts, texts[0], texts[0]])] + [(None, None, None, None, None, *[None] * len(more))]
    path = str(tmp_path / "more")
    spark.createDataFrame(rows, odd.schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, path).write.parquet(f"{path}/stage{i}")
        docs = spark.read.parquet(f"{path}/stage{i}")
        assert docs.columns == odd.columns
    assert sorted(x.doc_id for x in docs.collect()) == list(range(12))


def test_tables_of_a_stage_go_with_the_next(spark, tmp_path):
    """Only what a result may still read stays on disk: working tables until the next stage begins, results until the next is written."""
    r = random.Random(6)
    rows = [(i, " ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(99)}" for _ in range(80)), "en", "s", 0) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder = Path(shared_dir(spark).removeprefix("file:"), spark.sparkContext.applicationId)
    tables = lambda: {p.name for p in folder.glob("*")} - old
    old = set()
    corpus_pipeline.run(spark, str(tmp_path))  # also what other tests' stages have left goes
    old = tables()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 12
    assert [x.split("-")[0] for x in tables()] == ["stage4"]

    old = {p.name for p in folder.glob("*")}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    judged = corpus_pipeline.judge_quality(spark, docs, str(tmp_path))
    left = tables()
    assert any(x.startswith("quality") for x in left)
    unwritten = corpus_pipeline.drop_near_copies(spark, judged, str(tmp_path))  # reads the tables that judged reads
    assert any(x.startswith("quality") for x in tables())
    unwritten.write.parquet(str(tmp_path / "unwritten"))
    assert spark.read.parquet(str(tmp_path / "unwritten")).count() == 12
    corpus_pipeline.drop_passages(spark, spark.read.parquet(str(tmp_path / "unwritten")), str(tmp_path))
    assert not any(x.startswith("quality") for x in tables())
