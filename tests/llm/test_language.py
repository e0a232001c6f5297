import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.llm import language

LETTERS = {"aa": "abcde", "bb": "edcfg", "cc": "çéabx"}


def text(lang, seed, words):
    r = random.Random(f"{lang}{seed}")
    stems = ["".join(random.Random(f"{lang}{i}").choices(LETTERS[lang], k=3)) for i in range(12)]
    return " ".join("".join(r.choices(stems, k=r.randint(1, 3))) for _ in range(words))


def brute_phrases(data, training):
    """Greedy longest matches over the whole text."""
    n = i = 0
    while i < len(data):
        k = 1
        while i + k < len(data) and data[i : i + k + 1] in training:
            k += 1
        i += k
        n += 1
    return n


@pytest.mark.parametrize("step", [3, 8192])
def test_phrases_are_longest_matches(step):
    training = (text("aa", 1, 200) + "\n" + text("aa", 2, 300)).encode()
    assert len(training) > 3000
    texts = [x.encode() for x in ("", "a", "ZZZ", "ABC abc", text("aa", 3, 400), text("cc", 3, 300), "a" * 1500, "\x00é", text("aa", 1, 200), "x" + text("aa", 2, 300) + text("aa", 4, 900))]
    texts += [training, b"Z" + training[5:2500] + training, training * 2]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = language.count_phrases(raw, offsets, language.suffix_automaton(training), step).tolist()
    assert got == [brute_phrases(t.lower() if t.isascii() else t, training) for t in texts]


def test_samples_are_whole_texts(spark):
    rows = [(i, "abc " * (1 + i * 40), "aa") for i in range(30)] + [(100 + i, "x" * 3000, "bb") for i in range(3)] + [(200, "y" * 9000, "cc")]
    sample = language.sample_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=4000)
    texts = {t for _, t, _ in rows}
    assert all(t in texts for t in sample["aa"].decode().split("\n")) and 900 < len(sample["aa"]) <= 4000
    assert sample["bb"] == b"x" * 3000 and sample["cc"] == b"y" * 4000


def test_held_out_accuracy(spark):
    rows = [(i, text(lang, i, 5 + i % 60), lang) for i, lang in enumerate(list(LETTERS) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sample = language.sample_languages(df.where("doc_id % 4 <> 2"), rows=20, sample_bytes=4000)
    assert set(sample) == set(LETTERS) and all(0 < len(v) <= 4000 for v in sample.values())
    held = language.identify(df.where("doc_id % 4 = 2"), sample).collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in held)


def test_undetermined(docs, odd, none, spark):
    rows = {r.doc_id: r for r in language.identify(docs, {"aa": b"abc abc"}).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (70, 71, 72, 80)) and rows[76].lang_pred == "aa"
    assert {r.lang_pred for r in language.identify(odd.where("text IS NOT NULL"), {}).collect()} == {"und"}
    assert language.filter_language(odd).collect() == [] and language.filter_language(none).collect() == []
    df = spark.createDataFrame([(1, "abc", "aa"), (2, None, "aa"), (3, "1 2", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in language.filter_language(df).collect()] == [1]
    assert language.identify(odd.withColumn("score", F.lit(1)), {"aa": b"x"}).columns[-2:] == ["lang_pred", "score"]


def test_unlearned_and_random_texts_are_rejected(spark):
    letters = random.Random(3)
    learned = [(i, text(lang, i, 120), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    unlearned = [(1000 + i, "".join(letters.choice("qwxyzjkvu ") for _ in range(800)), None) for i in range(10)]
    unlearned += [(1100 + i, text("cc", i, 150), None) for i in range(10)]
    df = spark.createDataFrame(learned + unlearned, "doc_id long, text string, lang string")
    assert {r.doc_id for r in language.filter_language(df).collect()} == set(range(80))
