import math
import re
from collections import Counter

from pyspark.sql import functions as F

from rulewright.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    n, covered = len(w), set()
    windows = Counter(tuple(w[k : k + 8]) for k in range(n - 7))
    for k in range(n - 7):
        if windows[tuple(w[k : k + 8])] > 1:
            covered |= set(range(k, k + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, docs, corpus, odd):
    extra = [(200, "a b c d e f g h\n" * 5 + "x\n\n \nx"), (201, "#$ %& *|<> é\x0b\x0c\r z"), (202, "a b c d e f g h i a b c d e f g h")]
    df = docs.union(spark.createDataFrame(extra, docs.schema))
    rows = {r.doc_id: r for r in quality.with_counts(df).collect()}
    for i, text in corpus + extra:
        r = rows[i]
        want = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert len(quality.with_counts(odd).collect()) == 5


def cdf(x, n, p):
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))


def test_binomial_bound(spark):
    rows = [(x, n) for n in (0, 1, 20, 400, 3000) for x in (0, 1, 3, 7) if x <= n]
    df = spark.createDataFrame(rows, "x long, n long").select("x", "n", quality.at_most(F.col("x"), F.col("n"), 0.01).alias("p"))
    for r in df.collect():
        want = cdf(r.x, r.n, 0.01) if r.n and r.x < r.n * 0.01 else 1.0
        assert abs(r.p - want) < 1e-9, r


def test_cutoffs_are_the_certified_ones(spark):
    """5000 good documents of one stratum with symbols in 1 in 2000 of them, and bad ones full of symbols."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_capitals long, n_lines long, base_failed boolean"
    good = [(i, 300, 1500, 250 if i % 2000 == 0 else i % 7, 0, 0, 5, 10, False) for i in range(5000)]
    bad = [(10_000 + i, 300, 1500, 200, 0, 0, 5, 10, False) for i in range(100)]
    counted = spark.createDataFrame(good + bad, schema)
    labels = spark.createDataFrame([(r[0], int(r[0] < 10_000)) for r in good + bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.learn_cutoffs(counted, labels, risk=0.01, error=0.05).collect()
    assert [r.stratum for r in rows] == [3] and set(rows[0].cutoffs) == {"symbols"}
    cutoff, level = rows[0].cutoffs["symbols"], 0.05 / (len(quality.RULES) * 6)
    rejected = sum(r[3] / r[1] > cutoff for r in good)
    assert cdf(rejected, 5000, 0.01 / len(quality.RULES)) <= level and rejected == 3
    kept = {r.doc_id: r.kept for r in quality.judge(counted, quality.learn_cutoffs(counted, labels)).collect()}
    assert not any(kept[r[0]] for r in bad) and sum(kept[r[0]] for r in good) == 4997


def test_bands_are_merged_until_labels_certify():
    need = quality.labels_needed(4, 1)
    assert cdf(0, need, 0.0025) <= 0.05 / 4 < cdf(0, need - 1, 0.0025)
    assert quality.arrange([59, 312, 847, 988, 691, 405]) == ([0] * 6, 4)
    assert quality.arrange([2500] * 6) == ([0, 1, 2, 3, 4, 5], 4)
    assert quality.arrange([100, 100, 5000, 0, 0, 2500]) == ([0, 0, 0, 1, 1, 1], 4)
    assert quality.arrange([0, 298, 0, 0, 0, 0])[1] == 0 and quality.arrange([0, 299, 0, 0, 0, 0]) == ([0] * 6, 1)


def test_few_labels_in_every_band_still_certify(spark):
    """No band has 2467 good documents; together they certify symbols at 3302 labels of all rules, at 333 of one rule."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_capitals long, n_lines long, base_failed boolean"
    for sizes in ([59, 312, 847, 988, 691, 405], [0, 50, 90, 100, 60, 33]):
        words = [n for n, k in zip((30, 70, 150, 300, 500, 900), sizes, strict=True) for _ in range(k)]
        good = [(i, n, 5 * n, 0, 0, 0, 5 if n > 50 else 0, 10, False) for i, n in enumerate(words)]
        bad = [(10_000 + i, n, 5 * n, n, 0, 0, 0, 10, False) for i, n in enumerate((30, 70, 150, 300, 500, 900))]
        counted = spark.createDataFrame(good + bad, schema)
        labels = spark.createDataFrame([(r[0], int(r[0] < 10_000)) for r in good + bad], "doc_id long, quality int")
        rows = quality.learn_cutoffs(counted, labels).collect()
        assert sorted(r.stratum for r in rows) == [i for i, k in enumerate(sizes) if k] and all(set(r.cutoffs) == {"symbols"} for r in rows)
        kept = {r.doc_id for r in quality.judge(counted, quality.learn_cutoffs(counted, labels)).where("kept").collect()}
        assert kept == set(range(len(good))) | ({10_000} if not sizes[0] else set())


def test_too_few_labels_reject_nothing(docs, spark, none):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    counted = quality.with_counts(docs)
    assert quality.learn_cutoffs(counted, labels).collect() == []
    kept = {r.doc_id for r in quality.filter_quality(docs, labels).collect()}
    assert kept == {r.doc_id for r in counted.where("NOT base_failed").collect()}
    assert quality.filter_quality(none, labels.where("false")).collect() == []


def test_many_false_rejections_are_bounded_from_above(spark):
    """Beyond the terms that are summed: never less than the exact probability, and close to it where it matters."""
    cases = [(1001, 120_000, 0.01), (1500, 170_000, 0.01), (5000, 540_000, 0.01), (40_000, 4_100_000, 0.01), (1999, 200_000, 0.01)]

    def exact(x, n, p):
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(max(0, x - 5000), x + 1)]
        return sum(math.exp(v) for v in logs)

    for x, n, p in cases:
        (got,) = spark.range(1).select(quality.at_most(F.lit(x).cast("long"), F.lit(n).cast("long"), p)).first()
        want = exact(x, n, p)
        assert want * (1 - 1e-6) <= got and (want > 0.02 or got <= 1.5 * want)
    (seam,) = spark.range(1).select(quality.at_most(F.lit(1000).cast("long"), F.lit(120_000).cast("long"), 0.01)).first()
    assert abs(seam / exact(1000, 120_000, 0.01) - 1) < 1e-6
