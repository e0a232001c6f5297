"""Quality rules whose cutoffs carry a guarantee on good documents, from labelled holdouts.

Every rule is a metric of a document, worse when higher, and a fixed grid of cutoffs. Neighbouring bands of document
lengths are merged to strata, and rules taken in their fixed order, as far as the numbers of good labels can certify
(``arrange``). In each stratum, cutoffs are tested from the loosest to the tightest: the hypothesis "this cutoff
rejects more than ``risk / rules`` of good documents" is refuted when the exact binomial probability of as few false
rejections as the labelled holdout shows is at most ``error / (rules * strata)`` (Bonferroni over what is tested); the
first that isn't refuted ends the sequence, so the grid costs no further correction. Strata and rules depend on the
numbers of good labels only, not on their metrics, so with probability 1 - error every refuted hypothesis is indeed
false, and a stratum's rules together reject at most a ``risk`` part of its good documents. Among the certified
cutoffs of a rule the one is used that rejects the largest part of bad documents less that of good ones; a rule
without one never rejects. Everything but the arrangement of six numbers is DataFrame and SQL expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The rules' metrics over the columns of ``with_counts``, with their grids of cutoffs in ascending order. With few labels the first rules only are tested.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [round(0.02 * 1.2**k, 6) for k in range(32)]),
    "repeats": ("n_repeat_words / n_words", [round(k / 100, 2) for k in range(1, 31)]),
    "capitals": ("n_capitals / word_chars", [round(0.02 * k, 2) for k in range(2, 46)]),
    "duplicate_lines": ("n_dup_lines / n_lines", [round(0.02 * k, 2) for k in range(1, 46)]),
}
#: Upper ends of the length bands, in words; the last band is open.
BANDS = [50, 100, 200, 400, 800]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column, width: int) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows of ``width`` words in order."""

    def repeated(s: Column) -> Column:
        same = lambda x, i: F.element_at(s, i).h == x.h
        return F.filter(s, lambda x, i: ((i > 0) & same(x, F.greatest(i, F.lit(1)))) | ((i < F.size(s) - 1) & same(x, F.least(i + 2, F.size(s)))))

    def cover(places: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a.n + i + width - F.greatest(a.end, i)).alias("n"), (i + width).alias("end"))
        return F.aggregate(places, zero, step, lambda a: a.n)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return cover(F.sort_array(F.transform(_let(pairs, repeated), lambda x: x.i)))


def _word_counts(text: Column, width: int) -> Column:
    """struct(n_words, n_repeat_words)."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")

    def count(w: Column) -> Column:
        def windows(h: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(F.slice(h, i, width)))

        def repeats(h: Column) -> Column:
            found = _let(windows(h), lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), _covered(x, width)).otherwise(0))
            return F.when(F.size(h) > width, found).otherwise(0)

        n = _let(F.transform(w, lambda x: F.xxhash64(x)), repeats)
        return F.struct(F.size(w).cast("long").alias("n_words"), n.cast("long").alias("n_repeat_words"))

    return _let(words, count)


def with_counts(df: DataFrame, text_col: str = "text", width: int = 8) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_lines (long) and base_failed.

    A null text counts as empty, which has no words and fails the base rules. Columns of those names are replaced.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    without = lambda x, chars: F.char_length(x) - F.char_length(F.translate(x, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    made = {
        "n_words": F.col("__w.n_words"),
        "word_chars": F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": without(text, "#*$%&|<>").cast("long"),
        "n_dup_lines": F.col("__l.dup"),
        "n_repeat_words": F.col("__w.n_repeat_words"),
        "n_capitals": without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
        "n_lines": F.col("__l.n"),
    }
    kept = [c for c in df.columns if c not in (*made, "base_failed")]
    out = df.select("*", _word_counts(text, width).alias("__w"), line_counts.alias("__l")).select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in made.items()])
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def stratum() -> Column:
    """The number of the length band, from n_words."""
    return sum(((F.col("n_words") >= b).cast("int") for b in BANDS), F.lit(0))


#: Successes up to which a binomial probability is summed; beyond, it is bounded from above.
SUMMED = 1000


def at_most(x: Column, n: Column, risk: float) -> Column:
    """Exact binomial probability of x successes or fewer among n at rate risk; 1 where x / n isn't below risk.

    Beyond SUMMED successes an upper bound of it, so that a bound never certifies what the exact probability wouldn't: the last
    term, its factorials bounded by Stirling's series, times the geometric series of the greatest ratio of terms.
    """

    def step(s: Column, k: Column) -> Column:
        def add(term: Column) -> Column:
            top = F.greatest(s.sum, term)
            return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(s.sum, term) - top))).alias("sum"))

        return _let(s.term + F.log((n - k + 1) / k.cast("double")) + math.log(risk / (1 - risk)), add)

    first = n * math.log1p(-risk)
    ks = F.when((x >= 1) & (x <= SUMMED), F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<long>"))
    summed = F.aggregate(ks, F.struct(first.alias("term"), first.alias("sum")), step, lambda s: s.sum)

    def factorial(k: Column, above: bool) -> Column:
        return k * F.log(k) - k + F.log(2 * math.pi * k) / 2 + 1 / (12 * k + (0 if above else 1))

    k, m = x.cast("double"), n.cast("double")
    last = factorial(m, True) - factorial(k, False) - factorial(m - k, False) + k * math.log(risk) + (m - k) * math.log1p(-risk)
    bound = last - F.log1p(-k * (1 - risk) / ((m - k + 1) * risk))
    log = F.when(x <= SUMMED, summed).otherwise(bound)
    return F.when((n > 0) & (x < n * risk), F.least(F.lit(1.0), F.exp(log))).otherwise(F.lit(1.0))


def labels_needed(rules: int, strata: int, risk: float = 0.01, error: float = 0.05) -> int:
    """The least number of good labels of a stratum that certifies a cutoff without false rejections."""
    return math.ceil(math.log(error / (rules * strata)) / math.log1p(-risk / rules))


def arrange(good: list[int], risk: float = 0.01, error: float = 0.05) -> tuple[list[int], int]:
    """(stratum of each band, number of rules tested) from the good labels of each band.

    The most strata of which each can certify all rules; if not even all bands together can, one stratum and the most
    rules that it can certify, 0 if none.
    """
    for strata in range(len(good), 1, -1):
        need, of, have, at = labels_needed(len(RULES), strata, risk, error), [], 0, 0
        for n in good:
            if have >= need and at < strata - 1:
                have, at = 0, at + 1
            of.append(at)
            have += n
        if at == strata - 1 and have >= need:
            return of, len(RULES)
    return [0] * len(good), max((k for k in range(1, len(RULES) + 1) if sum(good) >= labels_needed(k, 1, risk, error)), default=0)


def learn_cutoffs(counted: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05) -> DataFrame:
    """(stratum, cutoffs map<rule, cutoff>), one row per length band at most, from counted documents and labels (doc_id, quality 0/1).

    Bands of one merged stratum get equal cutoffs; a band without a good label gets none, as nothing was seen of it. Labels of null documents, null labels and labels of documents that fail the base rules are left out; of several
    labels of one document the highest counts. No labels give no rows.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("__good"))
    grid = lambda name: F.array(*[F.lit(float(c)) for c in RULES[name][1]])
    passed = lambda name: F.size(F.filter(grid(name), lambda c: c < F.expr(RULES[name][0].replace(" / ", " * 1D / "))))
    per_rule = F.array(*[F.struct(F.lit(name).alias("rule"), passed(name).alias("over")) for name in RULES])
    seen = counted.where("NOT base_failed").select("doc_id", stratum().alias("stratum"), per_rule.alias("r")).join(marks, "doc_id")
    seen = seen.select("stratum", "__good", F.explode("r").alias("r")).groupBy("stratum", "r.rule", "r.over")
    seen = seen.agg(F.sum("__good").cast("long").alias("good"), F.sum(1 - F.col("__good")).cast("long").alias("bad"))
    # over = k: the metric exceeds the k lowest cutoffs. From here on rows are bands x rules x cutoffs.
    seen = materialize(seen, "bins")
    counts = dict(seen.where(F.col("rule") == next(iter(RULES))).groupBy("stratum").agg(F.sum("good")).where("stratum IS NOT NULL").collect())
    bands, rules = arrange([counts.get(i, 0) for i in range(len(BANDS) + 1)], risk, error)
    covered = F.array(*[F.struct(F.lit(i).alias("stratum"), F.lit(m).alias("merged"), F.lit(bool(counts.get(i))).alias("seen")) for i, m in enumerate(bands)])
    merged = F.element_at(F.array(*map(F.lit, bands)), F.col("stratum") + 1)
    seen = seen.withColumn("merged", merged).where(F.col("rule").isin(list(RULES)[:rules]))
    spread = F.create_map(*[x for name, (_, cuts) in RULES.items() for x in (F.lit(name), F.array(*[F.lit(float(c)) for c in cuts]))])
    group = seen.groupBy("merged", "rule").agg(F.collect_list(F.struct("over", "good", "bad")).alias("bins"))
    group = group.select("*", F.posexplode(F.element_at(spread, F.col("rule"))).alias("at", "cutoff"))
    total = lambda name, some: F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + F.when(some(b), b[name]).otherwise(0))
    every, beyond = (lambda b: F.lit(True)), (lambda b: b["over"] > F.col("at"))
    group = group.select("merged", "rule", "cutoff", *[total(k, f).alias(f"{n}_{k}") for k in ("good", "bad") for n, f in (("all", every), ("out", beyond))])
    level = error / (max(1, rules) * (max(bands) + 1))
    looser = Window.partitionBy("merged", "rule").orderBy(F.desc("cutoff"))
    tested = group.withColumn("p", at_most(F.col("out_good"), F.col("all_good"), risk / max(1, rules))).withColumn("held", F.max(F.col("p") > level).over(looser))
    gain = F.col("out_bad") / F.greatest(F.col("all_bad"), F.lit(1)) - F.col("out_good") / F.greatest(F.col("all_good"), F.lit(1))
    best = tested.where("NOT held").groupBy("merged", "rule").agg(F.max(F.struct(gain.alias("gain"), "cutoff")).alias("best"))
    found = best.where("best.gain > 0").groupBy("merged").agg(F.map_from_entries(F.collect_list(F.struct("rule", "best.cutoff"))).alias("cutoffs"))
    return found.select("cutoffs", F.explode(F.filter(covered, lambda x: x.seen & (x.merged == F.col("merged")))).alias("x")).select("x.stratum", "cutoffs")


def judge(counted: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """counted with kept: false if base_failed or if a metric exceeds its band's cutoff. cutoffs has a row per band at most."""
    out = counted.withColumn("stratum", stratum()).join(F.broadcast(cutoffs), "stratum", "left")
    exceeds = [F.coalesce(F.expr(expr.replace(" / ", " * 1D / nullif(") + ", 0)") > F.element_at("cutoffs", F.lit(name)), F.lit(False)) for name, (expr, _) in RULES.items()]
    broken = F.lit(False)
    for x in exceeds:
        broken = broken | x
    return out.withColumn("kept", ~F.col("base_failed") & ~broken).drop("stratum", "cutoffs")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with docs' columns. Documents and their counts are written once, then learned from and judged."""
    counted = materialize(with_counts(docs.select(F.struct("*").alias("row"), "doc_id", "text")).drop("text"), "quality")
    return judge(counted, learn_cutoffs(counted, labels)).where("kept").select("row.*")


def op6(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document; cutoffs from the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = materialize(with_counts(docs).drop("text"), "quality")
    verdicts = judge(counted, learn_cutoffs(counted, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
