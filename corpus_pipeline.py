"""The corpus pipeline: language ID, quality rules, near duplicates, repeated passages, packing.

Every stage gets all that the one before has kept, as (doc_id, text, lang, source, n_chars); the last returns pieces in
sequences. ``run`` writes each stage's result in the shared folder and reads it again for the next. Whoever calls the stages has to
write each result, too, before the next call: it deletes the tables that the stage before worked with.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import discard, leaving, materialize, release, settle
from rulewright.llm.language import filter_language
from rulewright.llm.packing import pack_documents
from rulewright.llm.passages import remove_repeats
from rulewright.llm.quality import filter_quality
from rulewright.llm.setjoin import keep_one

#: Tables that stages have left to their results.
_LEFT: list[str] = []


def stage(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """work (spark, docs, sf_dir) as a stage: the tables that stages before it left go first, but for those that docs still reads."""

    @functools.wraps(work)
    def run_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _LEFT, docs)
        settle(spark)
        with leaving(_LEFT):
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def tell_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told; languages are learned from the lang column of what came in."""
    return filter_language(docs)


@stage
def judge_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or a certified cutoff, learned from labels."""
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 percent of their 5-word shingles, directly or not, the one of the least doc_id stays."""
    return keep_one(docs, width=5, percent=80)


@stage
def drop_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated 400-byte strings out of the texts; n_chars follows."""
    cut = remove_repeats(docs, width=400)
    return cut.select(*[F.char_length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


@stage
def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", tell_language),
    ("quality rules", judge_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_passages),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None  # models and suffix sorting have no SQL form; tests/llm holds the stages against brute force


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, work) in enumerate(STAGES):
        made = materialize(work(spark, docs, sf_dir), f"stage{i}")
        if i:
            discard(docs)
        docs = made
    release(spark, _LEFT)
    return docs
