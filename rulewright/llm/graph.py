"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Rows of (id, root) up to which they are broadcast (4 MB); more are joined by a shuffle.
SMALL = 250_000


def small(roots: DataFrame) -> DataFrame:
    """A table of components as the side of a join: broadcast if it is known to have few rows."""
    return F.broadcast(roots) if roots.__dict__.get("_rulewright_small") else roots


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root long) of every end of edges (a, b long): the least id of its component.

    Rounds of two joins: every id takes the least root among its neighbours' and its own, then the root of that root,
    until none changes. A round's table is written, so a lost executor costs a round at most; it goes when the next one is there.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).toDF("id", "to").distinct()
    both = materialize(both, f"{name}-edges")
    roots = table = materialize(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("root")), name)
    few = table.count() <= SMALL
    side = F.broadcast if few else (lambda df: df)
    while True:
        near = both.join(side(roots.toDF("to", "r")), "to").groupBy("id").agg(F.min("r").alias("near"))
        least = roots.join(side(near), "id", "left").select("id", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        # hook: a root takes what its members have found, then everyone jumps to the root of its root
        found = least.groupBy(F.col("was").alias("old")).agg(F.min("root").alias("new"))
        hooked = least.join(side(found), F.col("was") == F.col("old"), "left").select("id", "was", F.least("root", F.coalesce("new", "root")).alias("root"))
        hooked = materialize(hooked, name)
        discard(table)
        jump = hooked.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = hooked.join(side(jump), "root", "left").select("id", "was", F.least("root", F.coalesce("next", "root")).alias("root"))
        table = materialize(after, name)
        discard(hooked)
        roots = table.select("id", "root")
        roots._rulewright_paths, roots._rulewright_small = table._rulewright_paths, few
        if table.where("was <> root").isEmpty():
            discard(both)
            return roots
