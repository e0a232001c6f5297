"""Patterns of a ruleset for filters outside of the engine."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ir import Primitive
from .hooks import CompilationContext, Hook, selectivity_hint


def adjusted(selectivity: float, modifiers: int) -> float:
    """A hint with the allowance that a compilation hook makes for modifiers, 1 at most."""
    return min(1.0, selectivity * 1.2 * (1 + 0.1 * modifiers) if modifiers else selectivity * 1.2)


class FilterIntegration:
    """Values by kind of filter, each kept once, in order of arrival; a value's last selectivity counts."""

    KINDS = ("aho_corasick", "fst", "filter", "regex", "bloom", "xor", "zero_copy")

    def __init__(self):
        self.values: dict[str, dict[str, float]] = {k: {} for k in self.KINDS}
        self.frequency: Counter[str] = Counter()
        self.fields: dict[str, dict[str, None]] = {}

    def add(self, kind: str, value: str, selectivity: float = 0.5, field: str | None = None) -> None:
        self.values[kind][value] = selectivity
        if kind in ("aho_corasick", "bloom", "xor", "zero_copy"):
            self.frequency[value] += 1
        if field is not None:
            self.fields.setdefault(field, {})[value] = None

    def _route(self, p: Primitive, s: float, literal: bool) -> None:
        for v in p.values:
            if p.match_type == "regex":
                self.add("regex", v, s, p.field)
            elif p.match_type not in ("equals", "contains", "startswith", "endswith"):
                self.add("filter", v, s, p.field)
            else:
                if literal:
                    self.add("aho_corasick", v, s, p.field)
                if s < 0.3:
                    self.add("fst", v, s, p.field)
                if s <= 0.1 and p.match_type == "equals":
                    self.add("xor", v, s, p.field)
                if s < 0.5:
                    self.add("bloom", v, s, p.field)
                if s <= 0.1:
                    self.add("filter", v, s, p.field)

    def extract(self, primitives: list[Primitive]) -> None:
        for p in primitives:
            self._route(p, selectivity_hint(p.match_type), p.is_literal_only)

    def hook(self) -> Hook:
        """The same while compiling, for literal primitives."""

        def see(c: CompilationContext) -> None:
            if c.literal_only:
                self._route(c.primitive, adjusted(c.selectivity, len(c.primitive.modifiers)), True)

        return see

    def aho_corasick_patterns(self) -> list[tuple[str, float]]:
        """By frequency, most first, then selectivity."""
        return sorted(self.values["aho_corasick"].items(), key=lambda x: (-self.frequency[x[0]], x[1]))

    def fst_values(self) -> list[str]:
        return sorted(self.values["fst"])

    def selective_patterns(self, most: float) -> list[str]:
        return [v for v, s in self.values["filter"].items() if s <= most]

    def regex_patterns(self) -> list[str]:
        return list(self.values["regex"])

    def bloom_values(self) -> list[str]:
        return list(self.values["bloom"])

    def xor_values(self) -> list[str]:
        return list(self.values["xor"])

    def zero_copy_patterns(self) -> list[str]:
        return list(self.values["zero_copy"])

    def distribution(self) -> dict[str, int]:
        """Values by tenths of selectivity, of the kind that each value has last."""
        last: dict[str, float] = {}
        for kind in self.values.values():
            last |= kind
        return dict(sorted(Counter(f"{min(9, int(s * 10)) / 10:.1f}" for s in last.values()).items()))

    def field_patterns(self, field: str) -> list[str]:
        return list(self.fields.get(field, {}))

    def statistics(self) -> dict[str, float | int | str | None | dict[str, int]]:
        """Numbers of values by kind, of fields, the average selectivity of values, the field with the most, and the distribution."""
        last: dict[str, float] = {}
        for kind in self.values.values():
            last |= kind
        every = list(last.values())
        most = max(self.fields, key=lambda f: len(self.fields[f]), default=None)
        return {k: len(v) for k, v in self.values.items()} | {"average_selectivity": sum(every) / len(every) if every else 0.5, "most_frequent_field": most, "unique_fields": len(self.fields), "distribution": self.distribution()}


def pattern_frequency(primitives: DataFrame) -> DataFrame:
    """(value, freq, sel) of literal values in a table of primitives: how many primitives have each, and the least hint."""
    hint = F.when(F.col("match_type") == "equals", 0.1).when(F.col("match_type") == "contains", 0.3).when(F.col("match_type").isin("startswith", "endswith"), 0.2)
    literal = primitives.withColumn("sel", hint).where("sel IS NOT NULL")
    return literal.select(F.explode("values").alias("value"), "sel").groupBy("value").agg(F.count(F.lit(1)).alias("freq"), F.min("sel").alias("sel"))
