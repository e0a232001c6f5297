"""Compiled rules: primitives, selections and conditions."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Primitive:
    """One predicate: a field, how it is matched, the values of which any may match, and modifiers in order."""

    field: str
    match_type: str
    values: tuple[str, ...]
    modifiers: tuple[str, ...] = ()

    @property
    def is_literal_only(self) -> bool:
        """No value has a wildcard."""
        return not any("*" in v or "?" in v for v in self.values)

    @property
    def value_count(self) -> int:
        return len(self.values)

    @property
    def has_modifiers(self) -> bool:
        return bool(self.modifiers)

    def field_path_string(self) -> str:
        """The field's path as written; a dot steps into an object."""
        return self.field

    def matches(self, text: str | None) -> bool:
        """Whether a text matches, for literal match types without modifiers: a check of single values on the driver."""
        tests = {"equals": str.__eq__, "exact": str.__eq__, "contains": str.__contains__, "startswith": str.startswith, "endswith": str.endswith}
        if self.match_type not in tests or self.modifiers:
            raise ValueError("evaluate this one with an engine")
        return text is not None and any(tests[self.match_type](text, v) for v in self.values)

    def memory_usage(self) -> int:
        """Bytes of its strings, about."""
        return len(self.field) + len(self.match_type) + sum(map(len, self.values)) + sum(map(len, self.modifiers)) + 24 * (2 + len(self.values) + len(self.modifiers))


@dataclass
class CompiledRule:
    """A rule's id, its selections (names to primitive ids, all of which must hold) and its condition as written."""

    rule_id: int
    selections: dict[str, list[int]]
    condition: str


@dataclass
class CompiledRuleset:
    """All rules; a primitive that several rules use is kept once."""

    primitives: list[Primitive] = field(default_factory=list)
    rules: list[CompiledRule] = field(default_factory=list)
    #: Of each primitive the rule that it came with and its field's name there; of each rule its title.
    origins: list[tuple[int, str]] = field(default_factory=list)
    titles: dict[int, str] = field(default_factory=dict)

    @property
    def primitive_count(self) -> int:
        return len(self.primitives)

    def get_primitive(self, primitive_id: int) -> Primitive | None:
        return self.primitives[primitive_id] if 0 <= primitive_id < len(self.primitives) else None

    def to_df(self, spark):
        """(primitive_id, field, match_type, values, modifiers)."""
        rows = [(i, p.field, p.match_type, list(p.values), list(p.modifiers)) for i, p in enumerate(self.primitives)]
        return spark.createDataFrame(rows, "primitive_id int, field string, match_type string, values array<string>, modifiers array<string>")


class FieldMapping:
    """Names of a taxonomy's fields in the events; a field that isn't mapped keeps its name."""

    def __init__(self, taxonomy: str = "sigma", mappings: dict[str, str] | None = None):
        self.taxonomy = taxonomy
        self.mappings = dict(mappings or {})

    def load(self, mappings: dict[str, str]) -> None:
        self.mappings.update(mappings)

    def add(self, source: str, target: str) -> None:
        self.mappings[source] = target

    def has(self, name: str) -> bool:
        return name in self.mappings

    def normalize(self, name: str) -> str:
        return self.mappings.get(name, name)
