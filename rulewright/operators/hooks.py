"""Hooks that see primitives while they are compiled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from ..ir import CompiledRuleset, Primitive


class Phase(Enum):
    PRE_COMPILATION = 1
    PRIMITIVE_DISCOVERY = 2
    POST_COMPILATION = 3


#: The share of events that a match type is assumed to let through.
SELECTIVITY = {"equals": 0.1, "contains": 0.3, "startswith": 0.2, "endswith": 0.2, "regex": 0.5}


def selectivity_hint(match_type: str) -> float:
    return SELECTIVITY.get(match_type, 0.5)


@dataclass(frozen=True)
class CompilationContext:
    """What a hook is told; outside of discovery primitive is None, and the rule is the ruleset's first one.

    A primitive that several rules share is shown once, with the rule that it came with.
    """

    phase: Phase
    primitive_id: int | None = None
    primitive: Primitive | None = None
    selectivity: float = 0.5
    rule_id: int | None = None
    rule_name: str | None = None
    raw_field: str = ""
    rule_count: int = 0
    primitive_count: int = 0

    @property
    def is_summary(self) -> bool:
        return self.primitive is None

    @property
    def normalized_field(self) -> str:
        return self.primitive.field if self.primitive else ""

    @property
    def match_type(self) -> str:
        return self.primitive.match_type if self.primitive else ""

    @property
    def literal_values(self) -> tuple[str, ...]:
        return self.primitive.values if self.primitive else ()

    @property
    def literal_value_count(self) -> int:
        return len(self.literal_values)

    @property
    def modifiers(self) -> tuple[str, ...]:
        return self.primitive.modifiers if self.primitive else ()

    @property
    def has_modifiers(self) -> bool:
        return bool(self.modifiers)

    def description(self) -> str:
        """A line for logs."""
        rule = f"rule {self.rule_id}" + (f" ({self.rule_name})" if self.rule_name else "")
        if self.primitive is None:
            return f"{self.phase.name.lower()}: {self.rule_count} rules, {self.primitive_count} primitives"
        kind = "literals" if self.literal_only else "patterns"
        return f"{self.normalized_field} {self.match_type}, {self.literal_value_count} {kind} of {rule}, expected to pass {self.selectivity:.0%}"

    @property
    def literal_only(self) -> bool:
        return self.primitive is not None and not any(set(v) & set("*?[^") for v in self.primitive.values)


Hook = Callable[[CompilationContext], None]


def run_hooks(hooks: dict[Phase, list[Hook]], ruleset: CompiledRuleset) -> None:
    """Before, then once for each primitive, then after; an exception of a hook ends compilation."""
    first = ruleset.rules[0].rule_id if ruleset.rules else None

    def tell(phase: Phase, rule_id: int | None, **more) -> None:
        for hook in hooks.get(phase, []):
            hook(CompilationContext(phase, rule_id=rule_id, rule_name=ruleset.titles.get(rule_id), rule_count=len(ruleset.rules), primitive_count=len(ruleset.primitives), **more))

    tell(Phase.PRE_COMPILATION, first)
    for i, p in enumerate(ruleset.primitives):
        rule_id, written = ruleset.origins[i] if i < len(ruleset.origins) else (first, p.field)
        tell(Phase.PRIMITIVE_DISCOVERY, rule_id, primitive_id=i, primitive=p, selectivity=selectivity_hint(p.match_type), raw_field=written)
    tell(Phase.POST_COMPILATION, first)


def literal_hook(sink: Callable[[str, float], None]) -> Hook:
    """Gives sink each value of literal-only primitives and its selectivity."""
    return lambda c: [sink(v, c.selectivity) for v in c.primitive.values] and None if c.literal_only else None


def value_hook(sink: Callable[[str, str, bool], None]) -> Hook:
    """Gives sink (field, value, literal) of every value."""
    return lambda c: [sink(c.primitive.field, v, c.literal_only) for v in c.primitive.values] and None if c.primitive else None
