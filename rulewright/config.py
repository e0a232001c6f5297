"""Engine settings."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum


class ExecutionStrategy(Enum):
    DEVELOPMENT = "development"
    PRODUCTION = "production"
    ADAPTIVE = "adaptive"


class RuleComplexity(Enum):
    SIMPLE = "simple"
    MEDIUM = "medium"
    COMPLEX = "complex"

    @classmethod
    def analyze(cls, operations: int, depth: int, primitives: int) -> RuleComplexity:
        if operations <= 3 and depth <= 2:
            return cls.SIMPLE
        return cls.COMPLEX if operations > 8 or depth > 4 or primitives > 10 else cls.MEDIUM

    def recommended_strategy(self) -> ExecutionStrategy:
        return ExecutionStrategy.PRODUCTION if self is RuleComplexity.SIMPLE else ExecutionStrategy.ADAPTIVE


@dataclass(frozen=True)
class EngineConfig:
    """batch_size: rows of an Arrow batch where Python runs. max_memory_bytes bounds the rules' own size at compile time.

    semantics: documented (modifiers apply, patterns and counts work, matching minds case), registry (folds ASCII case, modifiers
    ignored) or engine (as registry, minds case, unknown match types are equality). strict: rules that can't be lowered are
    errors; otherwise they are left out and listed in ``dropped``. prefilter: sound, reference (any rule's literals
    decide for all rules) or off. plan: inline, staged, array or auto.
    """

    batch_size: int = 100
    execution_strategy: ExecutionStrategy = ExecutionStrategy.ADAPTIVE
    enable_parallel_processing: bool = True
    enable_prefilter: bool = True
    max_memory_bytes: int = 512 << 20
    semantics: str = "documented"
    strict: bool = False
    prefilter: str = "sound"
    plan: str = "auto"
    reject_dangerous: bool = True

    def __post_init__(self):
        for key, allowed in (("semantics", ("documented", "registry", "engine")), ("prefilter", ("sound", "reference", "off")), ("plan", ("auto", "inline", "staged", "array"))):
            if getattr(self, key) not in allowed:
                raise ValueError(f"{key} is one of {', '.join(allowed)}")

    @classmethod
    def production(cls) -> EngineConfig:
        return cls(1000, ExecutionStrategy.PRODUCTION, True, True, 1 << 30)

    @classmethod
    def development(cls) -> EngineConfig:
        return cls(10, ExecutionStrategy.DEVELOPMENT, False, False, 64 << 20, strict=True)

    def with_(self, **changes) -> EngineConfig:
        """A copy with some settings changed."""
        return replace(self, **changes)
