"""Detection rules compiled to Spark SQL."""

from .compiler import Compiler
from .config import EngineConfig, ExecutionStrategy, RuleComplexity
from .engine import DetectionEngine, EngineBuilder
from .ir import CompiledRuleset, FieldMapping, Primitive

__all__ = ["Compiler", "CompiledRuleset", "DetectionEngine", "EngineBuilder", "EngineConfig", "ExecutionStrategy", "FieldMapping", "Primitive", "RuleComplexity"]
