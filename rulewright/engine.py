"""The engine: rules in, matched rule ids out, in one pass without a shuffle."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .compiler import Compiler
from .config import EngineConfig
from .errors import CompilationError, ExecutionError
from .functions import matchers, modifiers
from .functions.matchers import Matcher
from .functions.modifiers import Modifier
from .ir import CompiledRuleset, Primitive
from .operators.hooks import Hook, Phase, literal_hook, run_hooks, value_hook
from .plans import lower as lowering
from .plans.dag import Dag, DagStatistics, choose_plan
from .plans.prefilter import LiteralPrefilter, PrefilterConfig, PrefilterStats, necessary
from .plans.sqltext import any_of, name, sure
from .sources import ColumnSource, CustomSource, JsonSource, StagedSource, VariantSource, number

MATCHED = "matched_rules"


class DetectionEngine:
    """Evaluates a ruleset. Events are rows: columns, or JSON text or a variant in one column."""

    def __init__(
        self, ruleset: CompiledRuleset, config: EngineConfig | None = None, match_functions: dict[str, Matcher] | None = None,
        modifier_functions: dict[str, Modifier] | None = None, extractor: Callable[[str], str | None] | None = None, hooks: dict[Phase, list[Hook]] | None = None,
    ):
        self.ruleset, self.config = ruleset, config or EngineConfig()
        self._matchers, self._modifiers, self._extractor = match_functions or {}, modifier_functions or {}, extractor
        if sum(p.memory_usage() for p in ruleset.primitives) > self.config.max_memory_bytes:
            raise CompilationError("the rules exceed max_memory_bytes")
        run_hooks(hooks or {}, ruleset)
        self.trees, self.dropped = lowering.lower_all(ruleset, self.config.semantics, self.config.strict)
        on = self.config.enable_prefilter and self.config.prefilter != "off"
        self.prefilter = LiteralPrefilter(ruleset.primitives, PrefilterConfig.for_rules() if on else PrefilterConfig.disabled())

    @classmethod
    def from_rules(cls, rules: Iterable[str], config: EngineConfig | None = None, compiler: Compiler | None = None, **more) -> DetectionEngine:
        config = config or EngineConfig()
        return cls((compiler or Compiler(strict=config.strict)).compile_ruleset(rules), config, **more)

    @staticmethod
    def builder() -> EngineBuilder:
        return EngineBuilder()

    # introspection

    @property
    def rule_count(self) -> int:
        """Rules that were lowered."""
        return len(self.trees)

    @property
    def primitive_count(self) -> int:
        return len(self.ruleset.primitives)

    @property
    def dag(self) -> Dag:
        return Dag.build(self.trees)

    @property
    def node_count(self) -> int:
        return len(self.dag.nodes)

    def statistics(self) -> DagStatistics:
        return self.dag.statistics()

    def contains_rule(self, rule_id: int) -> bool:
        return rule_id in self.trees

    @property
    def prefilter_stats(self) -> PrefilterStats:
        return self.prefilter.stats

    # SQL

    def _field(self, p: Primitive, source) -> str:
        """SQL of the field's text after its modifiers, which only documented semantics applies."""
        sql = source.field(p.field)
        if self.config.semantics != "documented":
            return sql
        for m in p.modifiers:
            function = self._modifiers.get(m) or modifiers.documented(m)
            if function:
                sql = f"({function(sql)})"
        return sql

    def predicate(self, primitive_id: int, source) -> str:
        """SQL of a primitive; NULL where its field has no text."""
        p = self.ruleset.primitives[primitive_id]
        match = matchers.matcher(p.match_type, self.config.semantics, self._matchers)
        if match is matchers.number_range and (column := number(source, p.field)) and not (p.modifiers and self.config.semantics == "documented"):
            return matchers.column_range(*column, p.values)
        fold = self.config.semantics == "registry" and "case_sensitive" not in p.modifiers
        staged = getattr(source, "addresses", {})
        if match is matchers.cidr and any(f == p.field for f, _ in staged) and not (p.modifiers and self.config.semantics == "documented"):
            return matchers.in_networks(p.values, lambda part: staged[p.field, part])
        if match is matchers.regex:
            return match(self._field(p, source), p.values, p.modifiers, fold, self.config.reject_dangerous)
        return match(self._field(p, source), p.values, p.modifiers, fold)

    def _source(self, df: DataFrame, json: str | None = None, variant: str | None = None):
        source = JsonSource(json) if json else VariantSource(variant) if variant else ColumnSource(df.schema)
        return CustomSource(self._extractor, source) if self._extractor else source

    def _used(self) -> list[int]:
        return sorted(set().union(*map(lowering.primitives_of, self.trees.values()))) if self.trees else []

    def where(self, source, raw: str | None = None) -> str | None:
        """A filter that events with a match pass, in terms that reach the scan; None if there is none."""
        if not self.config.enable_prefilter or self.config.prefilter == "off":
            return None
        if self.config.prefilter == "reference":
            if not self.prefilter.patterns:
                return None
            fields = dict.fromkeys(p.field for p in self.ruleset.primitives)
            return self.prefilter.matches_raw(raw) if raw else self.prefilter.matches([source.field(f) for f in fields])
        literal = {i for i, p in enumerate(self.ruleset.primitives) if p.match_type in matchers.LITERAL}
        found = [necessary(t, literal) for t in self.trees.values()]
        if not found or any(f is None for f in found):
            return None
        return any_of([self.predicate(i, source) for i in sorted(set().union(*found))])

    def _staged(self, df: DataFrame, source, used: list[int]):
        """df with columns of the texts of fields that take an expression, and of the parts of fields that are compared as addresses; a source of them."""
        primitives = [self.ruleset.primitives[p] for p in used]
        fields = [f for f in dict.fromkeys(p.field for p in primitives) if "(" in source.field(f)]
        columns = {f: f"__f{i}" for i, f in enumerate(fields)}
        if fields:
            half = isinstance(source, JsonSource)
            df = df.selectExpr("*", *[f"{source.raw(f) if half else source.field(f)} AS {columns[f]}" for f in fields])
            if half:  # the text is got once, then looked at
                kept = [name(c) for c in df.columns if c not in columns.values()]
                df = df.selectExpr(*kept, *[f"{source.finished(f, columns[f])} AS {columns[f]}" for f in fields])
        parts: dict[str, dict[str, None]] = {}
        for p in primitives:
            if p.match_type == "cidr" and "cidr" not in self._matchers and not (p.modifiers and self.config.semantics == "documented"):
                parts.setdefault(p.field, {}).update(dict.fromkeys(matchers.address_parts(p.values)))
        staged = StagedSource(source, columns)
        addresses = {(f, k): f"__{k}{i}" for i, (f, need) in enumerate(parts.items()) for k in need}
        digits = {f: i for i, (f, need) in enumerate(parts.items()) if "h" in need}
        if digits:
            df = df.selectExpr("*", *[f"{matchers.address_groups(staged.field(f))} AS __g{i}" for f, i in digits.items()])
            df = df.selectExpr("*", *[f"{matchers.address_digits(f'__g{i}')} AS __d{i}" for i in digits.values()])
        if addresses:
            sql = lambda f, k: matchers.address_number(staged.field(f)) if k == "n" else matchers.address_half(f"__d{digits[f]}", k == "l")
            df = df.selectExpr("*", *[f"{sql(f, k)} AS {column}" for (f, k), column in addresses.items()])
        return df, StagedSource(source, columns, addresses)

    def _evaluate(self, df: DataFrame, source, raw: str | None = None) -> DataFrame:
        plan = self.config.plan if self.config.plan != "auto" else choose_plan(self.trees, self.primitive_count)
        kept = [name(c) for c in df.columns if c != MATCHED]
        used = self._used()
        df, source = self._staged(df, source, used)
        gate = self.where(source, raw) if self.config.prefilter == "reference" else None
        guard = (lambda x: f"IF({gate}, {x}, CAST(array() AS ARRAY<INT>)) AS {MATCHED}") if gate else (lambda x: f"{x} AS {MATCHED}")
        if plan == "inline" or not used:
            return df.selectExpr(*kept, guard(lowering.matched_rules(self.trees, lambda p: sure(self.predicate(p, source)))))
        extra = [f"{gate} AS __gate"] if gate else []
        outer = (lambda x: f"IF(__gate, {x}, CAST(array() AS ARRAY<INT>)) AS {MATCHED}") if gate else (lambda x: f"{x} AS {MATCHED}")
        if plan == "staged":
            staged = df.selectExpr(*kept, *[f"{sure(self.predicate(p, source))} AS __p{p}" for p in used], *extra)
            return staged.selectExpr(*kept, outer(lowering.matched_rules(self.trees, lambda p: f"__p{p}")))
        place: dict[int, int] = {}
        arrays, groups = [], {}
        for p in used:
            x = self.ruleset.primitives[p]
            plain = x.match_type in ("contains", "startswith", "endswith") and len(x.values) == 1 and not x.modifiers and self.config.semantics != "registry"
            groups.setdefault((x.field, x.match_type) if plain else p, []).append(p)
        for key, members in groups.items():
            for p in members:
                place[p] = len(place)
            if isinstance(key, tuple):
                v = source.field(key[0])
                values = ", ".join(matchers.text(self.ruleset.primitives[p].values[0]) for p in members)
                arrays.append(f"transform(array({values}), x -> coalesce({key[1]}({v}, x), false))")
            else:
                arrays.append(f"array({sure(self.predicate(members[0], source))})")
        held = f"concat({', '.join(arrays)})" if len(arrays) > 1 else arrays[0]
        return df.selectExpr(*kept, f"{held} AS __held", *extra).selectExpr(*kept, outer(lowering.matched_by_data(self.trees, place, "__held")))

    # evaluation

    def evaluate(self, df: DataFrame) -> DataFrame:
        """df with matched_rules array<int>, sorted; batch or streaming. Dotted fields are struct members."""
        return self._evaluate(df, self._source(df))

    evaluate_batch = evaluate

    def evaluate_raw(self, df: DataFrame, column: str = "value", fail_on_bad: bool = False) -> DataFrame:
        """The same with events as JSON text. Bad JSON matches as an event without fields, or fails the query."""
        if fail_on_bad:
            df = df.selectExpr(*[f"IF({name(c)} IS NOT NULL AND parse_json({name(c)}) IS NOT NULL, {name(c)}, NULL) AS {name(c)}" if c == column else name(c) for c in df.columns])
        return self._evaluate(df, self._source(df, json=column), name(column))

    def evaluate_variant(self, df: DataFrame, column: str) -> DataFrame:
        return self._evaluate(df, self._source(df, variant=column))

    def alerts(self, df: DataFrame, json: str | None = None, keep: list[str] | None = None) -> DataFrame:
        """(rule_id int, then the kept columns), a row per event and rule that holds. Literals that must occur filter the scan."""
        source = self._source(df, json=json)
        condition = self.where(source, name(json) if json else None)
        rows = self._evaluate(df.where(condition) if condition else df, source, name(json) if json else None)
        kept = [c for c in (keep if keep is not None else df.columns) if c not in (MATCHED, "rule_id")]
        # an outer explode: for an inner one the optimizer would evaluate all rules once more, as a filter below
        return rows.selectExpr(f"explode_outer({MATCHED}) AS rule_id", *map(name, kept)).where("rule_id IS NOT NULL")

    def evaluate_observed(self, df: DataFrame, observation: Observation, json: str | None = None) -> DataFrame:
        """``evaluate``, or ``evaluate_raw`` of a column, counting as the rows are read: events, passed (the literal prefilter),
        dropped by it, matched events, rule matches, and primitives evaluated (each one once an event that passes)."""
        source = self._source(df, json=json)
        found = self.where(source, name(json) if json else None)
        primitives = len(self._used())
        out = self._evaluate(df.selectExpr("*", f"{sure(found) if found else 'true'} AS __passed"), source, name(json) if json else None)
        size = F.size(MATCHED)
        count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
        passed = F.col("__passed")
        counted = out.observe(
            observation, F.count(F.lit(1)).alias("events"), count(passed).alias("passed"), count(~passed).alias("dropped"), count(size > 0).alias("matched"),
            count(size).alias("matches"), (count(passed) * primitives).alias("primitives"),
        )
        return counted.drop("__passed")

    def evaluate_primitive(self, df: DataFrame, primitive_id: int) -> DataFrame:
        """df with matched boolean."""
        return df.selectExpr("*", f"{sure(self.predicate(primitive_id, self._source(df)))} AS matched")

    def evaluate_events(self, spark: SparkSession, events: list[dict | str]) -> list[list[int]]:
        """Matched rules of a few events, in their order. Text that isn't JSON is an error."""
        texts = []
        for e in events:
            try:
                texts.append(json.dumps(json.loads(e), ensure_ascii=False) if isinstance(e, str) else json.dumps(e, ensure_ascii=False))
            except ValueError as x:
                raise ExecutionError(f"invalid JSON: {x}") from x
        df = spark.createDataFrame(list(enumerate(texts)), "n int, event string")
        return [r[MATCHED] for r in sorted(self.evaluate_raw(df, "event").collect(), key=lambda r: r.n)]


class EngineBuilder:
    """Collects an engine's parts."""

    def __init__(self):
        self._config, self._compiler, self._extractor = EngineConfig(), None, None
        self._matchers: dict[str, Matcher] = {}
        self._modifiers: dict[str, Modifier] = {}
        self._hooks: dict[Phase, list[Hook]] = {}

    def with_config(self, config: EngineConfig) -> EngineBuilder:
        self._config = config
        return self

    def with_compiler(self, compiler: Compiler) -> EngineBuilder:
        self._compiler = compiler
        return self

    def register_match(self, match_type: str, function: Matcher) -> EngineBuilder:
        """A match type of one's own: (field SQL, values, modifiers, folds case) to SQL, of a registered UDF if need be."""
        self._matchers[match_type] = function
        return self

    def register_modifier(self, modifier: str, function: Modifier) -> EngineBuilder:
        self._modifiers[modifier] = function
        return self

    def with_field_extractor(self, function: Callable[[str], str | None]) -> EngineBuilder:
        self._extractor = function
        return self

    def register_hook(self, phase: Phase, hook: Hook) -> EngineBuilder:
        self._hooks.setdefault(phase, []).append(hook)
        return self

    def with_literal_extraction(self, sink: Callable[[str, float], None]) -> EngineBuilder:
        """sink(value, selectivity) of every value of a literal primitive, for searches of many patterns."""
        return self.register_hook(Phase.PRIMITIVE_DISCOVERY, literal_hook(sink))

    def with_value_extraction(self, sink: Callable[[str, str, bool], None]) -> EngineBuilder:
        """sink(field, value, whether literal) of every value, for ordered sets."""
        return self.register_hook(Phase.PRIMITIVE_DISCOVERY, value_hook(sink))

    def with_filter_extraction(self, sink: Callable[[str, float], None]) -> EngineBuilder:
        """sink(value, selectivity) of every value of a literal primitive, for filters of set membership."""
        return self.register_hook(Phase.PRIMITIVE_DISCOVERY, literal_hook(sink))

    # what is registered

    @property
    def match_type_count(self) -> int:
        return len(matchers.MATCHERS.keys() | self._matchers.keys())

    @property
    def modifier_count(self) -> int:
        return len(modifiers.COMPAT.keys() | self._modifiers.keys())

    def has_match_type(self, match_type: str) -> bool:
        return match_type in matchers.MATCHERS or match_type in self._matchers

    def has_modifier(self, modifier: str) -> bool:
        return modifier in modifiers.COMPAT or modifier in self._modifiers

    def hook_count(self, phase: Phase) -> int:
        return len(self._hooks.get(phase, []))

    def has_hooks(self, phase: Phase) -> bool:
        return self.hook_count(phase) > 0

    @property
    def total_hook_count(self) -> int:
        return sum(map(len, self._hooks.values()))

    def build(self, rules: Iterable[str]) -> DetectionEngine:
        return DetectionEngine.from_rules(rules, self._config, self._compiler, match_functions=self._matchers, modifier_functions=self._modifiers, extractor=self._extractor, hooks=self._hooks)
