"""YAML, conditions, lowering, configuration and introspection; nothing here needs Spark."""

import pytest

from rulewright import Compiler, DetectionEngine, EngineConfig, FieldMapping, RuleComplexity
from rulewright.compiler import float_text, parse_field
from rulewright.condition import And, Count, Name, Not, Or, parse, tokenize
from rulewright.errors import CompilationError, YamlError
from rulewright.ir import Primitive
from rulewright.operators.filters import FilterIntegration
from rulewright.operators.hooks import Phase, literal_hook, value_hook
from rulewright.plans.dag import sharing_potential, should_use_dag
from rulewright.plans.lower import terms_of
from rulewright.plans.prefilter import LiteralPrefilter, PrefilterConfig, necessary, selectivity, suitable
from rulewright.queries import rule
from rulewright.sources import rules_from_dir


def test_tokens():
    assert [k for k, _ in tokenize("1 of sel* and not (a_1 or them) all")] == ["number", "of", "pattern", "and", "not", "(", "name", "or", "them", ")", "all"]
    assert tokenize("99999999999 a") == [("name", "a")]
    for bad in ("a | b", "a-b", '"x"', "a\rb"):
        with pytest.raises(CompilationError):
            tokenize(bad)


def test_precedence_and_forms():
    a, b, c = map(Name, "abc")
    assert parse("a or b and not c") == Or(a, And(b, Not(c)))
    assert parse("(a or b) and c") == And(Or(a, b), c) and parse("a and b and c") == And(And(a, b), c)
    assert parse("1 of them") == Count(1, None) and parse("all of them") == Count(None, None) and parse("3 of x*") == Count(3, "x*") and parse("all of x*") == Count(None, "x*")
    for bad in ("", "not not a", "2 of them", "a and", "(a", "a b", "a AND b", "1 of x", "of"):
        with pytest.raises(CompilationError):
            parse(bad)
    assert parse("a AND b", strict=False) == a


def test_field_keywords():
    assert parse_field("A") == ("A", "equals", ()) and parse_field("A|contains|all") == ("A", "contains", ("all",)) and parse_field("A|contains|re") == ("A", "regex", ())
    assert parse_field("A|base64offset|wide|utf16le|cased|x") == ("A", "equals", ("base64_offset_decode", "wide_decode", "utf16le_decode", "case_sensitive", "x"))


def test_values_are_text():
    c = Compiler()
    c.compile_rule("detection:\n  s:\n    A: [1, 1.0, 2.5, 'x', yes, 0x1F, [1], null]\n    B: 2024-01-01\n  condition: s\n")
    assert c.ruleset.primitives == [Primitive("A", "equals", ("1", "1", "2.5", "x", "yes", "31")), Primitive("B", "equals", ("2024-01-01",))]
    assert [float_text(x) for x in (1.0, 1e21, 1.5e-7, float("inf"))] == ["1", "1" + "0" * 21, "0.00000015", "inf"]


def test_ids_and_sharing():
    c = Compiler()
    ids = [c.compile_rule(f"id: {i}\ndetection:\n  s: {{E: 1}}\n  condition: s\n") for i in ("7", "'8'", "abc", "4294967298")]
    ids.append(c.compile_rule("detection:\n  s: {E: 1}\n  condition: s\n"))
    assert ids == [7, 8, 0, 2, 1] and len(c.ruleset.primitives) == 1


def test_compile_errors():
    for bad in ("a: [", "a: 1\na: 2\n", "x"):
        with pytest.raises((YamlError, CompilationError)):
            Compiler().compile_rule(bad)
    for bad in ("detection: {s: {A: 1}}", "detection: {s: {A: true}, condition: s}", "detection: {s: {A: null}, condition: s}", "detection: {s: {A: {b: 1}}, condition: s}", "title: x"):
        with pytest.raises(CompilationError):
            Compiler().compile_rule(bad)
    keywords = "detection:\n  s: [a, b]\n  condition: s\n"
    assert Compiler().compile_rule(keywords) == 0
    with pytest.raises(CompilationError):
        Compiler(strict=True).compile_rule(keywords)
    with pytest.raises(CompilationError):
        Compiler(strict=True).compile_ruleset([rule(1, "s", s="{A: 1}")] * 2)


def test_mapping():
    m = FieldMapping()
    m.add("A", "b")
    c = Compiler(m)
    c.compile_rule(rule(1, "s", s="{'A|contains': x, C: y}"))
    assert [p.field for p in c.ruleset.primitives] == ["b", "C"] and m.taxonomy == "sigma" and m.has("A") and not m.has("b")


def test_lowering_by_semantics():
    rules = [rule(1, "1 of sel*", sel_a="{A: 1, B: 2}", sel_b="{C: 3}"), rule(2, "1 of them", s="{A: 1, B: 2}"), rule(3, "2 of sel*", sel_a="{A: 1}", sel_b="{B: 2}"), rule(4, "a b", a="{A: 1}"), rule(5, "x", a="{A: 1}")]
    documented = DetectionEngine.from_rules(rules)
    assert sorted(documented.trees) == [1, 2, 3] and sorted(documented.dropped) == [4, 5] and documented.trees[3][0] == "least" and documented.trees[2][0] == "and"
    engine = DetectionEngine.from_rules(rules, EngineConfig(semantics="engine"))
    assert sorted(engine.trees) == [2, 4] and engine.trees[2][0] == "or"
    with pytest.raises(CompilationError):
        DetectionEngine.from_rules(rules, EngineConfig(strict=True))
    assert terms_of(("not", ("and", [("p", 0), ("p", 1)]))) == [(frozenset(), {0}), (frozenset(), {1})]


def test_statistics():
    e = DetectionEngine.from_rules([rule(1, "a and b", a="{A: 1}", b="{B: 2}"), rule(2, "a and c", a="{A: 1}", c="{C: 3}")])
    s = e.statistics()
    assert (e.rule_count, e.primitive_count, e.node_count) == (2, 3, 7) and (s.primitive_nodes, s.logical_nodes, s.result_nodes, s.max_depth, s.shared_primitives) == (3, 2, 2, 3, 1)
    assert e.contains_rule(1) and not e.contains_rule(9)
    assert [should_use_dag(*x) for x in ((49, 1.0), (50, 0.5), (99, 0.6), (100, 0.0))] == [False, False, True, True] and sharing_potential(1) == 0 and sharing_potential(250) == 1
    assert [RuleComplexity.analyze(*x).value for x in ((3, 2, 1), (5, 3, 5), (9, 1, 1), (4, 2, 11))] == ["simple", "medium", "complex", "complex"]
    assert EngineConfig.production().batch_size == 1000 and not EngineConfig.development().enable_prefilter


def test_prefilter():
    p = [Primitive("A", "contains", ("x", "yy")), Primitive("B", "regex", ("z",)), Primitive("C", "equals", ("a*",)), Primitive("D", "startswith", ("C:\\",)), Primitive("E", "contains", ("C:\\",))]
    assert [suitable(x) for x in p] == [True, False, False, True, False]
    f = LiteralPrefilter(p)
    assert set(f.patterns) == {"x", "yy", "C:\\"} and f.stats.pattern_count == 3 and f.stats.field_count == 2 and f.stats.should_enable and not f.stats.is_effective
    assert not LiteralPrefilter(p, PrefilterConfig.disabled()).patterns and set(LiteralPrefilter(p, PrefilterConfig(min_length=2)).patterns) == {"yy", "C:\\"}
    assert [selectivity(n) for n in (0, 1, 5, 10, 20, 50)] == [1.0, 0.7, 0.4, 0.2, 0.1, 0.05]
    assert necessary(("and", [("p", 1), ("or", [("p", 0), ("p", 3)])]), {0, 3}) == {0, 3} and necessary(("or", [("p", 0), ("p", 1)]), {0}) is None and necessary(("not", ("p", 0)), {0}) is None


def test_hooks_and_filters():
    seen, literals, values, f = [], [], [], FilterIntegration()
    builder = DetectionEngine.builder()
    for phase in Phase:
        builder.register_hook(phase, lambda c: seen.append(c.phase))
    builder.register_hook(Phase.PRIMITIVE_DISCOVERY, literal_hook(lambda v, s: literals.append((v, s)))).register_hook(Phase.PRIMITIVE_DISCOVERY, value_hook(lambda *x: values.append(x))).register_hook(Phase.PRIMITIVE_DISCOVERY, f.hook())
    builder.build([rule(1, "s", s="{A: x, 'B|re': 'y*', 'C|contains': [u, v]}")])
    assert seen == [Phase.PRE_COMPILATION, *[Phase.PRIMITIVE_DISCOVERY] * 3, Phase.POST_COMPILATION]
    assert literals == [("x", 0.1), ("u", 0.3), ("v", 0.3)] and values[1] == ("B", "y*", False)
    assert list(f.values["aho_corasick"]) == ["x", "u", "v"] and not f.values["xor"] and f.fst_values() == ["x"]
    g = FilterIntegration()
    g.extract([Primitive("A", "equals", ("x",)), Primitive("A", "equals", ("x",)), Primitive("B", "contains", ("y",)), Primitive("C", "cidr", ("z",))])
    assert list(g.values["xor"]) == ["x"] and g.aho_corasick_patterns() == [("x", 0.1), ("y", 0.3)] and g.selective_patterns(0.1) == ["x"] and g.field_patterns("B") == ["y"] and g.statistics()["aho_corasick"] == 2

    def fail(c):
        raise CompilationError("no")

    with pytest.raises(CompilationError):
        DetectionEngine.builder().register_hook(Phase.PRE_COMPILATION, fail).build([])
    with pytest.raises(CompilationError):
        DetectionEngine.from_rules([rule(1, "s", s="{A: x}")], EngineConfig(max_memory_bytes=3))


def test_a_folder_of_rules(tmp_path):
    """Files of several shapes, below several folders; one is malformed."""
    texts = {
        "a/one.yml": "title: Shell from an office program\nid: 1\ndetection:\n  parent: {ParentImage|endswith: ['\\word.exe', '\\excel.exe']}\n  child: {Image|endswith: '\\cmd.exe'}\n  condition: parent and child\n",
        "a/two.yaml": "id: 2\ndetection:\n  port: {DestinationPort: [4444, 1337]}\n  own: {DestinationIp|cidr: 10.0.0.0/8}\n  condition: port and not own\n",
        "b/three.yml": "id: 3\ndetection:\n  sel_a: {EventID: 4688}\n  sel_b: {CommandLine|contains: ['-enc', 'IEX']}\n  sel_c: {CommandLine|re: 'https?://'}\n  condition: 2 of sel_*\n",
        "b/readme.txt": "no rule",
    }
    for name, body in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    engine = DetectionEngine.from_rules(rules_from_dir(str(tmp_path)))
    assert sorted(engine.trees) == [1, 2, 3] and engine.primitive_count == 7 and engine.ruleset.titles == {1: "Shell from an office program"}
    assert engine.trees[3][0] == "least"
    (tmp_path / "b" / "bad.yml").write_text("id: 4\ndetection:\n  s: {A: 1}\n")
    with pytest.raises(CompilationError):
        DetectionEngine.from_rules(rules_from_dir(str(tmp_path)))


def test_compiler_tells_what_it_has():
    c = Compiler()
    c.compile_rule(rule(3, "a and b", a="{A: 1}", b="{'B|contains': [x, y]}"))
    assert c.primitive_count == 2 and c.current_selection_map == {"a": [0], "b": [1]} and c.primitives[1].field_path_string() == "B"
    assert c.primitives[0].matches("1") and c.primitives[1].matches("axb") and not c.primitives[1].matches(None)
    done = c.into_ruleset()
    assert done.primitive_count == 2 and done.get_primitive(5) is None and c.primitive_count == 0


def test_prefilter_limit_is_looked_at_after_each_value():
    with pytest.warns(UserWarning, match="full"):
        f = LiteralPrefilter([Primitive("A", "equals", ("x", "y", "x")), Primitive("B", "contains", ("x", "z"))], PrefilterConfig(max_patterns=3))
    assert list(f.exact) == ["x", "y"] and list(f.within) == ["x"] and f.patterns["x"] == {0, 1}
