"""Evaluation end to end."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulewright import DetectionEngine, EngineConfig
from rulewright.errors import ExecutionError
from rulewright.plans.prefilter import LiteralPrefilter
from rulewright.queries import rule, scale_rules
from rulewright.streaming import write_alerts

NOTEPAD = rule(1, "s", s="{'Image|endswith': '\\notepad.exe'}")
TEST = rule(2, "s", s="{'CommandLine|contains': test}")
EVENT = rule(3, "s", s="{EventID: 4688}")


def run(spark, rules, events, **config):
    return DetectionEngine.from_rules(rules, EngineConfig(**config)).evaluate_events(spark, events)


@pytest.mark.parametrize("plan", ["inline", "staged", "array"])
def test_known_answers(spark, plan):
    both = {"EventID": 4688, "Image": "C:\\Windows\\notepad.exe", "CommandLine": "notepad test.txt"}
    assert run(spark, [NOTEPAD, TEST, EVENT], [both], plan=plan) == [[1, 2, 3]]
    pair = [rule(1, "a and b", a="{EventID: 4688}", b="{'Image|endswith': '\\cmd.exe'}"), rule(2, "a and (b or c)", a="{EventID: 4688}", b="{'Image|endswith': '\\x.exe'}", c="{'CommandLine|contains': [whoami, net]}")]
    events = [{"EventID": "4688", "Image": "C:\\cmd.exe", "CommandLine": "whoami"}, {"EventID": 4688, "Image": "\\x.exe"}, {"EventID": 1, "Image": "\\cmd.exe"}, {}]
    assert run(spark, pair, events, plan=plan) == [[1, 2], [2], [], []]
    nots = [rule(1, "a and not f", a="{EventID: 3}", f="{Port: [80, 443]}"), rule(4294967295, "not a", a="{EventID: 3}")]
    assert run(spark, nots, [{"EventID": 3}, {"EventID": 3, "Port": 443}, {"EventID": 9}], plan=plan) == [[1], [], [-1]]
    counts = [rule(1, "2 of s*", s1="{A: 1}", s2="{B: 2}", s3="{C: 3}"), rule(2, "all of s* and not 1 of t*", s1="{A: 1}", s2="{B: 2}", t1="{C: 3}", t2="{D: 4}")]
    assert run(spark, counts, [{"A": 1, "B": 2}, {"A": 1, "C": 3}, {"A": 1, "B": 2, "D": 4}, {"C": 3}], plan=plan) == [[1, 2], [1], [1], []]
    assert run(spark, [], [{}], plan=plan) == [[]]


def test_json_fields(spark):
    rules = [rule(1, "s", s="{a.b: x}"), rule(2, "s", s="{n: '1.0'}"), rule(3, "s", s="{t: 'true'}"), rule(4, "s", s="{'o|contains': ''}"), rule(5, "not s", s="{z: q}"), rule(6, "s", s="{'u|contains': 'é\"'}")]
    events = [{"a": {"b": "x"}, "n": 1.0, "t": True, "o": {"k": 1}, "z": None, "u": 'né"'}, {"a.b": "x", "n": 1, "o": [1], "z": "q"}, {"o": "{text}"}]
    assert run(spark, rules, events) == [[1, 2, 3, 5, 6], [], [4, 5]]
    with pytest.raises(ExecutionError):
        run(spark, rules, ["{"])


def test_columns_and_variants(spark):
    df = spark.createDataFrame([(1, 1.0, True, ("x",), [1]), (2, 1e16, None, None, None), (3, 12345678.5, False, ("y",), [2]), (4, 1e-5, None, None, None)], "id int, d double, b boolean, s struct<f:string>, l array<int>")
    rules = [rule(1, "s", s="{d: ['1.0', '1e16', '12345678.5', '0.00001']}"), rule(2, "s", s="{b: 'true'}"), rule(3, "s", s="{s.f: [x, y]}"), rule(4, "s", s="{'l|contains': '1'}"), rule(5, "s", s="{absent: x}"), rule(6, "s", s="{id: [2, 3]}")]
    got = {r.id: r.matched_rules for r in DetectionEngine.from_rules(rules).evaluate(df).collect()}
    assert got == {1: [1, 2, 3], 2: [1, 6], 3: [1, 3, 6], 4: [1]}
    v = spark.createDataFrame([(1, '{"a": {"b": "x"}, "c": [1]}'), (2, '{"a": 5}')], "id int, j string").selectExpr("id", "parse_json(j) AS v")
    got = {r.id: r.matched_rules for r in DetectionEngine.from_rules([rule(1, "s", s="{a.b: x}"), rule(2, "s", s="{a: 5}"), rule(3, "s", s="{'c|contains': 1}")]).evaluate_variant(v, "v").collect()}
    assert got == {1: [1], 2: [2]}


def test_semantics(spark):
    event = [{"A": "ABC"}]
    upper = rule(1, "s", s="{A: abc}")
    assert run(spark, [upper], event) == [[]] and run(spark, [upper], event, semantics="registry") == [[1]] and run(spark, [upper], event, semantics="engine") == [[]]
    lowered = rule(1, "s", s="{'A|lowercase': abc}")
    assert run(spark, [lowered], event) == [[1]] and run(spark, [lowered], event, semantics="engine") == [[]]
    cased = rule(1, "s", s="{'A|cased': abc}")
    assert run(spark, [cased], event, semantics="registry") == [[]]


def test_prefilter_modes(spark):
    rules = [rule(1, "s", s="{A: x}"), rule(2, "s", s="{'N|range': '>1'}")]
    events = [{"A": "x", "N": 5}, {"A": "y", "N": 5}, {"B": "x", "N": 0}]
    assert run(spark, rules, events) == [[1, 2], [2], []]
    for plan in ("inline", "staged", "array"):
        assert run(spark, rules, events, prefilter="reference", plan=plan) == [[1, 2], [], []]
    df = spark.createDataFrame([("x", 5), ("y", 5)], "A string, N int")
    assert [r.rule_id for r in DetectionEngine.from_rules(rules).alerts(df).orderBy("A", "rule_id").collect()] == [1, 2, 2]
    hits = LiteralPrefilter(DetectionEngine.from_rules([rule(1, "s", s="{'A|contains': [ab, b]}")]).ruleset.primitives).find_matches(spark.createDataFrame([(1, "xabb"), (2, None)], "id int, A string"), "id", "A").collect()
    assert [(h.id, h.pattern, h.start, h.end, h.primitive_ids) for h in hits] == [(1, "ab", 1, 3, [0]), (1, "b", 3, 4, [0])]


def test_extensions(spark):
    builder = DetectionEngine.builder().register_match("longer", lambda v, xs, m, fold: f"length({v}) > {xs[0]}").register_modifier("twice", lambda x: f"concat({x}, {x})").with_field_extractor(lambda f: "concat('v', n)" if f == "virtual" else None)
    engine = builder.build([rule(1, "s", s="{'t|twice': abab}"), rule(2, "s", s="{virtual: v2}")])
    df = spark.createDataFrame([(1, "ab"), (2, "x")], "n int, t string")
    assert [r.matched_rules for r in engine.evaluate(df).orderBy("n").collect()] == [[1], [2]]
    from rulewright.ir import CompiledRuleset, Primitive

    own = DetectionEngine(CompiledRuleset([Primitive("t", "longer", ("1",))], []), match_functions={"longer": lambda v, xs, m, fold: f"length({v}) > {xs[0]}"})
    assert [r.matched for r in own.evaluate_primitive(df, 0).orderBy("n").collect()] == [True, False]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_shuffle_and_push_literals(spark, tmp_path):
    spark.range(100).selectExpr("CAST(id AS STRING) AS a", "id AS n", "'w' AS unused").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    engine = DetectionEngine.from_rules([rule(1, "s", s="{'a|startswith': '7', 'n|range': '>5'}"), rule(2, "s", s="{a: '12'}")])
    plan = plan_of(engine.alerts(df, keep=["n"]))
    assert "Exchange" not in plan and "Python" not in plan and "PushedFilters: [Or(StringStartsWith(a,7),EqualTo(a,12))]" in plan and "unused" not in plan
    for mode in ("inline", "staged", "array"):
        assert "Exchange" not in plan_of(DetectionEngine.from_rules(scale_rules(40), EngineConfig(plan=mode)).evaluate(df.selectExpr("a AS event_type", "n AS user_id", "CAST(n AS DOUBLE) AS value")))


def test_many_rules_plan_quickly(spark):
    import time

    df = spark.range(10).selectExpr("'view' AS event_type", "id AS user_id", "CAST(id AS DOUBLE) AS value")
    start = time.time()
    DetectionEngine.from_rules(scale_rules(1000)).evaluate(df)._jdf.queryExecution().optimizedPlan()
    assert time.time() - start < 30


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, json.dumps({"A": "x" if i % 3 else "y"})) for i in range(30)]
    spark.createDataFrame(rows, "id int, event string").repartition(3).write.parquet(str(tmp_path / "in"))
    engine = DetectionEngine.from_rules([rule(1, "s", s="{A: x}"), rule(2, "not s", s="{A: x}")])
    stream = spark.readStream.schema("id int, event string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_alerts(engine, stream, str(tmp_path / "out"), str(tmp_path / "check"), "event", once=True).awaitTermination()
    got = {(r.rule_id, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1 if i % 3 else 2, i) for i in range(30)} == {(r.rule_id, r.id) for r in engine.alerts(spark.read.parquet(str(tmp_path / "in")), "event").collect()}


words = st.sampled_from(["a", "b", "ab", "A", "", "'", "\\", "1", "12"])


def holds(tree, event, primitives):
    kind = tree[0]
    if kind == "p":
        p = primitives[tree[1]]
        v = event.get(p.field)
        tests = {"equals": lambda x: v == x, "contains": lambda x: x in v, "startswith": lambda x: v.startswith(x), "endswith": lambda x: v.endswith(x)}
        return v is not None and any(tests[p.match_type](x) for x in p.values)
    if kind == "not":
        return not holds(tree[1], event, primitives)
    parts = [holds(t, event, primitives) for t in tree[-1]]
    return sum(parts) >= tree[1] if kind == "least" else all(parts) if kind == "and" else any(parts)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.data())
def test_plans_agree_with_the_definition(spark, data):
    rules = []
    for i in range(data.draw(st.integers(1, 6))):
        selections = {}
        for s in ("sa", "sb", "t"):
            field, match = data.draw(st.sampled_from("fg")), data.draw(st.sampled_from(["", "|contains", "|startswith", "|endswith"]))
            selections[s] = json.dumps({field + match: data.draw(st.lists(words, min_size=1, max_size=3))})
        rules.append(rule(i, data.draw(st.sampled_from(["sa", "sa and not sb", "1 of s* or t", "2 of s* and not t", "not (sa or sb)", "all of them"])), **selections))
    events = [{f: data.draw(words) for f in data.draw(st.sets(st.sampled_from("fg")))} for _ in range(8)]
    engines = [DetectionEngine.from_rules(rules, EngineConfig(plan=p)) for p in ("inline", "staged", "array")]
    want = [[i for i, t in sorted(engines[0].trees.items()) if holds(t, e, engines[0].ruleset.primitives)] for e in events]
    df = spark.createDataFrame([(n, e.get("f"), e.get("g")) for n, e in enumerate(events)], "n int, f string, g string")
    for engine in engines:
        assert [r.matched_rules for r in engine.evaluate(df).orderBy("n").collect()] == want
        assert sorted((r.n, r.rule_id) for r in engine.alerts(df).collect()) == [(n, i) for n, ids in enumerate(want) for i in ids]
    assert F
