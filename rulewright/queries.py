"""One query for each operator of the rule engine, over the test tables, with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .compiler import Compiler
from .config import EngineConfig
from .engine import DetectionEngine
from .functions.modifiers import COMPAT, DOCUMENTED, documented
from .ir import FieldMapping, Primitive
from .operators.filters import FilterIntegration, pattern_frequency
from .operators.hooks import Phase
from .plans.dag import Dag
from .plans.prefilter import LiteralPrefilter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def rule(rule_id: int, condition: str, **selections: str) -> str:
    """A rule; each selection is YAML flow text."""
    lines = "".join(f"  {k}: {v}\n" for k, v in selections.items())
    return f"id: {rule_id}\ndetection:\n{lines}  condition: {condition}\n"


def _alerts(query: str, table: str, keep: list[str], rules: list[str], oracle: str, config: EngineConfig | None = None, compiler: Callable[[], Compiler] | None = None, json: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = DetectionEngine.from_rules(rules, config or EngineConfig(), compiler() if compiler else None)
        return engine.alerts(spark.read.parquet(f"{sf_dir}/{table}.parquet"), json, keep)

    QUERIES[query], ORACLE_SQL[query] = run, oracle


def _where(query: str, table: str, key: str, selection: str, where: str, config: EngineConfig | None = None) -> None:
    """One rule of one selection."""
    _alerts(query, table, [key], [rule(1, "s", s=selection)], f"SELECT 1 AS rule_id, {key} FROM {table} WHERE {where}", config)


REGISTRY = EngineConfig(semantics="registry")

# match types
_where("m_equals", "events", "event_id", "{event_type: purchase}", "event_type = 'purchase'")
_where("m_equals_list", "events", "event_id", "{event_type: [purchase, error, absent]}", "event_type IN ('purchase', 'error')")
_where("m_equals_ci", "events", "event_id", "{event_type: PURCHASE}", "event_type = 'purchase'", REGISTRY)
_where("m_equals_cased", "events", "event_id", "{'event_type|cased': [PURCHASE, view]}", "event_type = 'view'", REGISTRY)
_where("m_contains", "part", "p_partkey", "{'p_name|contains': [ring, blue]}", "contains(p_name, 'ring') OR contains(p_name, 'blue')")
_where("m_contains_long", "customer", "c_custkey", "{'c_name|contains': [" + ", ".join(f"'{i}'" for i in range(10, 60)) + "]}", " OR ".join(f"contains(c_name, '{i}')" for i in range(10, 60)))
_where("m_startswith", "customer", "c_custkey", "{'c_mktsegment|startswith': [AUTO, BUILD]}", "starts_with(c_mktsegment, 'AUTO') OR starts_with(c_mktsegment, 'BUILD')")
_where("m_endswith", "supplier", "s_suppkey", "{'s_name|endswith': ['1', '7']}", "suffix(s_name, '1') OR suffix(s_name, '7')")
_where("m_regex", "pages", "page_id", "{'url|re': '^https?://[a-z.]+\\.example\\.(com|net)/en/\\d+$'}", r"regexp_matches(url, '^https?://[a-z.]+\.example\.(com|net)/en/\d+\z')")
_where("m_range_incl", "lineitem", "l_orderkey", "{'l_linenumber|range': '2..4'}", "l_linenumber BETWEEN 2 AND 4")
_where("m_range_excl", "lineitem", "l_orderkey", "{'l_linenumber|range': '2...4'}", "l_linenumber >= 2 AND l_linenumber < 4")
for _name, _sign in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _where(f"m_range_{_name}", "events", "event_id", f"{{'value|range': '{_sign}100.5'}}", f"value {_sign} 100.5")
_where("m_range_eq", "lineitem", "l_orderkey", "{'l_quantity|range': '17'}", "l_quantity = 17")
_where("m_fuzzy", "part", "p_partkey", "{'p_type|fuzzy|fuzzy:0.6': STANDARD}", "1 - levenshtein(p_type, 'STANDARD') / greatest(strlen(p_type), 8) >= 0.6")
_where("m_unknown_is_equality", "events", "event_id", "{'event_type|lt': error}", "event_type = 'error'", EngineConfig(semantics="engine"))


def _m_cidr(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "concat('10.', event_id % 7, '.', event_id % 256, '.', event_id % 300) AS ip")
    return DetectionEngine.from_rules([rule(1, "s", s="{'ip|cidr': [10.3.0.0/17, '10.5.16.9/30', 'fe80::/10']}")]).alerts(events, keep=["event_id"])


QUERIES["m_cidr4"] = _m_cidr
ORACLE_SQL["m_cidr4"] = "SELECT 1 AS rule_id, event_id FROM events WHERE event_id % 300 < 256 AND ((event_id % 7 = 3 AND event_id % 256 < 128) OR (event_id % 7 = 5 AND event_id % 256 = 16 AND event_id % 300 BETWEEN 8 AND 11))"


def _m_cidr6(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "concat('2001:db8:', event_id % 16, '::', event_id % 10) AS ip")
    return DetectionEngine.from_rules([rule(1, "s", s="{'ip|cidr': ['2001:db8:4::/46']}")]).alerts(events, keep=["event_id"])


QUERIES["m_cidr6"] = _m_cidr6
ORACLE_SQL["m_cidr6"] = "SELECT 1 AS rule_id, event_id FROM events WHERE event_id % 16 BETWEEN 4 AND 7"


def _by_name(query: str, match_type: str, values: list[str], modifiers: list[str], oracle: str) -> None:
    """Match types that no keyword reaches, by evaluating a primitive."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .ir import CompiledRuleset

        table = "lineitem" if match_type == "range_dash" else "part"
        field, key = ("l_linenumber", "l_orderkey") if match_type == "range_dash" else ("p_type", "p_partkey")
        engine = DetectionEngine(CompiledRuleset([Primitive(field, match_type, tuple(values), tuple(modifiers))], []))
        return engine.evaluate_primitive(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, field), 0)

    QUERIES[query], ORACLE_SQL[query] = run, oracle


_by_name("m_range_dash", "range_dash", ["2-4"], [], "SELECT l_orderkey, l_linenumber, l_linenumber BETWEEN 2 AND 4 AS matched FROM lineitem")
_by_name("m_fuzzy_threshold", "fuzzy_threshold", ["SMALL"], ["threshold:0.5"], "SELECT p_partkey, p_type, p_type = 'SMALL' OR 1 - levenshtein(p_type, 'SMALL') / greatest(strlen(p_type), 5) >= 0.5 AS matched FROM part")
_by_name("m_exact", "exact", ["PROMO", "SMALL"], [], "SELECT p_partkey, p_type, p_type IN ('PROMO', 'SMALL') AS matched FROM part")


# the condition language
_ABC = {"a": "{event_type: [purchase, view]}", "b": "{'value|range': '>50'}", "c": "{'user_id|endswith': '7'}"}
_A, _B, _C = "event_type IN ('purchase', 'view')", "coalesce(value > 50, false)", "suffix(CAST(user_id AS VARCHAR), '7')"
_SEL = {"sel_a": _ABC["a"], "sel_b": _ABC["b"], "sel_c": _ABC["c"], "other": "{event_type: error}"}


def _condition(query: str, condition: str, where: str, selections: dict[str, str] | None = None) -> None:
    _alerts(query, "events", ["event_id"], [rule(5, condition, **(selections or _ABC))], f"SELECT 5 AS rule_id, event_id FROM events WHERE {where}")


_condition("c_selection_and", "s", f"event_type = 'view' AND {_B}", {"s": "{event_type: view, 'value|range': '>50'}"})
_condition("c_and", "a and b", f"{_A} AND {_B}")
_condition("c_or", "a or b", f"{_A} OR {_B}")
_condition("c_not", "not a", f"NOT ({_A})")
_condition("c_paren", "a and (b or c)", f"{_A} AND ({_B} OR {_C})")
_condition("c_precedence", "a or b and not c", f"{_A} OR ({_B} AND NOT {_C})")
_condition("c_one_of_them", "1 of them", f"{_A} OR {_B} OR {_C}")
_condition("c_all_of_them", "all of them", f"{_A} AND {_B} AND {_C}")
_condition("c_one_of_glob", "1 of sel*", f"{_A} OR {_B} OR {_C}", _SEL)
_condition("c_n_of_glob", "2 of sel_*", f"CAST({_A} AS INT) + CAST({_B} AS INT) + CAST({_C} AS INT) >= 2", _SEL)
_condition("c_all_of_glob", "all of sel* and not other", f"{_A} AND {_B} AND {_C} AND event_type <> 'error'", _SEL)
_condition("c_not_missing_field", "a and not m", _A, {"a": _ABC["a"], "m": "{absent: x}"})
_alerts("c_one_of_them_primitives", "events", ["event_id"], [rule(5, "1 of them", s="{event_type: view, 'value|range': '>50'}")], f"SELECT 5 AS rule_id, event_id FROM events WHERE event_type = 'view' OR {_B}", EngineConfig(semantics="engine"))
_alerts("c_trailing_ignored", "events", ["event_id"], [rule(5, "a AND b", **_ABC)], f"SELECT 5 AS rule_id, event_id FROM events WHERE {_A}", EngineConfig(semantics="engine"))


# field modifiers: of each the value it makes
def _modifier(query: str, modifier: str, table: str, key: str, given: str, oracle: str, registry: dict | None = None) -> None:
    """given: SQL that both engines understand, for a column x; oracle: DuckDB SQL of the result over x."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(key, f"{given} AS x")
        return rows.selectExpr(key, f"{(registry or COMPAT)[modifier]('x')} AS y")

    QUERIES[query], ORACLE_SQL[query] = run, f"SELECT {key}, {oracle} AS y FROM (SELECT {key}, {given} AS x FROM {table})"


_modifier("f_base64_decode", "base64_decode", "part", "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN 'aGVsbG8gd29ybGQ=' WHEN p_partkey % 3 = 1 THEN 'aGk' ELSE '/w==' END", "CASE WHEN x = 'aGVsbG8gd29ybGQ=' THEN 'hello world' END")
_modifier("f_base64", "base64", "part", "p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN 'dGVzdA==' ELSE '!' END", "CASE WHEN x = 'dGVzdA==' THEN 'test' END")
_modifier("f_base64offset_decode", "base64offset_decode", "part", "p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN '=+aGk=' ELSE '====-' END", "CASE WHEN x = '=+aGk=' THEN 'hi' END")
_modifier("f_url_decode", "url_decode", "part", "p_partkey", "concat('%41%62', p_name)", "concat('Ab', substr(x, 7))")
_modifier("f_url_decode_documented", "url_decode", "part", "p_partkey", "concat('a%20b%2Fc', p_partkey)", "replace(replace(x, '%20', ' '), '%2F', '/')", DOCUMENTED)
_modifier("f_url_encode", "url_encode", "pages", "page_id", "url", "replace(replace(replace(replace(replace(replace(replace(x, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23')")
for _name in ("utf16_decode", "utf16le_decode", "utf16be_decode", "json_extract", "xml_extract", "unix_timestamp", "iso_timestamp", "gzip_decode", "regex_extract"):
    _modifier(f"f_{_name}", _name, "part", "p_partkey", "p_name", "x")
_modifier("f_wide_decode", "wide_decode", "part", "p_partkey", "concat('a', chr(0), p_name, chr(0))", "replace(x, chr(0), '')")
_modifier("f_html_decode", "html_decode", "pages", "page_id", "html", "replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&#x27;', ''''), '&#x2F;', '/'), '&#39;', '''')")
_modifier("f_lowercase", "lowercase", "documents", "doc_id", "text", "lower(x)")
_modifier("f_uppercase", "uppercase", "customer", "c_custkey", "c_name", "upper(x)")
_modifier("f_trim", "trim", "documents", "doc_id", "concat('  ', text, '   ')", r"regexp_replace(x, '^\s+|\s+$', '', 'g')")
_modifier("f_reverse", "reverse", "documents", "doc_id", "text", "reverse(x)")
_modifier("f_normalize_whitespace", "normalize_whitespace", "documents", "doc_id", "text", r"regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')")
_modifier("f_remove_whitespace", "remove_whitespace", "documents", "doc_id", "text", r"regexp_replace(x, '\s', '', 'g')")
_modifier("f_normalize_path", "normalize_path", "pages", "page_id", "replace(url, '.', chr(92))", "replace(replace(x, chr(92), '/'), '//', '/')")
_modifier("f_basename", "basename", "pages", "page_id", "url", r"string_split_regex(x, '[/\\]')[-1]")
_modifier("f_dirname", "dirname", "pages", "page_id", "url", "array_to_string(string_split(x, '/')[:-2], '/')")
_modifier("f_hex_decode", "hex_decode", "part", "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN '68 65-6C6c6f' WHEN p_partkey % 3 = 1 THEN '686' ELSE 'ff' END", "CASE WHEN x = '68 65-6C6c6f' THEN 'hello' END")
_modifier("f_hex_encode", "hex_encode", "documents", "doc_id", "text", "lower(hex(encode(x)))")
_modifier("f_json_normalize", "json_normalize", "documents", "doc_id", "text", "replace(replace(replace(x, chr(10), ''), chr(9), ''), '  ', ' ')")
_modifier("f_csv_extract", "csv_extract", "documents", "doc_id", "concat('\"', text)", "trim(split_part(x, ',', 1), '\"')")
_modifier("f_to_int", "to_int", "orders", "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN concat(' +', o_orderkey) WHEN o_orderkey % 3 = 1 THEN concat(o_orderkey, '.0') ELSE '007' END", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 3 = 2 THEN '7' END")
_modifier("f_to_float", "to_float", "orders", "o_orderkey", "CASE WHEN o_orderkey % 4 = 0 THEN concat(o_orderkey, '.50') WHEN o_orderkey % 4 = 1 THEN '1e10' WHEN o_orderkey % 4 = 2 THEN '0.00001' ELSE 'x' END", "CASE WHEN o_orderkey % 4 = 0 THEN concat(o_orderkey, '.5') WHEN o_orderkey % 4 = 1 THEN '10000000000' WHEN o_orderkey % 4 = 2 THEN '0.00001' END")
for _name, _duck in (("md5", "md5(x)"), ("sha1", "sha1(x)"), ("sha256", "sha256(x)")):
    _modifier(f"f_{_name}", _name, "part", "p_partkey", "p_name", f"concat('{_name}:', x)")
    _modifier(f"f_{_name}_documented", _name, "part", "p_partkey", "p_name", _duck, DOCUMENTED)
_where("f_chain", "part", "p_partkey", "{'p_type|reverse|uppercase|startswith': [DRAD, OMORP]}", "p_type IN ('STANDARD', 'PROMO')")
_where("f_case_sensitive", "part", "p_partkey", "{'p_type|cased|contains': ['promo', 'PROMO']}", "contains(p_type, 'PROMO')", REGISTRY)


# JSON events
_alerts("j_simple", "events", ["event_id"], [rule(1, "s", s="{'k|range': '>=50'}")], "SELECT 1 AS rule_id, event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 50", json="props")
_alerts("j_missing", "events", ["event_id"], [rule(1, "not s", s="{'absent|contains': x}")], "SELECT 1 AS rule_id, event_id FROM events", json="props")


def _json(query: str, event: str, selection: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{event} AS event")
        return DetectionEngine.from_rules([rule(1, "s", s=selection)]).alerts(events, "event", ["event_id"])

    QUERIES[query], ORACLE_SQL[query] = run, f"SELECT 1 AS rule_id, event_id FROM events WHERE {oracle}"


_json("j_nested", "concat('{\"a\": {\"b\": ', props, '}}')", "{'a.b.k|range': '10..19'}", "CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 10 AND 19")
_json("j_number_text", "concat('{\"n\": ', event_id, '.0, \"t\": true}')", "{n: ['12.0', '15'], t: 'true'}", "event_id = 12")
_json("j_object_guard", "if(event_id % 2 = 0, concat('{\"a\": ', props, '}'), '{\"a\": \"{k}\"}')", "{'a|contains': 'k'}", "event_id % 2 = 1")
_json("j_bad_json", "if(event_id % 5 = 0, '{\"a\": \"k', '{\"a\": \"k\"}')", "{a: k}", "event_id % 5 <> 0")


def _j_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "parse_json(props) AS event")
    found = DetectionEngine.from_rules([rule(1, "s", s="{'k|range': '<20'}")]).evaluate_variant(events, "event")
    return found.where("size(matched_rules) > 0").select("event_id")


QUERIES["j_variant"] = _j_variant
ORACLE_SQL["j_variant"] = "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) < 20"


# the engine
_THREE = [rule(10, "s", s="{event_type: purchase, 'value|range': '>100'}"), rule(11, "s", s="{event_type: error}"), rule(12, "s and not f", s="{event_type: [view, click]}", f="{'user_id|endswith': ['1', '3']}")]
_THREE_SQL = [
    (10, "event_type = 'purchase' AND value > 100"), (11, "event_type = 'error'"),
    (12, "event_type IN ('view', 'click') AND NOT (suffix(CAST(user_id AS VARCHAR), '1') OR suffix(CAST(user_id AS VARCHAR), '3'))"),
]
_UNION = " UNION ALL ".join(f"SELECT {i} AS rule_id, event_id FROM events WHERE {w}" for i, w in _THREE_SQL)
_alerts("e_multi_rule_alerts", "events", ["event_id"], _THREE, _UNION)
_alerts("e_prefilter_sound", "events", ["event_id"], [*_THREE, rule(13, "not s", s="{event_type: signup}")], _UNION + " UNION ALL SELECT 13, event_id FROM events WHERE event_type <> 'signup'")
_alerts(
    "e_prefilter_reference", "events", ["event_id"], [rule(1, "s", s="{event_type: purchase}"), rule(2, "s", s="{'value|range': '>100'}")],
    "SELECT 1 AS rule_id, event_id FROM events WHERE event_type = 'purchase' UNION ALL SELECT 2, event_id FROM events WHERE event_type = 'purchase' AND value > 100", EngineConfig(prefilter="reference"),
)
_alerts("e_field_mapping", "events", ["event_id"], [rule(1, "s", s="{Kind: signup}")], "SELECT 1 AS rule_id, event_id FROM events WHERE event_type = 'signup'", compiler=lambda: Compiler(FieldMapping(mappings={"Kind": "event_type"})))


def _matched(plan: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = DetectionEngine.from_rules(_THREE, EngineConfig(plan=plan)).evaluate(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value", "user_id"))
        return found.selectExpr("event_id", "array_join(matched_rules, ',') AS matched")

    return run


for _plan in ("inline", "staged", "array"):
    QUERIES[f"e_matched_{_plan}"] = _matched(_plan)
    ORACLE_SQL[f"e_matched_{_plan}"] = "SELECT event_id, concat_ws(',', " + ", ".join(f"CASE WHEN {w} THEN '{i}' END" for i, w in _THREE_SQL) + ") AS matched FROM events"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["e_multi_rule_alerts"](spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES["e_rule_counts"] = _counts
ORACLE_SQL["e_rule_counts"] = f"SELECT rule_id, count(*) AS n FROM ({_UNION}) GROUP BY rule_id"


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = DetectionEngine.from_rules([rule(i, "a and b", a="{event_type: view}", b=f"{{'value|range': '>{i}'}}") for i in range(3)])
    primitives = engine.ruleset.to_df(spark).where("match_type = 'equals'")
    return primitives.selectExpr("primitive_id", "field", "array_join(values, ',') AS vals")


QUERIES["e_shared_primitives"] = _shared
ORACLE_SQL["e_shared_primitives"] = "SELECT CAST(0 AS INT) AS primitive_id, 'event_type' AS field, 'view' AS vals"


def scale_rules(n: int) -> list[str]:
    """n generated rules of four shapes over events."""
    types = ("click", "view", "error", "signup", "purchase")
    shapes = (
        lambda i: rule(i, "a", a=f"{{event_type: {types[i % 5]}, 'value|range': '>{i % 200}'}}"),
        lambda i: rule(i, "a and not b", a=f"{{event_type: [{types[i % 5]}, {types[(i + 2) % 5]}]}}", b=f"{{'user_id|endswith': '{i % 10}'}}"),
        lambda i: rule(i, "a and (b or c)", a=f"{{'user_id|startswith': '{i % 9 + 1}'}}", b=f"{{event_type: {types[i % 5]}}}", c=f"{{'value|range': '{i % 50}..{i % 50 + 20}'}}"),
        lambda i: rule(i, "a or b", a=f"{{user_id: '{i}'}}", b=f"{{event_type: {types[i % 5]}, 'user_id|contains': '{i % 100:02d}'}}"),
    )
    return [shapes[i % 4](i) for i in range(n)]


def scale_sql(n: int) -> str:
    types, u = ("click", "view", "error", "signup", "purchase"), "CAST(user_id AS VARCHAR)"

    def where(i: int) -> str:
        t = types[i % 5]
        return (
            f"event_type = '{t}' AND value > {i % 200}",
            f"event_type IN ('{t}', '{types[(i + 2) % 5]}') AND NOT suffix({u}, '{i % 10}')",
            f"starts_with({u}, '{i % 9 + 1}') AND (event_type = '{t}' OR value BETWEEN {i % 50} AND {i % 50 + 20})",
            f"{u} = '{i}' OR (event_type = '{t}' AND contains({u}, '{i % 100:02d}'))",
        )[i % 4]

    return "SELECT rule_id, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS rule_id FROM events WHERE {where(i)}" for i in range(n)) + ") GROUP BY rule_id"


def scale_query(n: int, plan: str = "auto") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = DetectionEngine.from_rules(scale_rules(n), EngineConfig(plan=plan)).evaluate(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value", "user_id"))
        return found.select(F.explode_outer("matched_rules").alias("rule_id")).where("rule_id IS NOT NULL").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))

    return run


for _n in (10, 100, 300):
    QUERIES[f"e_scale_{_n}_rules"], ORACLE_SQL[f"e_scale_{_n}_rules"] = scale_query(_n), scale_sql(_n)


def _find(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = DetectionEngine.from_rules([rule(1, "s", s="{'p_name|contains': [ar, e]}")])
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return LiteralPrefilter(engine.ruleset.primitives).find_matches(part, "p_partkey", "p_name").selectExpr("p_partkey", "pattern", "start", "end AS stop")


QUERIES["e_find_matches"] = _find
ORACLE_SQL["e_find_matches"] = (
    "SELECT p_partkey, CASE WHEN substr(p_name, CAST(i AS INT), 1) = 'e' THEN 'e' ELSE 'ar' END AS pattern, CAST(i - 1 AS INT) AS start, CAST(CASE WHEN substr(p_name, CAST(i AS INT), 1) = 'e' THEN i ELSE i + 1 END AS INT) AS stop "
    "FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part) WHERE substr(p_name, CAST(i AS INT), 1) = 'e' OR substr(p_name, CAST(i AS INT), 2) = 'ar'"
)


def _find_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in all fields of an event, with their primitives."""
    engine = DetectionEngine.from_rules([rule(1, "s", s="{event_type: click, 'props|contains': k}")])
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "props")
    return LiteralPrefilter(engine.ruleset.primitives).find_matches(events, "event_id").selectExpr("event_id", "field", "pattern", "start", "array_join(primitive_ids, ',') AS ids")


def _literals(query: str, make: Callable[[LiteralPrefilter], str], oracle: str) -> None:
    """A column made by a prefilter's SQL over events."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = DetectionEngine.from_rules([rule(1, "s", s="{event_type: [click, view], 'props|contains': 'none of this'}")])
        return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{make(LiteralPrefilter(engine.ruleset.primitives))} AS found")

    QUERIES[query], ORACLE_SQL[query] = run, f"SELECT event_id, {oracle} AS found FROM events"


QUERIES["e_find_matches_event"] = _find_anywhere
ORACLE_SQL["e_find_matches_event"] = (
    "SELECT event_id, 'event_type' AS field, 'click' AS pattern, CAST(0 AS INT) AS start, '0' AS ids FROM events WHERE event_type = 'click' "
    "UNION ALL SELECT event_id, 'props', 'k', CAST(strpos(props, 'k') - 1 AS INT), '1' FROM events"
)
_literals("e_prefilter_has_match", lambda f: f.has_match("event_type"), "event_type IN ('click', 'view')")
_literals("e_prefilter_matches", lambda f: f.matches(["event_type", "CAST(user_id AS STRING)"]), "event_type IN ('click', 'view')")
_literals("e_prefilter_raw", lambda f: f.matches_raw("concat(event_type, props)"), "event_type IN ('click', 'view')")


# values of modifiers' documented forms
_modifier("f_json_extract_path", "json_extract:$.k", "events", "event_id", "props", "json_extract_string(x, '$.k')", {"json_extract:$.k": documented("json_extract:$.k")})
_modifier("f_xml_extract_path", "xml_extract:/a/b", "part", "p_partkey", "concat('<a><b>', p_size, '</b><c>', p_brand, '</c></a>')", "regexp_extract(x, '<b>(.*?)</b>', 1)", {"xml_extract:/a/b": documented("xml_extract:/a/b")})
_modifier("f_regex_extract_pattern", "regex_extract:t([a-z]+)", "events", "event_id", "concat('at', event_type)", "substr(x, 3)", {"regex_extract:t([a-z]+)": documented("regex_extract:t([a-z]+)")})
_modifier("f_gzip_decode_base64", "gzip_decode:base64", "part", "p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN 'H4sIAAAAAAAC/8tIzcnJBwCGphA2BQAAAA==' ELSE 'aGk=' END", "CASE WHEN p_partkey % 2 = 0 THEN 'hello' END", {"gzip_decode:base64": documented("gzip_decode:base64")})
_modifier("f_unix_timestamp_documented", "unix_timestamp", "events", "event_id", "concat('2024-01-', CASE WHEN event_id % 2 = 0 THEN '02' ELSE '03' END, ' 00:00:10')", "CASE WHEN event_id % 2 = 0 THEN '1704153610' ELSE '1704240010' END", DOCUMENTED)
_modifier("f_iso_timestamp_documented", "iso_timestamp", "events", "event_id", "concat('2024-01-02 03:04:', CASE WHEN event_id % 2 = 0 THEN '05' ELSE '59' END)", "concat(replace(x, ' ', 'T'), 'Z')", DOCUMENTED)
for _name, _given in (("utf16le_decode", "concat(p_type, chr(0))"), ("utf16be_decode", "concat(chr(0), left(p_type, 1))")):
    _modifier(f"f_{_name}_documented", _name, "part", "p_partkey", "concat(left(p_type, 1), chr(0))" if _name == "utf16le_decode" else _given, "replace(x, chr(0), '')", DOCUMENTED)
_modifier("f_utf16_decode_documented", "utf16_decode", "part", "p_partkey", "concat(chr(0), left(p_type, 1), chr(0), 'x')", "replace(x, chr(0), '')", DOCUMENTED)


# keywords of modifiers, in rules
def _keyword(query: str, keyword: str, made: str, value: str, where: str) -> None:
    """A rule whose field, an expression over events, is decoded before it is compared."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{made} AS x")
        return DetectionEngine.from_rules([rule(1, "s", s=f"{{'x|{keyword}': {value}}}")], EngineConfig(semantics="documented")).alerts(events, keep=["event_id"])

    QUERIES[query], ORACLE_SQL[query] = run, f"SELECT 1 AS rule_id, event_id FROM events WHERE {where}"


_keyword("k_base64", "base64", "base64(CAST(event_type AS BINARY))", "click", "event_type = 'click'")
_keyword("k_base64_contains", "base64|contains", "base64(CAST(event_type AS BINARY))", "ie", "event_type = 'view'")
_keyword("k_base64offset", "base64offset", "concat('=', base64(CAST(event_type AS BINARY)))", "error", "event_type = 'error'")
_keyword("k_wide", "wide", "regexp_replace(event_type, '(.)', concat('$1', chr(0)))", "view", "event_type = 'view'")
_keyword("k_utf16le", "utf16le", "regexp_replace(event_type, '(.)', concat('$1', chr(0)))", "view", "event_type = 'view'")
_keyword("k_utf16be", "utf16be", "regexp_replace(event_type, '(.)', concat(chr(0), '$1'))", "signup", "event_type = 'signup'")
_keyword("k_utf16", "utf16", "regexp_replace(event_type, '(.)', concat(chr(0), '$1'))", "signup", "event_type = 'signup'")
_keyword("k_json_extract", "json_extract:$.k", "props", "'7'", "json_extract_string(props, '$.k') = '7'")


# building an engine, and what it tells of itself
def _own_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match type, a modifier and fields of one's own."""
    builder = DetectionEngine.builder().register_match("longer", lambda v, values, modifiers, fold: f"length({v}) > {int(values[0])}")
    builder = builder.register_modifier("shout", lambda x: f"concat(upper({x}), '!')").with_field_extractor(lambda path: "event_type" if path == "Kind" else None)
    engine = builder.with_config(EngineConfig(semantics="documented")).build([rule(1, "a or b", a="{'Kind|shout': 'VIEW!'}", b="{'Kind|shout|contains': 'PUR'}")])
    engine.ruleset.primitives.append(Primitive("Kind", "longer", ("5",)))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    rows = engine.evaluate_primitive(events, 2).withColumnRenamed("matched", "long")
    return engine.evaluate(rows).selectExpr("event_id", "long", "size(matched_rules) = 1 AS found")


QUERIES["e_own_parts"] = _own_parts
ORACLE_SQL["e_own_parts"] = "SELECT event_id, length(event_type) > 5 AS long, event_type IN ('view', 'purchase') AS found FROM events"


def _told(query: str, make: Callable[[], list[tuple[str, str]]], oracle: list[tuple[str, str]]) -> None:
    """Facts of an engine or a builder, as rows (name, value)."""
    QUERIES[query] = lambda spark, sf_dir: spark.createDataFrame(make(), "name string, value string")
    ORACLE_SQL[query] = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in oracle) + ") t(name, value)"


def _seen_by_hooks() -> list[tuple[str, str]]:
    seen: list[tuple[str, str]] = []
    builder = DetectionEngine.builder().with_literal_extraction(lambda v, s: seen.append(("literal", f"{v} {s}"))).with_value_extraction(lambda f, v, literal: seen.append((f, f"{v} {literal}")))
    for phase in Phase:
        builder.register_hook(phase, lambda c: seen.append((c.phase.name.lower(), f"{c.rule_id} {c.rule_name} {c.raw_field} {c.literal_value_count} {c.is_summary}")))
    builder.with_compiler(Compiler(FieldMapping(mappings={"Kind": "event_type"}))).build(["title: one\n" + rule(4, "s", s="{Kind: [view, 'c*'], 'value|startswith': '1'}")])
    return [*seen, ("hooks", str(builder.total_hook_count)), ("discovery", str(builder.hook_count(Phase.PRIMITIVE_DISCOVERY)))]


_told("e_hooks", _seen_by_hooks, [
    ("pre_compilation", "4 one  0 True"), ("event_type", "view False"), ("event_type", "c* False"), ("primitive_discovery", "4 one Kind 2 False"), ("literal", "1 0.2"), ("value", "1 True"),
    ("primitive_discovery", "4 one value 1 False"), ("post_compilation", "4 one  0 True"), ("hooks", "5"), ("discovery", "3"),
])


def _builder_facts() -> list[tuple[str, str]]:
    b = DetectionEngine.builder().register_match("longer", lambda *a: "true").register_modifier("shout", lambda x: x)
    return [("match types", str(b.match_type_count)), ("modifiers", str(b.modifier_count)), ("longer", str(b.has_match_type("longer"))), ("other", str(b.has_match_type("other"))), ("shout", str(b.has_modifier("shout"))), ("hooks", str(b.has_hooks(Phase.PRE_COMPILATION)))]


_told("e_registry", _builder_facts, [("match types", "9"), ("modifiers", "35"), ("longer", "True"), ("other", "False"), ("shout", "True"), ("hooks", "False")])


def _graph_facts() -> list[tuple[str, str]]:
    engine = DetectionEngine.from_rules(_THREE)
    dag, s = engine.dag, engine.statistics()
    dag.validate()
    spare = dag.add_node("primitive", 99)
    facts = {"rules": engine.rule_count, "primitives": engine.primitive_count, "has 11": engine.contains_rule(11), "has 9": engine.contains_rule(9), "nodes": s.total_nodes, "results": s.result_nodes, "depth": s.max_depth}
    facts |= {"spare is leaf": dag.is_leaf(spare), "spare is root": dag.is_root(spare), "after optimize": len(dag.optimize().nodes), "of primitives": len(Dag.from_primitives(4).nodes), "no node": dag.get_node(99)}
    return [(k, str(v)) for k, v in facts.items()]


_told("e_graph", _graph_facts, [
    ("rules", "3"), ("primitives", "5"), ("has 11", "True"), ("has 9", "False"), ("nodes", "11"), ("results", "3"), ("depth", "4"), ("spare is leaf", "True"), ("spare is root", "True"),
    ("after optimize", "11"), ("of primitives", "8"), ("no node", "None"),
])


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an evaluation counts as its rows are read."""
    seen = Observation("counters")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value", "user_id")
    DetectionEngine.from_rules(_THREE).evaluate_observed(events, seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, v) for k, v in seen.get.items()], "counter string, n long")


QUERIES["e_counters"] = _counters
_OR = " OR ".join(f"({w})" for _, w in _THREE_SQL)
_TYPES_SEEN = "event_type IN ('purchase', 'error', 'view', 'click')"
ORACLE_SQL["e_counters"] = (
    f"SELECT unnest(['events', 'passed', 'dropped', 'matched', 'matches', 'primitives']) AS counter, unnest([count(*), count(*) FILTER ({_TYPES_SEEN}), count(*) FILTER (NOT {_TYPES_SEEN}), count(*) FILTER ({_OR}), "
    + " + ".join(f"count(*) FILTER ({w})" for _, w in _THREE_SQL) + f", 5 * count(*) FILTER ({_TYPES_SEEN})]) AS n FROM events"
)


# patterns for other filters
def _ruleset():
    return DetectionEngine.from_rules(scale_rules(40)).ruleset


QUERIES["x_pattern_frequency"] = lambda spark, sf_dir: pattern_frequency(_ruleset().to_df(spark)).where("length(value) > 3")
ORACLE_SQL["x_pattern_frequency"] = (
    "SELECT value, count(*) AS freq, CAST(0.1 AS DOUBLE) AS sel FROM (SELECT DISTINCT i % 5 AS a, CASE WHEN i % 4 = 1 THEN 1 ELSE 0 END AS pair FROM range(40) t(i)) r, "
    "(VALUES (0, 'click'), (1, 'view'), (2, 'error'), (3, 'signup'), (4, 'purchase')) v(k, value) WHERE k = a OR (pair = 1 AND k = (a + 2) % 5) GROUP BY value"
)


def _lists(query: str, make: Callable[[FilterIntegration], list[str]], oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = FilterIntegration()
        found.extract(_ruleset().primitives)
        return spark.createDataFrame([(v,) for v in make(found)], "value string")

    QUERIES[query], ORACLE_SQL[query] = run, oracle


_TYPES = "SELECT unnest(['click', 'view', 'error', 'signup', 'purchase']) AS value"
_lists("x_fst_values", lambda f: f.fst_values(), f"SELECT DISTINCT value FROM ({_TYPES} UNION ALL SELECT CAST(i AS VARCHAR) FROM range(40) t(i) WHERE i % 4 = 3 UNION ALL SELECT CAST(i % 10 AS VARCHAR) FROM range(40) t(i) WHERE i % 4 = 1 UNION ALL SELECT CAST(i % 9 + 1 AS VARCHAR) FROM range(40) t(i) WHERE i % 4 = 2)")
_lists("x_selective_patterns", lambda f: f.selective_patterns(0.1), f"{_TYPES} UNION ALL SELECT CAST(i AS VARCHAR) FROM range(40) t(i) WHERE i % 4 = 3")


def _routed() -> FilterIntegration:
    """Sinks filled while rules compile."""
    found = FilterIntegration()
    selections = {"a": "{A: [x, y]}", "b": "{'B|contains': x, 'B|re': 'r+'}", "c": "{'C|startswith|lowercase': z, 'D|endswith': 'p*'}"}
    DetectionEngine.builder().register_hook(Phase.PRIMITIVE_DISCOVERY, found.hook()).build([rule(1, "a and b and c", **selections)])
    return found


_told("x_hook_routing", lambda: [(k, v) for k, values in _routed().values.items() for v in sorted(values)], [
    ("aho_corasick", "x"), ("aho_corasick", "y"), ("aho_corasick", "z"), ("fst", "x"), ("fst", "y"), ("fst", "z"), ("regex", "r+"), ("bloom", "x"), ("bloom", "y"), ("bloom", "z"),
])
_told("x_pattern_order", lambda: [(str(i), f"{v} {s:.3f}") for i, (v, s) in enumerate(_routed().aho_corasick_patterns())], [("0", "x 0.360"), ("1", "y 0.120"), ("2", "z 0.264")])
_told("x_statistics", lambda: [(k, f"{v:.3f}" if isinstance(v, float) else str(v)) for k, v in _routed().statistics().items() if k != "distribution"] + list((k, str(v)) for k, v in _routed().distribution().items()), [
    ("aho_corasick", "3"), ("fst", "3"), ("filter", "0"), ("regex", "1"), ("bloom", "3"), ("xor", "0"), ("zero_copy", "0"), ("average_selectivity", "0.336"), ("most_frequent_field", "A"), ("unique_fields", "3"),
    ("0.1", "1"), ("0.2", "1"), ("0.3", "1"), ("0.6", "1"),
])
