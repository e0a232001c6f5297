"""Conditions to SQL over the primitives of a ruleset, and plan modes.

``inline``: one projection with all predicates written out. ``staged``: the distinct predicates as columns, then the rules
over them. ``array``: the predicates as one array of booleans, the rules as data: lists of primitives that must and
mustn't hold, searched by higher-order functions; rules that don't fit are written out.
"""

from __future__ import annotations

from fnmatch import fnmatchcase

from ..condition import And, Count, Name, Not, parse
from ..errors import CompilationError, RuleError
from ..ir import CompiledRule, CompiledRuleset

#: Rules that are evaluated within a whole stage's generated method.
WHOLE_STAGE = 8

# The lowered tree: ("p", id), ("and" | "or", [trees]), ("not", tree), ("least", n, [trees])


def _join(kind: str, trees: list) -> tuple:
    return trees[0] if len(trees) == 1 else (kind, trees)


def lower(rule: CompiledRule, semantics: str, strict: bool) -> tuple:
    """The rule's tree over primitive ids. Raises CompilationError for what its semantics has no answer to."""
    documented = semantics == "documented"

    def selection(name: str) -> tuple:
        if not rule.selections.get(name):
            raise CompilationError(f"unknown or empty selection {name!r}")
        return _join("and", [("p", p) for p in rule.selections[name]])

    def count(node: Count) -> tuple:
        names = list(rule.selections)
        if node.pattern is not None:
            names = [n for n in names if fnmatchcase(n, node.pattern)] if documented else [n for n in names if node.pattern in n]
        names = [n for n in names if rule.selections[n]]
        if not names:
            raise CompilationError(f"no selection for {node.pattern or 'them'!r}")
        if documented:
            trees = [selection(n) for n in names]
            if node.n is None or node.n == 1:
                return _join("or" if node.n else "and", trees)
            return ("least", node.n, trees)
        return _join("and" if node.n is None else "or", [("p", p) for n in names for p in rule.selections[n]])

    def walk(node) -> tuple:
        if isinstance(node, Name):
            return selection(node.name)
        if isinstance(node, Not):
            return ("not", walk(node.of))
        if isinstance(node, Count):
            return count(node)
        return ("and" if isinstance(node, And) else "or", [walk(node.left), walk(node.right)])

    return walk(parse(rule.condition, strict=documented or strict))


def lower_all(ruleset: CompiledRuleset, semantics: str, strict: bool) -> tuple[dict[int, tuple], dict[int, str]]:
    """(trees by rule id, reasons of the rules left out); a repeated id's last rule counts."""
    trees, dropped = {}, {}
    for rule in ruleset.rules:
        try:
            trees[rule.rule_id] = lower(rule, semantics, strict)
        except RuleError as e:
            if strict:
                raise
            dropped[rule.rule_id] = str(e)
    return trees, dropped


def to_sql(tree: tuple, leaf) -> str:
    """SQL of a tree; leaf gives that of a primitive id, two-valued."""
    kind = tree[0]
    if kind == "p":
        return leaf(tree[1])
    if kind == "not":
        return f"(NOT {to_sql(tree[1], leaf)})"
    if kind == "least":
        return "(" + " + ".join(f"CAST({to_sql(t, leaf)} AS INT)" for t in tree[2]) + f" >= {tree[1]})"
    return "(" + f" {kind.upper()} ".join(to_sql(t, leaf) for t in tree[1]) + ")"


def primitives_of(tree: tuple) -> set[int]:
    kind = tree[0]
    if kind == "p":
        return {tree[1]}
    return primitives_of(tree[1]) if kind == "not" else set().union(*map(primitives_of, tree[-1]))


def terms_of(tree: tuple, negated: bool = False, limit: int = 16) -> list[tuple[frozenset, frozenset]] | None:
    """The tree as alternatives of (must hold, mustn't hold); None beyond limit."""
    kind = tree[0]
    if kind == "p":
        one = frozenset([tree[1]])
        return [(frozenset(), one) if negated else (one, frozenset())]
    if kind == "not":
        return terms_of(tree[1], not negated, limit)
    if kind == "least":
        return None
    parts = [terms_of(t, negated, limit) for t in tree[1]]
    if any(p is None for p in parts):
        return None
    if (kind == "or") != negated:
        out = [t for p in parts for t in p]
    else:
        out = [(frozenset(), frozenset())]
        for p in parts:
            out = [(a | c, b | d) for a, b in out for c, d in p]
            if len(out) > limit:
                return None
    return out if len(out) <= limit else None


def matched_rules(trees: dict[int, tuple], leaf) -> str:
    """SQL of the sorted array of ids of the rules that hold, by one conditional each.

    A number that is no rule's id marks the others. Removing it stays under code generation with all that the conditionals
    contain, which a higher-order function, as that removes nulls, would not. Beyond WHOLE_STAGE rules an element that always is
    that number has a higher-order function of its own: it keeps the projection out of the stage's single method, which would be
    too large for the JVM to compile, while a projection by itself is generated as many small methods.
    """
    if not trees:
        return "CAST(array() AS ARRAY<INT>)"
    ids = {signed(i) for i in trees}
    none = next(i for i in range(-1, -len(ids) - 2, -1) if i not in ids)
    terms = ", ".join(f"IF({to_sql(trees[i], leaf)}, {as_int(i)}, {none})" for i in sorted(trees, key=signed))
    if len(trees) > WHOLE_STAGE:
        terms += f", IF(size(filter(array({to_sql(next(iter(trees.values())), leaf)}), x -> x)) > 1, 0, {none})"
    return f"array_remove(array({terms}), {none})"


def signed(rule_id: int) -> int:
    """Ids beyond 2**31 - 1 as the int column holds them."""
    return rule_id - 2**32 if rule_id >= 2**31 else rule_id


def as_int(rule_id: int) -> str:
    n = signed(rule_id)
    return "CAST(-2147483648L AS INT)" if n == -(2**31) else str(n)


def matched_by_data(trees: dict[int, tuple], place: dict[int, int], held: str) -> str:
    """The same with rules as data; held is the array of booleans in which place finds primitives."""
    terms, rest = [], {}
    for i, tree in trees.items():
        found = terms_of(tree)
        if found is None:
            rest[i] = tree
        else:
            terms += [(signed(i), sorted(place[p] + 1 for p in a), sorted(place[p] + 1 for p in b)) for a, b in found if not a & b]
    if not terms:
        return matched_rules(rest, lambda p: f"{held}[{place[p]}]")

    def array(xs: list) -> str:
        return f"array({', '.join(map(str, xs))})" if xs else "CAST(array() AS ARRAY<INT>)"

    rules = ", ".join(f"struct({as_int(i)} AS id, {array(a)} AS yes, {array(b)} AS no)" for i, a, b in terms)
    hold = f"filter(array({rules}), r -> forall(r.yes, k -> element_at({held}, k)) AND NOT exists(r.no, k -> element_at({held}, k)))"
    found = f"array_distinct(transform({hold}, r -> r.id))"
    if rest:
        found = f"concat({found}, {matched_rules(rest, lambda p: f'{held}[{place[p]}]')})"
    return f"array_sort({found})"
