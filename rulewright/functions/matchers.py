"""Match types: SQL of whether a field's text matches any of a primitive's values; NULL where the field has no text."""

from __future__ import annotations

import ipaddress
import math
import re
from collections.abc import Callable, Sequence

from ..errors import InvalidCidr, InvalidIpAddress, InvalidRange, InvalidThreshold, RuleError, UnsupportedMatchType
from ..plans.sqltext import any_of, text
from .regex import to_java

#: fn(field SQL, values, modifiers, folds case) -> SQL
Matcher = Callable[[str, Sequence[str], Sequence[str], bool], str]

#: Values from which a list is searched by a higher-order function instead of a chain of OR.
LONG_LIST = 40
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])[.]){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
_FLOAT = r"^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?(?:inf|infinity|nan)$"


def _folded(v: str, values: Sequence[str], fold: bool) -> tuple[str, list[str]]:
    """Field and values with A to Z lowered if case is folded: ASCII only."""
    if not fold:
        return v, list(values)
    return f"translate({v}, '{_UPPER}', '{_LOWER}')", [x.translate(_FOLD) for x in values]


def equals(v: str, values: Sequence[str], modifiers: Sequence[str] = (), fold: bool = False) -> str:
    v, values = _folded(v, values, fold)
    return f"{v} IN ({', '.join(map(text, values))})" if values else "false"


def _by(function: str) -> Matcher:
    def match(v: str, values: Sequence[str], modifiers: Sequence[str] = (), fold: bool = False) -> str:
        v, values = _folded(v, values, fold)
        if len(values) >= LONG_LIST:
            return f"exists(array({', '.join(map(text, values))}), x -> {function}({v}, x))"
        return any_of([f"{function}({v}, {text(x)})" for x in values])

    return match


contains, startswith, endswith = _by("contains"), _by("startswith"), _by("endswith")


def _valid(values: Sequence[str], make: Callable[[str], str]) -> list[str]:
    """SQL of the values before the first invalid one: an error there hides those after it."""
    out = []
    for x in values:
        try:
            out.append(make(x))
        except RuleError:
            break
    return out


def regex(v: str, values: Sequence[str], modifiers: Sequence[str] = (), fold: bool = False, reject_dangerous: bool = True) -> str:
    return any_of(_valid(values, lambda x: f"{v} RLIKE {text(to_java(x, reject_dangerous))}"))


def address_number(v: str) -> str:
    """SQL of a dotted quad's number; NULL for anything else."""
    terms = " + ".join(f"CAST(substring_index(substring_index({v}, '.', {i + 1}), '.', -1) AS BIGINT) * {256 ** (3 - i)}L" for i in range(4))
    return f"IF({v} RLIKE {text(_V4)}, {terms}, NULL)"


_GROUPS = "(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"


def address_groups(v: str) -> str:
    """SQL of an IPv6 address as groups with at most one ``::``, a dotted quad at its end as two groups; NULL where that quad is none."""
    tail = f"substring_index({v}, ':', -1)"
    quad = f"concat(left({v}, length({v}) - length({tail})), hex(shiftright({address_number(tail)}, 16)), ':', hex({address_number(tail)} & 65535L))"
    return f"IF(contains({v}, '.'), IF(contains({v}, ':'), {quad}, NULL), {v})"


def address_digits(groups: str) -> str:
    """SQL of the 32 hexadecimal digits of an IPv6 address given as groups; NULL for anything else."""
    count = lambda x: f"IF({x} = '', 0, length({x}) - length(replace({x}, ':', '')) + 1)"
    before, after = f"substring_index({groups}, '::', 1)", f"substring_index({groups}, '::', -1)"
    pad = lambda x: f"regexp_replace(regexp_replace({x}, '([0-9A-Fa-f]+)', '000$1'), '0*([0-9A-Fa-f]{{4}})(:|$)', '$1')"
    whole = f"{groups} RLIKE '^(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$'"
    short = f"{groups} RLIKE '^{_GROUPS}::{_GROUPS}$' AND {count(before)} + {count(after)} <= 7"
    return f"CASE WHEN {whole} THEN {pad(groups)} WHEN {short} THEN concat({pad(before)}, repeat('0000', 8 - {count(before)} - {count(after)}), {pad(after)}) END"


def address_half(digits: str, second: bool) -> str:
    """SQL of 64 bits of an IPv6 address given as digits."""
    return f"CAST(conv({'right' if second else 'left'}({digits}, 16), 16, -10) AS BIGINT)"


def parse_cidr(value: str) -> ipaddress.IPv4Network | ipaddress.IPv6Network:
    address, slash, length = value.partition("/")
    if not slash or not re.fullmatch(r"\+?[0-9]{1,3}", length):
        raise InvalidCidr(value)
    try:
        ip = ipaddress.ip_address(address)
    except ValueError as e:
        raise InvalidIpAddress(address) from e
    if int(length) > ip.max_prefixlen or "%" in address:
        raise InvalidCidr(value)
    return ipaddress.ip_network((ip, int(length)), strict=False)


#: SQL of a field's text to what networks are compared with: its IPv4 number and the halves of its IPv6 address.
ADDRESS = {"n": address_number, "h": lambda v: address_half(address_digits(address_groups(v)), False), "l": lambda v: address_half(address_digits(address_groups(v)), True)}


def address_parts(values: Sequence[str]) -> list[str]:
    """The parts of an address that a list of networks needs."""
    found = [parse_cidr(x) for x in _valid(values, lambda x: parse_cidr(x) and x)]
    need = {"n": any(n.version == 4 for n in found), "h": any(n.version == 6 for n in found), "l": any(n.version == 6 and n.prefixlen > 64 for n in found)}
    return [k for k, wanted in need.items() if wanted]


def in_networks(values: Sequence[str], part: Callable[[str], str]) -> str:
    """SQL of whether an address, of which part gives SQL of the parts, is in any of the networks."""

    def signed(n: int) -> str:
        return f"CAST('{n - 2**64 if n >= 2**63 else n}' AS BIGINT)"

    def one(x: str) -> str:
        network = parse_cidr(x)
        start, length = int(network.network_address), network.prefixlen
        if network.version == 4:
            return f"shiftright({part('n')}, {32 - length}) = {start >> 32 - length}L"
        high, low = start >> 64, start & 2**64 - 1
        if length == 0:
            return f"({part('h')} IS NOT NULL)"
        if length <= 64:
            return f"shiftrightunsigned({part('h')}, {64 - length}) = {signed(high >> 64 - length)}"
        return f"({part('h')} = {signed(high)} AND shiftrightunsigned({part('l')}, {128 - length}) = {signed(low >> 128 - length)})"

    return any_of(_valid(values, one))


def cidr(v: str, values: Sequence[str], modifiers: Sequence[str] = (), fold: bool = False) -> str:
    return in_networks(values, lambda part: f"({ADDRESS[part](v)})")


def _number(x: str) -> int | float:
    if re.fullmatch(r"[+-]?[0-9]+", x) and -(2**63) <= int(x) < 2**63:
        return int(x)
    if re.fullmatch(_FLOAT, x, re.I):
        return float(x)
    raise InvalidRange(x)


def _compare(v: str, sign: str, bound: int | float) -> str:
    """A comparison as whole numbers if both are, else as doubles; NaN compares as equal to all."""
    whole = f"IF({v} RLIKE '^[+-]?[0-9]+$', try_cast({v} AS BIGINT), NULL)"
    real = f"IF({v} RLIKE {text('(?i)' + _FLOAT)}, try_cast({v} AS DOUBLE), NULL)"
    equal = "true" if sign in ("=", ">=", "<=") else "false"
    if isinstance(bound, float) and math.isnan(bound):
        return f"IF({real} IS NOT NULL, {equal}, NULL)"
    number = f"CAST('{bound!r}' AS DOUBLE)"
    as_double = f"CASE WHEN isnan({real}) THEN {equal} WHEN {real} IS NOT NULL THEN {real} {sign} {number} END"
    if isinstance(bound, float):
        return as_double
    whole_bound = f"{bound}L" if bound > -(2**63) else "(-9223372036854775807L - 1L)"
    return f"CASE WHEN {whole} IS NOT NULL THEN {whole} {sign} {whole_bound} ELSE {as_double} END"


def _typed(x: str, whole: bool) -> Callable[[str, int | float], str]:
    """Comparisons of a numeric column itself; of NaN as of its text."""

    def compare(sign: str, bound: int | float) -> str:
        if whole and isinstance(bound, int):
            return f"{x} {sign} {bound}L" if bound > -(2**63) else f"{x} {sign} (-9223372036854775807L - 1L)"
        equal = "true" if sign in ("=", ">=", "<=") else "false"
        if isinstance(bound, float) and math.isnan(bound):
            return f"IF({x} IS NOT NULL, {equal}, NULL)"
        number = f"CAST('{bound!r}' AS DOUBLE)"
        if whole:
            return f"CAST({x} AS DOUBLE) {sign} {number}"
        # NaN is greater than all numbers here, and by its text equal to all
        return f"({x} {sign} {number} AND NOT isnan({x}))" if equal == "false" else f"({x} {sign} {number} OR isnan({x}))"

    return compare


def _range(compare: Callable[[str, int | float], str], value: str) -> str:
    for sign in (">=", "<=", ">", "<"):
        if value.startswith(sign):
            return compare(sign, _number(value[len(sign) :]))
    for dots, upper in (("...", "<"), ("..", "<=")):
        if dots in value:
            low, high = value.split(dots, 1)
            return f"({compare('>=', _number(low))} AND {compare(upper, _number(high))})"
    return compare("=", _number(value))


def number_range(v: str, values: Sequence[str], modifiers: Sequence[str] = (), fold: bool = False) -> str:
    """``a..b`` with both ends, ``a...b`` without the upper one, ``>=x``, ``<=x``, ``>x``, ``<x`` or ``x``."""
    return any_of(_valid(values, lambda x: _range(lambda sign, bound: _compare(v, sign, bound), x)))


def column_range(x: str, whole: bool, values: Sequence[str]) -> str:
    """The same of a numeric column, which a scan can evaluate."""
    return any_of(_valid(values, lambda value: _range(_typed(x, whole), value)))


def dash_range(v: str, values: Sequence[str], modifiers: Sequence[str] = (), fold: bool = False) -> str:
    """``a-b`` with both ends, as doubles."""

    def one(x: str) -> str:
        low, dash, high = x.partition("-")
        if not dash:
            raise InvalidRange(x)
        return f"({_compare(v, '>=', float(_number(low)))} AND {_compare(v, '<=', float(_number(high)))})"

    return any_of(_valid(values, one))


def similarity(v: str, value: str) -> str:
    """1 less edits in characters over the longer one's bytes; 1 for equal texts, 0 if one is empty."""
    x = text(value)
    return f"CASE WHEN {v} = {x} THEN 1D WHEN {v} = '' OR {x} = '' THEN 0D ELSE 1 - levenshtein({v}, {x}) / greatest(octet_length({v}), octet_length({x})) END"


def _threshold(modifiers: Sequence[str], label: str, strict: bool) -> float:
    out = 0.8
    for m in modifiers:
        if m.startswith(label + ":"):
            try:
                given = float(m[len(label) + 1 :])
            except ValueError as e:
                if strict:
                    raise InvalidThreshold(m[len(label) + 1 :]) from e
                continue
            if 0 <= given <= 1:
                out = given
                if not strict:
                    break
    return out


def fuzzy(v: str, values: Sequence[str], modifiers: Sequence[str] = (), fold: bool = False) -> str:
    """Similarity of at least 0.8, or of what a modifier ``fuzzy:x`` gives."""
    least = _threshold(modifiers, "fuzzy", False)
    return any_of([f"({similarity(v, x)}) >= {least!r}D" for x in values])


def fuzzy_threshold(v: str, values: Sequence[str], modifiers: Sequence[str] = (), fold: bool = False) -> str:
    """The same with a modifier ``threshold:x``."""
    least = _threshold(modifiers, "threshold", True)
    return any_of([f"({similarity(v, x)}) >= {least!r}D" for x in values])


MATCHERS: dict[str, Matcher] = {"equals": equals, "contains": contains, "startswith": startswith, "endswith": endswith, "regex": regex, "cidr": cidr, "range": number_range, "fuzzy": fuzzy}
#: Match types that are reached by name only.
EXTRA: dict[str, Matcher] = {"exact": equals, "range_dash": dash_range, "fuzzy_threshold": fuzzy_threshold}
LITERAL = ("equals", "exact", "contains", "startswith", "endswith")


def matcher(name: str, semantics: str, own: dict[str, Matcher] | None = None) -> Matcher:
    """By name; an unknown one is an error, or equality where semantics is engine."""
    found = (own or {}).get(name) or MATCHERS.get(name) or (EXTRA.get(name) if semantics != "registry" else None)
    if found is None and semantics == "engine":
        return equals
    if found is None:
        raise UnsupportedMatchType(name)
    return found
