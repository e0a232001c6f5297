"""Match types and modifiers: all cases of a table in one projection."""

import ipaddress
import random

import pytest

from rulewright.errors import CompilationError, DangerousRegexPattern, InvalidCidr, InvalidIpAddress, InvalidRange, InvalidRegex, UnsupportedMatchType
from rulewright.functions import matchers, modifiers, regex
from rulewright.plans.sqltext import sure, text


def values(spark, expressions):
    row = spark.range(1).selectExpr(*[f"{e} AS c{i}" for i, e in enumerate(expressions)]).first()
    return list(row)


MATCHES = [
    ("equals", "abc", ["x", "abc"], [], True), ("equals", "Abc", ["abc"], [], False), ("equals", None, ["abc"], [], False), ("equals", "a'b\\c\n", ["a'b\\c\n"], [], True),
    ("contains", "hello", ["ell"], [], True), ("contains", "hello", [""], [], True), ("contains", None, [""], [], False), ("startswith", "C:\\Win", ["C:\\"], [], True),
    ("endswith", "a\\cmd.exe", ["\\cmd.exe", "x"], [], True), ("endswith", "cmd.exe", ["\\cmd.exe"], [], False),
    ("regex", "abc123", [r"\d+$"], [], True), ("regex", "abc1\n", [r"\d$"], [], False), ("regex", "foo\rbar", ["foo.bar"], [], True), ("regex", "٣", [r"^\d$"], [], True),
    ("regex", "x", ["(?=x)", "x"], [], False), ("regex", "x", ["x", "(?=x)"], [], True), ("regex", "aZ", ["(?i)^Az$"], [], True), ("regex", "É", ["(?i)é"], [], True),
    ("regex", "ab", ["[[:alpha:]]{2}"], [], True), ("regex", "€", [r"\x{20AC}"], [], True), ("regex", "a$b", [r"a\$b"], [], True), ("regex", "a$", ["a[$]"], [], True), ("regex", "k1", ["(?P<n_m>k)1"], [], True),
    ("cidr", "192.168.1.7", ["192.168.1.0/24"], [], True), ("cidr", "192.168.2.7", ["192.168.1.0/24"], [], False), ("cidr", "10.1.2.3", ["10.255.255.255/8"], [], True),
    ("cidr", "255.255.255.255", ["0.0.0.0/0"], [], True), ("cidr", "256.1.1.1", ["0.0.0.0/0"], [], False), ("cidr", "01.1.1.1", ["0.0.0.0/0"], [], False), ("cidr", "x", ["0.0.0.0/0"], [], False),
    ("cidr", "10.0.0.1", ["bad", "10.0.0.0/8"], [], False), ("cidr", "10.0.0.1", ["10.0.0.0/8", "bad"], [], True), ("cidr", "2001:db8::1", ["2001:db8::/32"], [], True), ("cidr", "2001:db9::1", ["2001:db8::/32"], [], False),
    ("cidr", "::ffff:10.0.0.1", ["10.0.0.0/8"], [], False), ("cidr", "10.0.0.1", ["::/0"], [], False),
    ("range", "15", ["10..20"], [], True), ("range", "20", ["10..20"], [], True), ("range", "20", ["10...20"], [], False), ("range", "19.9", ["10...20"], [], True), ("range", "5", [">=5"], [], True),
    ("range", "5", ["<5"], [], False), ("range", "4.5", ["<5"], [], True), ("range", "42", ["42"], [], True), ("range", "42.0", ["42"], [], True), ("range", " 42", ["42"], [], False), ("range", "1.0f", [">0"], [], False),
    ("range", "abc", [">0"], [], False), ("range", "7", ["x..9", "7"], [], False), ("range", "9223372036854775807", ["9223372036854775807"], [], True), ("range", "-3", ["-5..-1"], [], True), ("range", "nan", ["5"], [], True),
    ("range", "1e3", ["1000"], [], True), ("range", "inf", [">1"], [], True), ("range", "", [">1"], [], False),
    ("fuzzy", "hello", ["hallo"], [], True), ("fuzzy", "hello", ["world"], [], False), ("fuzzy", "hello", ["help"], ["fuzzy:0.5"], True), ("fuzzy", "hello", ["help"], ["fuzzy:9"], False), ("fuzzy", "", [""], [], True),
    ("fuzzy", "", ["a"], [], False), ("fuzzy", "né", ["ne"], ["fuzzy:0.66"], True), ("range_dash", "150", ["100-200"], [], True), ("range_dash", "99", ["100-200"], [], False), ("fuzzy_threshold", "hello", ["help"], ["threshold:0.5"], True),
    ("exact", "a", ["a"], [], True),
]


def test_match_types(spark):
    sql = []
    for name, v, xs, mods, _ in MATCHES:
        field = "CAST(NULL AS STRING)" if v is None else text(v)
        sql.append(sure(matchers.matcher(name, "documented")(field, xs, mods, False)))
    got = values(spark, sql)
    assert [(m[:4], g) for m, g in zip(MATCHES, got, strict=True) if m[4] != g] == []


def test_folding(spark):
    cases = [("equals", "ABC", ["abc"], True), ("contains", "xABCx", ["abc"], True), ("startswith", "É", ["é"], False), ("endswith", "Az", ["Z"], True), ("regex", "A", ["a"], False)]
    got = values(spark, [sure(matchers.matcher(n, "registry")(text(v), xs, [], True)) for n, v, xs, _ in cases])
    assert got == [c[3] for c in cases]


def test_long_lists(spark):
    xs = [f"k{i}" for i in range(100)]
    assert values(spark, [sure(matchers.contains(text(v), xs)) for v in ("a k99 b", "q")]) == [True, False]


def test_errors():
    for value, error in (("10.0.0.0", InvalidCidr), ("10.0.0.0/33", InvalidCidr), ("300.0.0.0/8", InvalidIpAddress), ("::/129", InvalidCidr)):
        with pytest.raises(error):
            matchers.parse_cidr(value)
    for pattern in ("(?=a)", "(?<!a)b", r"(a)\1", "a++", "[a", "\\", "(?U)a", "(?R)a"):
        with pytest.raises(InvalidRegex):
            regex.to_java(pattern)
    with pytest.raises(DangerousRegexPattern):
        regex.to_java("(.*)+.*.*")
    with pytest.raises(DangerousRegexPattern):
        regex.to_java("|".join("abcdefghijklmnopq"))
    assert regex.to_java("|".join("abcdefghijklmnopq"), reject_dangerous=False)
    with pytest.raises(InvalidRange):
        matchers._range(lambda sign, bound: "", "a..b")
    with pytest.raises(UnsupportedMatchType):
        matchers.matcher("odd", "registry")
    assert matchers.matcher("odd", "engine") is matchers.equals
    assert str(InvalidCidr("x")) == "Invalid CIDR notation: x" and str(CompilationError("y")) == "Compilation error: y"
    assert [regex.complexity_class(p) for p in ("abc", "a|b|c", "a.*.*b", "(.*)+x|y")] == ["simple", "medium", "complex", "dangerous"]


MODIFIED = [
    ("base64_decode", "aGVsbG8=", "hello"), ("base64_decode", "aGVsbG8", None), ("base64_decode", "/w==", None), ("base64_decode", "a b=", None), ("base64offset_decode", "=+aGk=", "hi"), ("base64offset_decode", "----", None),
    ("url_decode", "hello%20world", "hello%20world"), ("url_decode", "%41%42c", "ABc"), ("url_decode", "%E9", "é"), ("url_encode", "a b~é/", "a%20b~%E9%2F"), ("utf16_decode", "x", "x"), ("wide_decode", "a\0b\0", "ab"),
    ("html_decode", "&lt;a&gt; &amp;quot; &#x27;&#x2F;&#39;", "<a> \" '/'"), ("lowercase", "ÀB", "àb"), ("uppercase", "àb", "ÀB"), ("trim", "\u2003 a b\t\n", "a b"), ("reverse", "añb", "bña"),
    ("normalize_whitespace", "  a \t\n b ", "a b"), ("remove_whitespace", " a b\u00a0c ", "abc"), ("normalize_path", "C:\\a\\\\b///c", "C:/a/b//c"), ("basename", "C:\\a/b.exe", "b.exe"), ("basename", "a/", ""), ("dirname", "a\\b/c", "a/b"), ("dirname", "c", "."),
    ("hex_decode", "68 65-6C6c6f", "hello"), ("hex_decode", "686", None), ("hex_decode", "zz", None), ("hex_decode", "ff", None), ("hex_encode", "hé", "68c3a9"), ("json_normalize", "{\n\t\"a\":  1}", "{\"a\": 1}"), ("csv_extract", "\"\"a\"\",b", "a"),
    ("to_int", " +42 ", "42"), ("to_int", "4.2", None), ("to_int", "9223372036854775808", None), ("to_float", "1.0", "1"), ("to_float", "1e10", "10000000000"), ("to_float", "1.5e-7", "0.00000015"), ("to_float", "-12345678.25", "-12345678.25"), ("to_float", "x", None), ("to_float", "0.0", "0"),
    ("md5", "x", "md5:x"), ("sha1", "x", "sha1:x"), ("sha256", "x", "sha256:x"), ("json_extract", "{}", "{}"),
]


def test_modifiers(spark):
    got = values(spark, [modifiers.COMPAT[m](text(x)) for m, x, _ in MODIFIED])
    assert [(m, g) for m, g in zip(MODIFIED, got, strict=True) if m[2] != g] == []
    got = values(spark, [modifiers.DOCUMENTED[m](text(x)) for m, x in (("url_decode", "a%20b"), ("md5", "x"), ("sha1", "x"), ("sha256", ""), ("base64_offset_decode", "=+aGk="), ("unix_timestamp", "1970-01-01 00:01:00"))])
    assert got == ["a b", "9dd4e461268c8034f5c8564e155c67a6", "11f6ad8ec52a2984abaafd7c3b516503785c2072", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "hi", "60"]
    assert len(modifiers.COMPAT) == 34


def test_ipv6_addresses_against_the_definition(spark):
    r = random.Random(7)
    words = lambda n: ":".join(f"{r.randrange(65536):x}" if r.random() < 0.7 else r.choice(["0", "0000", "FFFF", "00a"]) for _ in range(n))
    texts = ["::", "::1", "1::", ":", ":::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "::1.2.3.4", "::1.2.3.400", "1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", "", "::ffff:0.0.0.0", "1::1.2.3.4:5", " ::1", "1:", ":1", "1:2:3:4:5:6:7:"]
    for _ in range(150):
        n = r.randrange(8)
        texts += [words(8), f"{words(n)}::{words(max(0, 7 - n - r.randrange(1, 4)))}"]
    networks = ["::/0", "fe80::/10", "::/96", "::ffff:0:0/96", "1::/16", "1:2:3:4::/64", "1:2:3:4:5:6::/95", "::1/128", "8000::/1", "ffff::/16", "0:0:0:0:8000::/65"]

    def inside(address, network):
        try:
            ip = ipaddress.IPv6Address(address)
            return ip.scope_id is None and ip in ipaddress.ip_network(network)
        except ValueError:
            return False

    df = spark.createDataFrame(list(enumerate(texts)), "n int, ip string")
    got = df.selectExpr("n", *[f"coalesce({matchers.cidr('ip', [x])}, false) AS m{i}" for i, x in enumerate(networks)]).collect()
    assert {(x.n, i) for x in got for i in range(len(networks)) if x[f"m{i}"]} == {(n, i) for n, t in enumerate(texts) for i, x in enumerate(networks) if inside(t, x)}
