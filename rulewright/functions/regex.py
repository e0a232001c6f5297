"""Regular expressions of rules, in Java's dialect.

Rules are written for a linear-time engine: no look-around, back-references or possessive quantifiers; ``\\d``, ``\\w`` and
``\\s`` are Unicode; ``$`` is the very end; ``.`` stops at line feeds alone.
"""

from __future__ import annotations

import re

from ..errors import DangerousRegexPattern, InvalidRegex

_UNSUPPORTED = re.compile(r"\(\?(?:=|!|<=|<!|>)|[*+?}]\+")
# Names of bracketed classes.
_POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}",
    "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}


def complexity(pattern: str) -> int:
    """A cost estimate; 16 and more is refused as dangerous."""
    score = 10 * (".*.*" in pattern or ".+.+" in pattern)
    score += 15 * ("(.*)+" in pattern or "(.+)+" in pattern)
    score += pattern.count("|")
    score += 5 * any(x in pattern for x in ("(?=", "(?!", "(?<=", "(?<!"))
    return score + pattern.count("[") // 2 + 3 * (len(pattern) > 100)


def complexity_class(pattern: str) -> str:
    score = complexity(pattern)
    return "simple" if score <= 1 else "medium" if score <= 7 else "complex" if score <= 15 else "dangerous"


def to_java(pattern: str, reject_dangerous: bool = True) -> str:
    """The pattern for rlike. Raises InvalidRegex or DangerousRegexPattern."""
    if reject_dangerous and complexity(pattern) >= 16:
        raise DangerousRegexPattern(pattern)
    bare = re.sub(r"\\.", "", pattern, flags=re.S)
    bare = re.sub(r"\[\^?\]?(?:\[:\w+:\]|[^\]])*\]", "[]", bare)
    if _UNSUPPORTED.search(bare) or re.search(r"\\[1-9]|\\k<", re.sub(r"\\\\", "", pattern)):
        raise InvalidRegex(pattern)
    multiline = bool(re.search(r"\(\?[a-zA-Z]*m", bare))
    out, i, in_class = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise InvalidRegex(pattern)
            if m := re.match(r"\\[xu]\{([0-9a-fA-F]+)\}", pattern[i:]):
                out.append(f"\\x{{{m[1]}}}")
                i += m.end()
                continue
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            if m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:]):
                if m[2] not in _POSIX:
                    raise InvalidRegex(pattern)
                name = _POSIX[m[2]]
                out.append(name.replace("\\p", "\\P").replace("\\w", "\\W") if m[1] else name)
                i += m.end()
                continue
            in_class += (c == "[") - (c == "]")
        elif c == "[":
            in_class = 1
            if m := re.match(r"\[\^?\]", pattern[i:]):
                out.append(m[0][:-1] + "\\]")
                i += m.end()
                continue
        elif c == "$" and not multiline:
            out.append("\\z")
            i += 1
            continue
        elif c == "(" and (m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])):
            out.append(f"(?<{m[1].replace('_', 'U')}>")
            i += m.end()
            continue
        elif c == "(" and (m := re.match(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]*))?([:)])", pattern[i:])):
            on, off = m[1], m[2] or ""
            if "U" in on or "U" in off or "R" in on:
                raise InvalidRegex(pattern)  # swapped greed and CRLF mode have no counterpart
            on += "u" * ("i" in on and "u" not in on)
            out.append(f"(?{on}{'-' + off if off else ''}{m[3]}")
            i += m.end()
            continue
        out.append(c)
        i += 1
    if in_class:
        raise InvalidRegex(pattern)
    java = "(?dU)" + "".join(out)
    from pyspark import SparkContext

    if (context := SparkContext._active_spark_context) is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(java)
        except Exception as e:
            raise InvalidRegex(pattern) from e
    return java
