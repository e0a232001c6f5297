"""Field modifiers: functions from SQL of a string to SQL of a string; NULL where the modifier fails.

Modes: ``compat`` keeps placeholders as they are; ``documented`` does what the names say.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..plans.sqltext import text
from .regex import to_java

Modifier = Callable[[str], str]

SPACE = r"(?U)\\s"


def _base64(x: str) -> str:
    shape = r"'^[A-Za-z0-9+/]*={0,2}$'"
    return f"IF(length({x}) % 4 = 0 AND {x} RLIKE {shape}, try_validate_utf8(CAST(try_to_binary({x}, 'base64') AS STRING)), NULL)"


def _base64_offset(x: str) -> str:
    return "coalesce(" + ", ".join(_base64(f"substr({x}, {i})") for i in (1, 2, 3, 4)) + ")"


def _url_decode(x: str) -> str:
    one = "if(c RLIKE '^%[0-9A-Fa-f]{2}$', chr(CAST(conv(substr(c, 2), 16, 10) AS INT)), c)"
    return f"array_join(transform(regexp_extract_all({x}, '(?s).{{1,3}}', 0), c -> {one}), '')"


def _url_encode(x: str) -> str:
    one = "if(c RLIKE '^[A-Za-z0-9_.~-]$', c, concat('%', upper(lpad(hex(CAST(conv(hex(encode(c, 'UTF-32')), 16, 10) AS BIGINT) & 255), 2, '0'))))"
    return f"array_join(transform(filter(split({x}, ''), c -> c <> ''), c -> {one}), '')"


# Entities in the order in which they are replaced.
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#x27;", "'"), ("&#x2F;", "/"), ("&#39;", "'")]


def _html_decode(x: str) -> str:
    for entity, char in _ENTITIES:
        x = f"replace({x}, {text(entity)}, {text(char)})"
    return x


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '(?U)^\\\\s+|\\\\s+$', '')"


def _hex_decode(x: str) -> str:
    bare = f"translate({x}, ' -', '')"
    return f"IF(length({bare}) % 2 = 0 AND {bare} RLIKE '^[0-9A-Fa-f]*$', try_validate_utf8(CAST(try_to_binary({bare}, 'hex') AS STRING)), NULL)"


def _dirname(x: str) -> str:
    p = f"split({x}, '[/\\\\\\\\]')"
    return f"if(size({p}) > 1, array_join(slice({p}, 1, size({p}) - 1), '/'), '.')"


def _to_int(x: str) -> str:
    t = _trim(x)
    return f"IF({t} RLIKE '^[+-]?[0-9]+$', CAST(try_cast({t} AS BIGINT) AS STRING), NULL)"


def _to_float(x: str) -> str:
    t = _trim(x)
    number = f"try_cast({t} AS DOUBLE)"
    shape = r"'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
    plain = f"CAST({number} AS STRING)"
    digits = f"replace(substring_index(abs({number}), 'E', 1), '.', '')"
    digits = f"if({digits} RLIKE '^0+$', '0', rtrim('0', {digits}))"
    power = f"CAST(substring_index(CAST(abs({number}) AS STRING), 'E', -1) AS INT)"
    sign = f"if({number} < 0, '-', '')"
    large = f"concat({sign}, if(length({digits}) - 1 <= {power}, rpad({digits}, {power} + 1, '0'), concat(left({digits}, {power} + 1), '.', substr({digits}, {power} + 2))))"
    small = f"concat({sign}, '0.', repeat('0', -{power} - 1), {digits})"
    short = f"regexp_replace({plain}, '[.]0$', '')"
    return f"CASE WHEN NOT ({t} RLIKE {shape}) THEN NULL WHEN NOT contains({plain}, 'E') THEN {short} WHEN abs({number}) >= 1D THEN {large} ELSE {small} END"


def _same(x: str) -> str:
    return x


def _prefixed(label: str) -> Modifier:
    return lambda x: f"concat('{label}:', {x})"


def _utf16(charset: str) -> Modifier:
    return lambda x: f"try_validate_utf8(decode(encode({x}, 'ISO-8859-1'), '{charset}'))"


COMPAT: dict[str, Modifier] = {
    "base64_decode": _base64, "base64": _base64, "base64offset_decode": _base64_offset, "url_decode": _url_decode, "url_encode": _url_encode,
    "utf16_decode": _same, "utf16le_decode": _same, "utf16be_decode": _same, "wide_decode": lambda x: f"replace({x}, chr(0), '')", "html_decode": _html_decode,
    "lowercase": lambda x: f"lower({x})", "uppercase": lambda x: f"upper({x})", "trim": _trim, "reverse": lambda x: f"reverse({x})",
    "normalize_whitespace": lambda x: _trim(f"regexp_replace({x}, '{SPACE}+', ' ')"), "remove_whitespace": lambda x: f"regexp_replace({x}, '{SPACE}', '')",
    "normalize_path": lambda x: f"replace(replace({x}, '\\\\', '/'), '//', '/')", "basename": lambda x: f"element_at(split({x}, '[/\\\\\\\\]'), -1)", "dirname": _dirname,
    "hex_decode": _hex_decode, "hex_encode": lambda x: f"lower(hex(encode({x}, 'UTF-8')))", "json_extract": _same,
    "json_normalize": lambda x: f"replace(translate({x}, '\\n\\t', ''), '  ', ' ')", "xml_extract": _same, "csv_extract": lambda x: f"trim(BOTH '\"' FROM substring_index({x}, ',', 1))",
    "to_int": _to_int, "to_float": _to_float, "unix_timestamp": _same, "iso_timestamp": _same, "md5": _prefixed("md5"), "sha1": _prefixed("sha1"), "sha256": _prefixed("sha256"),
    "gzip_decode": _same, "regex_extract": _same,
}

DOCUMENTED: dict[str, Modifier] = COMPAT | {
    "base64_offset_decode": _base64_offset, "url_decode": lambda x: f"try_url_decode({x})", "utf16_decode": _utf16("UTF-16"), "utf16le_decode": _utf16("UTF-16LE"), "utf16be_decode": _utf16("UTF-16BE"),
    "md5": lambda x: f"md5({x})", "sha1": lambda x: f"sha1({x})", "sha256": lambda x: f"sha2({x}, 256)",
    "unix_timestamp": lambda x: f"CAST(unix_timestamp(try_to_timestamp({x})) AS STRING)", "iso_timestamp": lambda x: f"date_format(try_to_timestamp({x}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
}



def _register_gunzip() -> str:
    """The function that decompresses; Spark has none."""
    import pandas as pd
    from pyspark.sql import SparkSession
    from pyspark.sql.functions import pandas_udf

    def gunzip(data):
        import zlib

        def one(x):
            try:
                return None if x is None else zlib.decompress(bytes(x), 31).decode()
            except (zlib.error, UnicodeDecodeError):
                return None

        return pd.Series([one(x) for x in data], dtype=object)

    SparkSession.active().udf.register("rulewright_gunzip", pandas_udf(gunzip, "string"))
    return "rulewright_gunzip"


#: Modifiers that take an argument after a colon, in documented mode: a JSON path, an XPath, a pattern whose first group (or
#: whole match) is taken, and how compressed bytes are written.
WITH_ARGUMENT: dict[str, Callable[[str, str], str]] = {
    "json_extract": lambda x, path: f"get_json_object({x}, {text(path)})",
    "xml_extract": lambda x, path: f"IF({x} RLIKE '^\\\\s*<', xpath_string({x}, {text(path)}), NULL)",
    "regex_extract": lambda x, pattern: f"IF({x} RLIKE {text(to_java(pattern))}, regexp_extract({x}, {text(to_java(pattern))}, {min(1, re.compile(pattern).groups)}), NULL)",
    "gzip_decode": lambda x, form: f"{_register_gunzip()}(try_to_binary({x}, {text(form)}))",
}


def documented(modifier: str) -> Modifier | None:
    """By name, with its argument if it has one."""
    label, colon, argument = modifier.partition(":")
    if colon and label in WITH_ARGUMENT:
        return lambda x: WITH_ARGUMENT[label](x, argument)
    return DOCUMENTED.get(modifier)


#: Names that steer matching and are no functions.
FLAGS = {"case_sensitive", "all"}
