"""Where events and rules come from: fields of rows, JSON text or variants as text, and rule files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import types as T

from ..plans.sqltext import name, text


def double_text(x: str) -> str:
    """SQL of a double's shortest text: a point always, an exponent from 1e16 and below 1e-5 only."""
    digits = f"replace(substring_index(abs({x}), 'E', 1), '.', '')"
    digits = f"if({digits} = '0', '0', rtrim('0', {digits}))"
    power = f"CAST(substring_index(CAST(abs({x}) AS STRING), 'E', -1) AS INT)"
    sign = f"if({x} < 0, '-', '')"
    large = f"concat({sign}, if(length({digits}) - 1 <= {power}, concat(rpad({digits}, {power} + 1, '0'), '.0'), concat(left({digits}, {power} + 1), '.', substr({digits}, {power} + 2))))"
    small = f"concat({sign}, '0.', repeat('0', -{power} - 1), {digits})"
    plain = f"CAST({x} AS STRING)"
    odd = f"replace(replace(lower({plain}), '.0e', 'e'), 'infinity', 'inf')"
    return f"CASE WHEN NOT contains({plain}, 'E') THEN {plain} WHEN abs({x}) >= 1e7D AND abs({x}) < 1e16D THEN {large} WHEN abs({x}) >= 1e-5D AND abs({x}) < 1D THEN {small} ELSE {odd} END"


class ColumnSource:
    """Fields are columns; a dotted field walks structs. Arrays, maps, structs, binary and missing fields have no text."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def _find(self, path: str) -> tuple[str, T.DataType] | None:
        kind, sql = self.schema, []
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            kind = kind[part].dataType
            sql.append(name(part))
        return ".".join(sql), kind

    def number(self, path: str) -> tuple[str, bool] | None:
        """(SQL, whether it is whole) of a numeric column, whose comparisons need no text."""
        found = self._find(path)
        if found is None or not isinstance(found[1], (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType)):
            return None
        return found[0], not isinstance(found[1], T.DoubleType)

    def field(self, path: str) -> str:
        found = self._find(path)
        if found is None:
            return "CAST(NULL AS STRING)"
        sql, kind = found
        if isinstance(kind, T.StringType):
            return sql
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return double_text(f"CAST({sql} AS DOUBLE)" if isinstance(kind, T.FloatType) else sql)
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType, T.NullType)):
            return "CAST(NULL AS STRING)"
        return f"CAST({sql} AS STRING)"


def _path(path: str) -> str:
    return "$" + "".join(f"['{part}']" for part in path.split("."))


class JsonSource:
    """Fields are members of the JSON object in a string column. Arrays and objects have no text, nor has bad JSON."""

    def __init__(self, column: str):
        self.column = name(column)

    def field(self, path: str) -> str:
        return self.finished(path, self.raw(path))

    def raw(self, path: str) -> str:
        """SQL of the member's text, an array's or an object's too."""
        return "CAST(NULL AS STRING)" if "'" in path else f"get_json_object({self.column}, {text(_path(path))})"

    def finished(self, path: str, got: str) -> str:
        """SQL of the field from SQL of ``raw``: what begins like an array or an object is looked at again."""
        if "'" in path:
            return got
        at = text(_path(path).replace("['", '["').replace("']", '"]'))
        kind = f"schema_of_variant(try_variant_get(try_parse_json({self.column}), {at}, 'variant'))"
        return f"CASE WHEN left({got}, 1) IN ('{{', '[') AND {kind} RLIKE '^(OBJECT|ARRAY)' THEN NULL ELSE {got} END"


class VariantSource:
    """Fields are members of the object in a variant column. Whole numbers have no point, whatever the JSON text had."""

    def __init__(self, column: str):
        self.column = name(column)

    def field(self, path: str) -> str:
        at = text("$" + "".join(f'["{part}"]' for part in path.replace('"', "").split(".")))
        kind = f"schema_of_variant(try_variant_get({self.column}, {at}, 'variant'))"
        return f"CASE WHEN {kind} RLIKE '^(OBJECT|ARRAY)' THEN NULL ELSE try_variant_get({self.column}, {at}, 'string') END"


class CustomSource:
    """Fields by a function of the path that returns SQL of a string, falling back on another source for None."""

    def __init__(self, extractor, otherwise):
        self.extractor, self.otherwise = extractor, otherwise

    def field(self, path: str) -> str:
        return self.extractor(path) or self.otherwise.field(path)


class StagedSource:
    """Another source's fields, of which some are columns already: each text is made once, however many predicates use it.

    addresses: columns of parts of addresses, by field and part.
    """

    def __init__(self, source, columns: dict[str, str], addresses: dict[tuple[str, str], str] | None = None):
        self.source, self.columns, self.addresses = source, columns, addresses or {}

    def number(self, path: str) -> tuple[str, bool] | None:
        return number(self.source, path)

    def field(self, path: str) -> str:
        return self.columns.get(path) or self.source.field(path)


def number(source, path: str) -> tuple[str, bool] | None:
    """The source's numeric column for a field, if it has such."""
    return source.number(path) if hasattr(source, "number") else None


def rules_from_dir(folder: str) -> list[str]:
    """Texts of all .yml and .yaml files under a folder, by path."""
    return [p.read_text(encoding="utf-8") for p in sorted(Path(folder).rglob("*")) if p.suffix in (".yml", ".yaml")]


def rules_from_spark(spark, path: str) -> list[str]:
    """The same from any file system that Spark reads. Rules are collected: the driver plans with them."""
    return [r.value for r in spark.read.text(path, wholetext=True).collect()]
