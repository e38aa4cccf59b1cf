"""Metadata filters compiled to boolean Columns over VARIANT metadata.

A filter is a flat list of conditions joined by AND (operator 0) or OR (any other value).
A condition on a missing or null field is false for every operator, neq included. Values
of different types, and booleans, arrays and objects, compare as equal in gt/gte/lt/lte
and range (on_type_mismatch="equal"); "no_match" makes such comparisons false. Numbers
are one domain, DOUBLE. Fields are dotted paths through nested objects.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

AND, OR = 0, 1


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class MetadataFilter:
    conditions: list[Condition] = field(default_factory=list)
    operator: int = AND

    @staticmethod
    def of(raw: dict | None) -> MetadataFilter | None:
        """From a request's JSON, with keys in any letter case."""
        if raw is None:
            return None
        low = {k.lower(): v for k, v in raw.items()}
        conditions = [{k.lower(): v for k, v in c.items()} for c in low.get("conditions") or []]
        return MetadataFilter([Condition(c.get("field", ""), c.get("operator", ""), c.get("value")) for c in conditions], low.get("operator") or AND)


def equals(name: str, value: Any) -> Condition:
    return Condition(name, "eq", value)


def in_range(name: str, gte: Any = None, lte: Any = None) -> Condition:
    return Condition(name, "range", {k: v for k, v in (("gte", gte), ("lte", lte)) if v is not None})


def all_of(*conditions: Condition) -> MetadataFilter:
    return MetadataFilter(list(conditions), AND)


def any_of(*conditions: Condition) -> MetadataFilter:
    return MetadataFilter(list(conditions), OR)


def field_at(v: Column, dotted: str) -> Column:
    """The variant at a dotted path; null where a step is missing or no object.

    Steps whose names a path cannot quote, such as empty ones, are looked up in a map.
    """
    steps = ""
    for name in dotted.split("."):
        quote = next((q for q in "'\"" if name and q not in name), None)
        if quote:
            steps += f"[{quote}{name}{quote}]"
        else:
            v = F.try_variant_get(v, "$" + steps, "map<string,variant>")
            v, steps = F.try_element_at(v, F.lit(name)), ""
    return F.try_variant_get(v, "$" + steps, "variant") if steps else v


class _Value:
    """A variant expression with its type tests."""

    def __init__(self, v: Column):
        self.v = v
        self.type = F.schema_of_variant(v)
        self.present = v.isNotNull() & ~F.is_variant_null(v)
        self.is_string = self.type == "STRING"
        self.is_number = self.type.isin("BIGINT", "DOUBLE", "FLOAT") | self.type.startswith("DECIMAL")
        self.string = F.try_variant_get(v, "$", "string")
        self.number = F.when(self.is_number, F.try_variant_get(v, "$", "double"))

    def equals(self, value: Any) -> Column:
        if value is None:
            return F.lit(False)
        if isinstance(value, bool):
            return (self.type == "BOOLEAN") & (F.try_variant_get(self.v, "$", "boolean") == value)
        if isinstance(value, (int, float)):
            return self.is_number & (self.number == float(value))
        if isinstance(value, str):
            return self.is_string & (self.string == value)
        if isinstance(value, (list, tuple)):
            parts = F.try_variant_get(self.v, "$", "array<variant>")
            same = [F.coalesce(_Value(F.get(parts, F.lit(i))).same(x), F.lit(False)) for i, x in enumerate(value)]
            return reduce(lambda a, b: a & b, same, self.type.startswith("ARRAY") & (F.size(parts) == len(value)))
        parts = F.try_variant_get(self.v, "$", "map<string,variant>")
        same = [F.coalesce(_Value(F.try_element_at(parts, F.lit(k))).same(x), F.lit(False)) for k, x in value.items()]
        return reduce(lambda a, b: a & b, same, self.type.startswith("OBJECT") & (F.size(parts) == len(value)))

    def same(self, value: Any) -> Column:
        """equals inside arrays and objects, where null equals null."""
        return self.v.isNotNull() & F.is_variant_null(self.v) if value is None else self.equals(value)

    def compare(self, value: Any, mismatch: Column) -> Column:
        """-1, 0 or 1; mismatch where the types differ or have no order."""
        if value is None:
            return F.lit(1)
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            sign = F.when(self.number < float(value), -1).when(self.number > float(value), 1).otherwise(0)
            return F.when(self.is_number, sign).otherwise(mismatch)
        if isinstance(value, str):
            sign = F.when(self.string < value, -1).when(self.string > value, 1).otherwise(0)
            return F.when(self.is_string, sign).otherwise(mismatch)
        return mismatch


def condition_column(metadata: Column, c: Condition, on_type_mismatch: str = "equal") -> Column:
    x = _Value(field_at(metadata, c.field))
    mismatch = F.lit(0 if on_type_mismatch == "equal" else None).cast("int")
    op = c.operator
    if op == "eq":
        found = x.equals(c.value)
    elif op == "neq":
        found = ~F.coalesce(x.equals(c.value), F.lit(False))
    elif op in ("gt", "gte", "lt", "lte"):
        sign = x.compare(c.value, mismatch)
        found = {"gt": sign > 0, "gte": sign >= 0, "lt": sign < 0, "lte": sign <= 0}[op]
    elif op == "range":
        if not isinstance(c.value, dict):
            return F.lit(False)
        found = F.lit(True)
        if "gte" in c.value:
            found = found & (x.compare(c.value["gte"], mismatch) >= 0)
        if "lte" in c.value:
            found = found & (x.compare(c.value["lte"], mismatch) <= 0)
    elif op == "contains":
        inside = F.exists(F.try_variant_get(x.v, "$", "array<variant>"), lambda e: F.coalesce(_Value(e).equals(c.value), F.lit(False)))
        found = x.type.startswith("ARRAY") & inside
        if isinstance(c.value, str):
            found = F.when(x.is_string, F.contains(x.string, F.lit(c.value))).otherwise(found)
    else:
        return F.lit(False)
    return F.coalesce(x.present & found, F.lit(False))


def filter_column(metadata: Column, f: MetadataFilter | None, on_type_mismatch: str = "equal") -> Column:
    """The whole filter; true without conditions, false for null metadata with some."""
    if f is None or not f.conditions:
        return F.lit(True)
    parts = [condition_column(metadata, c, on_type_mismatch) for c in f.conditions]
    return reduce((lambda a, b: a & b) if f.operator == AND else (lambda a, b: a | b), parts)


#: Names of field types in declared schemas.
FIELD_TYPES = ("string", "number", "bool", "array", "geo")


def field_type(v: Column) -> Column:
    """The detected type of a variant: string, number, bool, array or geo; null is string,
    and so is an object without both lat and lon."""
    t = F.schema_of_variant(v)
    geo = F.try_variant_get(v, "$.lat", "variant").isNotNull() & F.try_variant_get(v, "$.lon", "variant").isNotNull()
    return (
        F.when(t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"), "number").when(t == "BOOLEAN", "bool")
        .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT") & geo, "geo").otherwise("string")
    )


def schema_violations(metadata: Column, schema: dict[str, str]) -> Column:
    """ARRAY<STRING> of declared fields that are present with another type."""
    checks = []
    for name, expected in schema.items():
        v = field_at(metadata, name)
        checks.append(F.when(v.isNotNull() & (field_type(v) != expected), F.lit(name)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
