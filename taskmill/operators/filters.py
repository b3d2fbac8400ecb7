"""Rows that a filter document asks for, over columns and JSON documents. The definition is our own.

A filter is a dict. A field's value is a scalar, which it must equal, or a dict of conditions, all of
which must hold; `$and`, `$or`, `$nor` take lists of filters, all else that begins with `$` is
refused. Conditions: `$eq $ne $gt $gte $lt $lte $in $nin $exists $regex $size`, and `$not` of
conditions. A field is a column, or else a path of names and list places (a.b.0) in the document.

Types are kept apart: a number is compared with numbers only, a text with texts, a truth value with
truth values, and what isn't there with none. Equal to null is what is null or isn't there.
`$ne`, `$nin`, `$not` and `$nor` hold wherever their opposite doesn't.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ORDER = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b, "$eq": lambda a, b: a == b}


class FilterError(ValueError):
    """A filter that has no meaning."""


def _true(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


class _Field:
    """A field as a column of each type that it can be compared by; null where it is of another."""

    def __init__(self, df: DataFrame, name: str, document: Column | None):
        self.kind = df.schema[name].dataType if name in df.columns else None
        if self.kind is not None:
            self.value = df[name]
            self.there, self.empty = F.lit(True), self.value.isNull()
            return
        if document is None:
            raise FilterError(f"no column {name}, and no document")
        if not re.fullmatch(r"[^.\[\]'\"$]+(\.[^.\[\]'\"$]+)*", name):
            raise FilterError(f"not a path: {name}")
        self.path = "$" + "".join(f"[{x}]" if x.isdigit() else f"['{x}']" for x in name.split("."))
        self.document = document
        self.value = F.try_variant_get(document, self.path, "variant")
        self.there = self.value.isNotNull()
        self.empty = ~self.there | _true(F.is_variant_null(self.value))
        self.shape = F.schema_of_variant(self.value)

    def as_like(self, other) -> Column:
        number, text, truth = isinstance(other, (int, float)) and not isinstance(other, bool), isinstance(other, str), isinstance(other, bool)
        if not (number or text or truth):
            raise FilterError(f"can't compare with {other!r}")
        if self.kind is not None:
            fits = number and isinstance(self.kind, T.NumericType) or text and isinstance(self.kind, T.StringType) or truth and isinstance(self.kind, T.BooleanType)
            return self.value if fits else F.lit(None).cast("double" if number else "string" if text else "boolean")
        if number:
            return F.when(self.shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(self.document, self.path, "double"))
        name = "STRING" if text else "BOOLEAN"
        return F.when(self.shape == name, F.try_variant_get(self.document, self.path, name.lower()))

    def size(self) -> Column:
        if self.kind is not None:
            return F.array_size(self.value) if isinstance(self.kind, T.ArrayType) else F.lit(None).cast("int")
        return F.when(self.shape.startswith("ARRAY"), F.array_size(F.try_variant_get(self.document, self.path, "array<variant>")))


def _condition(field: _Field, op: str, value) -> Column:
    if op in ("$eq", "$ne"):
        equal = field.empty if value is None else field.as_like(value) == F.lit(value)
        return equal if op == "$eq" else ~_true(equal)
    if op in _ORDER:
        return _ORDER[op](field.as_like(value), F.lit(value))
    if op in ("$in", "$nin"):
        if not isinstance(value, (list, tuple)):
            raise FilterError(f"{op} takes a list")
        kinds: dict[type, list] = {}
        for x in value:
            kinds.setdefault(float if type(x) is int else type(x), []).append(x)
        found = F.lit(False)
        for kind, items in kinds.items():
            found = found | (field.empty if kind is type(None) else field.as_like(items[0]).isin(*items))
        return found if op == "$in" else ~_true(found)
    if op == "$exists":
        return field.there if value else ~field.there
    if op == "$regex":
        return field.as_like("").rlike(str(value))
    if op == "$size":
        return field.size() == int(value)
    if op == "$not":
        return ~_true(_conditions(field, value))
    raise FilterError(f"unknown condition {op}")


def _conditions(field: _Field, given) -> Column:
    if not isinstance(given, dict):
        return _condition(field, "$eq", given)
    out = F.lit(True)
    for op, value in given.items():
        out = out & _condition(field, op, value)
    return out


def compiled(df: DataFrame, query: dict, document: Column | None = None) -> Column:
    """The filter as one Column of built-in functions, true where it holds, else false or null (so that
    Spark can push it down). document: a VARIANT, if paths are to be used."""
    if not isinstance(query, dict):
        raise FilterError("a filter is a dict")
    out = F.lit(True)
    for name, given in query.items():
        if name in ("$and", "$or", "$nor"):
            if not isinstance(given, (list, tuple)):
                raise FilterError(f"{name} takes a list")
            made = F.lit(name == "$and")
            for x in given:
                one = compiled(df, x, document)
                made = made & one if name == "$and" else made | one
            out = out & (~_true(made) if name == "$nor" else made)
        elif name.startswith("$"):
            raise FilterError(f"unknown operator {name}")
        else:
            out = out & _conditions(_Field(df, name, document), given)
    return out


def matching(df: DataFrame, query: dict, json_column: str | None = None) -> DataFrame:
    """Rows of df that the filter holds for; paths look into the JSON text of json_column, which
    has none where it can't be parsed. Conditions on columns reach the scan."""
    return df.filter(compiled(df, query, F.try_parse_json(df[json_column]) if json_column else None))
