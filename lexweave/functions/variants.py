"""Fields that come in several forms, as variants: an object or its name, a list or one value, a cell of any type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def named(value: Column, *names: str) -> Column:
    """The first filled field of the names (by default ``name``) of an object, or the value itself where it is a plain one; null for lists and null."""
    kind = F.schema_of_variant(value)
    fields = [F.nullif(_get(value, f"$.{name}", "string"), F.lit("")) for name in names or ("name",)]
    return F.when(kind.startswith("OBJECT"), F.coalesce(*fields)).when(~kind.startswith("ARRAY"), _get(value, "$", "string"))


def listed(value: Column) -> Column:
    """The elements of a list as texts, or one plain value as a list of one; null for objects and null."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("ARRAY"), _get(value, "$", "array<string>")).when(~kind.startswith("OBJECT") & (kind != "VOID"), F.array(_get(value, "$", "string")))


def _boxed(value: Column) -> Column:
    """A plain value as a variant; null stays null."""
    return F.when(value.isNotNull(), F.variant_get(F.to_variant_object(F.array(value)), "$[0]", "variant"))


def cell(text: Column) -> Column:
    """A CSV cell as a variant: true or false, a whole number, a number, a JSON list or object, else the trimmed text; null where it is empty or says so."""
    value = F.trim(text)
    low = F.lower(value)
    truth = F.when(low.isin("true", "false"), low == "true")
    number = F.when(~low.rlike(r"[\d.][df]$"), value.try_cast("double"))
    as_json = F.when(value.rlike(r"^[\[{]"), F.try_parse_json(value))
    typed = F.coalesce(_boxed(truth), _boxed(value.try_cast("bigint")), _boxed(number), as_json, _boxed(value))
    return F.when(~low.isin("", "null", "none", "n/a"), typed)


def kind(value: Column) -> Column:
    """What a variant holds: bool, int, float, list, object or text; null for null."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (name == "VOID"), None)
        .when(name == "BOOLEAN", "bool")
        .when(name == "BIGINT", "int")
        .when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "float")
        .when(name.startswith("ARRAY"), "list")
        .when(name.startswith("OBJECT"), "object")
        .otherwise("text")
    )
