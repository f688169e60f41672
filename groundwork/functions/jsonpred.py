"""Typed checks and bounded reads on JSON text and nested records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bounded_number(value: Column, low: float, high: float, kind: str = "double") -> Column:
    """Blank becomes null; otherwise cast and clamp."""
    number = F.nullif(F.trim(value.cast("string")), F.lit("")).try_cast(kind)
    return F.when(number.isNotNull(), F.least(F.lit(high).cast(kind), F.greatest(F.lit(low).cast(kind), number)))


def capped_string(value: Column, limit: int, default: str = "") -> Column:
    """Left part of the value (or the default); blank becomes null."""
    return F.nullif(F.substring(F.coalesce(value, F.lit(default)), 1, limit), F.lit(""))


def json_kind(variant: Column, path: str = "$") -> Column:
    """object / array / boolean / number / string, or null when absent."""
    node = F.try_variant_get(variant, path, "variant")
    shape = F.schema_of_variant(node)
    return (
        F.when(node.isNull(), F.lit(None).cast("string"))
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "STRING", "string")
        .when(shape.isin("VOID"), "null")
        .otherwise("number")
    )


def json_is(variant: Column, path: str, kind: str) -> Column:
    return F.coalesce(json_kind(variant, path) == kind, F.lit(False))


def json_in(variant: Column, path: str, allowed: list[str]) -> Column:
    return F.coalesce(F.try_variant_get(variant, path, "string"), F.lit("")).isin(allowed)


def first_error(*checks: tuple[Column, str]) -> Column:
    """Name of the first check that fails (a check is a condition that must hold)."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for ok, code in checks])


def sane_record(required: dict, optional: dict | None = None, enums: dict | None = None, counts: dict | None = None) -> Column:
    """A struct of checked fields, or null when any required number is missing, not
    finite or out of range, or an optional number is present but out of range.
    Enum values outside their list become empty; counts are rounded and clamped.

    required / optional: name -> (column, low, high); enums: name -> (column, allowed);
    counts: name -> (column, low, high)."""

    def finite(c, low, high):
        return F.coalesce(c.isNotNull() & ~F.isnan(c) & (c >= low) & (c <= high), F.lit(False))

    ok, fields = F.lit(True), []
    for name, (column, low, high) in required.items():
        number = column.cast("double")
        ok = ok & finite(number, low, high)
        fields.append(number.alias(name))
    for name, (column, low, high) in (optional or {}).items():
        number = column.cast("double")
        ok = ok & (column.isNull() | finite(number, low, high))
        fields.append(number.alias(name))
    for name, (column, allowed) in (enums or {}).items():
        fields.append(F.when(column.isin(allowed), column).otherwise("").alias(name))
    for name, (column, low, high) in (counts or {}).items():
        number = F.floor(F.coalesce(column.cast("double"), F.lit(0.0)) + 0.5)
        fields.append(F.least(F.lit(high), F.greatest(F.lit(low), number)).cast("bigint").alias(name))
    return F.when(ok, F.struct(*fields))
