"""Values kept as JSON texts: one column type for strings, numbers, lists and objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """A string as a JSON text."""
    return F.to_json(text.cast("variant"))


def text_of(value: Column) -> Column:
    """A JSON text's value as a string: strings without their quotes, others as written; null for null."""
    parsed = F.try_parse_json(value)
    return F.when(is_string(value), F.try_variant_get(parsed, "$", "string")).when(value != "null", value)


def is_string(value: Column) -> Column:
    return value.startswith('"')


def is_bool(value: Column) -> Column:
    return value.isin("true", "false")


def is_list(value: Column) -> Column:
    return F.coalesce(value.startswith("["), F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(value.startswith("{"), F.lit(False))


def elements(value: Column) -> Column:
    """The elements of a JSON list as JSON texts; null if it is none."""
    items = F.try_variant_get(F.try_parse_json(value), "$", "array<variant>")
    return F.when(is_list(value), F.transform(items, lambda x: F.to_json(x)))


def field(value: Column, name: str) -> Column:
    """A field of a JSON object as a JSON text; null if it is missing or null."""
    found = F.to_json(F.try_variant_get(F.try_parse_json(value), f"$['{name}']", "variant"))
    return F.when(found != "null", found)


def first_filled(attributes: Column, *keys: str) -> Column:
    """The first key's value that is neither missing, null nor the empty string."""
    values = [F.element_at(attributes, F.lit(k)) for k in keys]
    return F.coalesce(*[F.when(~v.isin("null", '""'), v) for v in values])


def lenient_count(value: Column) -> Column:
    """A count: whole numbers, integral decimals and strings of digits; null for booleans, negative numbers and others."""
    digits = F.regexp_extract(value, r'^"?\s*\+?([0-9]+)(?:\.0+)?\s*"?$', 1)
    whole = ~(is_string(value) & F.contains(value, F.lit(".")))  # a string with a decimal point is no count
    return F.when(whole & (digits != ""), digits.try_cast("long"))


def lenient_decimal(value: Column) -> Column:
    """An amount; null for booleans and whatever is no number."""
    return F.when(~is_bool(value), F.trim(text_of(value)).try_cast("decimal(12,6)"))


def clipped(text: Column, limit: int) -> Column:
    """The first `limit` characters; null if there are none."""
    return F.nullif(F.substring(text, 1, limit), F.lit(""))


def unwrapped(value: Column) -> Column:
    """A string that holds a JSON object or list is that object or list."""
    inner = F.trim(text_of(value))
    parsed = F.to_json(F.try_parse_json(inner))
    return F.when(is_string(value) & inner.rlike(r"^[\[{]") & parsed.isNotNull(), parsed).otherwise(value)


def as_object(value: Column) -> Column:
    """Objects as they are, other values as {"value": ...}."""
    return F.when(value.isNotNull(), F.when(is_object(value), value).otherwise(F.concat(F.lit('{"value":'), value, F.lit("}"))))


def object_of(pairs: Column) -> Column:
    """A JSON object from an array of (key, value), values being JSON texts."""
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["key"]), F.lit(":"), p["value"])), ","), F.lit("}"))
