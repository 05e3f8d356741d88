"""JSON texts as VARIANT: kinds of values, keys, values set by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELDS = "map<string,variant>"


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once a row, however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def kind(value: Column) -> Column:
    """object, array, string, number, boolean or null, of a VARIANT; null of none."""
    return _let(
        F.schema_of_variant(value),
        lambda name: F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .when(name.isNotNull(), "number"),
    )


def parsed(text: Column) -> Column:
    """A VARIANT of a JSON text; null if it is none."""
    return F.try_parse_json(text)


def fields(text: Column) -> Column:
    """map key -> VARIANT of a JSON object; null for anything else."""
    return _fields(parsed(text))


def _fields(value: Column) -> Column:
    return F.try_variant_get(value, F.lit("$"), _FIELDS)


def exploded(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep` and (key, kind, value as JSON text) for every field of the objects in a column."""
    each = rows.select(*keep, F.explode(fields(F.col(text))).alias("key", "value"))
    return each.select(*keep, "key", F.coalesce(kind(F.col("value")), F.lit("null")).alias("kind"), F.coalesce(F.to_json("value"), F.lit("null")).alias("value"))


def with_value(text: Column, path: tuple[str, ...], value: Column) -> Column:
    """The JSON text with `value` (a JSON text) at a path of keys; objects on the way are made where there are none.

    The text is parsed once, however long the path: each step takes its object's fields from the VARIANT above.
    """
    return F.to_json(_put(parsed(text), path, value))


def _put(inside: Column, path: tuple[str, ...], value: Column) -> Column:
    key, rest = path[0], path[1:]

    def put(now):
        inner = F.to_variant_object(_put(F.try_element_at(now, F.lit(key)), rest, value)) if rest else F.parse_json(value)
        return F.map_concat(F.map_filter(now, lambda k, _: k != key), F.create_map(F.lit(key), inner))

    return _let(F.coalesce(_fields(inside), F.create_map().cast(_FIELDS)), put)
