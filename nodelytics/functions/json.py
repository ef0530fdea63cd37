"""Strict reading of JSON records through VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import bound

_CASTS = {"int": "bigint", "number": "double", "string": "string", "bool": "boolean", "array": "array<variant>", "object": "map<string,variant>"}


def record(line: Column) -> Column:
    """The record's VARIANT; null for text that is not one JSON value, or has a key twice."""
    return F.try_parse_json(line)


def _is(v: Column, kind: str) -> Column:
    """Whether a scalar VARIANT has exactly the JSON type."""
    name = F.schema_of_variant(v)
    if kind == "string":
        return name == "STRING"
    if kind == "bool":
        return name == "BOOLEAN"
    whole = (name == "BIGINT") | name.rlike(r"^DECIMAL\(\d+,0\)$")
    return whole if kind == "int" else whole | (name == "DOUBLE") | name.startswith("DECIMAL")


def req(v: Column, path: str, kind: str) -> Column:
    """The value at ``path`` if it is present, not null, and of exactly the JSON type; else null.

    Only a list or an object casts to one, so what is inside them is not walked for their type.
    """
    value = F.try_variant_get(v, path, _CASTS[kind])
    if kind in ("array", "object"):
        return value
    return F.when(_is(F.try_variant_get(v, path, "variant"), kind), value)


def presence(v: Column, path: str) -> Column:
    """``missing``, ``null`` or ``value``."""
    inner = F.try_variant_get(v, path, "variant")
    return F.when(inner.isNull(), "missing").when(F.is_variant_null(inner), "null").otherwise("value")


def envelope(v: Column) -> Column:
    """A parsed ``["<time>", payload]`` as a struct of ``ts`` text and ``payload``; null unless there are exactly two items and the first is text."""
    time = lambda x: req(F.get(x, F.lit(0)), "$", "string")
    return bound(req(v, "$", "array"), lambda x: F.when((F.size(x) == 2) & time(x).isNotNull(), F.struct(time(x).alias("ts"), F.get(x, F.lit(1)).alias("payload"))))


def tagged(payload: Column) -> Column:
    """``["<tag>", args...]`` as a struct of tag, arity and arguments."""
    items = req(payload, "$", "array")
    tag = req(payload, "$[0]", "string")
    return F.when(tag.isNotNull(), F.struct(tag.alias("tag"), F.size(items).alias("arity"), items.alias("items")))


def single_variant(v: Column, path: str = "$") -> Column:
    """``{"Tag": body}`` at ``path`` as a struct of tag and body; exactly one key, and a body that is not null.

    A cast to an object copies all that is inside, so it is made once, and straight from ``v``.
    """
    body = lambda m: F.get(F.map_values(m), F.lit(0))
    return bound(req(v, path, "object"), lambda m: F.when((F.size(m) == 1) & ~F.is_variant_null(body(m)), F.struct(F.get(F.map_keys(m), F.lit(0)).alias("tag"), body(m).alias("body"))))


def digest(v: Column) -> Column:
    """SHA-256 of a canonical form: keys sorted, numbers normalised.  For equality within one run."""
    return F.sha2(F.to_json(v), 256)


def text_array(v: Column, path: str) -> Column:
    """The array at ``path`` if all its items are non-empty text; null otherwise."""
    items = req(v, path, "array")
    good = F.forall(items, lambda x: _is(x, "string") & (F.try_variant_get(x, "$", "string") != ""))
    return F.when(good, F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))
