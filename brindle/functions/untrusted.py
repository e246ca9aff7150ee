"""Typed reading of JSON that others wrote: what isn't of the wanted type counts as absent.

Texts are parsed once into variants, which keep the types of the JSON: true is
no number, "7" is no number, 5.0 is no whole number.  Texts that aren't JSON, that
name a key of one object twice or hold NaN, give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Variant = Column


def parsed(text: Column | str) -> Variant:
    return F.try_parse_json(text)


def kind(v: Variant, path: str = "$") -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``BIGINT``, ``DECIMAL``, ``DOUBLE``, ``BOOLEAN`` or ``VOID``; null where nothing is."""
    found = v if path == "$" else F.try_variant_get(v, path, "variant")
    return F.regexp_extract(F.schema_of_variant(found), "^[A-Z]+", 0)


def is_a(v: Variant, path: str, *kinds: str) -> Column:
    return F.coalesce(kind(v, path).isin(*kinds), F.lit(False))


def text_at(v: Variant, path: str) -> Column:
    return F.when(is_a(v, path, "STRING"), F.try_variant_get(v, path, "string"))


def whole_at(v: Variant, path: str) -> Column:
    """A whole number of at most 64 bits."""
    return F.when(is_a(v, path, "BIGINT"), F.try_variant_get(v, path, "bigint"))


def number_at(v: Variant, path: str) -> Column:
    return F.when(is_a(v, path, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, path, "double"))


def object_at(v: Variant, path: str = "$") -> Column:
    """map<string, variant> of an object."""
    return F.when(is_a(v, path, "OBJECT"), F.try_variant_get(v, path, "map<string,variant>"))


def list_at(v: Variant, path: str = "$") -> Column:
    """array<variant> of an array."""
    return F.when(is_a(v, path, "ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def has_keys(v: Variant, *keys: str) -> Column:
    """Whether it is an object with exactly these keys."""
    return F.coalesce(F.array_sort(F.map_keys(object_at(v))) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def first_rule(rules: dict[str, Column] | list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule, in order, that holds; a null condition doesn't hold."""
    out = None
    for name, condition in rules.items() if isinstance(rules, dict) else rules:
        holds = F.coalesce(condition, F.lit(False))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise(otherwise)
