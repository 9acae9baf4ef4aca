"""JSON values as VARIANT columns: dotted paths, a schema check, canonical text, payloads."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The names at which a path may begin; any other begins in the output.
ROOTS = ("output", "input", "expected", "metadata", "state")
#: Variant types of each JSON-schema type.
KINDS = {
    "object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID",
    "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL",
}


class PathError(ValueError):
    pass


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN or VOID (JSON null); null for a missing value."""
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def elements(value: Column) -> Column:
    """The elements of an array, null for other values."""
    return F.try_variant_get(value, "$", "array<variant>")


def member(value: Column, key: str) -> Column:
    """An object's value of a key; a key can't have both kinds of quotes."""
    mark = '"' if "'" in key else "'"
    if mark in key:
        raise PathError(f"both kinds of quotes in {key!r}")
    return F.try_variant_get(value, f"$[{mark}{key}{mark}]", "variant")


def resolve(value: Column, path: str) -> Column:
    """The value at a dotted path, null where there is none. A whole number is a key of an object and a place in an array, from its end if negative."""
    for part in path.split("."):
        if not part:
            raise PathError(f"empty part in {path!r}")
        found = member(value, part)
        if part.removeprefix("-").isdigit():
            index = int(part)
            place = F.try_element_at(elements(value), F.lit(index + 1 if index >= 0 else index))
            found = F.when(kind(value) == "ARRAY", place).otherwise(found)
        value = found
    return value


def rooted(path: str, roots: Mapping[str, Column]) -> Column:
    """A path that begins with one of ROOTS (missing roots are null), or else in the output."""
    head, _, rest = path.partition(".")
    if head not in ROOTS:
        return resolve(roots["output"], path)
    base = roots.get(head, F.lit(None).cast("variant"))
    return resolve(base, rest) if rest else base


def resolve_or(value: Column, path: str, kind_: str, default) -> Column:
    """The value at a path as a type, or the default where it is absent or of another type."""
    return F.coalesce(F.try_variant_get(resolve(value, path), "$", kind_), F.lit(default))


def schema_errors(value: Column, schema: dict, path: str = "$") -> Column:
    """What a value breaks of a JSON schema, as an array of texts. Unknown keywords are passed over; a wrong type hides all else at its place."""
    checks: list[Column] = []
    texts = lambda when, what: F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(f"{path}: {what}")))
    own = kind(value)
    for key in schema.get("required", []):
        checks.append(F.when((own == "OBJECT") & member(value, key).isNull(), F.array(F.lit(f"{path}.{key}: missing"))))
    for key, inner in schema.get("properties", {}).items():
        checks.append(F.when((own == "OBJECT") & member(value, key).isNotNull(), schema_errors(member(value, key), inner, f"{path}.{key}")))
    if schema.get("additionalProperties") is False:
        known = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
        more = F.array_except(F.json_object_keys(F.to_json(value)), known)
        checks.append(F.when(own == "OBJECT", F.transform(more, lambda k: F.concat(F.lit(f"{path}."), k, F.lit(": not allowed")))))
    size, length = F.size(elements(value)), F.length(F.try_variant_get(value, "$", "string"))
    number = F.when(own.rlike(KINDS["number"]), F.try_variant_get(value, "$", "double"))
    is_array, is_text = own == "ARRAY", own == "STRING"
    if "items" in schema:
        checks.append(F.when(is_array, F.flatten(F.transform(elements(value), lambda x: schema_errors(x, schema["items"], f"{path}[]")))))
    for word, broken in (
        ("minItems", lambda n: is_array & (size < n)), ("maxItems", lambda n: is_array & (size > n)),
        ("minLength", lambda n: is_text & (length < n)), ("maxLength", lambda n: is_text & (length > n)),
        ("pattern", lambda p: is_text & ~F.try_variant_get(value, "$", "string").rlike(p)),
        ("minimum", lambda n: number < n), ("maximum", lambda n: number > n),
        ("enum", lambda xs: ~F.to_json(value).isin([json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in xs])),
    ):
        if word in schema:
            checks.append(texts(broken(schema[word]), word))
    none = F.array().cast("array<string>")
    found = F.concat(none, *[F.coalesce(c, none) for c in checks])
    if schema.get("type") in KINDS:
        found = F.when(own.rlike(f"^({KINDS[schema['type']]})$"), found).otherwise(F.array(F.lit(f"{path}: not of type {schema['type']}")))
    return found


def _canonical(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return text

    return texts.map(one)


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and without white space, as itself where it is no JSON. Arrow batches go through Python."""
    return F.pandas_udf(_canonical, StringType())(text)


def args_hash(args: Column) -> Column:
    """16 hex digits for JSON arguments (null: none), whatever the order of their keys."""
    return F.substring(F.sha2(canonical_json(F.coalesce(args, F.lit("{}"))), 256), 1, 16)


def payload(text: Column, mime: Column | None = None) -> Column:
    """A payload as a variant: JSON if the MIME type or the first character says so and it parses, else the raw text."""
    looks = F.ltrim(text).rlike(r"^[\[{]")
    if mime is not None:
        looks = looks | F.coalesce(mime.contains("json"), F.lit(False))
    raw = member(F.try_parse_json(F.to_json(F.struct(text.alias("raw")))), "raw")
    return F.when(looks, F.coalesce(F.try_parse_json(text), raw)).otherwise(raw)


def jsonable(value: Column) -> Column:
    """Any column as JSON text."""
    return F.get_json_object(F.to_json(F.struct(value.alias("v"))), "$.v")


def in_range(value: Column, least=None, most=None, exclusive: bool = False) -> tuple[Column, Column]:
    """(passed, error) of a variant against bounds; what isn't a number, booleans too, is an error and doesn't fail."""
    number = F.when(kind(value).rlike(KINDS["number"]), F.try_variant_get(value, "$", "double"))
    ok = F.lit(True)
    if least is not None:
        ok = ok & ((number > least) if exclusive else (number >= least))
    if most is not None:
        ok = ok & ((number < most) if exclusive else (number <= most))
    return F.when(number.isNotNull(), ok), F.when(number.isNull(), F.concat(F.lit("not a number: "), F.coalesce(kind(value), F.lit("nothing"))))


def set_comparison(actual: Column, expected: Column, mode: str = "equals") -> tuple[Column, Column, Column]:
    """(score, missing, unexpected) of two arrays as sets: equals, subset, superset (1 or 0) or jaccard; two empty sets are equal.

    The lists are sorted and have at most 20 elements.
    """
    missing, more = F.array_except(expected, actual), F.array_except(actual, expected)
    union = F.size(F.array_union(actual, expected))
    score = {
        "equals": (F.size(missing) + F.size(more) == 0).cast("double"),
        "subset": (F.size(more) == 0).cast("double"),
        "superset": (F.size(missing) == 0).cast("double"),
        "jaccard": F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(actual, expected)) / union),
    }[mode]
    return score, F.slice(F.array_sort(missing), 1, 20), F.slice(F.array_sort(more), 1, 20)


def ids(values: Column, key: str = "id") -> Column:
    """Of an array of variants the ids: a key of objects, other elements as text."""
    text = lambda v: F.try_variant_get(v, "$", "string")
    return F.transform(elements(values), lambda v: F.when(kind(v) == "OBJECT", text(member(v, key))).otherwise(text(v)))


def merged(first: Column, *later: Column) -> Column:
    """Maps into one; later ones win."""
    for m in later:
        first = F.map_concat(without_keys_of(first, m), m)
    return first


def without_keys_of(values: Column, other: Column) -> Column:
    return F.map_filter(values, lambda k, v: ~F.map_contains_key(other, k))


def only(values: Column, keys: list[str]) -> Column:
    """A map with the allowed keys only."""
    return F.map_filter(values, lambda k, v: k.isin(keys))


def first_present(values: Column, keys: list[str]) -> Column:
    """The first of a map's keys that has a value that isn't empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(values, F.lit(k)), F.lit("")) for k in keys])


def without(values: Column, keys: list[str]) -> Column:
    """What is left of a map once these keys have been used."""
    return F.map_filter(values, lambda k, v: ~k.isin(keys))
