"""Metadata predicates: a filter document compiled to one Column.

Filter documents follow the operator form {"field": {"$op": value}}, {"field": value} (equality), {"$and": [...]},
{"$or": [...]}, {"$not": {...}}, {"field": {"$geo_radius": {...}}} and {"field": {"$geo_bbox": {...}}}. Several keys in
one document, and several operators on one field, all have to hold. Logic is two-valued: every leaf is false (or, for
ne, nin and a negated exists, true) where its field is missing, before it is combined. A leaf is a plain comparison that
is null for a missing field; it is made two-valued where a negation stands above it or it is true by default. Elsewhere a
filter drops null as it drops false, so comparisons of typed columns reach the Parquet scan as they are.

Fields come from `Fields`: typed top-level columns or paths in a variant or JSON column.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# A fixed value: the number grammar that counts as numeric text.
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


class Field:
    """One metadata field in the forms that comparisons need."""

    def __init__(self, text: Column, number: Column, present: Column, items: Column | None = None, lat: Column | None = None, lon: Column | None = None, is_text: Column | None = None, native: Column | None = None):
        self.native = native  # a numeric column as it is
        self.text, self.number, self.present, self.items, self.lat, self.lon = text, number, present, items, lat, lon
        self.is_text = F.lit(True) if is_text is None else is_text


def numeric(text: Column) -> Column:
    """A string's number, null where it isn't one."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


class Fields:
    """Resolves dotted paths: in `columns` as typed columns, else in the variant column `variant`."""

    def __init__(self, columns: dict[str, str] | None = None, variant: str | Column | None = None):
        self.columns = columns or {}
        self.variant = F.col(variant) if isinstance(variant, str) else variant

    @classmethod
    def of(cls, df: DataFrame, variant: str | None = None) -> Fields:
        return cls({name: kind for name, kind in df.dtypes if name != variant}, variant)

    def __getitem__(self, path: str) -> Field:
        head, _, rest = path.partition(".")
        kind = self.columns.get(head)
        if kind is not None:
            return self._typed(head, rest, kind)
        if self.variant is None:
            none = F.lit(None)
            return Field(none.cast("string"), none.cast("double"), F.lit(False))
        where = "$" + "".join(f"['{p}']" for p in path.split("."))
        got = F.try_variant_get(self.variant, where, "variant")
        text = F.try_variant_get(self.variant, where, "string")
        items = F.try_variant_get(self.variant, where, "array<string>")
        kind_of = F.schema_of_variant(got)
        point = F.try_variant_get(self.variant, where, "array<double>")
        lat = F.coalesce(F.try_variant_get(self.variant, where + ".lat", "double"), F.when(F.size(point) == 2, F.get(point, 0)))
        lon = F.coalesce(F.try_variant_get(self.variant, where + ".lon", "double"), F.when(F.size(point) == 2, F.get(point, 1)))
        return Field(text, numeric(text), got.isNotNull(), items, lat, lon, kind_of == "STRING")

    def _typed(self, head: str, rest: str, kind: str) -> Field:
        column = F.col(head)
        if kind.startswith("map<") and rest:
            value = F.try_element_at(column, F.lit(rest))
            text = value.cast("string")
            return Field(text, numeric(text), F.map_contains_key(column, rest))
        if kind.startswith("struct<") and rest:
            value = column.getField(rest) if "." not in rest else reduce(lambda c, p: c.getField(p), rest.split("."), column)
            text = value.cast("string")
            return Field(text, numeric(text), value.isNotNull())
        if kind.startswith("array<"):
            numbers = column.try_cast("array<double>")
            two = F.size(numbers) == 2
            return Field(F.lit(None).cast("string"), F.lit(None).cast("double"), column.isNotNull(), column.cast("array<string>"), F.when(two, F.get(numbers, 0)), F.when(two, F.get(numbers, 1)), F.lit(False))
        if kind.startswith("struct<") and "lat:" in kind:
            return Field(F.lit(None).cast("string"), F.lit(None).cast("double"), column.isNotNull(), None, column["lat"].cast("double"), column["lon"].cast("double"), F.lit(False))
        text = column.cast("string")
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            return Field(text, column.cast("double"), column.isNotNull(), is_text=F.lit(False), native=column)
        return Field(text, numeric(text) if kind == "string" else F.lit(None).cast("double"), column.isNotNull(), is_text=F.lit(kind == "string"))


def _as_number(value: Any) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value)
    return float(value) if isinstance(value, str) and re.match(NUMBER, value) else None


def _as_text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def _sure(c: Column, missing: bool = False) -> Column:
    return F.coalesce(c, F.lit(missing))


def _literal(number: float) -> Column:
    return F.lit(int(number)) if number.is_integer() and abs(number) < 1 << 31 else F.lit(number)


def equal(field: Field, value: Any) -> Column:
    """Equal as numbers if both are, else as text; null equals only a present null."""
    if value is None:
        return field.present & field.text.isNull()
    number = _as_number(value)
    if number is None:
        return field.text == F.lit(_as_text(value))
    if field.native is not None:
        return field.native == _literal(number)
    return (field.number == F.lit(number)) | (field.text == F.lit(_as_text(value)))


def _ordered(field: Field, value: Any, order: Callable[[Column, Column], Column]) -> Column:
    number = _as_number(value)
    by_text = field.is_text & order(field.text, F.lit(_as_text(value))) if isinstance(value, str) else F.lit(False)
    if number is None:
        return by_text
    if field.native is not None:
        return order(field.native, _literal(number))
    return F.when(field.number.isNotNull(), order(field.number, F.lit(number))).otherwise(by_text)


def greater(field: Field, value: Any) -> Column:
    return _ordered(field, value, operator.gt)


def less(field: Field, value: Any) -> Column:
    return _ordered(field, value, operator.lt)


def at_least(field: Field, value: Any) -> Column:
    """Greater or equal; equality holds for values that have no order, too."""
    return _ordered(field, value, operator.ge) if field.native is not None and _as_number(value) is not None else greater(field, value) | field.present & equal(field, value)


def at_most(field: Field, value: Any) -> Column:
    return _ordered(field, value, operator.le) if field.native is not None and _as_number(value) is not None else less(field, value) | field.present & equal(field, value)


def among(field: Field, values: Any) -> Column:
    if not isinstance(values, (list, tuple)) or not values:
        return F.lit(False)
    numbers = [_as_number(x) for x in values]
    if field.native is not None and None not in numbers:
        return field.native.isin([int(x) if x.is_integer() else x for x in numbers])
    if all(isinstance(x, str) and n is None for x, n in zip(values, numbers, strict=True)):
        return field.text.isin(list(values))
    return reduce(operator.or_, [_sure(equal(field, x)) for x in values])


def contains(field: Field, value: Any) -> Column:
    """Substring of a string, or an element of an array."""
    inside = field.is_text & field.text.contains(_as_text(value)) if isinstance(value, str) else F.lit(False)
    if field.items is None:
        return inside
    number, text = _as_number(value), _as_text(value)
    element = F.exists(field.items, lambda x: _sure(x == F.lit(text)) | (_sure(numeric(x) == F.lit(number)) if number is not None else F.lit(False)))
    return F.when(field.is_text, inside).otherwise(element)


def _haversine(lat: Column, lon: Column, at_lat: float, at_lon: float) -> Column:
    up, across = F.radians(F.lit(at_lat) - lat), F.radians(F.lit(at_lon) - lon)
    a = F.pow(F.sin(up / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(at_lat))) * F.pow(F.sin(across / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


haversine_km = _haversine


def _at_point(field: Field, test: Callable[[Column], Column]) -> Column:
    """A test of a point that is taken from the metadata once, however often the test names it."""
    return F.get(F.transform(F.array(F.struct(field.lat.alias("lat"), field.lon.alias("lon"))), test), 0)


def geo_radius(field: Field, lat: float, lon: float, radius_km: float) -> Column:
    """Within a great-circle distance; false where there is no point."""
    return F.lit(False) if field.lat is None else _at_point(field, lambda p: _haversine(p["lat"], p["lon"], lat, lon) <= F.lit(radius_km))


def geo_bbox(field: Field, top_left: tuple[float, float], bottom_right: tuple[float, float]) -> Column:
    """Inside a box, edges included; boxes don't wrap at the date line."""
    if field.lat is None:
        return F.lit(False)
    return _at_point(field, lambda p: p["lat"].between(bottom_right[0], top_left[0]) & p["lon"].between(top_left[1], bottom_right[1]))


def _point(value: Any) -> tuple[float, float]:
    return (float(value["lat"]), float(value["lon"])) if isinstance(value, dict) else (float(value[0]), float(value[1]))


def _leaf(field: Field, op: str, value: Any) -> tuple[Column, bool]:
    """A comparison, null where it doesn't apply, and what it counts as there."""
    match op.lstrip("$"):
        case "eq":
            return equal(field, value), False
        case "ne":
            return ~equal(field, value), True
        case "gt":
            return greater(field, value), False
        case "gte":
            return at_least(field, value), False
        case "lt":
            return less(field, value), False
        case "lte":
            return at_most(field, value), False
        case "in":
            return among(field, value), False
        case "nin" | "not_in":
            return ~among(field, value), True
        case "contains":
            return contains(field, value), False
        case "startswith" | "starts_with":
            return (field.is_text & field.text.startswith(value) if isinstance(value, str) else F.lit(False)), False
        case "endswith" | "ends_with":
            return (field.is_text & field.text.endswith(value) if isinstance(value, str) else F.lit(False)), False
        case "regex":
            re.compile(value)
            return field.is_text & field.text.rlike(value), False
        case "exists":
            return (field.present == F.lit(value) if isinstance(value, bool) else F.lit(False)), False
        case "geo_radius":
            at = _point(value.get("center", value))
            return geo_radius(field, *at, float(value.get("radius_km", value.get("radius")))), False
        case "geo_bbox":
            return geo_bbox(field, _point(value["top_left"]), _point(value["bottom_right"])), False
    raise ValueError(f"unknown operator {op}")


def compile_filter(document: dict | None, fields: Fields, negated: bool = False) -> Column:
    """The predicate of a filter document; an empty one holds everywhere. Under a negation it is never null."""
    parts: list[Column] = []
    for key, value in (document or {}).items():
        if key in ("$and", "and"):
            parts.append(reduce(operator.and_, [compile_filter(d, fields, negated) for d in value], F.lit(True)))
        elif key in ("$or", "or"):
            parts.append(reduce(operator.or_, [compile_filter(d, fields, negated) for d in value], F.lit(False)))
        elif key in ("$not", "not"):
            parts.append(~compile_filter(value, fields, True))
        else:
            several = isinstance(value, dict) and value and all(k.startswith("$") for k in value)
            for op, x in value.items() if several else [("eq", value)]:
                test, missing = _leaf(fields[key], op, x)
                parts.append(_sure(test, missing) if negated or missing else test)
    return reduce(operator.and_, parts) if parts else F.lit(True)


def from_json(text: str | bytes, fields: Fields) -> Column:
    return compile_filter(json.loads(text) if text else None, fields)


# -- string maps (the older request form) ------------------------------------------------------------------------------


def meta_all(meta: Column, wanted: dict[str, str] | None) -> Column:
    """Every key present with that value; true for none."""
    return reduce(lambda a, b: a & b, [_sure(F.try_element_at(meta, F.lit(k)) == F.lit(v)) for k, v in (wanted or {}).items()], F.lit(True))


def meta_any(meta: Column, clauses: list[dict[str, str]] | None) -> Column:
    """Some clause holds as a whole; true if there is no clause."""
    return reduce(lambda a, b: a | b, [meta_all(meta, c) for c in clauses], F.lit(False)) if clauses else F.lit(True)


def meta_not(meta: Column, unwanted: dict[str, str] | None) -> Column:
    """Not the whole conjunction; true for none."""
    return ~meta_all(meta, unwanted) if unwanted else F.lit(True)


def meta_ranges(meta: Column, ranges: list[dict] | None) -> Column:
    """Inclusive numeric or RFC 3339 time bounds by key; time bounds win where both are given; a value that doesn't parse fails."""

    def one(r: dict) -> Column:
        value = F.try_element_at(meta, F.lit(r["key"]))
        if r.get("time_min") or r.get("time_max"):
            at = F.try_to_timestamp(value)
            low, high = r.get("time_min"), r.get("time_max")
            bounds = [at >= F.to_timestamp(F.lit(low))] if low else []
            bounds += [at <= F.to_timestamp(F.lit(high))] if high else []
        else:
            at = numeric(value)
            bounds = [at >= F.lit(float(r["min"]))] if r.get("min") is not None else []
            bounds += [at <= F.lit(float(r["max"]))] if r.get("max") is not None else []
        return _sure(at.isNotNull() & reduce(lambda a, b: a & b, bounds, F.lit(True)))

    return reduce(lambda a, b: a & b, [one(r) for r in ranges or []], F.lit(True))


def access(tenant: str, collections: list[str] | None = None, admin: bool = False, tenant_column: str = "tenant_id", collection_column: str = "collection") -> Column:
    """Rows of a tenant (a missing one is `default`) in the collections it may read; an administrator reads all."""
    if admin:
        return F.lit(True)
    mine = F.coalesce(F.col(tenant_column), F.lit("default")) == F.lit(tenant)
    return mine & F.col(collection_column).isin(collections) if collections is not None else mine


def parse_time(text: Column) -> Column:
    """A timestamp in one of four layouts: RFC 3339, date, date and time, RFC 1123; null for other texts."""
    mail = F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(text)),
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))),
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))),
        F.when(mail != "", F.try_to_timestamp(mail, F.lit("dd MMM yyyy HH:mm:ss"))),
    )
