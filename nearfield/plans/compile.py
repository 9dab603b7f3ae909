"""From filters to Columns.

Leaves are compiled bare, so that Parquet readers get them as pushed filters; NOT is moved down to the
leaves first, where a field that is missing must count as no match and its negation as a match.

``compat=True`` keeps two quirks of filters as they were first defined: NOT changes nothing, and a
pattern with its only % in front must match with that % as a character.
"""

from __future__ import annotations

import logging
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.plans.filters import And, Compare, Filter, In, Like, Literal, Not, Or

log = logging.getLogger(__name__)


class Fields(Protocol):
    """Finds a metadata field as one of the three kinds that can be matched; None if it never is of that kind."""

    def string(self, field: str) -> Column | None: ...
    def number(self, field: str) -> Column | None: ...
    def boolean(self, field: str) -> Column | None: ...


class TypedFields:
    """Metadata in ordinary columns."""

    def __init__(self, schema: T.StructType):
        self.kinds = {f.name: f.dataType for f in schema.fields}

    def _of(self, field: str, *kinds: type) -> Column | None:
        return F.col(f"`{field}`") if isinstance(self.kinds.get(field), kinds) else None

    def string(self, field: str) -> Column | None:
        return self._of(field, T.StringType)

    def number(self, field: str) -> Column | None:
        return self._of(field, T.NumericType)

    def boolean(self, field: str) -> Column | None:
        return self._of(field, T.BooleanType)


class VariantFields:
    """Metadata in one VARIANT column, whose fields may have another type in each row.

    Types are checked, as reading a variant would otherwise turn strings into numbers and the like.
    """

    def __init__(self, column: str):
        self.column = column

    def _typed(self, field: str, kinds: str, cast: str) -> Column:
        path = '$["' + field.replace('"', '\\"') + '"]'
        kind = F.schema_of_variant(F.variant_get(self.column, path, "variant"))
        return F.when(kind.rlike(f"^({kinds})"), F.try_variant_get(self.column, path, cast))

    def string(self, field: str) -> Column | None:
        return self._typed(field, "STRING", "string")

    def number(self, field: str) -> Column | None:
        return self._typed(field, "TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT", "double")

    def boolean(self, field: str) -> Column | None:
        return self._typed(field, "BOOLEAN", "boolean")



_LONG = 1 << 63


def _number(value: Literal) -> int | float:
    """The number that a field is compared with; in a range, what is no number counts as 0.

    Whole numbers are integers, as a double would keep a filter on an integer column from the scan.
    """
    if isinstance(value, bool) or not isinstance(value, int | float):
        log.warning("a range over %r compares with 0", value)
        return 0
    return int(value) if float(value).is_integer() and -_LONG <= value < _LONG else float(value)


def _equal(fields: Fields, field: str, value: Literal) -> Column | None:
    if isinstance(value, bool):
        found, value = fields.boolean(field), bool(value)
    elif isinstance(value, int | float):
        found, value = fields.number(field), _number(value)
    elif isinstance(value, str):
        found = fields.string(field)
    else:
        found = None
    return None if found is None else found == F.lit(value)


def _present(fields: Fields, field: str) -> Column | None:
    """Whether the row has the field as a string, a number or a boolean."""
    known = [c.isNotNull() for c in (fields.string(field), fields.number(field), fields.boolean(field)) if c is not None]
    return _any(known)


def _any(columns: list[Column]) -> Column | None:
    out = None
    for c in columns:
        out = c if out is None else out | c
    return out


def _like(found: Column, pattern: str, compat: bool) -> Column:
    lead, tail = pattern.startswith("%"), pattern.endswith("%")
    if pattern.strip("%") == "" and len(pattern) in (1, 2):
        return F.contains(found, F.lit("%")) if compat and len(pattern) == 1 else found.isNotNull()
    inner = pattern[lead : len(pattern) - tail]
    if lead and tail:
        return F.contains(found, F.lit(inner))
    if lead:
        return F.endswith(found, F.lit(pattern if compat else inner))
    return F.startswith(found, F.lit(inner)) if tail else found == F.lit(pattern)


def _leaf(tree: Filter, fields: Fields, compat: bool) -> Column | None:
    match tree:
        case Compare(field, "=", value):
            return _equal(fields, field, value)
        case Compare(field, "!=", value):
            present, equal = _present(fields, field), _equal(fields, field, value)
            if present is None or equal is None:
                return present
            if isinstance(fields, TypedFields):
                return ~equal  # null for a missing field, which is no match
            return present & ~F.coalesce(equal, F.lit(False))
        case Compare(field, op, value):
            found, bound = fields.number(field), F.lit(_number(value))
            if found is None:
                return None
            return {"<": found < bound, ">": found > bound, "<=": found <= bound, ">=": found >= bound}[op]
        case In(field, values):
            by_kind: dict[str, list] = {}
            for v in values:
                by_kind.setdefault("boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number", []).append(v)
            found = [(getattr(fields, kind)(field), vs) for kind, vs in by_kind.items()]
            return _any([c.isin(*vs) for c, vs in found if c is not None])
        case Like(field, pattern):
            found = fields.string(field)
            return None if found is None else _like(found, pattern, compat)
    raise TypeError(f"not a filter: {tree!r}")


def to_column(tree: Filter, fields: Fields, compat: bool = False, negated: bool = False) -> Column:
    """The predicate; rows for which it is null do not match."""
    match tree:
        case Not(inner):
            return to_column(inner, fields, compat, negated if compat else not negated)
        case And(a, b) | Or(a, b):
            left, right = (to_column(x, fields, compat, negated) for x in (a, b))
            return left & right if isinstance(tree, And) != negated else left | right
    found = _leaf(tree, fields, compat)
    if found is None:
        return F.lit(negated)
    return ~F.coalesce(found, F.lit(False)) if negated else found


def matching_ids(df: DataFrame, tree: Filter, fields: Fields | None = None, id_column: str = "id", compat: bool = False) -> DataFrame:
    """The distinct ids that match, ascending."""
    fields = fields or TypedFields(df.schema)
    return df.where(to_column(tree, fields, compat)).select(id_column).distinct().orderBy(id_column)


def by_set_algebra(df: DataFrame, tree: Filter, fields: Fields | None = None, id_column: str = "id") -> DataFrame:
    """The same ids by intersection, union and difference of id sets; a cross-check of the compiler."""
    fields = fields or TypedFields(df.schema)
    match tree:
        case And(a, b):
            return by_set_algebra(df, a, fields, id_column).intersect(by_set_algebra(df, b, fields, id_column))
        case Or(a, b):
            return by_set_algebra(df, a, fields, id_column).union(by_set_algebra(df, b, fields, id_column)).distinct()
        case Not(a):
            return df.select(id_column).distinct().subtract(by_set_algebra(df, a, fields, id_column))
    return df.where(to_column(tree, fields)).select(id_column).distinct()
