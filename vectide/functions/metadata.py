"""Free metadata: any keys beyond the fixed fields, and filter descriptions compiled to predicates.

Free metadata are one VARIANT column. A description is a dictionary::

    {"lang": "en"}                              equal
    {"lang": ["en", "fr"]}                      one of
    {"year": {"gte": 2019, "lt": 2024}}         gt, gte, lt, lte, eq, ne, in
    {"note": None}                              missing, or null
    {("author", "name"): "Ann"}                 a key within a key
    {"any": [..., ...]}, {"all": [...]}, {"not": {...}}
    {("not",): "x"}                             a key that is called any, all or not

Several keys must all hold. A value is compared after a cast to the type of
what it is compared with, so the number 5 and the text "5" are both equal to
"5"; what cannot be cast is unequal to everything. Numbers are doubles. ``ne``
and ``not`` hold for rows without the key, all other comparisons do not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types that a key may be promoted to, by the Python type that a description compares with.
TYPES = {str: "string", bool: "boolean", int: "double", float: "double"}
COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}
Key = str | tuple[str, ...]
Field = Callable[[Key, str], Column]
"""The column of a key, cast to a type."""


def variant_path(key: Key) -> str:
    """Path of a key, or of a key within keys, whatever characters it holds."""
    path = "$"
    for part in (key,) if isinstance(key, str) else key:
        if "'" not in part and "?" not in part and part:
            path += f"['{part}']"
        elif '"' not in part and "?" not in part and part:
            path += f'["{part}"]'
        elif "." not in part and "[" not in part and part:
            path += f".{part}"
        else:
            raise ValueError(f"no path for the key {part!r}")
    return path


def free_value(column: str, key: Key, kind: str) -> Column:
    """A key of a VARIANT column; null where it is missing or cannot be cast."""
    return F.try_variant_get(F.col(column), variant_path(key), kind)


def literal_type(value: object) -> str:
    for python, kind in TYPES.items():
        if type(value) is python:
            if python is int and abs(value) > 1 << 53:
                raise ValueError(f"{value} is no exact double; keep such numbers as text")
            return kind
    raise ValueError(f"cannot compare metadata with {value!r}")


def _one_of(field: Field, key: Key, values: Iterable[object]) -> Column:
    by_type: dict[str, list] = {}
    for value in values:
        by_type.setdefault(literal_type(value), []).append(float(value) if literal_type(value) == "double" else value)
    found = [field(key, kind).isin(some) for kind, some in by_type.items()]
    # A cast that fails for one type must not hide a match of another.
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in found]) if len(found) > 1 else found[0] if found else F.lit(False)


def _compared(field: Field, key: Key, comparison: str, value: object) -> Column:
    if comparison == "in":
        return _one_of(field, key, value)
    if comparison == "ne":
        if value is None:
            return field(key, "string").isNotNull()
        return field(key, literal_type(value)).isNull() | ~_compared(field, key, "eq", value)
    if comparison not in COMPARISONS:
        raise ValueError(f"unknown comparison {comparison!r}")
    if value is None:
        if comparison != "eq":
            raise ValueError(f"{comparison} needs a value")
        return field(key, "string").isNull()
    kind = literal_type(value)
    return COMPARISONS[comparison](field(key, kind), F.lit(float(value) if kind == "double" else value))


def metadata_filter(description: Mapping, field: Field) -> Column:
    """Predicate of a description over the columns that ``field`` gives for its keys.

    Comparisons of columns with literals stay as they are, so that a field that
    is a stored column is filtered in the scan.
    """
    parts: list[Column] = []
    for key, wanted in description.items():
        if key in ("any", "all") and isinstance(wanted, (list, tuple)) and all(isinstance(w, Mapping) for w in wanted):
            inner = [metadata_filter(w, field) for w in wanted]
            if key == "all":
                parts += inner
            else:
                parts.append(reduce(lambda a, b: a | b, inner) if inner else F.lit(False))
        elif key == "not" and isinstance(wanted, Mapping):
            parts.append(~F.coalesce(metadata_filter(wanted, field), F.lit(False)))
        elif isinstance(wanted, Mapping):
            parts += [_compared(field, key, comparison, value) for comparison, value in wanted.items()]
        elif isinstance(wanted, (list, tuple, set, frozenset)):
            parts.append(_one_of(field, key, wanted))
        else:
            parts.append(_compared(field, key, "eq", wanted))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
