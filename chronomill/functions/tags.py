"""Tag queries over JSON tags as column predicates."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ReservedTagNameError

# Names of what the engine itself reports among the tags.
RESERVED = frozenset(
    "stream_id value_downsamplers time_downsamplers highest_granularity derived_from contributes_to earliest_datapoint "
    "latest_datapoint downsampled_until pending_backprocess value_type value_type_options derive_op derive_args".split()
)
OPERATORS = ("iexact", "icontains", "contains", "startswith", "endswith", "gte", "gt", "lte", "lt", "ne", "in", "nin", "all", "size", "exists")


def check_tags(tags: dict | None, reserved: bool = True) -> None:
    """No reserved names at the top, no double underscore in any key."""
    for key in tags or {}:
        if reserved and key in RESERVED:
            raise ReservedTagNameError(f"the tag name {key!r} is reserved")
    stack = [tags or {}]
    while stack:
        now = stack.pop()
        for key, value in now.items():
            if "__" in str(key):
                raise ReservedTagNameError(f"a tag name may not hold two underscores: {key!r}")
            if isinstance(value, dict):
                stack.append(value)


def _path(parts: tuple[str, ...]) -> str:
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in parts)


def _at(tags: Column, parts: tuple[str, ...]) -> tuple[Column, Column]:
    """The value at a path as text, and as the list of its members' JSON if it is an array."""
    found = F.get_json_object(tags, _path(parts))
    return found, F.from_json(found, "array<string>")


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True, separators=(",", ":"))


def _equal(tags: Column, parts: tuple[str, ...], value) -> Column:
    found, members = _at(tags, parts)
    if value is None:
        return found.isNull()
    if isinstance(value, (list, tuple)):
        return found == F.lit(json.dumps(list(value), separators=(",", ":")))
    inside = F.coalesce(F.array_contains(members, F.lit(_text(value))), F.lit(False))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.coalesce((found == F.lit(_text(value))) | (found.try_cast("double") == float(value)), F.lit(False)) | inside
    return (found == F.lit(_text(value))) | inside


def _operator(tags: Column, parts: tuple[str, ...], op: str, value) -> Column:
    found, members = _at(tags, parts)
    number = found.try_cast("double")
    listed = lambda: F.array(*[F.lit(_text(v)) for v in value]).cast("array<string>")
    if op in ("gte", "gt", "lte", "lt"):
        left, right = (number, F.lit(float(value))) if isinstance(value, (int, float)) else (found, F.lit(str(value)))
        return {"gte": left >= right, "gt": left > right, "lte": left <= right, "lt": left < right}[op]
    return {
        "iexact": lambda: F.lower(found) == F.lit(str(value).lower()),
        "icontains": lambda: F.contains(F.lower(found), F.lit(str(value).lower())),
        "contains": lambda: F.coalesce(F.array_contains(members, F.lit(_text(value))), F.contains(found, F.lit(_text(value)))),
        "startswith": lambda: F.startswith(found, F.lit(str(value))),
        "endswith": lambda: F.endswith(found, F.lit(str(value))),
        "ne": lambda: ~F.coalesce(_equal(tags, parts, value), F.lit(False)),
        "in": lambda: found.isin([_text(v) for v in value]) | F.coalesce(F.arrays_overlap(members, listed()), F.lit(False)),
        "nin": lambda: ~F.coalesce(found.isin([_text(v) for v in value]) | F.coalesce(F.arrays_overlap(members, listed()), F.lit(False)), F.lit(False)),
        "all": lambda: F.size(F.array_except(listed(), F.coalesce(members, F.array(found)))) == 0,
        "size": lambda: F.size(members) == int(value),
        "exists": lambda: found.isNotNull() if value else found.isNull(),
    }[op]()


def matches(query: dict | None, tags: Column) -> Column:
    """Whether JSON `tags` match a query: equal members (an array matches by any of its own), nested
    dictionaries as paths, and the operators of OPERATORS as only keys of a dictionary."""
    parts: list[Column] = []

    def walk(now: dict, path: tuple[str, ...]) -> None:
        for key, value in now.items():
            if path and key in OPERATORS:
                parts.append(_operator(tags, path, key, value))
            elif isinstance(value, dict):
                walk(value, (*path, key))
            else:
                parts.append(_equal(tags, (*path, key), value))

    walk(query or {}, ())
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def contains(query: dict, tags: Column) -> Column:
    """JSON containment: every part of `query` is in `tags`; arrays contain all members asked for."""
    parts: list[Column] = []

    def walk(now: dict, path: tuple[str, ...]) -> None:
        for key, value in now.items():
            if isinstance(value, dict):
                walk(value, (*path, key))
            elif isinstance(value, (list, tuple)):
                parts.append(_operator(tags, (*path, key), "all", value))
            else:
                found, _ = _at(tags, (*path, key))
                parts.append(found == F.lit(_text(value)))

    walk(query or {}, ())
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def merged(old: dict, new: dict) -> dict:
    """`new` over `old`, dictionaries member by member."""
    out = dict(old)
    for key, value in new.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def without(tags: dict, tag) -> dict:
    """`tags` without a tag: a name, or a nested dictionary that leads to the names that go."""
    if not isinstance(tag, dict):
        return {k: v for k, v in tags.items() if k != tag}
    out = dict(tags)
    for key, value in tag.items():
        if isinstance(value, dict) and value and isinstance(out.get(key), dict):
            out[key] = without(out[key], value)
        else:
            out.pop(key, None)
    return out
