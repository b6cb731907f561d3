"""Search filters: a client's filter tree becomes one Column.

Missing values never match a clause, and `must_not` keeps rows that lack the field, so every leaf is a
definite true or false.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import and_, or_
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import props, times
from tidemark.model import ENVELOP_VERSION, WIRE_TO_FACT, Scope

Tree = Mapping[str, Any]

TIME_FIELDS = ("occured_at", "@timestamp")
# Keys that would make a filter read from elsewhere.
FORBIDDEN_KEYS = ("index", "_index", "wrapper")
_DATES = ("occured_at", "@timestamp", "arrived_at")


class FilterError(ValueError):
    """A filter that cannot be accepted."""


# -- checks on the tree ----------------------------------------------------


def _places(tree: Any) -> list[tuple[tuple[str, ...], Any]]:
    """Every node of a tree with its position: the keys above it, ``#n`` for a place in a list."""
    found, at = [((), tree)], 0
    while at < len(found):
        path, node = found[at]
        at += 1
        if isinstance(node, Mapping):
            found += [((*path, str(key)), child) for key, child in node.items()]
        elif isinstance(node, (list, tuple)):
            found += [((*path, f"#{n}"), child) for n, child in enumerate(node)]
    return found


#: Below ``org_id``: the value itself, one of a list, or the value of a long form.
_ORG_VALUE = re.compile(r"(#\d+|value|query)?")


def check_filter(tree: Any, scope: Scope) -> None:
    """Refuses a filter that names another source or, at any depth, another org."""
    if not isinstance(tree, Mapping):
        raise FilterError("the query must be an object")
    places = _places(tree)
    named = {path[-1] for path, _ in places if path} & set(FORBIDDEN_KEYS)
    if named:
        raise FilterError(f"`{min(named)}` is not allowed in a query")
    wanted: dict[tuple[str, ...], list[bool]] = {}
    for path, node in places:
        if "org_id" in path:
            end = path.index("org_id") + 1
            agrees = wanted.setdefault(path[:end], [])
            if not isinstance(node, (Mapping, list, tuple)) and _ORG_VALUE.fullmatch("/".join(path[end:])):
                agrees.append(node == scope.org_id)
    if not all(agrees and all(agrees) for agrees in wanted.values()):
        raise FilterError("the query names another org")


#: Positions whose clause every match must meet.
_REQUIRED = re.compile(r"(bool/(must|filter)/(#\d+/)?)*range/(" + "|".join(TIME_FIELDS) + ")/(gte?|lte?)")


def has_time_range(tree: Any) -> bool:
    """Whether a two-sided event-time range restricts every match."""
    sides: dict[tuple[str, ...], set[str]] = {}
    for path, node in _places(tree):
        if node is not None and _REQUIRED.fullmatch("/".join(path)):
            sides.setdefault(path[:-1], set()).add(path[-1][0])
    return {"g", "l"} in sides.values()


def require_time_range(tree: Tree | None) -> None:
    if not has_time_range(tree):
        raise FilterError("the query needs a range on the event time with both a lower and an upper bound")


# -- single clauses --------------------------------------------------------


def field_column(field: str) -> Column:
    """The column a wire field names; an unknown field is never present."""
    if field == "envelop_version":
        return F.lit(ENVELOP_VERSION)
    if field in WIRE_TO_FACT:
        return F.col(WIRE_TO_FACT[field])
    if field.startswith("properties."):
        return props.text_at(F.col("properties"), field.removeprefix("properties."))
    return F.lit(None).cast("string")


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _any_of(field: str, values: Sequence[Any], now: datetime | None = None) -> Column:
    if not values:
        return F.lit(False)
    if field in _DATES:
        return reduce(or_, [_sure(field_column(field) == times.time_lit(_instant(v, False, None, now))) for v in values])
    column = field_column(field)
    if field == "authenticated":
        return _sure(column.cast("string").isin(*[_text(v) for v in values]))
    texts = [_text(v) for v in values]
    match = _sure(column.isin(*texts))
    if field.startswith("properties."):
        # A list matches by any of its items.
        path = field.removeprefix("properties.")
        items = props.value_at(F.col("properties"), path, "array<string>")
        match = match | _sure(F.arrays_overlap(items, F.array(*[F.lit(t) for t in texts])))
    return match


def exists(field: str) -> Column:
    column = field_column(field)
    if field in _DATES or field == "authenticated":
        return column.isNotNull()
    return _sure(column.isNotNull() & (column != ""))


def prefix_filter(field: str, prefix: str | None) -> Column:
    """Values that start with a text; an empty prefix restricts nothing."""
    if not prefix:
        return F.lit(True)
    return _sure(field_column(field).cast("string").startswith(prefix))


def _wildcard(field: str, pattern: str) -> Column:
    translated = "".join({"*": "(?s:.*)", "?": "(?s:.)"}.get(ch, re.escape(ch)) for ch in pattern)
    return _sure(field_column(field).cast("string").rlike(rf"\A{translated}\z"))


def ids_filter(ids: Sequence[str]) -> Column:
    return F.col("event_id").isin(*ids) if ids else F.lit(False)


def scope_filter(scope: Scope) -> Column:
    return (F.col("org_id") == scope.org_id) & (F.col("workspace_id") == scope.workspace_id)


time_halfopen = times.half_open
time_closed = times.closed

# -- date bounds -----------------------------------------------------------

_DATE_MATH = re.compile(r"(now|.+\|\|)((?:[+-]\d+[yMwdhHms])*)(?:/([yMwdhHms]))?")


def _instant(value: Any, round_up: bool, zone: str | None, now: datetime | None) -> datetime:
    """A bound as UTC; ``round_up`` fills missing parts with the latest moment."""
    if isinstance(value, datetime):
        return times.instant(value)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return datetime.fromtimestamp(value / 1000, timezone.utc)
    text = str(value).strip()
    math = _DATE_MATH.fullmatch(text)
    if math:
        anchor, offsets, unit = math.groups()
        if anchor == "now":
            if now is None:
                raise FilterError("a relative time needs `now`")
            base = times.instant(now)
        else:
            base = _iso(anchor[:-2], False, zone)
        for sign, amount, step in re.findall(r"([+-])(\d+)([yMwdhHms])", offsets):
            base = _shift(base, int(sign + amount), step)
        return _round(base, unit, round_up) if unit else base
    return _iso(text, round_up, zone)


def _iso(text: str, round_up: bool, zone: str | None) -> datetime:
    try:
        parsed = datetime.fromisoformat(text)
    except ValueError:
        raise FilterError(f"`{text}` is not a date") from None
    if round_up and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        parsed += timedelta(days=1) - timedelta(milliseconds=1)
    if parsed.tzinfo is None and zone:
        offset = re.fullmatch(r"([+-])(\d{2}):(\d{2})", zone)
        if offset:
            sign, hours, minutes = offset.groups()
            delta = timedelta(hours=int(hours), minutes=int(minutes))
            parsed = parsed.replace(tzinfo=timezone(-delta if sign == "-" else delta))
        else:
            parsed = parsed.replace(tzinfo=ZoneInfo(zone))
    return times.instant(parsed)


def _shift(base: datetime, amount: int, unit: str) -> datetime:
    if unit in "yM":
        months = base.year * 12 + base.month - 1 + amount * (12 if unit == "y" else 1)
        year, month = divmod(months, 12)
        following = datetime(year + (month == 11), (month + 1) % 12 + 1, 1)
        last_day = (following - timedelta(days=1)).day
        return base.replace(year=year, month=month + 1, day=min(base.day, last_day))
    names = {"w": "weeks", "d": "days", "h": "hours", "H": "hours", "m": "minutes", "s": "seconds"}
    return base + timedelta(**{names[unit]: amount})


def _round(base: datetime, unit: str, up: bool) -> datetime:
    floor = base.replace(microsecond=0)
    if unit in "yMwdhHm":
        floor = floor.replace(second=0)
    if unit in "yMwdhH":
        floor = floor.replace(minute=0)
    if unit in "yMwd":
        floor = floor.replace(hour=0)
    if unit == "w":
        floor -= timedelta(days=floor.weekday())
    if unit in "yM":
        floor = floor.replace(day=1)
    if unit == "y":
        floor = floor.replace(month=1)
    return _shift(floor, 1, unit) - timedelta(milliseconds=1) if up else floor


def _range(field: str, bounds: Mapping[str, Any], now: datetime | None) -> Column:
    compare = {
        "gte": lambda c, v: c >= v,
        "gt": lambda c, v: c > v,
        "lte": lambda c, v: c <= v,
        "lt": lambda c, v: c < v,
    }
    column, zone = field_column(field), bounds.get("time_zone")
    found = []
    for key, apply in compare.items():
        value = bounds.get(key)
        if value is None:
            continue
        if field in _DATES:
            right = times.time_lit(_instant(value, key in ("gt", "lte"), zone, now))
        else:
            # Everything but the times is compared as text.
            right = F.lit(_text(value))
        found.append(_sure(apply(column, right)))
    return reduce(and_, found, exists(field) if not found else F.lit(True))


# -- trees -----------------------------------------------------------------


def _as_list(clauses: Any) -> list[Any]:
    if clauses is None:
        return []
    return list(clauses) if isinstance(clauses, (list, tuple)) else [clauses]


def _single(body: Mapping[str, Any], what: str) -> tuple[str, Any]:
    pairs = [(field, value) for field, value in body.items() if field != "boost"]
    if len(pairs) != 1:
        raise FilterError(f"`{what}` takes exactly one field")
    return pairs[0]


def _operand(value: Any, *keys: str) -> Any:
    if not isinstance(value, Mapping):
        return value
    return next((value[key] for key in keys if key in value), None)


def compile_filter(tree: Tree | None, now: datetime | None = None) -> Column:
    """One Column for a filter tree; no tree means everything."""
    if tree is None:
        return F.lit(True)
    if not isinstance(tree, Mapping) or len(tree) != 1:
        raise FilterError("a clause is an object with exactly one kind")
    kind, body = next(iter(tree.items()))
    if kind == "match_all":
        return F.lit(True)
    if kind == "match_none":
        return F.lit(False)
    if kind == "term":
        field, value = _single(body, kind)
        return _any_of(field, [_operand(value, "value")], now)
    if kind == "terms":
        field, values = _single(body, kind)
        return _any_of(field, _as_list(values), now)
    if kind in ("match", "match_phrase"):
        # Every searchable field is a keyword, so matching is equality.
        field, value = _single(body, kind)
        return _any_of(field, [_operand(value, "query")], now)
    if kind == "range":
        field, bounds = _single(body, kind)
        return _range(field, bounds, now)
    if kind == "exists":
        return exists(body["field"])
    if kind == "prefix":
        field, value = _single(body, kind)
        return prefix_filter(field, _operand(value, "value"))
    if kind == "wildcard":
        field, value = _single(body, kind)
        return _wildcard(field, _operand(value, "value", "wildcard"))
    if kind == "ids":
        return ids_filter(_as_list(body.get("values")))
    if kind == "constant_score":
        return compile_filter(body["filter"], now)
    if kind == "bool":
        return _bool(body, now)
    raise FilterError(f"`{kind}` is not a supported clause")


def _bool(body: Mapping[str, Any], now: datetime | None) -> Column:
    compiled = {
        occur: [compile_filter(item, now) for item in _as_list(body.get(occur))]
        for occur in ("must", "filter", "should", "must_not")
    }
    required = compiled["must"] + compiled["filter"] + [~c for c in compiled["must_not"]]
    should = compiled["should"]
    # `should` is optional next to required clauses, unless a minimum is given.
    minimum = int(body.get("minimum_should_match", 0 if compiled["must"] or compiled["filter"] else 1))
    if should and minimum == 1:
        required.append(reduce(or_, should))
    elif should and minimum > 1:
        required.append(sum((c.cast("int") for c in should), F.lit(0)) >= minimum)
    return reduce(and_, required, F.lit(True))


def search(ev: DataFrame, scope: Scope | None = None, tree: Tree | None = None, now: datetime | None = None) -> DataFrame:
    """Events of a scope that match a filter. The scope is added around the filter, which cannot widen it."""
    if scope is not None:
        if tree is not None:
            check_filter(tree, scope)
        ev = ev.where(scope_filter(scope))
    return ev if tree is None else ev.where(compile_filter(tree, now))


# -- pills -----------------------------------------------------------------


def pill_tree(pill: Mapping[str, Any]) -> Tree:
    """The clause of one filter pill, before negation."""
    field, operator = pill["field"], pill["operator"]
    if operator == "is":
        return {"match_phrase": {field: pill["value"]}}
    if operator == "is_one_of":
        options = [{"match_phrase": {field: value}} for value in pill.get("values") or []]
        return {"bool": {"should": options, "minimum_should_match": 1}} if options else {"match_none": {}}
    if operator == "exists":
        return {"exists": {"field": field}}
    if operator == "range":
        return {"range": {field: {key: pill[key] for key in ("gte", "lt") if pill.get(key) is not None}}}
    raise FilterError(f"`{operator}` is not a pill operator")


def _same_pill(one: Mapping[str, Any], other: Mapping[str, Any]) -> bool:
    if one["field"] != other["field"] or one["operator"] != other["operator"]:
        return False
    if one["operator"] == "exists":
        return True
    a, b = one.get("value"), other.get("value")
    kind = lambda v: "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__
    return one["operator"] == "is" and kind(a) == kind(b) and a == b


def add_pill(pills: Sequence[Mapping[str, Any]], pill: Mapping[str, Any]) -> list[Mapping[str, Any]]:
    """Adds a pill; one for the same field and value (of the same type) is replaced, so negation flips."""
    pill = {"negate": False, "disabled": False, **pill}
    for at, existing in enumerate(pills):
        if _same_pill(existing, pill):
            return [*pills[:at], pill, *pills[at + 1 :]]
    return [*pills, pill]


def pills_tree(
    pills: Sequence[Mapping[str, Any]],
    rng: tuple[datetime, datetime] | None = None,
    query: Tree | None = None,
) -> Tree:
    """One filter tree of pills, an optional query tree and an optional closed time range."""
    active = [pill for pill in pills if not pill.get("disabled")]
    required = ([query] if query else []) + [pill_tree(p) for p in active if not p.get("negate")]
    if rng is not None:
        iso = [times.instant(end).isoformat(timespec="milliseconds") for end in rng]
        required.append({"range": {"occured_at": {"gte": iso[0], "lte": iso[1]}}})
    refused = [pill_tree(p) for p in active if p.get("negate")]
    return {"bool": {"must": [], "filter": required, "should": [], "must_not": refused}}


def compile_pills(pills: Sequence[Mapping[str, Any]], rng=None, query: Tree | None = None, now=None) -> Column:
    return compile_filter(pills_tree(pills, rng, query), now)
