"""A workspace's own metrics: scoped, parameterised plans over its rows, kept as snapshots.

A saved metric says what to filter, group, measure and sort, as values of the classes below. It becomes a DataFrame plan column
by column; none of its texts is read as SQL, so there is no function to call and no table to name beyond the scope's rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from operator import and_
from typing import Any

from pyspark.errors import AnalysisException, ArithmeticException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions import props, times
from tidemark.model import Scope
from tidemark.operators.catalog import schema_catalog
from tidemark.operators.filters import scope_filter
from tidemark.plans.library import MetricError
from tidemark.sources.events import folder_exists

# -- what a metric is made of ----------------------------------------------


@dataclass(frozen=True)
class Param:
    """Stands for the value of a variable."""

    name: str


@dataclass(frozen=True)
class Condition:
    """``field`` (or a part of it) passes ``test`` against ``value``. Null passes only ``not_set``."""

    field: str
    test: str
    value: Any = None
    part: str | None = None


@dataclass(frozen=True)
class Key:
    """A grouping column: a field, or a part of it, under a name."""

    name: str
    field: str
    part: str | None = None


@dataclass(frozen=True)
class Measure:
    """``kind`` of a field's values over a group, of the rows that meet ``where``; ``count`` needs no field."""

    name: str
    kind: str
    field: str | None = None
    where: tuple[Condition, ...] = ()
    part: str | None = None


@dataclass(frozen=True)
class SavedMetric:
    """Rows of ``source`` that meet all of ``where``, grouped by ``keys`` (or by each of ``sets``), measured, then cut and sorted.

    ``source`` is ``events``, ``catalog`` (event_name, property, type) or another metric, whose columns are then the fields.
    Without measures the distinct keys are the result. ``having`` and ``order`` speak of the result's columns; rows that
    ``order`` leaves tied are sorted by the keys.
    """

    keys: tuple[Key, ...] = ()
    measures: tuple[Measure, ...] = ()
    where: tuple[Condition, ...] = ()
    sets: tuple[tuple[str, ...], ...] = ()
    having: tuple[Condition, ...] = ()
    order: tuple[tuple[str, str | Param], ...] = ()
    limit: int | Param | None = None
    source: str | SavedMetric = "events"


_PARTS: dict[str, Callable[[Column], Column]] = {
    "day": lambda c: F.date_format(c, "yyyy-MM-dd"),
    "week": lambda c: F.date_format(times.week_start(F.to_date(c)), "yyyy-MM-dd"),
    "month": lambda c: F.date_format(c, "yyyy-MM"),
    "hour": lambda c: F.hour(c).cast("long"),
    "length": lambda c: F.char_length(c).cast("long"),
    "lower": F.lower,
}
_TIMED = ("day", "week", "month", "hour")
_TESTS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "contains": lambda c, v: c.cast("string").contains(v),
    "starts_with": lambda c, v: c.cast("string").startswith(v),
}
_KINDS: dict[str, Callable[[Column], Column]] = {
    "count": F.count, "distinct": F.count_distinct, "sum": F.sum, "mean": F.mean, "min": F.min, "max": F.max,
}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _known(table: Mapping[str, Any], name: str, what: str) -> Any:
    if name not in table:
        raise MetricError(f"`{name}` is not a {what}; known: {', '.join(sorted(table))}")
    return table[name]


def _field(rows: DataFrame, name: str, part: str | None) -> tuple[Column, T.DataType]:
    """The column of a field, and its type."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    if name in types and not isinstance(types[name], T.VariantType):
        column, kind = F.col(f"`{name}`"), types[name]
    elif name.startswith("properties.") and isinstance(types.get("properties"), T.VariantType):
        column, kind = props.text_at(F.col("properties"), name.removeprefix("properties.")), T.StringType()
    else:
        raise MetricError(f"`{name}` is not a field")
    if part is None:
        return column, kind
    made = _known(_PARTS, part, "part of a field")
    if (part in _TIMED) != isinstance(kind, (T.TimestampType, T.DateType)):
        raise MetricError(f"`{name}` has no {part}")
    return made(column), T.LongType() if part in ("hour", "length") else T.StringType()


def _condition(rows: DataFrame, test: Condition, args: Mapping[str, Any]) -> Column:
    column, kind = _field(rows, test.field, test.part)
    text = isinstance(kind, T.StringType)
    if test.test in ("is_set", "not_set"):
        there = column.isNotNull() & (column != "") if text else column.isNotNull()
        there = F.coalesce(there, F.lit(False))
        return there if test.test == "is_set" else ~there
    value = _value(test.value, args)
    if test.test == "in":
        if isinstance(value, str) or not isinstance(value, Sequence):
            raise MetricError("`in` takes a list of values")
        each = [_condition(rows, Condition(test.field, "=", v, test.part), args) for v in value]
        return reduce(lambda a, b: a | b, each, F.lit(False))
    made = _known(_TESTS, test.test, "test")
    if value is None or isinstance(value, (list, tuple, dict)):
        raise MetricError(f"`{test.test}` takes one value")
    if test.test in ("contains", "starts_with"):
        value = str(value)
    elif isinstance(kind, T.TimestampType):
        try:
            value = times.time_lit(value)
        except (ValueError, TypeError):
            raise MetricError(f"`{value}` is not a time") from None
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        column = column.try_cast("double") if text else column  # a text that is no number passes no test
    elif text:
        value = str(value).lower() if isinstance(value, bool) else str(value)
    elif isinstance(kind, T.NumericType):
        value = _number(value)
    return F.coalesce(made(column, value), F.lit(False))


def _all(rows: DataFrame, tests: Sequence[Condition], args: Mapping[str, Any]) -> Column:
    return reduce(and_, [_condition(rows, t, args) for t in tests], F.lit(True))


def _measure(rows: DataFrame, m: Measure, args: Mapping[str, Any]) -> Column:
    """What a row adds to a measure."""
    _known(_KINDS, m.kind, "measure")
    if m.field is None:
        if m.kind != "count":
            raise MetricError(f"`{m.kind}` needs a field")
        column: Column = F.lit(1)
    else:
        column, kind = _field(rows, m.field, m.part)
        if m.kind in ("sum", "mean") and not isinstance(kind, T.NumericType):
            if not isinstance(kind, T.StringType):
                raise MetricError(f"`{m.field}` is not a number")
            column = column.try_cast("double")
    return F.when(_all(rows, m.where, args), column) if m.where else column


def _rows(ev: DataFrame, scope: Scope, metric: SavedMetric, args: Mapping[str, Any]) -> DataFrame:
    if isinstance(metric.source, SavedMetric):
        return run_metric(ev, scope, metric.source, args)
    own = ev.where(scope_filter(scope))
    return _known({"events": lambda: own, "catalog": lambda: schema_catalog(own)}, metric.source, "source")()


def run_metric(ev: DataFrame, scope: Scope, metric: SavedMetric, args: Mapping[str, Any] | None = None) -> DataFrame:
    """The metric's plan over one workspace's rows; ``args`` are the values of its parameters (see ``bind``)."""
    args = dict(args or {})
    names = [k.name for k in metric.keys] + [m.name for m in metric.measures]
    if not names:
        raise MetricError("the metric is empty")
    for name in names:
        if not _NAME.fullmatch(name) or [n.lower() for n in names].count(name.lower()) > 1:
            raise MetricError(f"`{name}` is no name of its own for a column")
    rows = _rows(ev, scope, metric, args)
    rows = rows.where(_all(rows, metric.where, args))
    inputs = [_measure(rows, m, args).alias(f"_in{n}") for n, m in enumerate(metric.measures)]
    rows = rows.select(*[_field(rows, k.field, k.part)[0].alias(k.name) for k in metric.keys], *inputs)
    keys = [k.name for k in metric.keys]
    measured = [_KINDS[m.kind](F.col(f"_in{n}")).alias(m.name) for n, m in enumerate(metric.measures)]
    if metric.sets:
        if not measured or any(name not in keys for s in metric.sets for name in s):
            raise MetricError("grouping sets are sets of keys, with a measure")
        found = rows.groupingSets([[F.col(n) for n in s] for s in metric.sets], *[F.col(k) for k in keys]).agg(*measured)
    else:
        found = rows.groupBy(*keys).agg(*measured) if measured else rows.distinct()
    found = found.select(*names)
    found = found.where(_all(found, metric.having, args))
    if metric.order or metric.limit is not None:
        asked = [(name, str(_value(way, args)).upper()) for name, way in metric.order]
        for name, way in asked:
            if name not in names or way not in ("ASC", "DESC"):
                raise MetricError(f"cannot sort by `{name}` `{way}`")
        asked += [(key, "ASC") for key in keys if key not in dict(asked)]
        if asked:
            found = found.orderBy(*[F.col(name).asc() if way == "ASC" else F.col(name).desc() for name, way in asked])
    if metric.limit is not None:
        limit = _value(metric.limit, args)
        if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
            raise MetricError("a limit is a whole number from 1")
        found = found.limit(limit)
    return found


# -- variables -------------------------------------------------------------


@dataclass(frozen=True)
class Variable:
    """One parameter of a saved metric. Kinds: number, string, date, datetime, direction, searchable_dropdown."""

    kind: str
    default: str = ""
    dropdown: SavedMetric | None = None


def _value(value: Any, args: Mapping[str, Any]) -> Any:
    if not isinstance(value, Param):
        return value
    if value.name not in args:
        raise MetricError(f"`{value.name}` has no value")
    return args[value.name]


def _number(value: Any) -> int | float:
    try:
        return float(value) if re.search(r"[.eE]", str(value)) else int(value)
    except (ValueError, TypeError):
        raise MetricError(f"`{value}` is not a number") from None


def bind(variables: Mapping[str, Variable], values: Mapping[str, Any]) -> dict[str, Any]:
    """The variables' values by their kinds; one that is not given has its default."""
    args: dict[str, Any] = {}
    for name, variable in variables.items():
        value = values.get(name, variable.default)
        if variable.kind == "number":
            args[name] = _number(value)
        elif variable.kind == "direction":
            if str(value).upper() not in ("ASC", "DESC"):
                raise MetricError(f"`{value}` is not a sort direction")
            args[name] = str(value).upper()
        elif variable.kind in ("date", "datetime") and isinstance(value, (date, datetime)):
            args[name] = value.isoformat()
        else:
            args[name] = str(value)
    return args


def run_saved(
    ev: DataFrame, scope: Scope, metric: SavedMetric, variables: Mapping[str, Variable], values: Mapping[str, Any]
) -> DataFrame:
    return run_metric(ev, scope, metric, bind(variables, values))


def dropdown(
    ev: DataFrame,
    scope: Scope,
    name: str,
    variables: Mapping[str, Variable],
    values: Mapping[str, Any],
    term: str | None = None,
) -> DataFrame:
    """The options of a variable: the first column of its metric, without blanks. A searchable one takes the typed term."""
    asked = variables[name].dropdown
    if asked is None:
        return ev.sparkSession.createDataFrame([], "option string")
    typed = {**variables, name: Variable("string", variables[name].default)}
    rows = run_metric(ev, scope, asked, bind(typed, values if term is None else {**values, name: term}))
    option = F.col(rows.columns[0]).cast("string").alias("option")
    return rows.select(option).where("option != '' and option != 'null'")


# -- errors ----------------------------------------------------------------


def public_error(exc: BaseException) -> str:
    """What a user may see: the first line about their own query, nothing about the system below."""
    if isinstance(exc, MetricError):
        return str(exc)
    own = (AnalysisException, ParseException, ArithmeticException)
    if not isinstance(exc, PySparkException) or not isinstance(exc, own):
        return "Query failed"
    lines = (exc.getMessage() or str(exc)).strip().splitlines()
    return lines[0].split(" SQLSTATE:")[0].strip() if lines else "Query failed"


# -- snapshots -------------------------------------------------------------

STALE_AFTER_S = 30


def _runs(spark: SparkSession, folder: str) -> list[int]:
    if not folder_exists(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    statuses = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    found = [re.fullmatch(r"ran_at=(\d+)", status.getPath().getName()) for status in statuses]
    done = [m for m in found if m and folder_exists(spark, f"{folder}/{m[0]}/_SUCCESS")]
    return sorted(int(m[1]) for m in done)


def refresh_metric(
    spark: SparkSession, metric_id: str, run: Callable[[], DataFrame], root: str, now: datetime
) -> tuple[DataFrame | None, datetime | None, str | None]:
    """(result, last_ran_at, error): re-run when never run or last run over 30 whole seconds ago.

    A failed run leaves the old result in place and returns the error next to it.
    """
    folder, now_ms = f"{root}/{metric_id}", int(times.instant(now).timestamp() * 1000)
    runs, error = _runs(spark, folder), None
    if not runs or (now_ms - runs[-1]) // 1000 > STALE_AFTER_S:
        try:
            run().write.mode("overwrite").parquet(f"{folder}/ran_at={now_ms}")
            runs.append(now_ms)
        except Exception as exc:  # noqa: BLE001 - any failure keeps the old result
            error = public_error(exc)
    if not runs:
        return None, None, error
    last = datetime.fromtimestamp(runs[-1] / 1000, tz=times.instant(now).tzinfo)
    return spark.read.parquet(f"{folder}/ran_at={runs[-1]}"), last, error

