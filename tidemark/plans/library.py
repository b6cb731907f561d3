"""The metric library by name: what each answers, its parameters and how to run it."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tidemark.operators import behaviour, metrics


class MetricError(ValueError):
    """A metric or parameter that cannot be used."""


@dataclass(frozen=True)
class Metric:
    id: str
    name: str
    description: str
    use_case: str
    run: Callable[..., DataFrame]
    params: tuple[str, ...] = ("start_date", "end_date")
    fixed: Mapping[str, Any] = field(default_factory=dict)

    @property
    def tags(self) -> list[str]:
        """Words to find a metric by: those of its operator, its fixed property and its parameters."""
        words = {*self.run.__name__.split("_"), str(self.fixed.get("prop", "")), *(p for p in self.params if not p.endswith("_date"))}
        return sorted(words - {"", "by", "of"})


_NAMED = ("event_name", "property_name")

# Ids and names.
LIBRARY: tuple[Metric, ...] = (
    Metric("gq-001", "Daily Event Volume", "Events per day.", "Trends over days.",
           metrics.daily_event_volume),
    Metric("gq-002", "Event Distribution by Name", "The most frequent events.", "What is happening at all.",
           metrics.event_distribution),
    Metric("gq-003", "Events by Platform", "Events per platform.", "How use splits over platforms.",
           metrics.events_by_property, fixed={"prop": "platform"}),
    Metric("gq-004", "Events by Device Type", "Events per device type.", "Mobile against desktop.",
           metrics.events_by_property,
           fixed={"prop": "device_type"}),
    Metric("gq-005", "Events by Browser", "The ten most used browsers.", "Which browsers matter.",
           metrics.events_by_property, fixed={"prop": "browser", "n": 10}),
    Metric("gq-006", "Events by Country", "The twenty most active countries.", "Where visitors are.",
           metrics.events_by_country),
    Metric("gq-007", "Hourly Event Distribution", "Events per hour of the day.", "When visitors are active.",
           metrics.hourly_distribution),
    Metric("gq-008", "Weekly Event Trend", "Events per week.", "Trends over weeks.",
           metrics.weekly_trend),
    Metric("gq-009", "Monthly Event Trend", "Events per month.", "Trends over months.",
           metrics.monthly_trend),
    Metric("gq-010", "Specific Event Count", "How often one event occurred.", "The number of one action.",
           metrics.specific_event_count,
           ("event_name", "start_date", "end_date")),
    Metric("gq-011", "Unique Users Count", "Distinct known users.", "The size of the audience.",
           metrics.unique_users),
    Metric("gq-012", "Daily Active Users", "Distinct known users per day.", "Daily audience.",
           metrics.daily_active_users),
    Metric("gq-013", "Event Funnel", "Users that reach each step in order in time.", "Where users drop out.",
           behaviour.funnel, ("step_names",)),
    Metric("gq-014", "Top Cities by Events", "The twenty most active cities.", "Where events come from.",
           metrics.events_by_property, fixed={"prop": "city", "n": 20}),
    Metric("gq-015", "Available Event Names", "Distinct event names.", "What can be asked about.",
           metrics.available_events, ()),
    Metric("gq-016", "Event Property Distribution", "The values of one property of one event.", "How a property is used.",
           metrics.property_distribution,
           (*_NAMED, "start_date", "end_date")),
    Metric("gq-017", "Mean Reciprocal Rank", "Mean of 1 / rank for one event.", "How good a ranking is.",
           metrics.mean_reciprocal_rank, (*_NAMED, "start_date", "end_date")),
    Metric("gq-018", "Consecutive Event Time Gap Distribution", "Time between a user's events of one name.",
           "How fast an action repeats.",
           behaviour.consecutive_gap, ("event_name",)),
    Metric("gq-019", "Consecutive Event Text Similarity Distribution", "Edit distance between a user's consecutive texts.",
           "How much users rewrite their searches.",
           behaviour.consecutive_similarity, _NAMED),
    Metric("gq-020", "Reciprocal Position Distribution", "How high on the list users choose.", "Weight of top results.",
           metrics.reciprocal_position, _NAMED),
    Metric("gq-021", "Boolean Cross-Tabulation", "Rows by two conditions.", "A 2x2 table.",
           metrics.boolean_crosstab,
           ("condition_a", "condition_b", "filter_conditions")),
)

_ARGUMENTS = {"event_name": "name", "property_name": "prop", "condition_a": "cond_a", "condition_b": "cond_b",
              "filter_conditions": "where", "step_names": "step_names"}
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")


def list_metrics() -> list[dict[str, Any]]:
    return [
        {"id": m.id, "name": m.name, "description": m.description, "use_case": m.use_case, "tags": m.tags}
        for m in LIBRARY
    ]


def get_metric(name_or_id: str) -> dict[str, Any]:
    """By name in any case, or by exact id; an unknown one is an error value."""
    for m in LIBRARY:
        if m.name.lower() == name_or_id.lower() or m.id == name_or_id:
            listed = next(entry for entry in list_metrics() if entry["id"] == m.id)
            return {**listed, "params": list(m.params), "run": m.run}
    return {"error": f"Metric '{name_or_id}' not found"}


def run_metric(name_or_id: str, ev: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Runs a library metric. Every parameter is a value or a checked name; no text becomes SQL."""
    found = get_metric(name_or_id)
    if "error" in found:
        raise MetricError(found["error"])
    metric = next(m for m in LIBRARY if m.id == found["id"])
    missing = [p for p in metric.params if p not in params and p != "filter_conditions"]
    if missing:
        raise MetricError(f"missing parameters: {', '.join(missing)}")
    arguments = dict(metric.fixed)
    if "start_date" in metric.params:
        arguments["rng"] = (params["start_date"], params["end_date"])
    for param, argument in _ARGUMENTS.items():
        if param in metric.params and params.get(param) is not None:
            arguments[argument] = params[param]
    if not _IDENTIFIER.fullmatch(str(arguments.get("prop", "x"))):
        raise MetricError(f"`{arguments['prop']}` is not a property name")
    return metric.run(ev, **arguments)
