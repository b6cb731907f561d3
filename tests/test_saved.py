"""Metric library, a workspace's own SQL, snapshots and result shaping."""

from datetime import datetime, timedelta, timezone

import pytest
from data import facts_of
from pyspark.sql import functions as F

from tidemark.model import Scope
from tidemark.operators import catalog, explore, metrics, shape
from tidemark.plans import library, saved
from tidemark.plans.library import MetricError
from tidemark.plans.saved import Condition, Key, Measure, Param, SavedMetric, Variable

A = Scope("org-one", "workspace-a")
NOW = datetime(2026, 9, 1, 12, tzinfo=timezone.utc)


def load(spark):
    return facts_of(spark, [{"event_name": n, "workspace_id": w} for n, w in [("a", "workspace-a"), ("a", "workspace-a"), ("b", "workspace-a"), ("z", "workspace-b")]])


KEY, COUNT = Key("event_name", "event_name"), Measure("n", "count")


def run(spark, metric, scope=A, **args):
    return [tuple(r) for r in saved.run_metric(load(spark), scope, metric, args).collect()]


def test_a_metric_sees_one_workspace(spark):
    assert run(spark, SavedMetric((KEY,), (COUNT,), order=(("event_name", "ASC"),))) == [("a", 2), ("b", 1)]
    assert run(spark, SavedMetric((KEY,)), Scope("org-one", "workspace-b")) == [("z",)]
    assert run(spark, SavedMetric((KEY,)), Scope("org-two", "workspace-a")) == []
    widened = (Condition("workspace_id", "in", ["workspace-a", "workspace-b"]),)
    assert run(spark, SavedMetric((), (COUNT,), widened)) == [(3,)]  # a condition cannot widen the scope
    assert run(spark, SavedMetric((), (COUNT,), (Condition("event_name", "=", Param("n")),)), n="a") == [(2,)]
    assert run(spark, SavedMetric((Key("property", "property"),), source="catalog")) == []


@pytest.mark.parametrize("metric", [
    SavedMetric(), SavedMetric((KEY,), source="secrets"), SavedMetric((KEY,), source="global_temp.secret_t"), SavedMetric((Key("x", "nothing"),)),
    SavedMetric((Key("x", "reflect('java.lang.System', 'getenv', 'PATH')"),)), SavedMetric((Key("x` AS y, `z", "event_name"),)),
    SavedMetric((KEY, Key("Event_Name", "source"),)), SavedMetric((), (Measure("n", "java_method", "event_name"),)),
    SavedMetric((), (Measure("n", "sum"),)), SavedMetric((), (Measure("n", "sum", "event_timestamp"),)), SavedMetric((Key("x", "properties"),)),
    SavedMetric((Key("x", "event_name", "day"),)), SavedMetric((Key("x", "event_timestamp", "length"),)), SavedMetric((Key("x", "event_name", "reflect"),)),
    SavedMetric((KEY,), where=(Condition("event_name", "~", "a"),)), SavedMetric((KEY,), where=(Condition("event_name", "=", Param("n")),)),
    SavedMetric((KEY,), where=(Condition("event_name", "in", "a"),)), SavedMetric((KEY,), where=(Condition("event_timestamp", ">", "soon"),)),
    SavedMetric((KEY,), where=(Condition("event_name", "=", None),)), SavedMetric((KEY,), sets=(("event_name",),)),
    SavedMetric((KEY,), (COUNT,), sets=(("source",),)), SavedMetric((KEY,), (COUNT,), order=(("source", "ASC"),)),
    SavedMetric((KEY,), (COUNT,), order=(("n", "DESC, x"),)), SavedMetric((KEY,), limit=0), SavedMetric((KEY,), (COUNT,), having=(Condition("n", ">", "x"),)),
])
def test_what_is_no_metric_is_refused(spark, metric):
    spark.sql("SELECT 1 AS v").createOrReplaceGlobalTempView("secret_t")
    with pytest.raises(MetricError) as caught:
        run(spark, metric)
    assert saved.public_error(caught.value) == str(caught.value) != ""
    assert saved.public_error(RuntimeError("host db-1 is down")) == "Query failed"


def test_conditions(spark):
    ev = facts_of(spark, [
        {"event_name": "x' OR 1=1 --", "properties": '{"n": 5, "t": "50%"}', "authenticated": True}, {"event_name": "b_c", "properties": '{"n": "x"}'},
        {"event_name": "bxc", "event_timestamp": "2026-09-03T10:00:00Z", "properties": '{"n": 40}', "country": "DE"},
    ])
    found = lambda *tests: sorted(r[0][0] + r[0][1] for r in saved.run_metric(ev, A, SavedMetric((KEY,), where=tests)).collect())
    assert found(Condition("event_name", "=", "x' OR 1=1 --")) == ["x'"]
    assert found(Condition("event_name", "contains", "b_")) == ["b_"] and found(Condition("event_name", "starts_with", "b")) == ["b_", "bx"]
    assert found(Condition("properties.n", ">", 4)) == ["bx", "x'"] and found(Condition("properties.n", ">", 39.5)) == ["bx"]
    assert found(Condition("properties.t", "contains", "0%")) == ["x'"] and found(Condition("properties.n", "in", ["x", "5"])) == ["b_", "x'"]
    assert found(Condition("country", "is_set")) == ["bx"] and found(Condition("country", "not_set"), Condition("properties.n", "!=", "x")) == ["x'"]
    assert found(Condition("event_timestamp", ">=", "2026-09-02")) == ["bx"] and found(Condition("event_timestamp", "=", "2026-09-03", "day")) == ["bx"]
    assert found(Condition("event_name", "<=", 3, "length")) == ["b_", "bx"] and found(Condition("authenticated", "=", True)) == ["x'"]
    assert found(Condition("event_name", "in", [])) == []


def test_measures_sets_and_nesting(spark):
    ev = facts_of(spark, [{"event_name": n, "source": s, "properties": p} for n, s, p in
                          [("a", "web", '{"v": 1}'), ("a", "ios", '{"v": 2.5}'), ("b", "web", '{"v": "x"}'), ("b", "", "{}")]])
    web = (Condition("source", "=", "web"),)
    measures = (COUNT, Measure("web", "count", where=web), Measure("kinds", "distinct", "source"), Measure("v", "sum", "properties.v"),
                Measure("mean_v", "mean", "properties.v"), Measure("top", "max", "source"))
    got = saved.run_metric(ev, A, SavedMetric((KEY,), measures, order=(("event_name", "DESC"),)))
    assert [tuple(r) for r in got.collect()] == [("b", 2, 1, 2, None, None, "web"), ("a", 2, 1, 2, 3.5, 1.75, "web")]
    both = (KEY, Key("src", "source"))
    sets = SavedMetric(both, (COUNT, Measure("names", "distinct", "event_name")), sets=(("event_name", "src"), ("src",), ()), order=(("n", "DESC"),), limit=2)
    assert [tuple(r) for r in saved.run_metric(ev, A, sets).collect()] == [(None, None, 4, 2), (None, "web", 2, 2)]
    per_name = SavedMetric((KEY,), (COUNT,))
    over = SavedMetric((), (Measure("names", "count"), Measure("mean_n", "mean", "n")), source=per_name)
    assert [tuple(r) for r in saved.run_metric(ev, A, over).collect()] == [(2, 2.0)]
    none = saved.run_metric(ev.where("false"), A, SavedMetric((), (COUNT,)))
    assert [tuple(r) for r in none.collect()] == [(0,)]


def test_values_follow_their_kinds():
    variables = {"d": Variable("date", "2026-09-01"), "t": Variable("string", "x"), "n": Variable("number", "5"), "way": Variable("direction", "DESC")}
    assert saved.bind(variables, {"t": "' OR 1=1 --"}) == {"d": "2026-09-01", "t": "' OR 1=1 --", "n": 5, "way": "DESC"}
    assert saved.bind(variables, {"n": "2.5", "way": "asc"})["n"] == 2.5
    for bad in ({"n": "5; DROP"}, {"way": "DESC, x"}):
        with pytest.raises(MetricError):
            saved.bind(variables, bad)


def test_saved_metric_and_dropdown(spark):
    options = SavedMetric((KEY,), where=(Condition("event_name", "contains", Param("name")),))
    variables = {"name": Variable("searchable_dropdown", "a", options), "least": Variable("number", "1")}
    metric = SavedMetric((KEY,), (COUNT,), (Condition("event_name", "=", Param("name")),), having=(Condition("n", ">=", Param("least")),))
    assert [tuple(r) for r in saved.run_saved(load(spark), A, metric, variables, {"name": "b"}).collect()] == [("b", 1)]
    assert saved.run_saved(load(spark), A, metric, variables, {"name": "b", "least": "2"}).count() == 0
    offered = lambda term: [r[0] for r in saved.dropdown(load(spark), A, "name", variables, {}, term).collect()]
    assert offered("b") == ["b"] and offered("'") == [] and offered("%") == [] and offered(None) == ["a"]
    assert saved.dropdown(load(spark), A, "least", variables, {}).count() == 0


def test_library(spark):
    assert [m["id"] for m in library.list_metrics()] == [f"gq-{n:03d}" for n in range(1, 22)]
    assert library.get_metric("event FUNNEL")["id"] == "gq-013" and library.get_metric("gq-001")["name"] == "Daily Event Volume"
    assert "error" in library.get_metric("GQ-001")
    ev = load(spark)
    dates = {"start_date": "2026-09-01", "end_date": "2026-09-02"}
    assert library.run_metric("gq-010", ev, {**dates, "event_name": "a"}).first()[0] == 2
    cross = library.run_metric("gq-021", ev, {"condition_a": F.col("event_name") == "a", "condition_b": F.col("actor_id") == ""})
    assert sorted(map(tuple, cross.collect())) == [(False, True, 2), (True, True, 2)]
    assert library.run_metric("gq-013", ev, {"step_names": ["a", "b"]}).count() == 1
    for bad in ({"event_name": "a"}, {**dates, "event_name": "a", "property_name": "x') --"}):
        with pytest.raises(MetricError):
            library.run_metric("gq-016", ev, bad)


def test_snapshots(spark, folder):
    value = lambda n: lambda: spark.range(n, n + 1)
    ask = lambda n, s: saved.refresh_metric(spark, "m", value(n), folder, NOW + timedelta(seconds=s))
    seen = [(df.first()[0], (at - NOW).total_seconds(), err) for df, at, err in (ask(1, 0), ask(2, 30.9), ask(3, 31), ask(4, 40))]
    assert seen == [(1, 0, None), (1, 0, None), (3, 31, None), (3, 31, None)]
    broken = lambda: spark.sql("SELECT nope FROM range(1)")
    df, at, error = saved.refresh_metric(spark, "m", broken, folder, NOW + timedelta(hours=1))
    assert df.first()[0] == 3 and "nope" in error
    assert saved.refresh_metric(spark, "other", broken, folder, NOW)[:2] == (None, None)


def test_matrix(spark):
    rows = [("x", "p", "1"), ("x", "p", "2.5"), ("x", "q", "abc"), ("x", "q", "3"), ("y", "p", ""), ("y", "p", None)]
    df = spark.createDataFrame(rows, "a string, b string, v string")
    got = {r["a"]: (r["p"], r["q"]) for r in shape.pivot_matrix(df, "a", "b", "v").collect()}
    assert got == {"x": (3.5, 2.0), "y": (0.0, 0.0)}


def test_series(spark):
    df = spark.createDataFrame([(1, 10, 7), (2, 30, 7), (3, 20, 7)], "x int, a int, b int")
    got = {(r["series"], r["x"]): (r["scaled"], r["original"]) for r in shape.minmax_normalise(df, "x", ["a", "b"]).collect()}
    assert got == {("a", 1): (0, 10), ("a", 2): (100, 30), ("a", 3): (50, 20), ("b", 1): (0, 7), ("b", 2): (0, 7), ("b", 3): (0, 7)}


def test_sampled_values(spark):
    plans = ['{"plan":"pro"}', '{"plan":"pro"}', '{"plan":"free"}', "{}", '{"plan":null}', '{"n":1}', '{"n":"1"}']
    ev = facts_of(spark, [{"properties": p} for p in plans])
    top = lambda f: [tuple(r) for r in explore.top_values_sample(ev, f).collect()]
    assert top("properties.plan") == [("string", "pro", 2, 3, 7), ("string", "free", 1, 3, 7)]
    assert top("properties.n") == [("number", "1", 1, 2, 7), ("string", "1", 1, 2, 7)]


def test_fields_and_summary(spark):
    ev = facts_of(spark, [
        {"event_timestamp": "2026-09-01T10:00:00Z", "properties": '{"b":null,"plan":"pro"}', "source": "web", "country": "DE"},
        {"event_timestamp": "2026-09-01T11:00:00Z", "properties": '{"b":5,"cart":{"items":[1,2],"none":{}}}'},
        {"event_timestamp": "2026-09-01T12:00:00Z", "properties": '{"b":"x"}'},
    ])
    extra = [(r["name"], r["type"]) for r in catalog.field_catalog(ev).collect()][16:]
    assert extra == [("properties.b", "number"), ("properties.cart.items", "object"), ("properties.cart.none", "object"), ("properties.plan", "string")]
    first = shape.doc_summary(ev.where("source = 'web'")).first()["summary"]
    assert [e["path"] for e in first] == ["name", "anon_id", "source", "properties.b", "properties.plan", "system_properties.geo.country", "id"]
    flat = shape.export_rows(ev)
    assert "properties.cart.items" in flat.columns and flat.columns[0] == "name"
    row = shape.export_rows(ev.where("source = ''"), ["name", "properties.cart.items"]).orderBy("occured_at").first()
    assert row["properties.cart.items"] == "[1,2]" and row["occured_at"] == "2026-09-01T11:00:00.000Z"


def test_events_today_uses_the_local_day(spark):
    ev = facts_of(spark, [{"event_timestamp": t} for t in ("2026-08-31T18:29:59Z", "2026-08-31T18:30:00Z", "2026-09-01T18:29:59Z", "2026-09-01T18:30:00Z")])
    assert metrics.events_today(ev, NOW).first()[0] == 2


def test_descriptions_keep_their_creation(spark):
    table = lambda rows: spark.createDataFrame(rows, "event_name string, description string, created_at string, updated_at string")
    base, new = table([("a", "old", "1", "1"), ("b", "keep", "1", "1")]), table([("a", "new", None, "2"), ("c", "first", None, "2")])
    got = sorted(map(tuple, catalog.upsert_descriptions(base, new, ["event_name"]).collect()))
    assert got == [("a", "new", "1", "2"), ("b", "keep", "1", "1"), ("c", "first", "2", "2")]
