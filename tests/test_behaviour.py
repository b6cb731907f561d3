"""Order-dependent operators against brute force, with one actor holding a third of the rows."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from data import facts_of
from pyspark.sql import functions as F

from tidemark.operators import behaviour, shape, slices

START = datetime(2026, 9, 1, 22, tzinfo=timezone.utc)


def skewed(seed, n=900, names="abcd", spread_s=40_000):
    """Rows where actor '' has a third, seconds collide and copies occur."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        actor = "" if rng.random() < 0.34 else f"u{rng.randrange(40)}"
        at = START + timedelta(milliseconds=rng.randrange(spread_s) * rng.choice([250, 1000]))
        text = rng.choice(["red", "red shoes", "reds", "blue", "blue hat", None])
        body = "{}" if text is None else f'{{"q":"{text}"}}'
        row = {"actor_id": actor, "event_name": rng.choice(names), "event_timestamp": at.isoformat(), "properties": body, "session_id": actor and f"s{actor}"}
        rows += [row] * (3 if rng.random() < 0.1 else 1)
    return rows


def brute_funnel(rows, steps, window):
    """The state machine: per step the start of the chain that reached it last."""
    hits = defaultdict(list)
    for row in rows:
        second = int(datetime.fromisoformat(row["event_timestamp"]).timestamp())
        hits[row["actor_id"]] += [(second, n) for n, step in enumerate(steps) if row["event_name"] == step]
    levels = {}
    for actor, found in hits.items():
        chain, best = [None] * len(steps), 0
        for second, n in sorted(found):
            if n == 0:
                chain[0] = second
            elif chain[n - 1] is not None and second <= chain[n - 1] + window:
                chain[n] = chain[n - 1]
            else:
                continue
            best = max(best, n + 1)
        if best:
            levels[actor] = best
    return levels


@pytest.mark.parametrize(("seed", "steps", "window"), [(1, "abc", 600), (2, "abac", 3_000), (3, "aab", 60), (4, "dcba", 20_000), (5, "a", 10)])
def test_funnel_equals_the_state_machine(spark, seed, steps, window):
    rows = skewed(seed, spread_s=300_000)
    got = behaviour.funnel_levels(facts_of(spark, rows), [F.col("event_name") == s for s in steps], window).collect()
    assert {r["actor_id"]: r["level"] for r in got} == brute_funnel(rows, steps, window)


def test_funnel_counts_accumulate(spark):
    minutes = lambda m: (START + timedelta(minutes=m)).isoformat()
    walks = {"u1": "abc", "u2": "abc", "u3": "a", "u4": "a", "u5": "cba"}
    rows = [{"actor_id": u, "event_name": n, "event_timestamp": minutes(i)} for u, w in walks.items() for i, n in enumerate(w)]
    got = behaviour.funnel(facts_of(spark, rows), ["a", "b", "c"]).collect()
    # Nobody stopped at b, so it has no row.
    assert [tuple(r) for r in got] == [(1, "a", 5), (3, "c", 2)]


def test_funnel_bound_is_inclusive(spark):
    rows = [{"actor_id": u, "event_name": n, "event_timestamp": (START + timedelta(seconds=s)).isoformat()}
            for u, last in (("in", 1800.9), ("out", 1801)) for n, s in (("a", 0.2), ("b", last))]
    steps = [F.col("event_name") == n for n in "ab"]
    assert {r[0]: r[1] for r in behaviour.funnel_levels(facts_of(spark, rows), steps).collect()} == {"in": 2, "out": 1}


def by_actor(rows, name):
    found = defaultdict(list)
    for row in rows:
        if row["event_name"] == name:
            found[row["actor_id"]].append(row)
    return found


@pytest.mark.parametrize("seed", [11, 12])
def test_gaps_equal_brute_force(spark, seed):
    rows, want = skewed(seed), Counter()
    for found in by_actor(rows, "a").values():
        at = sorted(datetime.fromisoformat(r["event_timestamp"]) for r in found)
        for one, two in zip(at, at[1:]):
            gap = (two - one).total_seconds()
            want["<10s" if gap < 10 else "10-30s" if gap < 30 else "30-60s" if gap < 60 else "1-5min" if gap < 300 else "5min+"] += 1
    got = behaviour.consecutive_gap(facts_of(spark, rows), "a").collect()
    assert {r[0]: r[1] for r in got} == dict(want)
    assert [r[0] for r in got] == sorted(r[0] for r in got)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_similarity_equals_brute_force(spark):
    rows, want = skewed(21), Counter()
    text = lambda r: None if r["properties"] == "{}" else r["properties"][6:-2]
    for found in by_actor(rows, "b").values():
        found.sort(key=lambda r: (datetime.fromisoformat(r["event_timestamp"]), text(r) is not None, text(r) or ""))
        for one, two in zip(found, found[1:]):
            if text(one) is not None and text(two) is not None:
                d = distance(text(one), text(two))
                want["identical" if d == 0 else "minor_change" if d <= 2 else "moderate_change" if d <= 5 else "major_change"] += 1
    got = behaviour.consecutive_similarity(facts_of(spark, rows), "b", "q").collect()
    assert {r[0]: r[1] for r in got} == dict(want)


@pytest.mark.parametrize("slice_s", [1, 60, 10_000_000])
def test_pairs_do_not_depend_on_the_slices(spark, slice_s):
    ev = facts_of(spark, skewed(31, 300))
    pairs = lambda s: sorted(map(tuple, slices.adjacent_pairs(ev, "actor_id", "event_timestamp", "event_name", s).groupBy("value", "next_value").agg(F.sum("pairs")).collect()))
    assert pairs(slice_s) == pairs(3_600)


def test_timeline(spark):
    at = [0, 1, 31, 31, 5_000]
    rows = [{"session_id": "s", "event_name": f"e{n}", "event_id": str(n), "event_timestamp": (START + timedelta(seconds=s)).isoformat(),
             "properties": '{"a":{"b":1},"c":[1],"d":null,"e":"x","f":2}'} for n, s in enumerate(at)]
    got = behaviour.session_timeline(facts_of(spark, rows), "s").orderBy("event_timestamp", "event_id").collect()
    assert [r["offset_ms"] for r in got] == [s * 1000 for s in at]
    assert [r["gap_ms"] for r in got] == [None, 1000, 30_000, 0, 4_969_000]
    assert [r["idle"] for r in got] == [False, False, True, False, True]
    assert got[4]["offset_text"] == "+1h 23m" and got[0]["properties_shown"] == "a.b=1, c=[1], d=—, e=x"
    spots = behaviour.strip_position(facts_of(spark, rows)).orderBy("event_id").collect()
    assert [round(r["position"], 4) for r in spots] == [0, 0.0002, 0.0062, 0.0062, 1]


def test_one_event_has_position_zero(spark):
    assert behaviour.strip_position(facts_of(spark, [{"session_id": "s"}])).first()["position"] == 0


def brute_break(edges):
    """Removes the lightest edge on any cycle until there is none."""
    left, removed = dict(edges), set()
    while True:
        def reaches(start, goal):
            seen, todo = set(), [start]
            while todo:
                node = todo.pop()
                if node == goal:
                    return True
                if node not in seen:
                    seen.add(node)
                    todo += [t for s, t in left if s == node]
            return False

        cyclic = [(v, s, t) for (s, t), v in left.items() if reaches(t, s)]
        if not cyclic:
            return removed
        _, s, t = min(cyclic)
        del left[s, t]
        removed.add((s, t))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_equal_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    edges = {(s, t): rng.randrange(1, 9) for s in "abcdef" for t in "abcdef" if rng.random() < 0.5}
    df = spark.createDataFrame([(s, t, v) for (s, t), v in edges.items()], "source string, target string, value long")
    got = {(r["source"], r["target"]) for r in shape.break_cycles(df).where("removed").collect()}
    assert got == brute_break(edges)


def test_the_number_of_removed_edges_is_reported(spark):
    edges = lambda *rows: spark.createDataFrame(list(rows), "source string, target string, value long")
    got = lambda df: sorted(map(tuple, shape.acyclic_flow(shape.break_cycles(df)).collect()), key=str)
    assert got(edges(("a", "b", 5), ("b", "a", 2), ("b", "c", 1), ("c", "c", 9))) == [("a", "b", 5, 2), ("b", "c", 1, 2)]
    assert got(edges(("a", "a", 3))) == [(None, None, None, 1)] and got(edges(("a", "b", 3))) == [("a", "b", 3, 0)]
    assert got(edges()) == [(None, None, None, 0)]


def test_full_slices_are_cut(spark, monkeypatch):
    """One session that holds all rows of an hour: many slices, the same neighbours."""
    rows = skewed(41, 400, spread_s=3_000)
    ev = facts_of(spark, [{**r, "session_id": "kiosk"} for r in rows])
    pairs = lambda: sorted(map(tuple, slices.adjacent_pairs(ev, "session_id", "event_timestamp", "event_name").groupBy("value", "next_value").agg(F.sum("pairs")).collect()))
    near = lambda: sorted(map(str, slices.with_neighbours(ev, "session_id", "event_timestamp", "event_id").select("event_id", "first_ts", "previous_ts").collect()))
    whole = pairs(), near()
    cut = slices.sliced(ev, "session_id", "event_timestamp", "slice", most=25).groupBy("slice").count()
    assert cut.count() >= 10 and slices.sliced(ev, "session_id", "event_timestamp", "slice").select("slice").distinct().count() <= 2
    monkeypatch.setattr(slices.sliced, "__defaults__", (slices.SLICE_S, 25))
    assert (pairs(), near()) == whole


def test_edit_distance_counts_bytes(spark):
    rows = [{"event_name": "b", "actor_id": "x", "event_timestamp": f"2026-09-01T10:00:0{n}Z", "properties": f'{{"q":"{t}"}}'} for n, t in enumerate(["aaé", "aae", "éé", "é"])]
    got = {r[0]: r[1] for r in behaviour.consecutive_similarity(facts_of(spark, rows), "b", "q").collect()}
    assert got == {"minor_change": 2, "moderate_change": 1}  # 2, 4 and 2 bytes apart
