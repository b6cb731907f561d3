"""Trust and distrust settle on graphs where a fixed number of rounds or of decimals falls short."""

import pytest

from tidemark.llm import url_filter
from tidemark.llm.queries import URL_RULES


def test_a_host_far_from_a_blocked_seed_is_blocked(spark):
    """40 links lead to bad.net; no trusted host is near."""
    n = 40
    link = lambda host: f'<a href="http://{host}/">x</a>'
    rows = [(i, f"http://h{i}.com/", link(f"h{i + 1}.com" if i + 1 < n else "bad.net")) for i in range(n)] + [(n, "http://bad.net/", ""), (n + 1, "http://alone.com/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in url_filter.verdicts(pages, URL_RULES).collect()}
    assert [found[i]["verdict"] for i in range(n + 2)] == ["block"] * (n + 1) + ["allow"]
    assert found[0]["distrust"] / found[1]["distrust"] == pytest.approx(url_filter.DAMPING) and found[0]["trust"] == 0


def test_shares_below_any_decimal_place_count(spark):
    """A hub with 1e15 links hands on less than any fixed decimal place keeps; its neighbours are reached all the same."""
    edges = spark.createDataFrame([("leaf", "hub", 1), ("many", "hub", 10**15), ("hub", "bad", 1)], "source string, target string, n long")
    seeds = spark.createDataFrame([("bad", 0, 1), ("hub", 0, 0), ("leaf", 0, 0), ("many", 0, 0)], "host string, trusted int, banned int")
    found = {r["host"]: r for r in url_filter.ranks(edges, seeds).collect()}
    total = 1 + 0.85 + 0.85**2
    assert found["leaf"]["distrust"] == pytest.approx(0.85**2 / total / 1e15, rel=1e-6)
    assert found["many"]["distrust"] == pytest.approx(0.85**2 / total) and found["leaf"]["trust"] == 0
