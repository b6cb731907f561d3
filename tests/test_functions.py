"""Times, names, addresses and dynamic properties."""

import ipaddress
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import addresses, documents, names, props, times

NOW = datetime(2026, 9, 1, 12, tzinfo=timezone.utc)


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r[0] for r in df.select("n", build(F.col("v")).alias("out")).orderBy("n").select("out").collect()]


@pytest.mark.parametrize(
    ("span", "width"),
    [(1, "1s"), (60, "1s"), (61, "5s"), (900, "30s"), (3_600, "1m"), (86_400, "30m"), (7 * 86_400, "3h"), (30 * 86_400, "12h"),
     (90 * 86_400, "7d"), (365 * 86_400, "7d"), (5 * 365 * 86_400, "365d")],
)
def test_histogram_interval(span, width):
    assert times.histogram_interval(NOW, NOW + timedelta(seconds=span)) == width


@pytest.mark.parametrize("span", [0, -5, 0.4, 61 * 365 * 86_400])
def test_no_histogram_interval(span):
    with pytest.raises(ValueError):
        times.histogram_interval(NOW, NOW + timedelta(seconds=span))


def test_time_tokens():
    assert times.resolve_time("now-15m", NOW) == NOW - timedelta(minutes=15)
    assert times.resolve_time(" now ", NOW) == NOW
    assert times.resolve_time("2026-09-01T10:00:00Z", NOW) == NOW - timedelta(hours=2)
    assert times.resolve_time("yesterday", NOW) is None
    assert times.resolve_range("now", "now-1h", NOW) is None and times.resolve_range("x", "now", NOW) is None
    assert len(times.QUICK_RANGES) == 8
    assert all(times.resolve_range(*r, NOW) for r in times.QUICK_RANGES.values())
    assert times.ends_at_fixed_time("2026-09-01") and not times.ends_at_fixed_time("now-1h")
    assert (times.interval_ms("12h"), times.interval_ms("1w"), times.interval_ms("x")) == (43_200_000, 604_800_000, None)


def test_durations(spark):
    shown = column(spark, [850.0, 3_240.0, 245_000.0, 7_620_000.0, 273_600_000.0, -1.0], times.duration_text, "double")
    assert shown == ["850ms", "3.2s", "4m 05s", "2h 07m", "3d 4h", "—"]
    assert column(spark, [0.0, -3.0], times.offset_text, "double") == ["+0ms", "+0ms"]


def test_rfc3339(spark):
    found = column(spark, ["2024-01-01T00:00:00.123456789+05:30", "2024-01-01t00:00:00z", "2024-01-01", "10:00", "2024-13-01T00:00:00Z"], times.rfc3339)
    assert found[0] == datetime(2023, 12, 31, 18, 30, 0, 123456) and found[1] == datetime(2024, 1, 1) and found[2:] == [None] * 3


def test_weeks_start_on_sunday(spark):
    days = column(spark, ["2024-01-06", "2024-01-07", "2024-01-08"], lambda c: times.week_start(c.cast("date")).cast("string"))
    assert days == ["2023-12-31", "2024-01-07", "2024-01-07"]


def test_slugs(spark):
    good = ["abcdef", "a-b-c1", "a" * 30]
    bad = ["abcde", "a" * 31, "1abcdef", "Abcdef", "abcde-", "abc_def", "abcdéf", "", "abcdef\n", None]
    assert column(spark, good + bad, names.is_slug) == [True] * 3 + [False] * len(bad)


def test_index_and_topic_names(spark):
    index = {"events-a": True, "": False, ".": False, "..": False, "_a": False, "-a": False, "+a": False, "A": False, "a b": False,
             "a,b": False, "a#b": False, "a:b": False, 'a"b': False, "a/b": False, "a\\b": False, "a*": False, "é" * 127: True, "é" * 128: False}
    assert column(spark, list(index), names.is_index_name) == list(index.values())
    topic = {"a.B_c-1": True, "": False, ".": False, "..": False, "a b": False, "{org_id}": False, "x" * 249: True, "x" * 250: False}
    assert column(spark, list(topic), names.is_topic_name) == list(topic.values())


def test_client_ip(spark):
    rows = [("1.1.1.1, 2.2.2.2", "3.3.3.3", "1.1.1.1"), (" , 2.2.2.2", "3.3.3.3", "9.9.9.9"), (None, " 3.3.3.3 ", "3.3.3.3"), ("", "3.3.3.3", "3.3.3.3"), (None, None, "9.9.9.9")]
    df = spark.createDataFrame(rows, "f string, r string, want string")
    out = df.select(names.client_ip(F.col("f"), F.col("r"), F.lit("9.9.9.9")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in out)


def test_public_addresses(spark):
    public = "8.8.8.8 172.32.0.1 100.128.0.1 0.0.0.1 2001:4860:4860::8888 ::ffff:10.0.0.1 1:2:3:4:5:6:7:: ::1.2.3.4 ::10".split()
    private = ("10.1.2.3 172.16.0.1 192.168.1.1 100.64.1.1 0.0.0.0 127.0.0.1 169.254.1.1 224.0.0.1 255.255.255.255 192.0.2.4 198.51.100.7 "
               "203.0.113.9 :: ::1 0:0:0:0:0:0:0:1 fc00::1 fd12::1 fe80::1 febf::1 ff02::1 2001:db8::1 2001:0db8::1").split()  # fmt: skip
    broken = ["1.2.3", "abc", "01.2.3.4", "256.1.1.1", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "", None]
    for text in public + private:
        ipaddress.ip_address(text)
    got = column(spark, public + private + broken, addresses.is_public_ip)
    assert got == [True] * len(public) + [False] * (len(private) + len(broken))


def test_whole_json(spark):
    texts = ['{"a":1}', "[1]", "5", ' {"a":\n1} ', '{"a":1} x', '{"a":1}{"a":2}', '{"a":1}}', '{"a":1},2', '{"a":1}],[2', "", "{a:1}", None]
    got = column(spark, texts, lambda c: F.to_json(documents.whole_json(c)))
    assert got == ['{"a":1}', "[1]", "5", '{"a":1}'] + [None] * 8


def test_uuid_spellings(spark):
    want = "a1a2a3a4-b1b2-c1c2-d1d2-d3d4d5d6d7d8"
    texts = [want, want.upper(), want.replace("-", ""), "{" + want + "}", "urn:uuid:" + want, want[:-1], "x" + want, None]
    assert column(spark, texts, documents.canonical_uuid) == [want] * 5 + [None] * 3


def test_shapes_and_leaves(spark):
    text = '{"a":1,"b":{"c":"x","d":{}},"e":[1,2],"f":12.5,"n":null,"odd `k: ,>":{"x.y":3.0,"z":[{"q":1}]},"m":[1,"x"]}'
    df = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("v"))
    leaves = props.leaf_rows(df.select(props.shape_of(F.col("v")).alias("shape")))
    found = {r["path"]: r["name"] for r in leaves.select("path", props.catalog_type(F.col("stored")).alias("name")).collect()}
    assert found == {
        "a": "Int64", "b.c": "String", "b.d": "Object<>", "e": "Array(Nullable(Int64))", "f": "Float64", "n": "Void",
        "odd `k: ,>.x.y": "Float64", "odd `k: ,>.z": "Array(JSON)", "m": "Array(Dynamic)",
    }
    assert "Python" not in leaves._jdf.queryExecution().toString()
    flat = df.select(F.explode(props.flat_entries(F.col("v"))).alias("e")).select("e.path", F.to_json("e.value").alias("j")).collect()
    assert {r["path"]: r["j"] for r in flat} == {
        "a": "1", "b.c": '"x"', "b.d": "{}", "e": "[1,2]", "f": "12.5", "n": "null", "odd `k: ,>.x.y": "3", "odd `k: ,>.z": '[{"q":1}]', "m": '[1,"x"]',
    }


def test_leaves_of_odd_shapes(spark):
    texts = ['{"a":[[1],[2]],"b":[[{"x":1}]],"c":[],"d":[null],"e":[true],"f":[[]]}', '{"a":{"b":{"c":{"d":{"e":[1.5]}}}},"g":{"h":{}}}',
             '{"x\\"y":{"p\\nq":1},"OBJECT<":{"`":"t"},"9":{"":true}}', "{}", "[1]", "5", "null", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", F.parse_json("t").alias("v"))
    leaves = props.leaf_rows(df.select("n", props.shape_of(F.col("v")).alias("shape")))
    found = {(r["n"], r["path"]): r["name"] for r in leaves.select("n", "path", props.catalog_type(F.col("stored")).alias("name")).collect()}
    assert found == {
        (0, "a"): "Array(Array(Nullable(Int64)))", (0, "b"): "Array(Array(JSON))", (0, "c"): "Array(Nullable(String))",
        (0, "d"): "Array(Nullable(String))", (0, "e"): "Array(Nullable(Bool))", (0, "f"): "Array(Array(Nullable(String)))",
        (1, "a.b.c.d.e"): "Array(Nullable(Float64))", (1, "g.h"): "Object<>",
        (2, 'x"y.p\nq'): "Int64", (2, "OBJECT<.`"): "String", (2, "9."): "Bool",
    }
    flat = df.select("n", F.explode(props.flat_entries(F.col("v"))).alias("e")).select("n", "e.path").collect()
    assert sorted((r["n"], r["path"]) for r in flat) == sorted(found)


def test_stored_type_is_not_a_cast(spark):
    df = spark.createDataFrame([('{"a":"DE","b":5}',)], "t string").select(F.parse_json("t").alias("v"))
    row = df.select(props.stored_as(F.col("v"), "a"), props.stored_as(F.col("v"), "b"), props.text_at(F.col("v"), "b")).first()
    assert tuple(row) == ("DE", None, "5")


def test_defaults_and_nesting(spark):
    rows = ['{"a":1}', '{"a":{"b":1}}', '{"a":[1]}', "[1]", "5", None]
    nested = column(spark, rows, lambda c: props.has_nested(F.parse_json(c)))
    assert nested == [False, True, True, False, False, False]
    merged = column(spark, rows, lambda c: F.to_json(documents.merge_defaults(F.parse_json(c), F.parse_json(F.lit('{"a":0,"z":9}')))))
    assert merged == ['{"a":1,"z":9}', '{"a":{"b":1},"z":9}', '{"a":[1],"z":9}', "[1]", "5", None]
