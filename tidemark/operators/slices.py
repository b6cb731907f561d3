"""Order-dependent work on keys of any size.

A window over one key is one task, and one key (all anonymous visitors, say) may hold a third of the
rows. Two facts bound such work: rows that agree on everything the result depends on can be counted
before the shuffle, and a neighbour is almost always in the same short time slice. So rows are
grouped by (key, slice), and one boundary row per slice links neighbouring slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import small_side

SLICE_S = 3_600
#: Rows of one key that a slice may hold; a fuller one is cut into shorter ones.
SLICE_ROWS = 100_000


def sliced(rows: DataFrame, key: str, ts: str, name: str, slice_s: int = SLICE_S, most: int = SLICE_ROWS) -> DataFrame:
    """Adds the start (in milliseconds) of each row's slice.

    Slices of a key are ``slice_s`` long where they hold at most ``most`` rows. A fuller one is cut into as many equal
    parts as its rows call for, down to a millisecond, so no key is one long task in its busy hours.
    """
    whole = rows.withColumn("_long", F.floor(F.unix_seconds(ts) / slice_s))
    full = whole.groupBy(key, "_long").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    parts = small_side(full.select(key, "_long", F.ceil(F.col("_n") / most).alias("_parts")))
    start, span = F.col("_long") * (slice_s * 1000), slice_s * 1000
    width = F.greatest(F.ceil(span / F.coalesce("_parts", F.lit(1))), F.lit(1))
    at = start + F.floor((F.unix_millis(ts) - start) / width) * width
    return whole.join(parts, [key, "_long"], "left").withColumn(name, at).drop("_long", "_parts")


def adjacent_pairs(df: DataFrame, key: str, ts: str, value: str | None = None, slice_s: int = SLICE_S) -> DataFrame:
    """Neighbouring rows of each key in (ts, value) order, as distinct pairs with a count.

    Returns key, ts, value, next_ts, next_value, pairs. Equal rows are counted first, so a (key, slice)
    group holds at most one row per distinct (ts, value) however often each occurs.
    """
    value_col = F.lit(None).cast("string") if value is None else F.col(value)
    rows = df.select(F.col(key).alias("key"), F.col(ts).alias("ts"), value_col.alias("value"))
    counted = sliced(rows.groupBy("key", "ts", "value").agg(F.count(F.lit(1)).alias("copies")), "key", "ts", "slice", slice_s)
    at = F.struct("ts", "value")
    in_slice = Window.partitionBy("key", "slice").orderBy("ts", "value")
    placed = counted.withColumns({"next": F.lead(at).over(in_slice), "n": F.row_number().over(in_slice)})
    pair = lambda after, pairs: F.struct(after.alias("next"), pairs.alias("pairs"))
    candidates = F.array(
        F.when(F.col("next").isNotNull(), pair(F.col("next"), F.lit(1).cast("long"))),
        F.when(F.col("copies") > 1, pair(at, F.col("copies") - 1)),
    )
    inner = placed.withColumn("p", F.explode(F.filter(candidates, lambda p: p.isNotNull()))).select(
        "key", at.alias("at"), "p.next", "p.pairs"
    )
    # Both branches read one shuffle: the boundary rows are the ends of the same windows.
    edges = (
        placed.where("n = 1 or next is null")
        .groupBy("key", "slice")
        .agg(
            F.min(at).alias("first"),
            F.max(at).alias("last"),
            F.max(F.least(F.col("copies"), F.lit(1))).alias("pairs"),
        )
    )
    by_slice = Window.partitionBy("key").orderBy("slice")
    across = (
        edges.withColumn("next", F.lead("first").over(by_slice))
        .where("next is not null")
        .select("key", F.col("last").alias("at"), "next", "pairs")
    )
    return inner.unionByName(across).select(
        F.col("key").alias(key),
        F.col("at.ts").alias("ts"),
        F.col("at.value").alias("value"),
        F.col("next.ts").alias("next_ts"),
        F.col("next.value").alias("next_value"),
        "pairs",
    )


def with_neighbours(df: DataFrame, key: str, ts: str, tie: str, slice_s: int = SLICE_S) -> DataFrame:
    """Every row with its key's `first_ts`, `last_ts` and its own `previous_ts`, in (ts, tie) order."""
    rows = sliced(df, key, ts, "_slice", slice_s)
    edges = rows.groupBy(key, "_slice").agg(F.min(ts).alias("_low"), F.max(ts).alias("_high"))
    by_slice = Window.partitionBy(key).orderBy("_slice")
    whole = Window.partitionBy(key)
    bounds = edges.select(
        key,
        "_slice",
        F.lag("_high").over(by_slice).alias("_before"),
        F.min("_low").over(whole).alias("first_ts"),
        F.max("_high").over(whole).alias("last_ts"),
    )
    in_slice = Window.partitionBy(key, "_slice").orderBy(ts, tie)
    lagged = rows.withColumn("_lag", F.lag(ts).over(in_slice))
    return (
        lagged.join(bounds, [key, "_slice"])
        .withColumn("previous_ts", F.coalesce("_lag", "_before"))
        .select(*df.columns, "first_ts", "last_ts", "previous_ts")
    )
