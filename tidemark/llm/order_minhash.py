"""Fingerprints of documents by Order MinHash, in SQL functions alone.

A text's k-mers are its runs of ``K`` code points; the n-th occurrence of a k-mer is a k-mer of its own. All of them stand in one fixed order: first those that
begin with a blank, then by a hash of the k-mer, then by the number of the occurrence. The hash's leading bits part them into ``SKETCHES`` ranges; of each range
the ``TAKEN`` minimal ones are selected, put back in the order they have in the text, and hashed as a tuple. Two texts agree in a sketch if the same k-mers are
minimal and stand in the same order, so moved parts count as changes, which a set of k-mers would not notice. The likeness of two fingerprints is the share of
sketches that agree among those that either of them has.

The order lets most texts be read cheaply: k-mers that begin with a blank are looked at first, in long texts only those with hashes below a limit that leaves about
``SAMPLE`` or more. Where that leaves a range short (few words, or no blanks at all), every k-mer of the text is used, so the selection is the exact minimum for every text.

``with_next`` gives each document the next one in descending order of doc_id: keys are cut into at most ``BUCKETS`` ranges, rows are exchanged once by
their range, found by a binary search, and a range also gets the row that follows its last one.

Defined results: a null text counts as empty; an empty text has no k-mers, a sketch of nulls and the likeness 1 to another such text; a text shorter than ``K`` is one k-mer;
whole texts of any length are used. Null doc_ids come last. Rows that share a doc_id are ordered by their texts' hash; rows equal in doc_id and text are one
document in this order, so each of them gets the same result. The only document is its own next. An empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.documents import fence, let
from tidemark.llm.common import place_in, text_of
from tidemark.session import small_side

K = 8
SKETCHES, TAKEN = 32, 2
SAMPLE = 384
#: Bits of a hash below those that name its range.
REST_BITS = 58
BUCKETS, LEAST_ROWS = 20_000, 64
#: Copies of one row from which only about ``COPIES_SENT`` are exchanged; the result is given to all of them.
HOT, COPIES_SENT = 10_000, 1_000
#: Code points a blank stands for, about; only speed depends on it.
WORD = 6
#: What follows a blank in its k-mer; and every k-mer, where the class keeps a match from starting inside a surrogate pair.
BEHIND_BLANK = rf"(?s) (?=(.{{{K - 1}}}))"
EVERYWHERE = rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{K - 1}}}))"
LATER = 1 << (REST_BITS - 1)


def hash_of(run: Column) -> Column:
    """The hash of a k-mer; the bit below its range tells those that begin with no blank, which come later."""
    plain = F.shiftrightunsigned(F.xxhash64(run), 1)
    return F.when(run.startswith(" "), plain.bitwiseAND(F.lit(~LATER))).otherwise(plain.bitwiseOR(F.lit(LATER)))


def blank_hashes(text: Column) -> Column:
    """Hashes of the k-mers that begin with a blank, in text order; in long texts the small ones."""
    halvings = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.char_length(text), F.lit(1)) / (WORD * SAMPLE)))).cast("int")
    limit = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(REST_BITS - 1) - halvings)
    found = F.transform(F.regexp_extract_all(text, F.lit(BEHIND_BLANK), F.lit(1)), lambda rest: hash_of(F.concat(F.lit(" "), rest)))
    return let(limit, lambda once: F.filter(found, lambda h: h.bitwiseAND(F.lit(LATER - 1)) < once))


def all_hashes(text: Column) -> Column:
    """Hashes of all k-mers in text order; a shorter text is one."""
    short = (F.char_length(text) < K) & (text != "")
    return F.transform(F.when(short, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(EVERYWHERE), F.lit(1))), hash_of)


def selected(found: Column) -> Column:
    """For each range: how many k-mers are selected, and the hash of the tuple of them in text order (null for none)."""
    range_of = lambda x: F.shiftright(x["h"], REST_BITS)

    def pair_hash(pair: Column) -> Column:
        one, two = pair["one"], pair["two"]
        again = (one["h"] == two["h"]).cast("int")  # the second is the k-mer's second occurrence
        in_order = F.when(one["i"] < two["i"], F.xxhash64(one["h"], F.lit(0), two["h"], again)).otherwise(F.xxhash64(two["h"], again, one["h"], F.lit(0)))
        held = F.when(one.isNull(), 0).when(two.isNull(), 1).otherwise(TAKEN)
        made = F.when(held == TAKEN, in_order).when(held == 1, F.xxhash64(one["h"], F.lit(0)))
        return F.struct(held.alias("held"), made.bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash"))

    def all_ranges(placed: Column, steps: Column) -> Column:
        def below(end: Column) -> Column:
            """How many of the sorted hashes are below ``end``."""
            ahead = lambda at, step: (at + step <= F.size(placed)) & (F.get(placed, at + step - 1)["h"] < end)
            return F.aggregate(steps, F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at))

        def pair(n: Column, at: Column) -> Column:
            mine = lambda x: F.when(range_of(x) == n, x)
            return F.struct(mine(F.get(placed, at)).alias("one"), mine(F.get(placed, at + 1)).alias("two"))

        one = lambda n: let(below(F.shiftleft(n, REST_BITS)), lambda at: let(pair(n, at), pair_hash))
        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SKETCHES - 1).cast("long")), one)

    ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    steps = lambda placed: F.filter(F.array(*[F.lit(1 << n) for n in reversed(range(31))]), lambda step: step <= F.size(placed))
    return let(ordered, lambda placed: let(steps(placed), lambda held: all_ranges(placed, held)))


def sketch(text: Column) -> Column:
    """The sketches of a text: a hash for each range, null where the text has no k-mer."""
    few = selected(blank_hashes(text))
    short = lambda found: F.exists(found, lambda x: x["held"] < TAKEN)
    return F.transform(let(few, lambda found: F.when(short(found), selected(all_hashes(text))).otherwise(found)), lambda x: x["hash"])


def printed(sketches: Column) -> Column:
    return F.array_join(F.transform(sketches, lambda x: F.coalesce(F.lpad(F.hex(x), 8, "0"), F.lit("-"))), "")


def likeness(one: Column, other: Column) -> Column:
    """The share of equal sketches among those that either text has; 1 if both have none."""
    known = F.filter(F.zip_with(one, other, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False)))), lambda same: same.isNotNull())
    equal = F.size(F.filter(known, lambda same: same))
    return F.when(F.size(known) == 0, 1.0).otherwise(equal / F.size(known))


def _ordered_key(docs: DataFrame) -> Column:
    """A text that sorts as (doc_id, hash of the text); null doc_ids sort first."""
    name = F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        name = F.lpad(F.hex(name.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), name.cast("string"), F.lit("\0")), F.lit("0")), F.lpad(F.hex(F.xxhash64("text")), 16, "0"))


def with_next(docs: DataFrame, carried: Column, name: str) -> tuple[DataFrame, DataFrame, Column]:
    """Different documents with ``name``: ``carried`` of the next one, in ranges; the keys of copies and their numbers; the window for a further look at the next one.

    Rows with ``own`` 0 are there for their neighbour only.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("key", _ordered_key(docs))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    size = max(LEAST_ROWS, -(-counts.count() // BUCKETS))
    ranged = counts.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    numbered = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(F.col("key").desc())))
    bounds = sorted(r["key"] for r in numbered.filter((F.col("n") - 1) % size == 0).select("key").collect())  # about BUCKETS at most: each the last of a range
    copies = counts.filter("copies > 1")
    hot = small_side(copies.filter(F.col("copies") > HOT))
    thinned = rows.join(hot, "key", "left").filter(F.col("copies").isNull() | (F.rand(7) * F.col("copies") < COPIES_SENT)).drop("copies") if not hot.isEmpty() else rows
    if not bounds:
        bounds = [""]
    at = thinned.withColumn("at", fence(place_in(bounds, F.col("key"))))
    here = F.struct(F.col("at").alias("range"), F.lit(1).alias("own"))
    above = F.struct(((F.col("at") + 1) % len(bounds)).alias("range"), F.lit(0).alias("own"))
    last = F.get(F.array(*[F.lit(b) for b in bounds]), F.col("at")) == F.col("key")
    sent = at.withColumn("to", F.explode(F.when(last, F.array(here, above)).otherwise(F.array(here)))).select("doc_id", "text", "key", "to.*").repartition("range")
    single = sent.withColumn("copy", F.row_number().over(Window.partitionBy("range", "own", "key").orderBy("doc_id"))).filter("copy = 1").drop("copy")
    order = Window.partitionBy("range").orderBy("own", "key")
    return single.withColumn(name, F.lag(carried).over(order)), copies, order


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    ``edited`` is the text whose last third is replaced by the beginning of the next document.
    """
    rows, copies, order = with_next(docs, F.col("text"), "next")
    chars = F.char_length("text")
    third = F.floor(chars / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - third), F.substring(F.coalesce(F.col("next"), F.col("text")), F.lit(1), third))
    rows = rows.withColumns({"n_chars": fence(chars), "edited": fence(edited)}).drop("next")
    rows = rows.withColumns({"sketches": fence(sketch(F.col("text"))), "edited_sketches": fence(sketch(F.col("edited")))})
    rows = rows.select("range", "own", "key", "doc_id", "n_chars", "edited", "sketches", "edited_sketches")
    rows = rows.withColumn("next", F.lag("sketches").over(order)).filter("own = 1")
    made = rows.select(
        "key",
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited",
        printed(F.col("sketches")).alias("fingerprint"),
        printed(F.col("edited_sketches")).alias("edited_fingerprint"),
        likeness(F.col("sketches"), F.col("edited_sketches")).alias("near_edited"),
        likeness(F.col("sketches"), F.coalesce("next", "sketches")).alias("near_next"),
    )
    if copies.isEmpty():
        return made.drop("key")
    many = made.join(small_side(copies), "key", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    step = F.lit(100_000)  # a row's copies are made in two steps, so no array of them is long
    many = many.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), step.cast("long"))))
    many = many.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(step.cast("long"), F.col("copies") - F.col("from") + 1))))
    return many.drop("key", "copies", "from", "copy")
