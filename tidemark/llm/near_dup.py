"""Near duplicates by b-bit MinHash, confirmed on full sets, with the classes of linked documents.

1. A document's set is its distinct 5-word shingles (64-bit fingerprints). Documents with equal sets become one node, named by a digest of
   the set, before anything else is exchanged.
2. Each node has ``HASHES`` minima. Bands of ``ROWS`` whole minima give its buckets; the low ``BITS`` bits of all minima are packed
   into eight 64-bit integers.
3. Candidates: in each bucket one pivot meets every other member, so a bucket of n nodes gives n - 1 pairs. The similarity of a pair is
   estimated by counting equal fields of the packed minima, corrected for chance agreement; pairs far below the threshold go.
4. The rest are confirmed on full sets, and links give classes. Buckets that still hold several classes get another turn with another
   pivot; pairs inside one class are never asked again. In the last turn every pair that shares a bucket across two classes is asked, so
   no link that the bands can see is lost: small buckets are paired by a join (and filtered by the estimate), large ones are compared on
   full sets in blocks of ``BLOCK`` members, one pair of blocks at a time, and a task returns only as many links as join its classes.
5. Classes come from min-label rounds on the links (large star, small star), with files between the rounds.

Misses: a pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS, that is all but 5e-8 at 0.8. The estimate
turns away a pair only when it is ``MARGIN`` below the threshold, over five standard errors of 128 fields (5e-7 of pairs at 0.8).

Defined results: null, empty and blank texts have an empty set, are linked with nothing and are a class of their own; with fewer than five words
the whole sequence is the one shingle; repeated rows (also of one doc_id) have equal sets and share a class; the class id is the smallest
doc_id in it, ``kept`` marks the rows with that doc_id (``drop_near_copies`` keeps exactly one row); a null doc_id is never the smallest
unless alone; an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import id_type, only, ship, slices, stored, text_of

WORDS = 5
NEAR = 85  # per cent, where the caller names no other
HASHES, ROWS, BANDS = 128, 4, 32
BITS = 4
MARGIN = 0.2
REMEMBERED = 500_000
SMALL, BLOCK = 32, 2_000
PIVOT_ROUNDS = 2
_FIELDS = 0x1111_1111_1111_1111

_rng = np.random.default_rng(19)
_MULTIPLIERS = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_OFFSETS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_BAND_MIX = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


class Fingerprints(dict):
    """Word -> 64-bit fingerprint."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct fingerprints of the shingles of a whole text."""
    words = text.encode().lower().split() if text else []  # bytes fold and split on ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    known = only(("near duplicates",), Fingerprints)
    if len(known) > REMEMBERED:
        known.clear()
    prints = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    run = np.full(len(words) - size + 1, size, np.uint64)
    for n in range(size):
        run = _mixed(run * np.uint64(0x9E3779B97F4A7C15) + prints[n : n + len(run)])
    return np.unique(run)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each set; the sets are not empty."""
    flat = np.concatenate(sets)
    low = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    found = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        found[:, k] = np.minimum.reduceat(low * _MULTIPLIERS[k] + _OFFSETS[k], starts)
    return found


def band_keys(found: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(found), BANDS), np.uint64)
    for row in range(ROWS):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + found[:, row : BANDS * ROWS : ROWS].astype(np.uint64) * _BAND_MIX[row])
    # The band's number is part of its key.
    return _mixed(keys ^ _mixed(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def packed(found: np.ndarray) -> np.ndarray:
    """The low BITS bits of all minima in HASHES * BITS / 64 integers."""
    fields = (found & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(found), -1, 64 // BITS)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return (fields << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


def _lists(values: np.ndarray) -> pa.ListArray:
    edges = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32) if values.size else np.zeros(len(values) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values.reshape(-1), pa.int64()))


def sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: doc_id, sha and text to doc_id, sha, n_shingles, node, bands, bits; nulls for empty sets."""
    from xxhash import xxh3_128_digest

    names = ["doc_id", "sha", "n_shingles", "node", "bands", "bits"]
    for whole in batches:
        for batch in slices(whole, column=2):
            sets = [shingle_set(text) for text in batch.column(2).to_pylist()]
            full = np.flatnonzero([len(s) > 0 for s in sets])
            empty = np.flatnonzero([len(s) == 0 for s in sets])
            named = lambda at: [batch.column(n).take(pa.array(at)) for n in (0, 1)]  # noqa: B023, E731
            if len(full):
                own = [sets[i] for i in full]
                found = minima(own)
                made = [pa.array([len(s) for s in own], pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), _lists(band_keys(found)), _lists(packed(found))]
                yield pa.RecordBatch.from_arrays([*named(full), *made], names)
            if len(empty):
                none = [pa.array(np.zeros(len(empty), np.int64)), pa.nulls(len(empty), pa.binary()), *(pa.nulls(len(empty), pa.list_(pa.int64())) for _ in range(2))]
                yield pa.RecordBatch.from_arrays([*named(empty), *none], names)


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: text to node and its sorted set."""
    from xxhash import xxh3_128_digest

    for whole in batches:
        for batch in slices(whole, column=0):
            sets = [s for s in map(shingle_set, batch.column(0).to_pylist()) if len(s)]
            edges = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            nodes = pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], ["node", "shingles"])


def estimate(left: Column, right: Column) -> Column:
    """Similarity from packed minima, corrected for fields that agree by chance."""
    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(_FIELDS)))

    words = HASHES * BITS // 64
    apart = sum((unequal(left[i], right[i]) for i in range(1, words)), unequal(left[0], right[0]))
    chance = 2.0**-BITS
    return (1 - apart / HASHES - chance) / (1 - chance)


def classes(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its class) for every node of ``links`` (a, b).

    Rounds of large star and small star: each node hands its smallest neighbour to the larger ones, then the other way round, until
    every node points at the smallest of its class.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "near-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()  # both uses below read the one exchange
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = stored(large.join(down, "u").select(F.explode(ends).alias("e")).select("e.*").filter("u <> v").distinct(), "near-small")
        roles = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))).alias("r"))
        counted = roles.select("r.*").groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
        if counted.filter("child > 1 or (child = 1 and root = 1)").isEmpty():  # every node points at a root: all stars
            members = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def confirmed(pairs: DataFrame, sets: DataFrame, near: int) -> DataFrame:
    """The pairs whose full sets are near enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    sized = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("all"))
    return sized.filter(F.col("both") * 100 >= (F.col("all") - F.col("both")) * near).select("a", "b")


def _common(first: list[np.ndarray], second: list[np.ndarray], alone: bool) -> np.ndarray:
    """Numbers of common elements of every pair of sets; ``alone``: both lists are the same one."""
    flat_a, flat_b = np.concatenate(first), np.concatenate(second)
    if alone:  # an element of one set only counts on the diagonal, which nobody asks for
        values, counts = np.unique(flat_a, return_counts=True)
        shared = values[counts > 1]
    else:
        shared = np.intersect1d(flat_a, flat_b)
    found = np.zeros((len(first), len(second)), np.float32)

    def placed(flat: np.ndarray, sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
        here = part[at] == flat
        marks = np.zeros((len(sets), len(part)), np.float32)
        marks[rows[here], at[here]] = 1
        return marks

    for start in range(0, len(shared), 4096):
        part = shared[start : start + 4096]
        found += placed(flat_a, first, part) @ placed(flat_b, second, part).T
    return found


def block_links(near: int):
    """For ``applyInPandas``: members of two blocks of a cluster to confirmed links between their classes, as few as join them.

    Sets come as what they add to and lack of the cluster's pivot, so that |x & y| = |pivot| - |lacks x or y| + |added by both|.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group[group["side"] == 0]
        alone = not (group["side"] == 1).any()
        second = first if alone else group[group["side"] == 1]
        codes = pd.factorize(pd.concat([first["label"], second["label"]]))[0]  # numpy compares bytes without their trailing zeros
        mine, theirs = codes[: len(first)], codes[len(first) :]
        added, lacking = ([[np.asarray(v, np.int64) for v in side[c]] for side in (first, second)] for c in ("added", "lacking"))
        lacks = [np.array([len(v) for v in side]) for side in lacking]
        base = int(first["base"].iloc[0])
        sizes = [base - lacks[n] + np.array([len(v) for v in added[n]]) for n in (0, 1)]
        both = base - lacks[0][:, None] - lacks[1][None, :] + np.rint(_common(*lacking, alone) + _common(*added, alone)).astype(np.int64)
        either = sizes[0][:, None] + sizes[1][None, :] - both
        hits = (both * 100 >= either * near) & (mine[:, None] != theirs[None, :])
        names, others = first["node"].to_numpy(), second["node"].to_numpy()
        parent = list(range(int(codes.max()) + 1))

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = n = parent[parent[n]]
            return n

        found = []
        for row in np.flatnonzero(hits.any(axis=1)):
            columns = np.flatnonzero(hits[row])
            for code, at in zip(*np.unique(theirs[columns], return_index=True), strict=True):
                if root(mine[row]) != root(code):
                    parent[root(mine[row])] = root(code)
                    found.append((names[row], others[columns[at]]))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _across(members: DataFrame, sets: DataFrame, near: int) -> DataFrame:
    """Confirmed links (a, b) between classes that share a bucket, enough of them to join all classes that have a link.

    Small buckets give their pairs. Large ones are gathered into clusters (nodes that share large buckets, directly or over others);
    a cluster is compared in pairs of blocks, and a pair of blocks returns fewer links than it has classes.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    sized = members.join(sizes, "bucket")
    few, many = sized.filter(F.col("n") <= SMALL), stored(sized.filter(F.col("n") > SMALL).select("bucket", "node", "label"), "near-large")
    other = few.select("bucket", *(F.col(c).alias(f"{c}_2") for c in ("node", "label", "bits")))
    joined = few.join(other, "bucket").filter("node < node_2 and label <> label_2")
    close = joined.filter(estimate(F.col("bits"), F.col("bits_2")) >= near / 100 - MARGIN)
    links = confirmed(stored(close.select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct(), "near-pairs"), sets, near)
    if many.isEmpty():
        return links
    least = many.groupBy("bucket").agg(F.min("node").alias("a"))
    clusters = stored(classes(many.join(least, "bucket").select("a", F.col("node").alias("b"))), "near-clusters")
    nodes = many.select("node", "label").distinct().join(clusters.withColumnRenamed("label", "cluster"), "node").join(sets, "node")
    nodes = stored(nodes, "near-blocks")
    # The smallest set of a cluster: little of it can be lacking.
    smallest = F.min(F.struct(F.size("shingles").alias("size"), "node")).alias("p")
    pivots = nodes.groupBy("cluster").agg(smallest, F.count(F.lit(1)).alias("n")).select("cluster", "n", "p.node")
    pivots = pivots.join(sets, "node").select("cluster", "n", F.col("shingles").alias("pivot"))
    apart = nodes.join(pivots, "cluster").select(
        "cluster", "node", "label", F.array_except("shingles", "pivot").alias("added"), F.array_except("pivot", "shingles").alias("lacking"),
        F.size("pivot").alias("base"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
    )
    placed = apart.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = dealt.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with"), "side": (F.col("block") > F.col("with")).cast("int")})
    return links.unionByName(paired.drop("blocks", "block", "with").groupBy("cluster", "i", "j").applyInPandas(block_links(near), "a binary, b binary"))


def near_classes(docs: DataFrame, near: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """Signed rows (doc_id, n_shingles, node) and the label of every linked node."""
    spark = docs.sparkSession
    ship(spark)
    kind = id_type(docs)
    least = near / 100 - MARGIN
    keyed = docs.select("doc_id", F.sha2(text_of(), 256).alias("sha"), "text")
    signed = keyed.mapInArrow(sign_batches, f"{kind}, sha string, n_shingles long, node binary, bands array<long>, bits array<long>")
    rows = stored(signed, "near-rows")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("one"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    nodes = stored(nodes, "near-nodes")
    placed = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = placed.join(shared, "bucket").join(nodes.select("node", "bits"), "node")
    members = stored(members.withColumn("label", F.col("node")), "near-members")
    rows = rows.select("doc_id", "sha", "n_shingles", "node")

    wanted = members.select("node").distinct().join(nodes.select("node", "one"), "node").select(F.col("one").alias("wanted")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    sets = stored(texts.select("text").mapInArrow(set_batches, "node binary, shingles array<long>").dropDuplicates(["node"]), "near-sets")

    links, labels = None, nodes.select("node", F.col("node").alias("label")).limit(0)
    for turn in range(PIVOT_ROUNDS + 1):
        mixed = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
        waiting = stored(members.join(mixed, "bucket"), "near-waiting")
        if waiting.isEmpty():
            break
        if turn < PIVOT_ROUNDS:
            order = F.xxhash64("node", F.lit(turn)).alias("o")
            pivots = waiting.groupBy("bucket").agg(F.min(F.struct(order, "node", "label", "bits")).alias("p"))
            pivots = pivots.select("bucket", *(F.col(f"p.{c}").alias(f"{c}_2") for c in ("node", "label", "bits")))
            met = waiting.join(pivots, "bucket").filter("label <> label_2").filter(estimate(F.col("bits"), F.col("bits_2")) >= least)
            pairs = met.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()
            found = stored(confirmed(stored(pairs, "near-pairs"), sets, near), "near-links")
        else:
            found = stored(_across(waiting, sets, near), "near-links")
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        labels = stored(classes(links), "near-labels")
        renamed = waiting.drop("label").join(labels, "node", "left")
        members = stored(renamed.withColumn("label", F.coalesce("label", "node")), "near-members")
    return rows, labels


def near_duplicates(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """One row per document: doc_id, sha, n_shingles, component_id, kept, class (null for an empty set)."""
    rows, labels = near_classes(docs, near)
    named = rows.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node"))
    named = stored(named.select("doc_id", "sha", "n_shingles", "class"), "near-named")
    held = named.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    whole = named.join(held.filter("members > 1").drop("members"), "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return whole.select("doc_id", "sha", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "class")


def drop_near_copies(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """One document of each class, every column as it was; documents without words all stay."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = stored(near_duplicates(docs, near).select("sha", name.alias("name"), "kept", "class"), "near-found")
    chosen = found.filter("kept and class is not null").groupBy("class").agg(F.min(F.struct("name", "sha")).alias("c")).select("c.name", "c.sha", "class")
    texts = found.filter("class is not null").groupBy("name", "sha", "class").agg(F.count(F.lit(1)).alias("n"))
    marks = texts.join(chosen.withColumn("chosen", F.lit(True)), ["name", "sha", "class"], "left").filter("chosen is null or n > 1")
    marks = stored(marks.select("name", "sha", F.col("chosen").isNotNull().alias("repeated")), "near-marks")
    whole = docs.select(F.struct("*").alias("whole"), name.alias("name"), F.sha2(text_of(), 256).alias("sha"))
    # The texts are exchanged once: the rows to keep come from one join, and only repeated rows, where there are any, are settled behind it.
    kept = whole.join(marks, ["name", "sha"], "left").filter("repeated is null or repeated")
    if not marks.filter("repeated").isEmpty():
        own = F.when(F.col("repeated"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
        kept = kept.withColumn("own", own).dropDuplicates(["name", "sha", "own"])
    return kept.select("whole.*")
