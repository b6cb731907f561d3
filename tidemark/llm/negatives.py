"""Hard negatives of anchors, by bounds along a spanning tree of the anchors.

Anchors are dealt by a hash into chunks of about ``CHUNK``; each chunk gets a minimum spanning tree over the distances of its anchors. A task
that holds a batch of rows walks a tree from its root, where all rows are scored. A row's score at a child differs from that at the
parent by at most the edge's length times the row's norm (Cauchy-Schwarz), so the parent's score, or its own interval, bounds the child's; only
rows whose interval overlaps a window that is still open there are scored again, and their exact score tightens the bounds further down.
Heavy subtrees are walked last, so at most log2(anchors) intervals are held at a time.

Two walks over all rows: the first finds each anchor's positives (window: from the worst of the best found so far, begun with what the anchors
of the chunk already show); the second finds, for each positive, the best rows of other labels within [low, high] per cent of its score.
A task returns no more rows per anchor than the result can hold; windows over (anchor, positive) merge them. Trees are broadcast one block
after the other, at most ``BLOCK_BYTES`` each; anchors beyond that make more blocks, never a larger one.

Scores are integer inner products of floor(``SCALE`` * component), exact: in doubles where no product can pass 2**53, else in 64-bit integers.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component take no part; neither do rows of a norm from 2**31 on after
scaling, whose scores a long cannot hold. A shorter vector counts as filled with zeros. Rows that agree in vec_id, label and score count once
for an anchor, and rows of the anchor's own vec_id never; of repeated anchors each different one is an anchor. Ties go to the smaller vec_id. A
positive without a negative in its window has no row; empty tables give none. Columns other than vec_id, label and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import release, ship, stored

SCALE = 256
CHUNK = 2_048
BLOCK_BYTES = 32 << 20
#: Norm after scaling from which a row takes no part.
LARGEST = float(1 << 31)
EXACT_DOUBLE = float(1 << 53)


def usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Scaled vectors, one a row; shorter ones end in zeros, and components beyond ``width`` meet zeros only."""
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    width = int(lengths.max(initial=0)) if width is None else width
    values = np.floor(SCALE * np.asarray(column.flatten(), np.float64))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    made, inside = np.zeros((len(lengths), width)), place < width
    made[np.repeat(np.arange(len(lengths)), lengths)[inside], place[inside]] = values[inside]
    return made


def norms_of(points: np.ndarray) -> np.ndarray:
    return np.sqrt((points * points).sum(axis=1)) * (1 + 1e-9)


def products(points: np.ndarray, anchor: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products; ``bound`` is at least the product of the norms."""
    if bound < EXACT_DOUBLE:
        return (points @ anchor).astype(np.int64)
    return points.astype(np.int64) @ anchor.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` distinct (score, id), higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
    return scores[fresh][:most], ids[fresh][:most]


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the walk, parent's place in that order or -1, length of the edge to it) by Prim's method."""
    count = len(points)
    root = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    near, parent, left = np.full(count, np.inf), np.full(count, -1), np.ones(count, bool)
    at, joined = root, []
    while True:
        left[at] = False
        joined.append(at)
        if len(joined) == count:
            break
        apart = ((points - points[at]) ** 2).sum(axis=1)
        closer = left & (apart < near)
        near[closer], parent[closer] = apart[closer], at
        at = int(np.where(left, near, np.inf).argmin())
    weight, children = np.ones(count, np.int64), [[] for _ in range(count)]
    for node in reversed(joined[1:]):
        weight[parent[node]] += weight[node]
        children[parent[node]].append(node)
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting += sorted(children[node], key=lambda n: -weight[n])  # the lightest is walked first, the heaviest last
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    parents = np.array([place[parent[n]] if parent[n] >= 0 else -1 for n in order])
    return np.array(order), parents, np.where(parents < 0, 0.0, np.sqrt(np.where(np.isinf(near), 0.0, near))[order]) * (1 + 1e-9)


TREE = "chunk long, place int, parent int, edge double, vec_id long, label long, seed long, vector array<double>"


def grow_tree(positives: int):
    """For ``applyInArrow`` over a chunk: its anchors in the order of the walk; ``seed``: a score that its last positive reaches for sure."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        points, ids, labels = matrix(group["embedding"].combine_chunks()), np.asarray(group["vec_id"]), np.asarray(group["label"])
        norms = norms_of(points)
        fit = norms < LARGEST
        points, ids, labels, norms = points[fit], ids[fit], labels[fit], norms[fit]
        order, parents, edges = spanning_tree(points) if len(points) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        seeds: list[int | None] = []
        for n in order:
            same = np.flatnonzero((labels == labels[n]) & (ids != ids[n]))
            scores, _ = best(products(points[same], points[n], float(norms.max() ** 2)), ids[same], positives)
            seeds.append(int(scores[-1]) if len(scores) == positives else None)
        columns = [pa.array(np.full(len(order), group["chunk"][0].as_py())), pa.array(np.arange(len(order)), pa.int32()), pa.array(parents, pa.int32()), pa.array(edges, pa.float64())]
        columns += [pa.array(ids[order], pa.int64()), pa.array(labels[order], pa.int64()), pa.array(seeds, pa.int64()), pa.array(list(points[order]), pa.list_(pa.float64()))]
        return pa.Table.from_arrays(columns, ["chunk", "place", "parent", "edge", "vec_id", "label", "seed", "vector"])

    return run


def trees(anchors: DataFrame, positives: int) -> DataFrame:
    """The anchors' trees, on shared files."""
    ship(anchors.sparkSession)
    distinct = anchors.distinct()
    chunks = max(1, -(-distinct.count() // CHUNK))
    dealt = distinct.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(chunks)).cast("long"))
    return stored(dealt.groupBy("chunk").applyInArrow(grow_tree(positives), TREE), "anchor-trees")


@dataclass
class Block:
    """Some trees, one after the other, with what tasks need to know of each anchor."""

    chunk: np.ndarray
    place: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    seed: list[int | None]
    points: np.ndarray
    positives: list[list[tuple[int, int]]]

    def __post_init__(self):
        self.last = np.arange(len(self.parent))  # the last node that needs this one's interval
        for node, parent in enumerate(self.parent):
            if parent >= 0:
                self.last[parent] = node
        self.norms = norms_of(self.points)


def blocks_of(grown: DataFrame) -> list[list[int]]:
    """Chunks whose trees fit one broadcast together."""
    held = grown.groupBy("chunk").agg(F.sum(F.size("vector") * 8 + 64).alias("bytes")).collect()  # one row per CHUNK anchors
    made: list[list[int]] = []
    used = 0
    for row in sorted(held, key=lambda r: r["chunk"]):
        if not made or used + row["bytes"] > BLOCK_BYTES:
            made.append([])
            used = 0
        made[-1].append(row["chunk"])
        used += row["bytes"]
    return made


def load_block(grown: DataFrame, chunks: list[int], found: DataFrame | None = None) -> Block:
    """At most ``BLOCK_BYTES`` of anchors, and their positives if they are known."""
    wanted = F.col("chunk").isin(chunks)
    held = grown.filter(wanted).toArrow().sort_by([("chunk", "ascending"), ("place", "ascending")]).combine_chunks()
    chunk, place, parent = (np.asarray(held[name]).astype(np.int64) for name in ("chunk", "place", "parent"))
    first = np.arange(len(chunk)) - place
    positives: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for row in found.filter(wanted).orderBy("chunk", "place", "nth").collect() if found is not None else []:
        positives.setdefault((row["chunk"], row["place"]), []).append((row["positive_id"], row["positive_score"]))
    listed = [positives.get(key, []) for key in zip(chunk.tolist(), place.tolist(), strict=True)]
    vectors = held["vector"].combine_chunks()
    width = int(np.asarray(vectors.value_lengths()).max(initial=0))
    points = matrix(vectors, width) / SCALE if len(chunk) else np.zeros((0, width))
    return Block(chunk, place, np.where(parent < 0, -1, parent + first), np.asarray(held["edge"]), np.asarray(held["vec_id"]), np.asarray(held["label"]), held["seed"].to_pylist(), points, listed)


def walk(block: Block, points: np.ndarray, wanted: Callable, visit: Callable) -> int:
    """Visits every anchor with the rows whose interval it wants, and their scores; returns how many scores were computed."""
    norms, scored = norms_of(points), 0
    largest = float(norms.max(initial=0.0))
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for node, parent in enumerate(block.parent.tolist()):
        bound = largest * float(block.norms[node])
        if parent < 0:
            scores = products(points, block.points[node], bound)
            scored += len(scores)
            low = high = scores.astype(np.float64)
            near = wanted(node, low, high)
            visit(node, near, scores[near])
        else:
            low, high = held[parent]
            reach = block.edge[node] * norms
            slack = 0.5 + 1e-12 * np.maximum(np.abs(low), np.abs(high)) if bound >= EXACT_DOUBLE else 0.0
            low, high = low - reach - slack, high + reach + slack
            near = wanted(node, low, high)
            if len(near):
                scores = products(points[near], block.points[node], bound)
                scored += len(scores)
                low[near] = high[near] = scores
                visit(node, near, scores)
        if block.last[node] > node:
            held[node] = low, high
        if parent >= 0 and block.last[parent] == node:
            del held[parent]
    return scored


class Positives:
    """The best rows of each anchor's label."""

    def __init__(self, block: Block, most: int):
        self.block, self.most = block, most
        self.scores, self.ids = [np.zeros(0, np.int64)] * len(block.parent), [np.zeros(0, np.int64)] * len(block.parent)
        self.least = np.array([-np.inf if s is None else float(s) for s in block.seed])
        self.labels = np.unique(block.label)

    def take(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> int:
        inside = np.isin(labels, self.labels)
        ids, labels, points = ids[inside], labels[inside], points[inside]

        def wanted(node: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return np.flatnonzero((high + 0.5 >= self.least[node]) & (labels == self.block.label[node]) & (ids != self.block.vec_id[node]))

        def visit(node: int, near: np.ndarray, scores: np.ndarray) -> None:
            held = best(np.concatenate([self.scores[node], scores]), np.concatenate([self.ids[node], ids[near]]), self.most)
            self.scores[node], self.ids[node] = held
            if len(held[0]) == self.most:
                self.least[node] = max(self.least[node], float(held[0][-1]))

        return walk(self.block, points, wanted, visit)

    def rows(self) -> Iterator[tuple]:
        for node, (scores, ids) in enumerate(zip(self.scores, self.ids, strict=True)):
            for score, vec_id in zip(scores.tolist(), ids.tolist(), strict=True):
                yield int(self.block.chunk[node]), int(self.block.place[node]), vec_id, score


class Negatives:
    """The best rows of other labels in the window of each positive."""

    def __init__(self, block: Block, most: int, low: int, high: int):
        self.block, self.most = block, most
        self.windows: list[list[list]] = []  # per anchor: nth positive, least and greatest score, scores and ids found
        for listed in block.positives:
            spans = [[nth, -(-low * score // 100), high * score // 100, np.zeros(0, np.int64), np.zeros(0, np.int64)] for nth, (_, score) in enumerate(listed)]
            self.windows.append([s for s in spans if s[1] <= s[2]])

    def take(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> int:
        def wanted(node: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            near = np.zeros(len(ids), bool)
            for least, most in {(s[1], s[2]) for s in self.windows[node]}:
                near |= (high + 0.5 >= least) & (low - 0.5 <= most)
            return np.flatnonzero(near & (labels != self.block.label[node]))

        def visit(node: int, near: np.ndarray, scores: np.ndarray) -> None:
            for span in self.windows[node]:
                inside = (scores >= span[1]) & (scores <= span[2])
                if inside.any():
                    span[3], span[4] = best(np.concatenate([span[3], scores[inside]]), np.concatenate([span[4], ids[near[inside]]]), self.most)
                    if len(span[3]) == self.most:
                        span[1] = int(span[3][-1])

        return walk(self.block, points, wanted, visit)

    def rows(self) -> Iterator[tuple]:
        for node, spans in enumerate(self.windows):
            for nth, _, _, scores, ids in spans:
                positive_id, positive_score = self.block.positives[node][nth]
                for score, vec_id in zip(scores.tolist(), ids.tolist(), strict=True):
                    yield int(self.block.chunk[node]), int(self.block.place[node]), nth, int(self.block.vec_id[node]), positive_id, positive_score, vec_id, score


def search_batches(shared, start: Callable[[Block], Positives | Negatives], names: list[str]):
    """For ``mapInArrow``: vec_id, label and embedding to what the search of a task over a block found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        block = shared.value
        search, width = start(block), block.points.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column(2), width)
            fit = norms_of(matrix(batch.column(2))) < LARGEST
            search.take(np.asarray(batch.column(0))[fit], np.asarray(batch.column(1))[fit], points[fit])
        found = list(search.rows())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*found, strict=True)], names)

    return run


def _searched(rows: DataFrame, block: Block, start: Callable, names: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)
    return rows.mapInArrow(search_batches(shared, start, names), ", ".join(f"{name} long" for name in names))


def _first(rows: DataFrame, group: list[str], score: str, name: str, most: int, rank: str) -> DataFrame:
    """The first ``most`` distinct rows of each group; tasks have cut theirs, and Spark cuts again before it shuffles."""
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), name)
    return rows.dropDuplicates([*group, score, name]).withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= most)


NO_ROWS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and scores, for the rows of ``vectors`` where ``is_anchor`` holds.

    A negative's score is from ``low`` to ``high`` per cent of the positive's.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    grown = trees(usable(vectors.filter(is_anchor)), positives)
    parts = blocks_of(grown)
    if not parts:
        return spark.createDataFrame([], NO_ROWS)
    found = []
    for chunks in parts:
        near = _searched(rows, load_block(grown, chunks), lambda block: Positives(block, positives), ["chunk", "place", "positive_id", "positive_score"])
        found.append(stored(_first(near, ["chunk", "place"], "positive_score", "positive_id", positives, "nth"), "anchor-positives"))
    mined = []
    for chunks, own in zip(parts, found, strict=True):
        names = ["chunk", "place", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        near = _searched(rows, load_block(grown, chunks, own), lambda block: Negatives(block, negatives, low, high), names)
        mined.append(_first(near, ["chunk", "place", "nth", "anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives, "rank"))
    whole = mined[0]
    for more in mined[1:]:
        whole = whole.unionByName(more)
    return whole.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
