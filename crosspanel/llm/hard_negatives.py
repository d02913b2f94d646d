"""Hard negatives by branch and bound over ball trees: rows of another label that score close below a positive.

Vectors are scaled to integers and scores are their exact inner products. The rows of each partition go into
ball trees of bounded bytes, which are written. A node of a tree is a ball (centre, radius); for a query q every
score in it lies within q.centre +- |q| * radius, so a node is left out for a query whose window of scores it can't
reach from either side, or whose k best so far all score above it (strictly: at equal scores a smaller id can still win).

Queries are the anchor rows, in blocks of bounded bytes that are broadcast a few at a time; each round of blocks is a
job over all trees. A task carries its k best for each query from tree to tree and reports them once, so
the shuffle that merges the tasks' lists has k rows for each query and task. The first search finds each anchor's positives, the best other rows of
its label. They give the windows of the second, which finds the best rows of other labels in each.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; vectors of
another length than the anchor's take no part for it; a null vec_id is no anchor and comes last among equal scores;
rows with the anchor's vec_id are not its positives; repeated rows count as often as they stand there, as anchors
too; scaled components are held within +-(2**31 - 1) and scores within +-2**60; a positive with a negative score has
an empty window (low_share of it is above it); an anchor without positives, or a positive without negatives, gives no rows; an empty table gives none; other
columns, whatever their names, play no part. Texts aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import new_path, written

#: Bytes of a tree's or a block's vectors at 8 a component; rows of a leaf; anchors of a block; blocks of a round.
TREE_BYTES, LEAF, BLOCK_ROWS, ROUND = 8 << 20, 256, 2048, 16
NULL_ID, MOST, MOST_SCORE, NONE = 2**63 - 1, 2**31 - 1, 2**60, -(2**62)
_PACKED = "n int, dims int, kind string, ids binary, labels binary, vectors binary"
_TREE = _PACKED + ", centres binary, radii binary, spans binary, children binary"


class Vectors(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray  # integers, one row each


class Tree(NamedTuple):
    """Rows stand so that those of a node are neighbours: spans[i] of them, children[i] is -1, -1 for a leaf."""

    vectors: Vectors
    centres: np.ndarray
    radii: np.ndarray
    spans: np.ndarray
    children: np.ndarray


def build(vectors: Vectors, leaf: int = LEAF) -> Tree:
    """A ball is divided at the median of the line through two rows far apart."""
    x, order = vectors.rows.astype(np.float64), np.arange(len(vectors.ids))
    centres, radii, spans, children = [], [], [], []
    open_nodes = [(0, len(order), -1, 0)]
    while open_nodes:
        a, b, parent, side = open_nodes.pop()
        part = x[order[a:b]]
        centre = part.mean(axis=0)
        far = np.linalg.norm(part - centre, axis=1)
        if parent >= 0:
            children[parent][side] = len(spans)
        centres.append(centre)
        radii.append(far.max())
        spans.append((a, b))
        children.append([-1, -1])
        if b - a > leaf:
            one = part[far.argmax()]
            other = part[np.linalg.norm(part - one, axis=1).argmax()]
            order[a:b] = order[a:b][np.argsort(part @ (one - other), kind="stable")]
            mid = (a + b) // 2
            open_nodes += [(mid, b, len(spans) - 1, 1), (a, mid, len(spans) - 1, 0)]
    return Tree(Vectors(vectors.ids[order], vectors.labels[order], vectors.rows[order]), np.array(centres), np.array(radii), np.array(spans), np.array(children))


class Search:
    """The k best rows of each (query, window) over all trees that were added.

    low, high: (queries, windows) of scores, both ends included. same: rows of the query's own label, but not its own id; else those of other labels.
    """

    def __init__(self, queries: Vectors, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.queries, self.low, self.high, self.same, self.k = queries, low, high, same, k
        self.exact = queries.rows.astype(object)
        self.q = queries.rows.astype(np.float64)
        self.norm = np.linalg.norm(self.q, axis=1)
        self.score = np.full((*low.shape, k), NONE, np.int64)
        self.id = np.full((*low.shape, k), NULL_ID, np.int64)
        self.nodes = 0

    def _floor(self, active: np.ndarray) -> np.ndarray:
        """The least score of use to each window."""
        return np.maximum(self.low[active], self.score[active, :, -1])

    def add(self, tree: Tree) -> None:
        x = tree.vectors.rows
        size = np.linalg.norm(x.astype(np.float64), axis=1).max() * self.norm.max(initial=0)
        kind = np.float32 if size < 2**23 else np.float64 if size < 2**52 else object  # in which all sums are exact
        rows = x.astype(kind)
        q = self.exact if kind is object else self.q.astype(kind)
        lengths = np.linalg.norm(tree.centres, axis=1)
        stack = [(0, np.arange(len(self.norm)))]
        while stack:
            node, active = stack.pop()
            middle = self.q[active] @ tree.centres[node]
            reach = self.norm[active] * tree.radii[node] * (1 + 1e-9) + 1e-9 * self.norm[active] * lengths[node] + 1e-6
            up, down = np.minimum(middle + reach, MOST_SCORE), np.maximum(middle - reach, -MOST_SCORE)
            active = active[((up[:, None] >= self._floor(active)) & (down[:, None] <= self.high[active])).any(axis=1)]
            if not len(active):
                continue
            self.nodes += 1  # not left out
            if tree.children[node][0] < 0:
                a, b = tree.spans[node]
                scores = q[active] @ rows[a:b].T
                if kind is object:
                    scores = np.clip(scores, -MOST_SCORE, MOST_SCORE).astype(np.int64)
                self._leaf(active, scores, tree.vectors.ids[a:b], tree.vectors.labels[a:b])
            else:
                near = sorted(tree.children[node].tolist(), key=lambda c: float((self.q[active] @ tree.centres[c]).sum()))
                stack += [(c, active) for c in near]  # the nearer one is taken first

    def _leaf(self, active: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        floor, high = self._floor(active), self.high[active]
        use = (scores >= floor.min(axis=1)[:, None]) & (scores <= high.max(axis=1)[:, None])
        who, row = np.nonzero(use)
        own = labels[row] == self.queries.labels[active[who]]
        fits = own & (ids[row] != self.queries.ids[active[who]]) if self.same else ~own
        who, row = who[fits], row[fits]
        score = scores[who, row].astype(np.int64)
        hit, window = np.nonzero((score[:, None] >= floor[who]) & (score[:, None] <= high[who]))
        if len(hit):
            self._enter(active[who[hit]] * self.low.shape[1] + window, score[hit], ids[row[hit]])

    def _enter(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        best, best_id = self.score.reshape(-1, self.k), self.id.reshape(-1, self.k)
        touched = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(touched, self.k)])
        score = np.concatenate([score, best[touched].ravel()])
        ids = np.concatenate([ids, best_id[touched].ravel()])
        order = np.lexsort([ids, -score, slot])
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        first = rank < self.k
        best[slot[first], rank[first]] = score[first]
        best_id[slot[first], rank[first]] = ids[first]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, window, score and id of all that was found."""
        query, window, _ = at = np.nonzero(self.score > NONE)
        return query, window, self.score[at], self.id[at]


def _valid(batch: pa.RecordBatch, scale: int) -> Iterator[Vectors]:
    """The rows that take part, by the length of their vectors, as integers."""
    ids, labels, column = batch.columns
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    wrong = np.append(0, np.cumsum(~np.isfinite(values)))
    use = (wrong[ends] == wrong[ends - sizes]) & pc.and_(column.is_valid(), labels.is_valid()).to_numpy(zero_copy_only=False)
    ids, labels = pc.fill_null(ids, NULL_ID).to_numpy(), pc.fill_null(labels, 0).to_numpy()
    for dims in np.unique(sizes[use]).tolist():
        rows = np.flatnonzero(use & (sizes == dims))
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(values[(ends - sizes)[rows][:, None] + np.arange(dims)] * scale), -MOST, MOST)
        yield Vectors(ids[rows], labels[rows], whole.astype(np.int32))


def _gathered(batches: Iterator[pa.RecordBatch], scale: int, most_rows: int) -> Iterator[Vectors]:
    """The rows of a partition in groups of bounded bytes, each of one length of vectors."""
    waiting: dict[int, list[Vectors]] = {}
    held: dict[int, int] = {}
    for batch in batches:
        for v in (Vectors(*(x[at : at + 1024] for x in v)) for v in _valid(batch, scale) for at in range(0, len(v.ids), 1024)):
            dims = v.rows.shape[1]
            waiting.setdefault(dims, []).append(v)
            held[dims] = held.get(dims, 0) + 8 * max(dims, 1) * len(v.ids)
            if sum(held.values()) > TREE_BYTES:
                most = max(held, key=held.__getitem__)
                del held[most]
                yield from _parts(waiting.pop(most), most_rows)
    for parts in waiting.values():
        yield from _parts(parts, most_rows)


def _parts(parts: list[Vectors], most_rows: int) -> Iterator[Vectors]:
    v = Vectors(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    for at in range(0, len(v.ids), most_rows):
        yield Vectors(*(x[at : at + most_rows] for x in v))


def _packed(v: Vectors) -> dict:
    kind = "<i2" if np.abs(v.rows).max(initial=0) < 2**15 else "<i4"
    return {"n": len(v.ids), "dims": v.rows.shape[1], "kind": kind, "ids": v.ids.astype("<i8").tobytes(), "labels": v.labels.astype("<i8").tobytes(), "vectors": v.rows.astype(kind).tobytes()}


def _unpacked(row: dict) -> Vectors:
    return Vectors(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["vectors"], row["kind"]).reshape(row["n"], row["dims"]))


def _one(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=schema)


def _arrow(*binary: str) -> pa.Schema:
    return pa.schema([("n", pa.int32()), ("dims", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in ("ids", "labels", "vectors", *binary))])


def write_trees(vectors: DataFrame, scale: int) -> DataFrame:
    """Ball trees of vectors(vec_id, label, embedding), a row for each; a few to a file, so that the search spreads over all cores."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow("centres", "radii", "spans", "children")
        for v in _gathered(batches, scale, 1 << 30):
            t = build(v)
            yield _one(_packed(t.vectors) | {"centres": t.centres.astype("<f8").tobytes(), "radii": t.radii.astype("<f8").tobytes(), "spans": t.spans.astype("<i8").tobytes(), "children": t.children.astype("<i8").tobytes()}, schema)

    path = new_path(vectors.sparkSession, "ball_trees")
    made = vectors.mapInArrow(trees, _TREE)
    made.write.option("maxRecordsPerFile", 8).parquet(path)
    return vectors.sparkSession.read.schema(made.schema).parquet(path)


def _tree(row: dict) -> Tree:
    radii = np.frombuffer(row["radii"], "<f8")
    return Tree(_unpacked(row), np.frombuffer(row["centres"], "<f8").reshape(len(radii), row["dims"]), radii, np.frombuffer(row["spans"], "<i8").reshape(-1, 2), np.frombuffer(row["children"], "<i8").reshape(-1, 2))


def anchor_blocks(anchors: DataFrame, scale: int) -> DataFrame:
    """Blocks of at most BLOCK_ROWS anchors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in _gathered(batches, scale, BLOCK_ROWS):
            yield _one(_packed(v), _arrow())

    n = anchors.count()
    return written(anchors.repartition(max(1, -(-n // BLOCK_ROWS))).mapInArrow(pack, _PACKED), "anchor_blocks")


def _rounds(blocks: DataFrame) -> Iterator[list[Vectors]]:
    """A few blocks at a time; the driver holds no more than these."""
    held: list[Vectors] = []
    for row in blocks.toLocalIterator():
        held.append(_unpacked(row.asDict()))
        if len(held) == ROUND:
            yield held
            held = []
    if held:
        yield held


def best_rows(trees: DataFrame, blocks: list[Vectors], windows: list[tuple[np.ndarray, np.ndarray]], same: bool, k: int) -> DataFrame:
    """block, query, slot, rank, score, vec_id: the k best rows in each window (low, high) of each query of the blocks."""
    spark = trees.sparkSession
    sent = spark.sparkContext.broadcast((blocks, windows))  # at most ROUND blocks

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, bounds = sent.value
        searches = [Search(q, low, high, same, k) for q, (low, high) in zip(queries, bounds, strict=True)]
        for batch in batches:
            for i in range(batch.num_rows):
                tree = _tree(batch.slice(i, 1).to_pylist()[0])
                for s in searches:
                    if s.q.shape[1] == tree.vectors.rows.shape[1]:
                        s.add(tree)
        for number, s in enumerate(searches):
            query, window, score, ids = s.found()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), number, np.int32)), pa.array(query.astype(np.int32)), pa.array(window.astype(np.int32)), pa.array(score), pa.array(ids)], names=["block", "query", "slot", "score", "vec_id"])

    lists = trees.mapInArrow(search, "block int, query int, slot int, score long, vec_id long")
    best = Window.partitionBy("block", "query", "slot").orderBy(F.col("score").desc(), F.col("vec_id"))
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low_share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding. For each anchor its best `positives` other rows of the same label; for each of these the best
    `negatives` rows of other labels whose score is at most the positive's and at least low_share (a fraction) of it.
    """
    spark: SparkSession = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    trees = write_trees(rows, scale)
    over, under = low_share
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    paths = []
    for blocks in _rounds(anchor_blocks(rows.where(is_anchor), scale)):
        open_windows = [(np.full((len(b.ids), 1), NONE + 1), np.full((len(b.ids), 1), MOST_SCORE)) for b in blocks]
        first = best_rows(trees, blocks, open_windows, True, positives).select("block", "query", "rank", "score", "vec_id").toPandas()  # at most ROUND * BLOCK_ROWS * positives rows
        of = [(np.full((len(b.ids), positives), NONE), np.full((len(b.ids), positives), NULL_ID)) for b in blocks]
        for number, group in first.groupby("block"):
            at = group["query"].to_numpy(), group["rank"].to_numpy() - 1
            of[number][0][at], of[number][1][at] = group["score"], group["vec_id"]
        # over * positive <= under * negative, in Python's integers, which don't overflow; a slot without a positive has an empty window
        low = [np.array([-(-over * s // under) if s > NONE else MOST_SCORE for s in score.ravel().tolist()], np.int64).reshape(score.shape) for score, _ in of]
        found = best_rows(trees, blocks, [(a, score) for a, (score, _) in zip(low, of, strict=True)], False, negatives)
        known = spark.sparkContext.broadcast([(b.ids, score, ids) for b, (score, ids) in zip(blocks, of, strict=True)])

        def named(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            optional = lambda ids: pa.array(ids, mask=ids == NULL_ID)
            for batch in batches:
                block, query, slot, rank, score, ids = (c.to_numpy() for c in batch.columns)
                for number in np.unique(block).tolist():
                    use = block == number
                    anchor, scores, positive = known.value[number]
                    at = query[use], slot[use]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[query[use]]), optional(positive[at]), pa.array(rank[use]), optional(ids[use]), pa.array(scores[at]), pa.array(score[use])], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        paths.append(new_path(spark, "hard_negatives"))
        found.select("block", "query", "slot", "rank", "score", "vec_id").mapInArrow(named, schema).write.parquet(paths[-1])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.r AS r, a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_sum([z[1] * z[2] FOR z IN list_zip(a.e, v.e)])::BIGINT AS score
  FROM a JOIN v ON len(a.e) = len(v.e) AND (a.label <> v.label OR a.vec_id IS DISTINCT FROM v.vec_id)),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS slot
  FROM s WHERE same QUALIFY slot <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.slot ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
