"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Every vector gets one more component that makes all norms equal, so that the
largest inner product is the smallest distance. A tree of k-means splits is fitted
on a bounded sample; all vectors go to its leaves. A query visits leaves in the
order of a priority queue over the distances to the nodes' centres, and how many
it visits is widened until sampled queries, checked against all rows, reach the
wanted recall.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxbar.llm.common import materialize, struct
from fluxbar.llm.vectors import distinct_vectors, for_each_query, matrix


@dataclass
class Tree:
    """Inner nodes hold their children's centres; a child is a node's number or, if negative, leaf -1 - child."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, branch: int = 8, rounds: int = 8, seed: int = 0) -> Tree:
        tree, rng = cls(), np.random.default_rng(seed)
        least = max(2, len(sample) // max(1, leaves))

        def grow(at: np.ndarray) -> int:
            k = min(branch, -(-len(at) // least))
            if k < 2 or len(np.unique(sample[at[:4096]], axis=0)) < 2:
                tree.leaves += 1
                return -tree.leaves
            own = sample[at]
            centre = own[rng.choice(len(own), k, replace=False)]
            for _ in range(rounds):
                nearest = _distances(own, centre).argmin(1)
                centre = np.array([own[nearest == j].mean(0) if (nearest == j).any() else own[rng.integers(len(own))] for j in range(k)])
            nearest = _distances(own, centre).argmin(1)
            filled = np.unique(nearest)
            if len(filled) < 2:
                tree.leaves += 1
                return -tree.leaves
            n = len(tree.centres)
            tree.centres.append(centre[filled])
            tree.children.append([])
            tree.children[n] = [grow(at[nearest == j]) for j in filled]
            return n

        if grow(np.arange(len(sample))) < 0:
            tree.centres, tree.children = [], []
        return tree

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, at = todo.pop()
            nearest = _distances(x[at], self.centres[node]).argmin(1)
            for j, child in enumerate(self.children[node]):
                own = at[nearest == j]
                if not len(own):
                    continue
                if child < 0:
                    out[own] = -1 - child
                else:
                    todo.append((child, own))
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """All leaves in the order of the priority queue, worked out as far as they are asked for."""
        if not self.centres:
            yield 0
            return
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
            else:
                for d, child in zip(_distances(query[None], self.centres[node])[0].tolist(), self.children[node], strict=True):
                    heapq.heappush(queue, (d, child))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1)[None] - 2 * (x @ centres.T)


def _even(x: np.ndarray, norm2: float) -> np.ndarray:
    """x with the component that brings its squared norm to norm2."""
    return np.column_stack([x, np.sqrt(np.maximum(0, norm2 - (x**2).sum(1)))])


def _best(scores: np.ndarray, ids: list[np.ndarray], k: int) -> list[tuple[float, int]]:
    """The k best of a query's (score, id), ties to smaller ids."""
    at = np.arange(len(scores))
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
        if len(at) > 4 * k:
            first = np.array([ids[i][0] for i in at])
            at = at[np.lexsort((first, -scores[at]))[:k]]
    return sorted((-float(scores[i]), int(n)) for i in at for n in ids[i])[:k]


def _id_lists(column: pa.ListArray) -> list[np.ndarray]:
    return np.split(column.flatten().to_numpy(), np.cumsum(np.diff(np.asarray(column.offsets)))[:-1])


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) without rows that are null, zero or hold null or non-finite components."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


class Tops:
    """The k best (score, smaller id first) of many queries so far. Candidates are gathered and cut to size now and then."""

    def __init__(self, queries: int, k: int, most: int = 200_000):
        self.k, self.most, self.least = k, most, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, queries: np.ndarray, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """scores: of the queries (rows) with some vectors (columns); rows: the vectors' numbers; ids: all vectors' ids end to end, counts of them each."""
        q, v = np.nonzero(scores >= self.least[queries][:, None])
        if not len(q):
            return
        n = counts[rows[v]]
        start = np.cumsum(counts) - counts
        ends = np.cumsum(n)
        each = np.repeat(start[rows[v]] - ends + n, n) + np.arange(ends[-1])
        self.parts.append((np.repeat(queries[q], n), np.repeat(scores[q, v], n), ids[each]))
        self.held += int(ends[-1])
        if self.held > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is left, by query and rank."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        q, score, i = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((i, -score, q))
        q, score, i = q[order], score[order], i[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        last = rank == self.k - 1
        self.least[q[last]] = score[last]
        kept = rank < self.k
        self.parts, self.held = [(q[kept], score[kept], i[kept])], int(kept.sum())
        self.most = max(self.most, 2 * self.held)
        return self.parts[0]


def nearest_neighbours(
    embeddings: DataFrame, k: int = 20, every: int = 20, recall: float = 0.94, sample: int = 20_000, leaf_size: int = 64,
    most_leaves: int = 4096, probes: int = 128, block: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, nearest first, ties to smaller vec_ids.

    Queries are the rows whose vec_id is divisible by `every`, candidates all but the
    query's own. Bounds, for the index alone: the tree is fitted on about `sample`
    distinct vectors and has at most about most_leaves leaves; leaf visits are
    calibrated on about `probes` queries against all rows, to `recall` on their
    average. A query goes on to as many leaves as k candidates need. Vectors of
    other lengths count as filled up with zeros. Rows without vec_id take no part,
    rows that repeat a vec_id with another vector are candidates each, other columns
    are ignored.

    Vectors lie in the order of their leaves. Queries come in blocks of about `block`
    that lie near each other, with the leaves they visit; a block is sent to all
    tasks, which read the leaves that any of its queries visits, and each leaf is
    compared with the queries that visit it.
    """
    spark = embeddings.sparkSession
    rows = materialize(valid_vectors(embeddings), "vectors")
    vectors = materialize(distinct_vectors(rows, k + 1), "distinct-vectors")
    asked = rows.where(F.col("vec_id") % every == 0).join(vectors.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), "rep").distinct()
    asked = materialize(asked, "queries")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, dims, norm2 = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(squares)).first()
    if not n:
        return spark.createDataFrame([], struct("query_id long, rank int, vec_id long, score double"))

    place = F.shiftrightunsigned(F.xxhash64("rep"), 11) / float(1 << 53)
    drawn = sorted(vectors.where(place * n < sample).select("rep", "v").collect())
    data = np.zeros((len(drawn), dims))
    for i, r in enumerate(drawn):
        data[i, : len(r["v"])] = r["v"]
    tree = Tree.fit(_even(data, norm2), min(most_leaves, max(1, n // leaf_size))) if len(drawn) else Tree()
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches):
        for batch in batches:
            leaf = shared.value.leaf_of(_even(matrix(batch.column(1), dims, np.float64), norm2))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", "rep", "v", "ids"])

    kind = vectors.schema["v"].dataType.simpleString()
    placed = vectors.select("rep", "v", "ids").mapInArrow(assign, f"leaf long, rep long, v {kind}, ids array<bigint>")
    placed = materialize(placed, "placed")
    placed = materialize(placed.repartitionByRange("leaf", F.xxhash64("rep")).sortWithinPartitions("leaf"), "leaves")
    # most_leaves rows at most.
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}

    # Calibration: where in the order of visits the true neighbours of some queries lie.
    reps = materialize(placed.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v", "leaf"), "query-vectors")
    n_reps = reps.count()
    probe = reps.where(F.shiftrightunsigned(F.xxhash64(F.col("rep"), F.lit(1)), 11) / float(1 << 53) * n_reps < probes).collect()
    visits = tree.leaves or 1
    if probe:
        queries = np.zeros((len(probe), dims))
        for i, r in enumerate(probe):
            queries[i, : len(r["v"])] = r["v"]
        sent = spark.sparkContext.broadcast(queries)

        def scan(batches):
            tops: list[list] = [[] for _ in sent.value]
            for batch in batches:
                leaf, ids = batch.column(0).to_numpy(), _id_lists(batch.column(2))
                where = {int(x): int(at) for own, at in zip(ids, leaf, strict=True) for x in own}
                scores = sent.value @ matrix(batch.column(1), dims, np.float64).T
                for q, row in enumerate(scores):
                    tops[q] = sorted(tops[q] + [(s, i, where[i]) for s, i in _best(row, ids, k + 1)])[: k + 1]
            flat = [(q, s, i, l) for q, top in enumerate(tops) for s, i, l in top]
            q, s, i, l = zip(*flat, strict=True) if flat else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([-x for x in s], pa.float64()), pa.array(i, pa.int64()), pa.array(l, pa.int64())], names=["q", "score", "vec_id", "leaf"])

        best: dict[int, list] = {}
        for r in placed.select("leaf", "v", "ids").mapInArrow(scan, struct("q long, score double, vec_id long, leaf long")).toLocalIterator():
            if r["vec_id"] != probe[r["q"]]["rep"]:
                best[r["q"]] = sorted([*best.get(r["q"], []), (-r["score"], r["vec_id"], r["leaf"])])[:k]
        ranks = []
        for q, top in best.items():
            order = {leaf: i for i, leaf in enumerate(tree.visits(np.append(queries[q], 0.0)))}
            ranks += [order.get(leaf, 0) for _, _, leaf in top]
        ranks.sort()
        visits = ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1 if ranks else visits

    # Blocks of queries: leaf after leaf until a block is full; a leaf of more queries than a block is spread over several.
    blocks, at, room = {}, 0, block
    for r in sorted(reps.groupBy("leaf").count().collect()):
        if r["count"] > room and room < block:
            at, room = at + 1, block
        many = -(-r["count"] // block)
        blocks[r["leaf"]] = (at, many)
        at, room = (at + many, block) if many > 1 else (at, room - r["count"])
    spread = spark.sparkContext.broadcast((sizes, blocks))

    def route(batches):
        sizes, blocks = spread.value
        for batch in batches:
            routes, own = [], []
            for q, leaf, rep in zip(matrix(batch.column(1), dims, np.float64), batch.column(2).to_pylist(), batch.column(0).to_pylist(), strict=True):
                seen, order = 0, []
                for nth, visited in enumerate(shared.value.visits(np.append(q, 0.0))):
                    if nth >= visits and seen > k:
                        break
                    seen += sizes.get(visited, 0)
                    order.append(visited)
                routes.append(order)
                first, many = blocks[leaf]
                own.append(first + hash(rep) % many)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int64()), pa.array(routes, pa.list_(pa.int32()))], names=["rep", "v", "block", "leaves"])

    routed = materialize(reps.repartition(max(1, min(1000, n_reps // 256))).mapInArrow(route, f"rep long, v {kind}, block long, leaves array<int>"), "routed")
    out = struct("rep long, ids array<long>, scores array<double>")

    def one(number: int) -> DataFrame:
        own = routed.where(F.col("block") == number).collect()
        data, visitors = np.zeros((len(own), dims)), {}
        for i, r in enumerate(own):
            data[i, : len(r["v"])] = r["v"]
            for leaf in r["leaves"]:
                visitors.setdefault(leaf, []).append(i)
        sent = spark.sparkContext.broadcast((np.array([r["rep"] for r in own], np.int64), data, {leaf: np.array(q, np.int32) for leaf, q in visitors.items()}))

        def search(batches):
            names, queries, visitors = sent.value
            tops = Tops(len(names), k + 1)
            for batch in batches:
                leaf, held, lists = batch.column(0).to_numpy(), matrix(batch.column(1), dims, np.float64), batch.column(2)
                ids, counts = lists.flatten().to_numpy(), np.diff(np.asarray(lists.offsets))
                edge = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]])) if len(leaf) else []
                for a, b in zip(edge, edge[1:], strict=False):
                    asking = visitors.get(int(leaf[a]))
                    if asking is not None:
                        tops.add(asking, queries[asking] @ held[a:b].T, np.arange(a, b), ids, counts)
            q, score, i = tops.cut()
            cut = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1], [True]])) if len(q) else np.zeros(1, np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (i, score)]
            yield pa.RecordBatch.from_arrays([pa.array(names[q[cut[:-1]]]), *lists], names=["rep", "ids", "scores"])

        low, high = min(visitors), max(visitors)
        near = placed.where((F.col("leaf") >= low) & (F.col("leaf") <= high)).select("leaf", "v", "ids")
        return near.mapInArrow(search, out)

    found = None
    for number in sorted({first + i for first, many in blocks.values() for i in range(many)}):
        if routed.where(F.col("block") == number).isEmpty():
            continue
        part = one(number)
        part = part if len(blocks) and at == 0 else materialize(part, "block-results")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], struct("query_id long, rank int, vec_id long, score double"))
    return for_each_query(asked, found, k)
