"""Exact top-k by inner product of whole numbers with MaxScore.

The components are the terms: a document's posting under a term is its component,
a query's weight its own. In each shard a term's bound is the most that it can
add to a score there. With the terms in order of their bounds, those whose bounds
together cannot lift a document over the k-th score so far are non-essential:
only the essential postings are traversed, and the others are probed, the largest
bound first, while a document can still compete.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxbar.llm.common import materialize, struct
from fluxbar.llm.vectors import distinct_vectors, for_each_query, matrix

_EXACT = 2**53


class TopK:
    """The k best (score, smaller id first) so far."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], None

    def add(self, scores: np.ndarray, ids: list[np.ndarray]):
        self.rows += [(-int(s), int(i)) for s, own in zip(scores, ids, strict=True) for i in own]
        self.rows = sorted(self.rows)[: self.k]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


class Shard:
    """Postings of some documents by term, with each term's least and greatest component."""

    def __init__(self, values: np.ndarray, ids: list[np.ndarray]):
        self.values, self.ids = values, ids
        self.low, self.high = values.min(0), values.max(0)

    def search(self, query: np.ndarray, top: TopK) -> None:
        bound = np.maximum(query * self.low, query * self.high)
        order = np.argsort(bound, kind="stable")
        # below[i]: the most that the i terms of least bound can add together
        below = np.concatenate([[0], np.cumsum(bound[order])])
        essential = 0
        if top.least is not None:
            ok = np.flatnonzero(below < top.least)
            # Bounds can be negative, so that of the prefixes that cannot compete alone the longest counts.
            essential = int(ok.max()) if len(ok) and below[-1] >= top.least else 0
            if below[-1] < top.least:
                return
        at = None
        part = self.values[:, order[essential:]] @ query[order[essential:]]
        if essential:
            at = np.flatnonzero(part + below[essential] >= top.least)
            part = part[at]
            step = essential
            while step and len(at):
                down = max(0, step - 8)
                terms = order[down:step]
                part = part + self.values[np.ix_(at, terms)] @ query[terms]
                live = part + below[down] >= top.least
                at, part, step = at[live], part[live], down
        if not len(part):
            return
        if len(part) > top.k:
            cut = np.partition(part, len(part) - top.k)[len(part) - top.k]
            live = np.flatnonzero(part >= cut)
            part, at = part[live], live if at is None else at[live]
        elif at is None:
            at = np.arange(len(part))
        if len(part) > 64:
            # Many equal scores: the smaller ids decide, so the best k rows by (score, smallest id) are enough.
            first = np.array([self.ids[i][0] for i in at])
            best = np.lexsort((first, -part))[: top.k]
            part, at = part[best], at[best]
        top.add(part, [self.ids[i] for i in at])


def whole_numbers(embeddings: DataFrame, factor: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(factor * x) of each component as double; rows that are null or hold null or non-finite components are left out."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine).select("vec_id", F.transform("x", lambda x: F.floor(x * factor).cast("long")).alias("v"))


def exact_top_k(embeddings: DataFrame, k: int = 5, every: int = 50, factor: float = 256.0, block: int = 4096, shard: int = 4096) -> DataFrame:
    """The k highest whole-number inner products of each query: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by `every`, candidates all but the
    query's own; ties go to smaller vec_ids. Vectors of other lengths count as filled
    up with zeros; an empty one scores 0 with all. Rows without vec_id take no part,
    rows that repeat a vec_id with another vector are candidates each, other columns
    are ignored. Scores beyond 2**53 are added up as exact whole numbers and held at
    the range of long.

    Each block of distinct query vectors (`block` at most on average, so its size does
    not grow with the input) is sent to all tasks, a task reads its rows in shards and
    carries each query's k-th score from one to the next, and the tasks' results are
    merged by query.
    """
    spark = embeddings.sparkSession
    rows = materialize(whole_numbers(embeddings, factor), "whole-vectors")
    vectors = materialize(distinct_vectors(rows, k + 1), "distinct-vectors")
    asked = rows.where(F.col("vec_id") % every == 0).join(vectors.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), "rep").distinct()
    asked = materialize(asked, "queries")
    reps = asked.select("rep").distinct()
    wanted = materialize(vectors.join(reps, "rep", "left_semi").select("rep", "v"), "query-vectors")
    facts = vectors.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x).cast("double"))))).first()
    dims, most = facts[0] or 0, facts[1] or 0.0
    exact = dims * most * most < _EXACT
    dtype = np.float64 if exact else object
    n_blocks = max(1, -(-wanted.count() // block))

    def one(n: int) -> DataFrame:
        own = wanted.where(F.pmod(F.xxhash64(F.col("rep"), F.lit(7)), F.lit(n_blocks)) == n).collect()
        sent = spark.sparkContext.broadcast((np.array([r["rep"] for r in own], np.int64), [np.array(r["v"], np.int64) for r in own]))

        def run(batches):
            names, lists = sent.value
            queries = [np.concatenate([q, np.zeros(dims - len(q), np.int64)]).astype(dtype) for q in lists]
            tops = [TopK(k + 1) for _ in queries]
            for batch in batches:
                for a in range(0, batch.num_rows, shard):
                    part = batch.slice(a, shard)
                    ids = part.column(1)
                    values = matrix(part.column(0), dims, np.int64).astype(dtype)
                    index = Shard(values, np.split(ids.flatten().to_numpy(), np.cumsum(np.diff(np.asarray(ids.offsets)))[:-1]))
                    for query, top in zip(queries, tops, strict=True):
                        index.search(query, top)
            ids = [[i for _, i in top.rows] for top in tops]
            scores = [[min(2**63 - 1, max(1 - 2**63, -low)) for low, _ in top.rows] for top in tops]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.int64()))], names=["rep", "ids", "scores"])

        return vectors.select("v", "ids").mapInArrow(run, struct("rep long, ids array<long>, scores array<long>"))

    if n_blocks == 1:
        found = one(0)
    else:
        found = None
        for n in range(n_blocks):
            part = materialize(one(n), "block-results")
            found = part if found is None else found.unionByName(part)
    return for_each_query(asked, found, k)
