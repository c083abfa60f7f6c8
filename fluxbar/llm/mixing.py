"""Mixing sources to target weights with a splitting tree of multivariate hypergeometric draws.

The documents of a source form permuted blocks: a hash of the document orders
them and its first digits name the block. A source's target is so many whole
passes over its blocks and a rest, drawn as the first blocks of the permutation.
The blocks of all passes are dealt to the output shards by a binary tree, each
node of which splits its exact block quotas by a multivariate hypergeometric
draw; a shard takes the next blocks of each source's permutation and orders its
documents by another hash. Every draw is a function of the seed and the node.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxbar.llm.common import materialize, struct

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], most: int = 3) -> list[float]:
    """Words to take of each source: shares of all words by weight, none above `most` times its source's size.

    Rounds: of what remains, each source still open gets its share by weight; those
    above their bound are closed at it and the rest is shared anew.
    """
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = sum(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] > most * sizes[i] * weight]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= most * sizes[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def uniform(text: str) -> float:
    """A number in [0, 1) from the text's MD5: 48 bits of it."""
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16) / 16**12


def hypergeometric(own: int, others: int, take: int, u: float) -> int:
    """How many of `own` are among `take` of own + others: the inverse of the distribution at u.

    The probabilities come from their ratios, over twelve standard deviations around
    the mean, beyond which nothing adds to a double.
    """
    low, high, total = max(0, take - others), min(own, take), own + others
    if low == high:
        return low
    mean = take * own / total
    reach = 12 * math.sqrt(mean * (others / total) * ((total - take) / max(1, total - 1))) + 12
    low, high = max(low, math.floor(mean - reach)), min(high, math.ceil(mean + reach))
    k = np.arange(low, high, dtype=np.float64)
    log = np.concatenate([[0.0], np.cumsum(np.log(own - k) + np.log(take - k) - np.log(k + 1) - np.log(others - take + k + 1))])
    below = np.cumsum(np.exp(log - log.max()))
    return min(high, low + int((below <= u * below[-1]).sum()))


def split_quotas(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks that each shard (row) takes of each source (column); columns add up to counts, rows differ by one at most.

    A node of the tree, the shards [a, b), gives its left half's share of its blocks
    to [a, mid): a multivariate hypergeometric draw, source after source.
    """
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, [int(n) for n in counts])]
    while todo:
        a, b, n = todo.pop()
        if b - a == 1:
            out[a] = n
            continue
        mid, others, left = (a + b) // 2, sum(n), []
        take = others * (mid - a) // (b - a)
        for i, own in enumerate(n):
            others -= own
            left.append(hypergeometric(own, others, take, uniform(f"{seed}:{a}:{b}:{i}")))
            take -= left[-1]
        todo += [(a, mid, left), (mid, b, [x - y for x, y in zip(n, left, strict=True)])]
    return out


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("digest"),
    )
    return sized.withColumn("place", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "digest")))


def order_key(seed: int, copy: Column) -> Column:
    """What orders a copy within its shard: another hash of doc_id and text than the one that orders the source."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:order:"), copy.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "digest")), 1, 12)


def block_digits(docs: int) -> int:
    """Hex digits that name a block, so that about as many blocks as documents in a block come of them, and 16**5 blocks a source at most."""
    return next((d for d in range(1, 5) if 256**d >= docs), 5)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, shards: int = 16, seed: int = 0, max_sources: int = 100_000) -> DataFrame:
    """One row for each row of docs: doc_id, digest (of the text), size, source, source_size, target, taken, block, shards and orders.

    size counts words (null text: 0). taken is floor(target / source_size) passes
    over the document and, for the rest, the documents first in the source's
    permutation, the last of them in part, so that the source's taken words are its
    target rounded. shards names the shard of each copy, the last perhaps in part
    (empty if nothing is taken), orders what orders each within its shard. Rows alike
    in doc_id and text are interchangeable. Sources without words have target 0.
    The driver gets one row a source, max_sources at most (more raise an error); the
    rank within a source is taken over its blocks, then within the one block where
    the rest ends.
    """
    spark = docs.sparkSession
    sized = materialize(_sized(docs, seed), "mix-sizes")
    sized = sized.withColumn("block", F.substring("place", 1, block_digits(sized.count())))
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = materialize(blocks, "mix-blocks")
    found = blocks.groupBy("source").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("blocks")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in found]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    rows, dealt = [], []
    for r, size, t in zip(found, sizes, want, strict=True):
        passes, rest = divmod(math.floor(t + 0.5), size) if size else (0, 0)
        dealt.append(r["blocks"] * (passes + (rest > 0)))
        rows.append((r["source"], size, t, passes, rest, r["blocks"]))
    quotas = np.cumsum(split_quotas(dealt, shards, seed), axis=0)
    rows = [(*r, [int(x) for x in quotas[:, i]]) for i, r in enumerate(rows)]
    plan = spark.createDataFrame(rows, struct("source string, source_size long, target double, passes long, rest long, n_blocks long, until array<long>"))

    # Where the rest ends: the words before each block of its source's permutation, then, in the one block that holds the end, before each document.
    by_block = W.partitionBy("source").orderBy("block")
    blocks = blocks.withColumn("before", F.sum("words").over(by_block) - F.col("words")).withColumn("nth", F.row_number().over(by_block) - 1)
    at = blocks.join(F.broadcast(plan), blocks["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    copies = F.col("passes") + (F.col("before") < F.col("rest")).cast("long")
    dealt_to = F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), lambda p: F.size(F.filter("until", lambda u: u <= F.col("n_blocks") * p + F.col("nth"))))
    at = at.select(
        F.col("source").alias("b_source"), F.col("block").alias("b_block"), "source_size", "target", "passes", "rest", "before", "words",
        F.when(copies > 0, dealt_to).otherwise(F.array().cast("array<int>")).alias("dealt"),
    )
    rows = sized.join(at, sized["source"].eqNullSafe(at["b_source"]) & (sized["block"] == at["b_block"]))
    ends = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    whole = rows.where(~ends).withColumn("part", F.when(F.col("before") < F.col("rest"), F.col("size")).otherwise(0))
    by_doc = W.partitionBy("source", "block").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("size").over(by_doc), F.lit(0))
    cut = rows.where(ends).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before)))
    out = whole.unionByName(cut)
    times = F.when(F.col("size") > 0, F.col("passes") + (F.col("part") > 0).cast("long")).otherwise(0).cast("int")
    orders = F.transform("shards", lambda x, i: order_key(seed, i))
    out = out.withColumn("taken", F.col("passes") * F.col("size") + F.col("part")).withColumn("shards", F.slice("dealt", F.lit(1), times))
    return out.select("doc_id", "digest", "size", "source", "source_size", "target", "taken", "block", "shards", orders.alias("orders"))


def copies_of(size: Column, taken: Column) -> Column:
    """Whole copies: taken over size, a half and more rounded up."""
    return F.when(size > 0, F.floor((2 * taken + size) / (2 * size))).otherwise(0).cast("int")


def dealt_documents(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """The mix itself in its order: each row of docs as often as the mix takes it whole (a half and more counts), with __copy, __shard and __order.

    A copy goes to the shard the splitting tree gives its block; a shard is ordered
    by order_key, so that copies part. Rows alike in doc_id and text share the copies
    of the one that is taken most.
    """
    copies = copies_of(F.col("size"), F.col("taken"))
    dealt = F.slice(F.arrays_zip("shards", "orders"), F.lit(1), copies)
    taken = mix_sources(docs, seed=seed, **how).select("doc_id", "digest", F.struct(copies.alias("copies"), dealt.alias("dealt")).alias("own")).where("own.copies > 0")
    taken = taken.groupBy("doc_id", "digest").agg(F.max("own").getField("dealt").alias("__dealt"))
    taken = taken.withColumnsRenamed({"doc_id": "__taken_id", "digest": "__taken_digest"})
    own = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    joined = docs.join(taken, docs["doc_id"].cast("long").eqNullSafe(taken["__taken_id"]) & (own == taken["__taken_digest"]))
    each = joined.select(*[docs[c] for c in docs.columns], F.posexplode("__dealt").alias("__copy", "__to"))
    each = each.withColumns({"__shard": F.col("__to.shards"), "__order": F.col("__to.orders")}).drop("__to")
    return each.orderBy("__shard", "__order", "__copy", "doc_id")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """dealt_documents with the columns of docs only: shard after shard, each in its own order."""
    return dealt_documents(docs, **how).select(*docs.columns)
