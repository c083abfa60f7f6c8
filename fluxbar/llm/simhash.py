"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees, joined into components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxbar.llm.common import give_back, id_and_text, join_to_few, map_batches, materialize, struct

SEED = 42


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64. No word: 0."""
    import xxhash

    # bytes.lower() changes A-Z only and bytes.split() cuts at space and \t to \r only.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, at, starts = b" ".join(words), 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = starts[shingle:]
        h = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends))
    n, ones = len(h), np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        bits = np.unpackbits(h[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int("".join("1" if 2 * x > n else "0" for x in ones), 2)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, body, fp) for each row of docs; body is the text's hash, fp the fingerprint as a signed 64-bit number."""

    def run(batch):
        fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
        yield {"doc_id": batch.column(0), "body": batch.column(2), "fp": np.array(fps, np.uint64).astype(np.int64)}

    return map_batches(id_and_text(docs).withColumn("body", F.xxhash64("text")), run, struct("doc_id long, body long, fp long"))


class BKForest:
    """BK-trees of many shards at once: every item is a node, its children are keyed by their integer Hamming distance to it.

    Trees grow level by level: the first item of a group becomes its node, and the
    others part by their distance to it. A search holds pairs of a query and a node;
    from each it follows only the edges within the radius of the query's distance.
    """

    def __init__(self, items: np.ndarray, shard: np.ndarray):
        """items: distinct fingerprints within a shard, a row of 64-bit words each; shard: their shards in ascending order."""
        n = len(items)
        self.items, self.span = items, 64 * items.shape[1] + 1
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        live, group = np.arange(n), shard
        self.roots: dict[int, int] = {}
        above, by = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.levels = 0
        while len(live):
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            node = live[first]
            if not self.levels:
                self.roots = dict(zip(shard[node].tolist(), node.tolist(), strict=True))
            parent[node], edge[node] = above[first], by[first]
            head = np.repeat(node, np.diff(np.append(first, len(live))))
            rest = np.ones(len(live), bool)
            rest[first] = False
            live, head = live[rest], head[rest]
            d = distances(items[live], items[head])
            group = head * self.span + d
            order = np.argsort(group, kind="stable")
            live, group, above, by = live[order], group[order], head[order], d[order]
            self.levels += 1
        inner = np.flatnonzero(parent >= 0)
        key = parent[inner] * self.span + edge[inner]
        order = np.argsort(key, kind="stable")
        self._key, self._child = key[order], inner[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, item, distance) of what lies within the radius, part by part; roots: where each query begins, below 0 for nowhere."""
        self.visited = 0
        at = np.flatnonzero(roots >= 0)
        todo = [(at[a : a + most], roots[at[a : a + most]]) for a in range(0, len(at), most)]
        while todo:
            q, node = todo.pop()
            if len(q) > most:
                todo += [(q[a : a + most], node[a : a + most]) for a in range(0, len(q), most)]
                continue
            self.visited += len(q)
            d = distances(queries[q], self.items[node])
            near = d <= radius
            if near.any():
                yield q[near], node[near], d[near]
            low = np.searchsorted(self._key, node * self.span + np.maximum(d - radius, 0))
            high = np.searchsorted(self._key, node * self.span + np.minimum(d + radius, self.span - 1), "right")
            n = high - low
            ends = np.cumsum(n)
            if len(ends) and ends[-1]:
                todo.append((np.repeat(q, n), self._child[np.repeat(low - ends + n, n) + np.arange(ends[-1])]))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the items that the links a - b connect one label, the smallest; label[i] <= i is the smallest item known to be connected with i."""
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def shard_links(items: np.ndarray, shard: np.ndarray, in_tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (item, item) of links that connect what all links between the trees and all items connect; fewer than there are items."""
    tree = np.flatnonzero(in_tree)
    label = np.arange(len(items))
    if len(tree):
        forest = BKForest(items[tree], shard[tree])
        root = np.fromiter((forest.roots.get(x, -1) for x in shard.tolist()), np.int64, len(shard))
        for q, i, _ in forest.search(items, root, radius):
            merge(label, q, tree[i])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def band_keys(fp: Column, blocks: int, radius: int) -> Column:
    """Array of keys: fingerprints within the radius agree on blocks - radius of the blocks, and so on one key at least."""
    width = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    low = [sum(width[:k]) for k in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(n).cast("long")
        for k in chosen:
            part = F.shiftrightunsigned(fp, low[k]).bitwiseAND(F.lit((1 << width[k]) - 1))
            key = F.shiftleft(key, width[k]).bitwiseOR(part)
        keys.append(key)
    return F.array(*keys)


def words_of(column: pa.Array) -> np.ndarray:
    """A row of unsigned 64-bit words for each fingerprint: a whole number is one, a binary of 8 bytes a word several."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.uint64).reshape(-1, 1)
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)


def groups_of(batches, keys: int, most: int, close):
    """close(table, cut) for each run of rows in order of their first `keys` columns: whole groups together until they have about `most` rows.

    cut: whether the table's last group goes on; it then begins the next table too
    with its rows of role 0 (the column after the keys), which come first.
    """
    held: list[pa.RecordBatch] = []
    n = 0

    def parted(final: bool):
        nonlocal held, n
        table = pa.Table.from_batches(held).combine_chunks()
        key = [table.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(len(table) - 1, bool)
        for k in key:
            change |= k[1:] != k[:-1]
        last = 0 if final or not change.any() else int(np.flatnonzero(change)[-1]) + 1
        if final:
            yield from close(table)
            held, n = [], 0
        elif last:
            yield from close(table.slice(0, last))
            held = table.slice(last).to_batches()
            n = len(table) - last
        else:
            # One group alone: what is asked of its tree goes now, the tree stays.
            role = table.column(keys).to_numpy()
            if (role == 1).sum() >= most // 2:
                yield from close(table)
                held = table.filter(pa.array(role == 0)).to_batches()
                n = int((role == 0).sum())

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from parted(False)
    if held:
        yield from parted(True)


def dealt_shards(keyed: DataFrame, most: int, pivots: int | None = None) -> DataFrame:
    """keyed (key, fp, ...) with tree and role, without shards of one row.

    A shard of more than `most` rows is dealt over several trees (role 0), each of
    which is asked for all of the shard (role 1): none is left out. With `pivots` a
    tree is only asked for about so many of them, the same for all.
    """
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.select(F.col("key").alias("s_key"), "n"), "shards")
    trees = F.ceil(F.col("n") / most).cast("int")
    if sizes.where(F.col("n") > most).isEmpty():
        joined = keyed.join(sizes, F.col("key") == F.col("s_key"), "left_semi")
        return joined.select("key", F.lit(0).alias("tree"), F.lit(0).alias("role"), *[c for c in keyed.columns if c != "key"])
    total = sizes.agg(F.sum("n")).first()[0]
    sizes = sizes.withColumnRenamed("s_key", "key").withColumn("trees", trees)
    joined = join_to_few(keyed, sizes, "key", "n", total).withColumn("own", F.pmod(F.xxhash64("fp"), "trees").cast("int"))
    every = F.sequence(F.lit(0), F.col("trees") - 1)
    asked = every if pivots is None else F.when((F.col("trees") == 1) | (F.pmod(F.xxhash64(F.lit(1), "fp"), F.ceil(F.col("n") / pivots)) == 0), every).otherwise(F.array("own"))
    each = joined.withColumn("tree", F.explode(asked))
    return each.select("key", "tree", (F.col("tree") != F.col("own")).cast("int").alias("role"), *[c for c in keyed.columns if c != "key"])


def links(distinct: DataFrame, radius: int = 4, most: int = 20_000) -> DataFrame:
    """(a, b): links enough to connect all fingerprints of `distinct` (column fp) within the radius.

    A shard is what shares a band key; its BK-tree is built where its rows are and
    gives the links. No two fingerprints within the radius miss each other: they
    share a shard.
    """
    n = distinct.count()
    blocks = radius + 2 if n < 1 << 22 else radius + 3 if n < 1 << 28 else radius + 4
    keyed = distinct.select(F.explode(band_keys(F.col("fp"), blocks, radius)).alias("key"), "fp")

    def close(table: pa.Table):
        key, tree, role = (table.column(k).to_numpy() for k in range(3))
        fp = table.column(3).combine_chunks()
        shard = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (tree[1:] != tree[:-1])]))
        a, b = shard_links(words_of(fp), shard, role == 0, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([fp.take(pa.array(a)), fp.take(pa.array(b))], names=["a", "b"])

    def run(batches):
        yield from groups_of(batches, 2, 100_000, close)
        give_back()

    dealt = dealt_shards(keyed, most).repartition("key", "tree").sortWithinPartitions("key", "tree", "role")
    return dealt.mapInArrow(run, struct("a long, b long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Alternating large-star and small-star rounds: each links a node's neighbours to
    the smallest of them, until only stars are left. All rows stay distributed; a
    hub's smallest neighbour is broadcast, so its links need not meet in one task.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    last = None
    n = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_to_few(both, least, "u", "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_to_few(large, least, "u", "n", n).select(F.col("v").alias("x"), "m", "u")
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialize(small.where("u <> v").distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        n = state[0]
        if state == last:
            break
        last = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select("v", F.col("v").alias("root")).distinct().withColumnRenamed("v", "node"))


def _first() -> Column:
    """The row that stands for a group: the smallest doc_id (null last), then the text's hash."""
    return F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "body"))


def grouped(fps: DataFrame, link: Callable[[DataFrame], DataFrame], *more: Column) -> DataFrame:
    """(doc_id, body, fp, first) of each row of fps (doc_id, body, fp); first stands for all rows whose fp its links reach.

    link gives the links (a, b) of the distinct fps, which come with their first row and `more` aggregates.
    """
    distinct = materialize(fps.groupBy("fp").agg(_first().alias("first"), F.count(F.lit(1)).alias("n"), *more), "distinct-fingerprints")
    roots = components(link(distinct)).withColumnRenamed("node", "r_fp")
    rooted = materialize(distinct.join(roots, F.col("fp") == F.col("r_fp"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "rooted-fingerprints")
    several = rooted.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("members"))
    named = join_to_few(rooted.drop("first"), several, "root", "members", rooted.count()).select("fp", "n", F.col("least").alias("first"))
    return join_to_few(fps.select("doc_id", "body", "fp"), materialize(named, "components"), "fp", "n", fps.count())


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most `radius` bits are linked; component_id is
    the smallest doc_id of all documents that links reach, the row's own included.
    Null and empty texts have fingerprint zero and are linked like any other. A null
    doc_id links but is never a component_id unless the component has no other.
    Repeated rows give repeated results; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    found = grouped(fps, lambda distinct: links(distinct.select("fp"), radius))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of docs that stay, all columns as they are: of each group of linked fingerprints one (see keep_first)."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    return keep_first(docs, grouped(fps, lambda distinct: links(distinct.select("fp"), radius)))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that stand for their group in found (first): the smallest doc_id, null last, then the text's hash.

    Different texts that share a doc_id, or have none, are different documents. Of
    rows that repeat both doc_id and text the one with the smallest hash of all its
    columns stays, so a task that runs again keeps the same.
    """
    keep = found.select("first.doc_id", "first.body").distinct().select(F.col("doc_id").alias("__kept_id"), F.col("body").alias("__kept_body"))
    own = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__body", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = own.join(keep, F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__body") == F.col("__kept_body")), "left_semi")
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns))
    return kept.groupBy("__id", "__body").agg(row.alias("__row")).select("__row.*")
