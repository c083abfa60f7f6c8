"""SimHash near-dedup at a similarity: wide fingerprints in BK-trees propose pairs, the shingle sets confirm them.

At a similarity of 0.8 fingerprints of b bits differ in 0.15 b bits. A BK-tree over
all fingerprints follows nearly every edge at such a radius, so shards are formed
first: documents whose sets agree on the least hashes of a band meet in a shard,
and its BK-tree tells which of them lie within the radius.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxbar.llm.common import give_back, id_and_text, join_to_few, map_batches, materialize, struct
from fluxbar.llm.simhash import SEED, BKForest, components, dealt_shards, grouped, groups_of, keep_first, merge, words_of

#: Bands and rows that name shards. A pair of similarity 0.8 meets in one with a chance of 99.96 %, one of 0.9 but for one in 10^7.
BANDS, ROWS = 20, 5
#: 64-bit words of a fingerprint.
WIDTH = 4
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS + WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, shingle: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 of the shingles, of all words if there are fewer. No word: none."""
    # bytes.lower() changes A-Z only and bytes.split() cuts at space and \t to \r only.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined, starts = b" ".join(words), np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
    ends = starts[shingle:] if len(words) > shingle else starts[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)), np.uint64, n))


def set_id(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def band_keys(h: np.ndarray) -> list[int]:
    """A key for each band; sets without shingles have none."""
    if not len(h):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 4096):
        x = h[a : a + 4096] ^ (h[a : a + 4096] >> np.uint64(29))
        least = np.minimum(least, (_ODD[: BANDS * ROWS, None] * x[None, :]).min(1))
    parts = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(parts[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def wide_fingerprint(h: np.ndarray) -> bytes:
    """SimHash of 64 * WIDTH bits of a shingle set: a bit is 1 if set in over half of the members' hashes."""
    out = []
    for odd in _ODD[BANDS * ROWS :]:
        x = (h ^ (h >> np.uint64(32))) * odd
        x ^= x >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for a in range(0, len(x), 1 << 16):
            ones += np.unpackbits(x[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h)).tobytes())
    return b"".join(out)


def radius_of(similarity: float) -> int:
    """Bits in which fingerprints of sets that similar differ at most, but for six standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * WIDTH * p + 6 * math.sqrt(64 * WIDTH * p * (1 - p)))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity; rounded, so that one just as high doesn't fall to a double's last digit."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1:
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int((a[at] == b).sum()) if len(a) else 0
    return round(common / max(1, len(a) + len(b) - common), 12) >= similarity


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are as similar as that."""
    one = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    ratio = F.round(F.col("common") / (F.size("sa") + F.size("sb") - F.col("common")), 12)
    return both.where(ratio >= similarity).select("a", "b")


def _nearest(keyed: DataFrame, sketches: DataFrame, radius: int, most: int) -> DataFrame:
    """(a, b) from keyed (key, fp) and sketches (fp, sketch): each fingerprint of a shard's BK-tree with the nearest within the radius of those before it: fewer pairs than rows."""

    def close(table: pa.Table):
        key, tree, role = (table.column(k).to_numpy() for k in range(3))
        name, items = table.column(3).combine_chunks(), words_of(table.column(4).combine_chunks())
        shard = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (tree[1:] != tree[:-1])]))
        own = np.flatnonzero(role == 0)
        if not len(own):
            return
        forest = BKForest(items[own], shard[own])
        root = np.fromiter((forest.roots.get(x, -1) for x in shard.tolist()), np.int64, len(shard))
        n, none = len(items), np.iinfo(np.int64).max
        best = np.full(n, none)
        for q, i, d in forest.search(items, root, radius):
            i = own[i]
            before = i < q
            np.minimum.at(best, q[before], d[before] * n + i[before])
        q = np.flatnonzero(best < none)
        yield pa.RecordBatch.from_arrays([name.take(pa.array(q)), name.take(pa.array(best[q] % n))], names=["a", "b"])

    def run(batches):
        yield from groups_of(batches, 2, 50_000, close)
        give_back()

    # Sketches follow when only the shards of several rows are left.
    dealt = dealt_shards(keyed, most, 64).join(sketches, "fp").select("key", "tree", "role", "fp", "sketch")
    return dealt.repartition("key", "tree").sortWithinPartitions("key", "tree", "role").mapInArrow(run, struct("a binary, b binary"))


def _across(rows: DataFrame, radius: int, similarity: float, most: int) -> DataFrame:
    """(a, b): confirmed links between fingerprints of a shard with different labels, enough to join the labels that all such links join.

    rows: key, fp, sketch, band, bands, label, shingles. A pair that shares several
    shards is compared in that of the first band only.
    """

    def close(table: pa.Table):
        key, tree, role = (table.column(k).to_numpy() for k in range(3))
        name, items = table.column(3).combine_chunks(), words_of(table.column(4).combine_chunks())
        band, bands = table.column(5).to_numpy(), table.column(6).combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        label = np.unique(np.array([x.hex() for x in table.column(7).to_pylist()]), return_inverse=True)[1]
        held = table.column(8).combine_chunks()
        cut, flat = np.asarray(held.offsets), held.values.to_numpy().view(np.uint64)
        shard = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (tree[1:] != tree[:-1])]))
        own = np.flatnonzero(role == 0)
        if not len(own):
            return
        forest = BKForest(items[own], shard[own])
        root = np.fromiter((forest.roots.get(x, -1) for x in shard.tolist()), np.int64, len(shard))
        joined, a, b = np.arange(label.max() + 1), [], []
        for q, i, d in forest.search(items, root, radius):
            i = own[i]
            wanted = np.flatnonzero(i < q)
            wanted = wanted[np.argsort(d[wanted], kind="stable")]
            for at in np.split(wanted, range(2000, len(wanted), 2000)):
                at = at[joined[label[q[at]]] != joined[label[i[at]]]]
                seen = (bands[q[at]] == bands[i[at]]).argmax(1)
                at = at[seen == band[q[at]]]
                hit = [k for k in at.tolist() if alike(flat[cut[q[k]] : cut[q[k] + 1]], flat[cut[i[k]] : cut[i[k] + 1]], similarity)]
                merge(joined, label[q[hit]], label[i[hit]])
                a += q[hit].tolist()
                b += i[hit].tolist()
        yield pa.RecordBatch.from_arrays([name.take(pa.array(a, pa.int64())), name.take(pa.array(b, pa.int64()))], names=["a", "b"])

    def run(batches):
        yield from groups_of(batches, 2, 10_000, close)
        give_back()

    dealt = dealt_shards(rows, most).select("key", "tree", "role", "fp", "sketch", "band", "bands", "label", "shingles")
    return dealt.repartition("key", "tree").sortWithinPartitions("key", "tree", "role").mapInArrow(run, struct("a binary, b binary"))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, most: int = 4096) -> DataFrame:
    """(doc_id, body, fp, first) for each row of docs: fp names its shingle set, first the row that stands for its group.

    Documents whose sets have at least that Jaccard similarity are linked. Texts
    without words are alike; nulls are read as empty; other columns are ignored.

    First each fingerprint is paired with the nearest of its shard, and the pairs are
    confirmed. Then shards that still hold several groups get their shingle sets, and
    all pairs within the radius that lie in different groups are compared where the
    shard is: no pair but a confirmed one leaves its task. A shard of more than
    `most` distinct sets is dealt over several trees, each asked for all of it.
    """
    radius = radius_of(similarity)

    def sign(batch):
        found = [shingles(t, shingle) for t in batch.column(1).to_pylist()]
        yield {"doc_id": batch.column(0), "body": batch.column(2), "fp": [set_id(h) for h in found], "sketch": [wide_fingerprint(h) for h in found], "bands": [band_keys(h) for h in found]}

    own = id_and_text(docs).withColumn("body", F.xxhash64("text"))
    signed = materialize(map_batches(own, sign, struct("doc_id long, body long, fp binary, sketch binary, bands array<long>")), "signed")

    def link(distinct: DataFrame) -> DataFrame:
        pairs = _nearest(distinct.select(F.explode("bands").alias("key"), "fp"), distinct.select("fp", "sketch"), radius, most)
        pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")

        def gather(batch):
            sets, out = [], []
            for text, want in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = shingles(text, shingle)
                if set_id(h) == want:
                    sets.append(want)
                    out.append(h.astype(np.int64))
            yield {"fp": sets, "shingles": out}

        def sets_of(wanted: DataFrame, name: str) -> DataFrame:
            named = wanted.join(distinct, "fp").select("fp", F.col("first.doc_id").alias("n_id"), F.col("first.body").alias("n_body"))
            texts = own.join(named, (own["body"] == named["n_body"]) & own["doc_id"].eqNullSafe(named["n_id"])).select("doc_id", "text", "fp")
            return materialize(map_batches(texts, gather, struct("fp binary, shingles array<long>")).dropDuplicates(["fp"]), name)

        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "candidate-sets")
        found = materialize(_confirmed(pairs, sets, similarity), "near-links")
        roots = components(found).withColumnRenamed("node", "r_fp")
        label = F.coalesce("root", "fp")
        labelled = materialize(distinct.join(roots, F.col("fp") == F.col("r_fp"), "left").select("fp", "bands", label.alias("label")), "labelled")
        labelled = labelled.select("fp", "label", F.posexplode("bands").alias("band", "key"))
        mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "n")
        mixed = materialize(mixed, "mixed-shards")
        total = mixed.agg(F.sum("n")).first()[0]
        if total is None:
            return found
        rows = materialize(join_to_few(labelled, mixed, "key", "n", total), "mixed-rows")
        sets = sets_of(rows.select("fp").distinct(), "mixed-sets").withColumnRenamed("fp", "m_fp")
        rows = rows.join(sets, F.col("fp") == F.col("m_fp")).drop("m_fp").join(distinct.select("fp", "sketch", "bands"), "fp")
        further = _across(rows, radius, similarity, most // 4)
        return found.unionByName(materialize(further, "further-links"))

    return grouped(signed, link, F.max("bands").alias("bands"), F.max("sketch").alias("sketch"))


def keep_representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay, all columns as they are: of each group of near copies one (see simhash.keep_first)."""
    return keep_first(docs, near_copies(docs, shingle, similarity))
