"""What the searches over vectors share: valid rows, distinct vectors, and the join of results to queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxbar.llm.common import materialize


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(rep, v, ids): each distinct v of rows (vec_id, v), its smallest vec_id, and its `keep` smallest vec_ids.

    No query needs more ids of equal vectors than it returns, itself included, so
    thousands of copies cost what one does. Rows that repeat both count once.
    """
    first = rows.withColumn("n", F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= keep)
    return first.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_set("vec_id")).alias("ids"))


def for_each_query(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from queries (query_id, rep) and found (rep, ids, scores), each row of which has its k + 1 best of a part."""
    parts = F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct((-x["scores"]).alias("low"), x["ids"].alias("vec_id")))
    lists = found.groupBy("rep").agg(F.sort_array(F.flatten(F.collect_list(parts))).alias("every"))
    lists = materialize(lists.select(F.col("rep").alias("l_rep"), F.slice("every", 1, k + 1).alias("list")), "nearest")
    joined = queries.join(lists, queries["rep"] == lists["l_rep"])
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = joined.select("query_id", F.posexplode(others).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.low")).alias("score"))


def matrix(column: pa.Array, dims: int, dtype) -> np.ndarray:
    """Rows of a list column, filled up with zeros to `dims`."""
    size = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dims).all():
        return flat.reshape(len(size), dims).astype(dtype)
    out = np.zeros((len(size), dims), dtype)
    if len(flat):
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out
