"""Shared helpers: tables cut out of the lineage, and Arrow passes over texts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_local_dir: str | None = None


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is absent (single-JVM runs such as tests) a temporary
    folder is made; a cluster without the setting is refused, because its
    executors could not see that folder.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="fluxbar-")
        atexit.register(shutil.rmtree, _local_dir, True)
    return _local_dir


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    The result has no lineage: a lost executor costs only the tasks that ran on it.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/fluxbar/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bound of the keys broadcast at once.
HOT_KEYS = 5_000


def hot_limit(rows: int) -> int:
    """Keys with more rows than this are hot. There are HOT_KEYS of them at most."""
    return max(64, rows // HOT_KEYS)


def join_to_few(many: DataFrame, one: DataFrame, key: str, size: str, rows: int) -> DataFrame:
    """many joined to the rows of `one` (key is unique there, column `size` tells how many rows of many it has, `rows` how many they are in all).

    Hot keys' rows of `one` are broadcast, so that no task gets all rows of such a key; the others are joined by key.
    """
    limit = hot_limit(rows)
    names = [c for c in one.columns if c not in (key, size)]
    hot = one.where(F.col(size) > limit).select(F.col(key).alias("__key"), F.lit(True).alias("__hot"), *[F.col(c).alias(f"__{c}") for c in names])
    cold = one.where(F.col(size) <= limit).select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in names])
    columns = [*[F.col(c) for c in many.columns], *[F.col(f"__{c}").alias(c) for c in names]]
    tagged = many.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left")
    done = tagged.where("__hot").select(*columns)
    rest = tagged.where("__hot is null").select(*many.columns)
    return done.unionByName(rest.join(cold, F.col(key) == F.col("__key")).select(*columns))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """mapInArrow where fn yields dicts of columns; batches are cut so that texts stay within some MB."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                for cols in fn(part):
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """At the end of a task, return what its Python worker has freed: the worker stays for other tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batch: pa.RecordBatch, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes each, a row at least."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * limit / max(1, batch.nbytes)))
    for start in range(0, n, step):
        yield batch.slice(start, step)


_TYPES = {"long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "string": T.StringType, "boolean": T.BooleanType, "binary": T.BinaryType}


def struct(spec: str) -> T.StructType:
    """Schema from "name type, ..." with simple types and arrays of them; needs no session."""

    def kind(name: str) -> T.DataType:
        return T.ArrayType(kind(name[6:-1])) if name.startswith("array<") else _TYPES[name]()

    return T.StructType([T.StructField(name, kind(of)) for name, of in (x.split() for x in spec.split(","))])


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text with null read as empty; other columns are left behind, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
