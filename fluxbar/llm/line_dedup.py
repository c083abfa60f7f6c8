"""Repeated line runs from a suffix array over line-id sequences; only DataFrame functions.

Prefix doubling: all suffixes of the documents' line sequences are ranked by their
first h lines, h = 1, 2, 4, ...; the rank for 2h lines is the place, in sorted
order, of the pair of the suffix's rank for h lines and that of the suffix h lines
on. Suffixes of one rank are an interval of the suffix array whose longest common
prefix is h lines at least; those alone in theirs are done. A suffix whose interval
holds an earlier place begins a later copy of h lines, and overlapping later copies
make the maximal repeated runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxbar.llm.common import hot_limit, materialize

SOLID = r"[^\x20\x09-\x0D]"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and body, the text's hash: rows alike in both are one document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"))


def line_suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """Each line with a word: its document, nth among these lines, 128-bit id (k1, k2), and whether it has min_words words."""
    solid = F.filter(F.split("text", "\n"), lambda x: x.rlike(SOLID))
    lines = _keyed(docs).select("doc_id", "body", F.posexplode(solid).alias("nth", "line"))
    wide = rf"^[\x20\x09-\x0D]*({SOLID}+[\x20\x09-\x0D]+){{{max(0, min_words - 1)}}}{SOLID}"
    return lines.select("doc_id", "body", "nth", F.col("line").rlike(wide).alias("wide"), F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def _place():
    return F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "body", "nth")


def _ranked(suffixes: DataFrame) -> DataFrame:
    """The suffixes (k1, k2) whose interval of the suffix array holds others, with their rank by (k1, k2) and the interval's first place.

    Intervals are pre-aggregated, sorted over ranges and numbered in that order, then
    joined back. Those of hot size are broadcast, and their suffixes stay where they
    are: no task gets a whole hot interval.
    """
    intervals = suffixes.groupBy("k1", "k2").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last").drop("last")
    intervals = materialize(intervals, "intervals")
    # Ids increase with the partition and, in it, with the row: after a sort they are ranks, if not dense ones.
    ranks = materialize(intervals.orderBy("k1", "k2").withColumn("rank", F.monotonically_increasing_id()), "ranks")
    limit = hot_limit(ranks.agg(F.sum("n")).first()[0] or 0)
    kept = [c for c in suffixes.columns if c not in ("k1", "k2")]
    hot = ranks.where(F.col("n") > limit).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("rank").alias("h_rank"), F.col("first").alias("h_first"))
    cold = ranks.where(F.col("n") <= limit).select("k1", "k2", "rank", "first")
    tagged = suffixes.join(F.broadcast(hot), (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    done = tagged.where("h_rank is not null").select(*kept, F.col("h_rank").alias("rank"), F.col("h_first").alias("first"))
    return done.unionByName(tagged.where("h_rank is null").select(*suffixes.columns).join(cold, ["k1", "k2"]).select(*kept, "rank", "first"))


def _ahead(level: DataFrame, lines: int) -> DataFrame:
    """level's suffixes with their rank as k1 and that of the suffix so many lines on as k2; those without one are left out."""
    on = W.partitionBy("doc_id", "body").orderBy("nth").rangeBetween(lines, lines)
    pairs = level.select("doc_id", "body", "nth", "wide", F.col("rank").alias("k1"), F.first("rank").over(on).alias("k2"))
    return pairs.where("k2 is not null")


def repeated_runs(docs: DataFrame, min_lines: int = 2, min_words: int = 10) -> DataFrame:
    """(doc_id, body, from, until, lines, depth): the maximal runs of lines that are later copies, in numbers of lines with a word.

    A line begins a later copy of h lines if the same h lines begin at an earlier
    place too; places are ordered by doc_id (null last), the text's hash and the
    line. Later copies of min_lines lines and more count, and such of a single line
    with min_words words. Those that share lines form one run; lines without a word
    are passed over within it and not compared. depth is the largest h tried (1,
    min_lines and the powers of two over it) by which part of the run repeats.

    Rounds end when no interval of several suffixes is left: after the logarithm of
    the longest repeated run. Each round's suffixes are written to the shared folder.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    marks: list[DataFrame] = []

    def mark(level: DataFrame, h: int) -> None:
        marks.append(level.where(F.col("first") < _place()).select("doc_id", "body", "nth", F.lit(h).alias("h")))

    h = 1
    level = materialize(_ranked(line_suffixes(docs, min_words)).distinct(), "suffixes")
    while True:
        if h >= min_lines:
            mark(level, h)
        elif h == 1:
            mark(level.where("wide"), h)
        if h < min_lines < 2 * h:
            # Two overlapping prefixes of h lines make one of min_lines.
            mark(materialize(_ranked(_ahead(level, min_lines - h)), "suffixes"), min_lines)
        longer = _ranked(_ahead(level, h))
        level = materialize(longer, "suffixes")
        h *= 2
        if level.isEmpty():
            break
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    longest = every.groupBy("doc_id", "body", "nth").agg(F.max("h").alias("h"))
    by_doc = W.partitionBy("doc_id", "body").orderBy("nth")
    reach = F.max(F.col("nth") + F.col("h")).over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    runs = longest.withColumn("new", (F.col("nth") >= F.coalesce(reach, F.lit(0))).cast("int")).withColumn("run", F.sum("new").over(by_doc))
    runs = runs.groupBy("doc_id", "body", "run").agg(F.max(F.col("nth") + F.col("h")).alias("to"), F.min("nth").alias("from"), F.max("h").alias("depth"))
    return runs.select("doc_id", "body", "from", (F.col("to") - 1).alias("until"), (F.col("to") - F.col("from")).cast("long").alias("lines"), "depth")


def _cleaned(docs: DataFrame, columns: list, min_lines: int, min_words: int, solid_only: bool = False) -> DataFrame:
    """docs with __n_lines, __n_removed, __n_runs, __depth and __text; columns: what to keep of docs; solid_only: without texts of which no line with a word stays."""
    runs = repeated_runs(docs, min_lines, min_words)
    spans = F.sort_array(F.collect_list(F.struct("from", "until")))
    by_doc = runs.groupBy("doc_id", "body").agg(spans.alias("__runs"), F.max("depth").alias("__depth"), F.sum("lines").alias("__gone")).withColumnRenamed("doc_id", "__run_id").withColumnRenamed("body", "__run_body")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(*columns, F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text).alias("__body"), text.alias("__old"))
    joined = keyed.join(by_doc, keyed["__id"].eqNullSafe(by_doc["__run_id"]) & (keyed["__body"] == by_doc["__run_body"]), "left")
    if solid_only:
        # Told from counts: a filter on the new text would be pushed below it and work it out once more.
        solid = F.size(F.filter(F.split("__old", "\n"), lambda x: x.rlike(SOLID)))
        joined = joined.where(F.col("__runs").isNull() | (F.col("__gone") < solid))
    joined = joined.drop("__gone").withColumn("__lines", F.split("__old", "\n"))
    # Places in the text of the lines with a word; a run goes from its first to its last, what is blank between them included.
    at = F.filter(F.transform("__lines", lambda x, i: F.when(x.rlike(SOLID), i)), lambda i: i.isNotNull())
    joined = joined.withColumn("__at", F.when(F.col("__runs").isNotNull(), at))
    cut = F.transform("__runs", lambda r: F.struct(F.element_at("__at", r["from"] + 1).alias("low"), F.element_at("__at", r["until"] + 1).alias("high")))
    joined = joined.withColumn("__cut", F.coalesce(cut, F.array().cast("array<struct<low:int,high:int>>")))
    n = F.size("__cut")

    def between(k):
        """The lines after the k-th run from the beginning (0: from the start of the text) and before the next."""
        low = F.when(k == 0, F.lit(0)).otherwise(F.get("__cut", k - 1)["high"] + 1)
        high = F.when(k == n, F.size("__lines")).otherwise(F.get("__cut", k)["low"])
        return F.slice("__lines", low + 1, high - low)

    done = joined.withColumn("__kept", F.flatten(F.transform(F.sequence(F.lit(0), n), between)))
    own = ("__id", "__body", "__old", "__run_id", "__run_body", "__runs", "__kept", "__lines", "__at", "__cut", "__depth")
    return done.select(
        *[c for c in done.columns if c not in own],
        F.size("__lines").cast("long").alias("__n_lines"), (F.size("__lines") - F.size("__kept")).cast("long").alias("__n_removed"),
        n.cast("long").alias("__n_runs"), F.coalesce("__depth", F.lit(0)).cast("long").alias("__depth"), F.array_join("__kept", "\n").alias("__text"),
    )


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 10) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_removed, n_runs, the greatest depth (0: no run) and the text without the later copies of repeated_runs().

    Null texts are read as empty, which is one line. Rows that repeat doc_id and text
    are one document: neither is a later copy of the other. Other columns are ignored.
    """
    done = _cleaned(docs, [F.col("doc_id").cast("long").alias("doc_id")], min_lines, min_words)
    return done.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_lines", "n_removed", "n_runs", "depth", "text")])


def without_repeated_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 10) -> DataFrame:
    """docs with all columns, text without later copies and n_chars its length; documents that consist of later copies only go."""
    done = _cleaned(docs, [docs[c] for c in docs.columns], min_lines, min_words, solid_only=True)
    new = {"text": F.when(F.col("__n_removed") > 0, F.col("__text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__n_removed") > 0, F.length("__text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
