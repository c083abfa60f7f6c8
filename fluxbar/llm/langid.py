"""Language identification with bit-sliced Bloom filters over character trigrams.

Each slot of the filter holds a bit for each language, so the AND of an n-gram's
slots names all languages that contain it at once. The hits of each language are
counted over a text, corrected for the filter's false positives, and compared.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxbar.llm.common import id_and_text, map_batches, materialize, struct

_LETTER = re.compile(r"[^\W\d_]")


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams around each letter of the lower-cased texts, and where each text's codes begin and end.

    What is no letter counts as a space, as do a text's edges.
    """
    low = [t.lower() for t in texts]
    cp = np.frombuffer((" " + "  ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    c = np.where(letter, cp, 32).astype(np.uint64)
    codes = ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[letter[1:-1]]
    ends = np.cumsum(np.fromiter((len(t) + 2 for t in low), np.int64, len(low)))
    seen = np.concatenate([[0], np.cumsum(letter)])
    return codes, np.concatenate([[0], seen[np.minimum(ends, len(cp))]])


@dataclass(frozen=True)
class LanguageFilter:
    """slots: bit masks of the languages, a row of 64-bit words for each slot; false_rate: by language."""

    langs: tuple[str, ...]
    slots: np.ndarray
    probes: int
    false_rate: np.ndarray

    @staticmethod
    def _at(codes: np.ndarray, k: int, size: int) -> np.ndarray:
        x = (codes + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9) + np.uint64(2 * k)
        return (x >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], slots: int = 1 << 18, probes: int = 2) -> LanguageFilter:
        """slots: a power of two."""
        langs = tuple(sorted(grams))
        table = np.zeros((slots, max(1, -(-len(langs) // 64))), np.uint64)
        for i, lang in enumerate(langs):
            for k in range(probes):
                table[cls._at(grams[lang], k, slots), i // 64] |= np.uint64(1 << (i % 64))
        fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
        return cls(langs, table, probes, fill**probes)

    def coverage(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and the share of its trigrams in each language after correction."""
        codes, cut = trigrams(texts)
        n = np.diff(cut)
        out = np.zeros((len(texts), len(self.langs)))
        for w in range(self.slots.shape[1] if len(self.langs) else 0):
            mask = self.slots[self._at(codes, 0, len(self.slots)), w]
            for k in range(1, self.probes):
                mask &= self.slots[self._at(codes, k, len(self.slots)), w]
            for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                hits = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
                raw = (hits[cut[1:]] - hits[cut[:-1]]) / np.maximum(n, 1)
                out[:, i] = np.maximum(0, (raw - self.false_rate[i]) / (1 - self.false_rate[i])) if self.false_rate[i] < 1 else 0
        return n, out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (`und` without a letter), score from 0 to 1, and the share of trigrams that the language explains."""
        if not self.langs or not texts:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        _, part = self.coverage(texts)
        best = part.argmax(1)
        top = part[np.arange(len(texts)), best]
        total = part.sum(1)
        score = np.divide(top, total, out=np.zeros(len(texts)), where=total > 0)
        known = np.fromiter((bool(_LETTER.search(t)) for t in texts), bool, len(texts))
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), np.where(known, top, 0.0)


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample_per_lang: int = 2000, grams_per_lang: int = 4000, least_share: float = 1e-5, salience: float = 0.2) -> LanguageFilter:
    """Learn from the text and non-null lang of the documents whose crc32(doc_id) mod 5 isn't 0.

    sample_per_lang: the documented bound of the sample; of each language about so
    many documents, those with the smallest hash, are used with their whole text.
    A language keeps its grams_per_lang most frequent trigrams that make up
    least_share of its trigrams and at least `salience` of the largest share that
    any language gives them. The driver gets at most 1 / least_share rows a language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count()
    picked = rows.join(F.broadcast(counts) if counts.count() <= 10_000 else counts, "lang")
    # The place hashes the text too, so that rows without or with repeated ids part; rows alike in both are one document of the sample.
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)
    picked = picked.withColumn("place", place).where(F.col("place") * F.col("count") < sample_per_lang)
    picked = picked.groupBy("lang", "place").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batch):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        codes, cut = trigrams(texts)
        groups: dict[str, list[np.ndarray]] = {}
        for lang, a, b in zip(langs, cut[:-1], cut[1:], strict=True):
            groups.setdefault(lang, []).append(codes[a:b])
        for lang, parts in groups.items():
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            yield {"lang": [lang] * len(found), "gram": found.astype(np.int64), "n": n}

    grams = map_batches(picked, count, struct("lang string, gram long, n long")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialize(grams, "trigrams")
    totals = grams.groupBy("lang").agg((F.sum("n") * least_share).alias("least"))
    frequent = grams.join(totals, "lang").where(F.col("n") >= F.col("least")).select("lang", "gram", "n").toPandas()
    frequent["share"] = frequent["n"] / frequent.groupby("lang")["n"].transform("sum")
    frequent = frequent[frequent["share"] >= salience * frequent.groupby("gram")["share"].transform("max")]
    frequent = frequent.sort_values(["lang", "n", "gram"], ascending=[True, False, True]).groupby("lang").head(grams_per_lang)
    return LanguageFilter.build({lang: rows["gram"].to_numpy(np.int64).astype(np.uint64) for lang, rows in frequent.groupby("lang")})


SCHEMA = struct("doc_id long, held_out boolean, lang_pred string, score double, coverage double")


def identify_languages(docs: DataFrame, model: LanguageFilter | None = None, **how) -> DataFrame:
    """One row for each row of docs: the language of its whole text.

    model: a fitted filter, else fit(docs, **how). `und` with score 0 where the
    text is null, has no letter, or no language was learned. Ties go to the
    language first in code-point order. A null doc_id is not held out; repeated
    rows give repeated results; other columns are ignored.
    """
    model = model or fit(docs, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        lang, score, part = shared.value.predict(batch.column(1).to_pylist())
        yield {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": lang, "score": score, "coverage": part}

    return map_batches(id_and_text(docs).withColumn("held_out", _held_out()), run, SCHEMA)


def keep_identified(docs: DataFrame, least_coverage: float = 0.1, **how) -> DataFrame:
    """The rows of docs whose language was identified, all columns as they are.

    Rejected: `und`, and texts of which less than least_coverage of the trigrams
    belong to the predicted language. The verdict is computed beside each row, so
    no text is shuffled.
    """
    model = fit(docs, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        from fluxbar.llm.common import give_back, pieces

        for batch in batches:
            for part in pieces(batch):
                lang, _, share = shared.value.predict([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([x != "und" and s >= least_coverage for x, s in zip(lang, share, strict=True)], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
