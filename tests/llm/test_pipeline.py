"""The pipeline's stages against plain versions, each on its own input."""

from collections import defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from fluxbar.llm import packing
from fluxbar.llm.queries import tokenizer_path
from tests.llm.test_text_operators import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mix_sources", "pack"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    for t in tables[1:-1]:
        assert t.columns == docs.columns
    rows = [t.collect() for t in tables]
    ids = [{r.doc_id for r in x} for x in rows]
    # Documents with words of a language stay; so do all whose lines aren't copies.
    assert all(any(c.isalpha() for c in r.text) for r in rows[1]) and len(rows[1]) >= 0.95 * len(rows[0])
    assert ids[2] <= ids[1] and all(r.text for r in rows[2]) and all(r.n_chars == len(r.text) for r in rows[2])
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows[2]])
    assert ids[3] == set(want.values()) and len(rows[3]) == len(ids[3])
    texts = {r.doc_id: r.text for r in rows[3]}
    times = defaultdict(int)
    for r in rows[4]:
        assert r.text == texts[r.doc_id]
        times[r.doc_id] += 1
    assert max(times.values()) <= 3
    own = packing.tokenizer(tokenizer_path())
    total = sum(len(x) + 1 for x in own.encode([r.text for r in rows[4]]))
    assert sum(r.length for r in rows[5]) == total


def test_run_gives_the_stages_result(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_copies_of_a_similarity_of_0_8_go(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    texts = []
    for size in rng.integers(60, 400, 25):
        base = word(size)
        texts.append(base)
        for share in (0.01, 0.05, 0.1, 0.15, 0.3):  # of the words new in one run: similarities from about 0.97 to 0.5
            n = max(1, int(size * share))
            at = int(rng.integers(0, size - n))
            texts.append(base[:at] + word(n) + base[at + n :])
    hot = word(200)
    texts += [[*hot, *word(int(rng.integers(1, 30)))] for _ in range(150)] + [["a", "b"], ["a", "b"], []]
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    rows += [(None, rows[0][1]), (None, "quite alone here"), (None, "quite alone here"), (rows[3][0], rows[3][1])]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for a, b in combinations(sets, 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            near += 1
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {find(i) for i in sets}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set", F.lit("x")).withColumn("source", F.lit("s"))
    kept = corpus_pipeline.dedup_near(spark, docs, SF).collect()
    ids = [r.doc_id for r in kept]
    assert near > 100 and ids.count(None) == 1 and len(ids) == len(set(ids)) and set(ids) - {None} == want
    assert corpus_pipeline.dedup_near(spark, docs.limit(0), SF).count() == 0


def plain_mix(rows):
    """How often each (doc_id, text) is taken whole, from the targets and the order of places alone."""
    import hashlib
    import re

    from fluxbar.llm import mixing

    sized = [(r.source, hashlib.md5(f"0:{'' if r.doc_id is None else r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest(), r.doc_id, r.text, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in rows]
    sources = sorted({s[0] for s in sized}, key=lambda x: (x is None, x or ""))
    sizes = [sum(s[4] for s in sized if s[0] == x) for x in sources]
    out = {}
    for source, size, target in zip(sources, sizes, mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))]), strict=True):
        passes, rest = divmod(int(target + 0.5), size) if size else (0, 0)
        for _, _, doc_id, text, n in sorted((s for s in sized if s[0] == source), key=lambda s: s[1]):
            taken, rest = passes * n + min(n, rest), max(0, rest - n)
            out[doc_id, text] = (2 * taken + n) // (2 * n) if n else 0
    return {k: n for k, n in out.items() if n}


def test_stages_of_language_and_mix_against_plain_versions(spark):
    from fluxbar.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.identify(spark, docs, SF).collect()}
    want = set()
    for r in docs.collect():
        lang, _, share = model.predict([r.text or ""])
        if lang[0] != "und" and share[0] >= 0.1:
            want.add((r.doc_id, r.text))
    assert kept == want
    times = defaultdict(int)
    for r in corpus_pipeline.mix(spark, docs, SF).collect():
        times[r.doc_id, r.text] += 1
    assert dict(times) == plain_mix(docs.collect())


def test_run_on_odd_and_empty_tables(spark, odd_documents, no_documents, tmp_path):
    for name, docs in (("odd", odd_documents), ("none", no_documents)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path / name))
        rows = found.collect()
        assert found.columns == packing.SCHEMA.names and bool(rows) == (name == "odd")
        # The long text and its later copy of another id are one document; lines repeated within it go.
        assert len({r.doc_id for r in rows}) == len({r.doc_id for r in rows if r.length > 0})


def test_near_dedup_keeps_documents_that_share_an_id(spark):
    words = lambda a, n: " ".join(f"w{i}" for i in range(a, a + n))
    rows = [(7, words(0, 80)), (7, words(500, 80)), (8, words(0, 79)), (None, words(900, 60)), (None, words(1900, 60))]
    kept = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(r.text for r in kept) == sorted(t for i, t in rows if i != 8)
