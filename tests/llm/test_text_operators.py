"""Language ID, SimHash, packing, mixing and line dedup against plain versions."""

import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from fluxbar.llm import langid, line_dedup, mixing, packing, simhash
from fluxbar.llm.queries import tokenizer_path


# Language ID


def test_held_out_accuracy(documents):
    found = langid.identify_languages(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out and r.lang is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_filter_holds_what_it_was_given_and_corrects():
    grams, _ = langid.trigrams(["the house and the dog"])
    other, _ = langid.trigrams(["über die straße gehen"])
    model = langid.LanguageFilter.build({"en": np.unique(grams), "de": np.unique(other)}, slots=1 << 10)
    _, part = model.coverage(["the house and the dog"])
    assert part[0, list(model.langs).index("en")] == pytest.approx(1)
    assert model.predict(["", "123", "The Dog", "Straße"])[0] == ["und", "und", "en", "de"]


def test_more_languages_than_a_word_has_bits():
    grams = {f"l{i:03}": langid.trigrams([f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}a b{chr(0x6E00 + i)}"])[0] for i in range(130)}
    model = langid.LanguageFilter.build(grams, slots=1 << 14)
    assert model.predict([f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}a" for i in range(130)])[0] == sorted(grams)


def test_language_odd_tables(odd_documents, no_documents):
    found = langid.identify_languages(odd_documents).collect()
    assert len(found) == odd_documents.count()
    assert {r.lang_pred for r in found if r.doc_id in (2, 3, 6, 7)} == {"und"}
    assert langid.identify_languages(no_documents).count() == 0
    kept = langid.keep_identified(odd_documents)
    assert kept.schema == odd_documents.schema and not {2, 3, 6, 7} & {r.doc_id for r in kept.collect()}


def plain_trigrams(text):
    low = text.lower()
    padded = " " + "".join(c if c.isalpha() else " " for c in low) + " "
    return [padded[i : i + 3] for i in range(len(low)) if padded[i + 1] != " "]


def test_language_matches_the_definition(documents):
    """The same filter from sets and whole numbers, one trigram at a time."""
    rows = documents.select("doc_id", "text", "lang").collect()
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 5 == 0
    counts = defaultdict(lambda: defaultdict(int))
    for r in rows:
        if not held(r) and r.lang is not None and r.text is not None:
            for g in plain_trigrams(r.text):
                counts[r.lang][g] += 1
    share = {}
    for lang, own in counts.items():
        total = sum(own.values())
        own = {g: n for g, n in own.items() if n >= total * 1e-5}
        share[lang] = {g: n / sum(own.values()) for g, n in own.items()}
    most = defaultdict(float)
    for own in share.values():
        for g, x in own.items():
            most[g] = max(most[g], x)
    code = lambda g: sum((32 if c == " " else ord(c)) << s for c, s in zip(g, (42, 21, 0), strict=True))
    langs, slots = sorted(share), 1 << 18

    def place(c, k):
        x = (c + k) * 0x9E3779B97F4A7C15 % 2**64
        x ^= x >> 29
        return (x * (0xBF58476D1CE4E5B9 + 2 * k) % 2**64) >> 46

    bits = {}
    for lang in langs:
        kept = sorted((-n, code(g)) for g, n in share[lang].items() if n >= 0.2 * most[g])[:4000]
        bits[lang] = {place(c, k) for _, c in kept for k in (0, 1)}
    want = {}
    for r in rows:
        grams = [code(g) for g in plain_trigrams(r.text or "")]
        part = {}
        for lang in langs:
            wrong = (len(bits[lang]) / slots) ** 2
            raw = sum(place(c, 0) in bits[lang] and place(c, 1) in bits[lang] for c in grams) / max(1, len(grams))
            part[lang] = max(0, (raw - wrong) / (1 - wrong))
        best = max(langs, key=lambda x: (part[x], [-ord(c) for c in x]))
        want[r.doc_id] = ("und", 0.0) if not grams else (best, part[best] / sum(part.values()) if sum(part.values()) else 0.0)
    found = langid.identify_languages(documents).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-9) and r.held_out == held(r)


def test_the_sample_is_bounded_without_ids(spark, monkeypatch):
    rows = [(None, f"some words of number {i}", "en") for i in range(3000)] + [(None, "all the same", "en")] * 3000 + [(7, f"zwei worte {i}", "de") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, real = [], langid.map_batches
    monkeypatch.setattr(langid, "map_batches", lambda df, fn, schema: seen.append(df.count()) or real(df, fn, schema))
    model = langid.fit(df, sample_per_lang=200)
    assert model.langs == ("de", "en") and seen[0] <= 500


# SimHash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """pairs: (doc_id, fingerprint); the smallest doc_id that links reach, by fingerprint."""
    ids = defaultdict(list)
    for i, f in pairs:
        ids[f].append(i)
    root = {f: f for f in ids}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(ids, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    least = defaultdict(list)
    for f in ids:
        least[find(f)] += [i for i in ids[f] if i is not None]
    return {f: min(least[find(f)], default=None) for f in ids}


def test_near_duplicates_match_all_pairs(documents):
    rows = [(r.doc_id, plain_fingerprint(r.text or "")) for r in documents.collect()]
    want = plain_components(rows)
    found = simhash.near_duplicates(documents).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted((i, f"{f:016x}", want[f]) for i, f in rows)


@pytest.mark.parametrize("most", [20_000, 40])
def test_links_connect_what_all_pairs_connect(spark, most):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12).astype(object)
    fps = {int(rng.integers(0, 2**63)) for _ in range(200)}
    for c in centres:  # chains and dense groups
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fps.add(x)
            c = x if rng.random() < 0.2 else c
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(df, 4, most)).collect()}
    want = plain_components([(x, x % 2**64) for x in signed])
    assert {x: found.get(x, x) for x in signed} == {x: want[x % 2**64] for x in signed}


def test_trees_find_all_within_the_radius_and_follow_only_its_edges():
    rng = np.random.default_rng(1)
    for words, radius in ((1, 3), (3, 7)):
        items = rng.integers(0, 1 << 63, (900, words)).astype(np.uint64)
        items[1::2] = items[::2] ^ (np.uint64(1) << rng.integers(0, 63, (450, words)).astype(np.uint64))
        shard = np.sort(rng.integers(0, 3, 900))
        forest = simhash.BKForest(items, shard)
        roots = np.array([forest.roots[s] for s in shard.tolist()])
        found = {(int(a), int(b)): int(d) for q, i, near in forest.search(items, roots, radius, most=500) for a, b, d in zip(q, i, near, strict=True)}
        want = {}
        for a in range(900):
            for b in np.flatnonzero(shard == shard[a]).tolist():
                d = sum(int(x ^ y).bit_count() for x, y in zip(items[a], items[b], strict=True))
                if d <= radius:
                    want[a, b] = d
        every = sum(int((shard == s).sum()) ** 2 for s in range(3))
        assert found == want and len(want) > 900 and forest.visited < 0.9 * every and forest.levels > 3


def test_hubs_are_joined_with_all_their_links(spark):
    hub = [(0, i) for i in range(1, 3000)] + [(i, i + 10_000) for i in range(1, 3000, 7)] + [(50_000, 50_001), (50_001, 50_002)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(hub, "a long, b long")).collect()}
    assert found == {**{x: 0 for e in hub[:-2] for x in e}, **dict.fromkeys((50_000, 50_001, 50_002), 50_000)}


def test_different_texts_with_one_id_stay(spark):
    near = " ".join(f"w{i}" for i in range(300))
    rows = [(7, "one text about a river", "x"), (7, "another thing altogether here", "y"), (7, "another thing altogether here", "z"), (None, "no id but words", "u"), (None, "no id either and others", "v"), (1, near, "a"), (2, near, "b"), (None, near, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((r.text, r.doc_id) for r in simhash.keep_representatives(docs).collect())
    assert [t for t, _ in kept] == sorted({t for _, t, _ in rows}) and (near, 1) in kept


def test_near_duplicates_odd_tables(odd_documents, no_documents):
    rows = [(r.doc_id, plain_fingerprint(r.text or "")) for r in odd_documents.collect()]
    want = plain_components(rows)
    found = simhash.near_duplicates(odd_documents).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=key) == sorted(((i, f"{f:016x}", want[f]) for i, f in rows), key=key)
    assert simhash.near_duplicates(no_documents).count() == 0
    kept = simhash.keep_representatives(odd_documents)
    assert kept.columns == odd_documents.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted(set(want.values()), key=str)
    assert {(r.doc_id, r.n_chars) for r in kept.collect()} == {(r.doc_id, r.n_chars) for r in simhash.keep_representatives(odd_documents.repartition(3)).collect()}
    nameless = simhash.keep_representatives(odd_documents.where("doc_id is null"))
    assert nameless.count() == 2


# Packing


def test_ids_equal_the_library(documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = [r.text or "" for r in documents.limit(60).collect()]
    texts += ["", "  \n", "x" * 60 + " yy", "don't x'street ''s 'RE we'Ll'd", "Ça l'Été — “q” ΣΑΣ İ é ﬁ", "²½ 日本語 123 <|endoftext|> a<|startoftext|>b", "🙂🙂 a​b\x1cc\x85d", "naïve café's ÿŸ ſK"]
    for most in (1_000_000, 10):
        own = packing.WordTokenizer(tokenizer_path(), most)
        for _ in range(2):
            assert [x.tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check_packed(rows, expected):
    """rows: pieces with ids; expected: the token lists of the documents that were packed, by doc_id."""
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        bins[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    padding = 0
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    for key, want in expected.items():
        assert sum(r.length for r in docs[key]) == sum(map(len, want))
        if len(want) == 1:
            got = sorted(docs[key], key=lambda r: r.start)
            assert [i for r in got for i in r.ids] == want[0] and {r.doc_tokens for r in got} == {len(want[0])}
    return padding / sum(r.length for r in rows)


def test_packing_round_trip(documents, odd_documents, no_documents):
    own = packing.tokenizer(tokenizer_path())
    for docs in (documents, odd_documents):
        expected = defaultdict(list)
        for r in docs.collect():
            expected[r.doc_id].append([*own.encode([r.text or ""])[0].tolist(), 2])
        assert check_packed(packing.pack_documents(docs, tokenizer_path(), with_ids=True).collect(), expected) < 0.02
    assert packing.pack_documents(no_documents, tokenizer_path()).count() == 0


def test_cuts_fit_their_class():
    for n in [*range(0, 5000), 12_288, 100_001]:
        sizes = packing.cuts(n)
        assert sum(sizes) == n and all(s > 0 and s * (4096 // s) <= 4096 for s in sizes)


# Mixing


def test_targets_share_all_words():
    for sizes in ([100, 100, 100], [10, 1000, 1000], [1, 1, 1000], [0, 5], [0, 0], [], [7]):
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        t = mixing.targets(sizes, weights)
        assert sum(t) == pytest.approx(sum(sizes)) and all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes, strict=True))


def test_quotas_are_exact():
    counts = [7, 0, 100, 3]
    q = mixing.split_quotas(counts, 6, 1)
    assert (q.sum(0) == counts).all() and np.ptp(q.sum(1)) <= 1 and (q == mixing.split_quotas(counts, 6, 1)).all()


def test_draws_follow_the_hypergeometric_distribution():
    from math import comb

    for own, others, take in ((7, 5, 4), (3, 40, 20), (1, 0, 1), (0, 5, 2), (60, 90, 30)):
        p = [comb(own, k) * comb(others, take - k) / comb(own + others, take) if 0 <= take - k <= others else 0.0 for k in range(own + 1)]
        for u in np.linspace(0.0005, 0.9995, 997):
            k = mixing.hypergeometric(own, others, take, float(u))
            assert sum(p[:k]) <= u + 1e-9 and u - 1e-9 <= sum(p[: k + 1])
    # At a size where the draw is long past a billion blocks it stays a draw: about the mean, and not the mean.
    far = [mixing.hypergeometric(3 * 10**10, 5 * 10**10, 4 * 10**10, mixing.uniform(str(i))) - 15 * 10**9 for i in range(60)]
    sd = (4e10 * 3 / 8 * 5 / 8 * 0.5) ** 0.5
    assert len(set(far)) == 60 and abs(sum(far)) / 60 < sd and 0.5 * sd < np.std(far) < 1.6 * sd


def test_shards_get_their_quotas_of_blocks(documents):
    """What the tree deals, counted from the rows: each shard's blocks of each source are split_quotas', in the order of the permutation."""
    rows = mixing.mix_sources(documents).collect()
    by = defaultdict(set)
    for r in rows:
        for copy, shard in enumerate(r.shards):
            by[r.source, copy, r.block].add(shard)
    assert all(len(x) == 1 for x in by.values()) and len({s for x in by.values() for s in x}) == 16
    sources = sorted({r.source for r in rows}, key=lambda x: (x is None, x or ""))
    blocks = {s: sorted({r.block for r in rows if r.source == s}) for s in sources}
    passes = {s: [divmod(int(r.target + 0.5), r.source_size) for r in rows if r.source == s][0] for s in sources}
    quotas = mixing.split_quotas([len(blocks[s]) * (passes[s][0] + (passes[s][1] > 0)) for s in sources], 16, 0)
    for i, s in enumerate(sources):
        until = np.cumsum(quotas[:, i])
        for (source, copy, block), shards in by.items():
            if source == s:
                place = copy * len(blocks[s]) + blocks[s].index(block)
                assert shards == {int((until <= place).sum())}


def test_mix_takes_the_targets(documents, odd_documents, no_documents):
    for docs in (documents, odd_documents):
        rows = mixing.mix_sources(docs).collect()
        assert len(rows) == docs.count()
        by = defaultdict(list)
        for r in rows:
            by[r.source].append(r)
            assert 0 <= r.taken <= 3 * r["size"] and (not r.shards) == (r.taken == 0) and len(r.orders) == len(r.shards) <= 3
        for own in by.values():
            assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=0.51)
            assert sum(r["size"] for r in own) == own[0].source_size
    assert mixing.mix_sources(no_documents).count() == 0
    mixed = mixing.mixed_documents(odd_documents)
    assert mixed.columns == odd_documents.columns and mixed.count() > 0


def test_mix_deals_copies_to_the_tree_s_shards_and_parts_them(documents):
    sized = {r.doc_id: r for r in mixing.mix_sources(documents).collect()}
    rows = mixing.dealt_documents(documents).select("doc_id", "__copy", "__shard", "__order").collect()
    assert [(r["__shard"], r["__order"]) for r in rows] == sorted((r["__shard"], r["__order"]) for r in rows)
    assert len({r["__shard"] for r in rows}) > 4 and len({(r.doc_id, r["__copy"]) for r in rows}) == len(rows)
    for r in rows:
        own = sized[r.doc_id]
        assert r["__shard"] == own.shards[r["__copy"]] and r["__order"] == own.orders[r["__copy"]] and own.shards == sorted(own.shards)
    want = {i: (2 * r.taken + r["size"]) // (2 * r["size"]) for i, r in sized.items() if r["size"]}
    times = defaultdict(int)
    for r in rows:
        times[r.doc_id] += 1
    assert dict(times) == {i: n for i, n in want.items() if n}
    # With one shard copies of one document could lie side by side; the order's hash parts nearly all.
    order = [r.doc_id for r in mixing.mixed_documents(documents, shards=1).select("doc_id").collect()]
    beside = sum(a == b for a, b in zip(order, order[1:], strict=False))
    assert max(times.values()) > 1 and beside <= 0.05 * len(order)


# Line dedup


def plain_runs(rows, min_lines=2, min_words=10):
    """Texts without the lines that the longest earlier match at any line covers; rows: distinct (doc_id, text, order)."""
    docs = []
    for i, t, order in rows:
        lines = t.split("\n")
        docs.append(((i is None, i or 0, order), i, t, lines, [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]))
    docs.sort(key=lambda d: d[0])
    out = {}
    for n, (_, i, t, lines, solid) in enumerate(docs):
        gone = set()
        for p in range(len(solid)):
            best = 0
            for m in range(n + 1):
                other, own = docs[m][3], docs[m][4]
                for q in range(len(own) if m < n else p):
                    k = 0
                    while p + k < len(solid) and q + k < len(own) and lines[solid[p + k]] == other[own[q + k]]:
                        k += 1
                    best = max(best, k)
            if best >= min_lines:
                gone |= set(range(solid[p], solid[p + best - 1] + 1))
            elif best and len(lines[solid[p]].split()) >= min_words:
                gone.add(solid[p])
        out[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)
    return out


def test_line_runs_match_the_definition(spark):
    rng = np.random.default_rng(5)
    lines = ["a b", "c", "", "one two three four five six seven eight nine ten", "d e f", " ", "g"]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(0, 9)))) for i in range(60)]
    rows += [(100, "\n".join(f"row {i}" for i in range(40))), (101, "x\n" + "\n".join(f"row {i}" for i in range(3, 37)) + "\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_runs([(i, t, 0) for i, t in rows])
    for r in line_dedup.dedup_lines(df).collect():
        assert (r.text, r.n_removed) == want[r.doc_id, dict(rows)[r.doc_id]] and (r.n_runs > 0) == (r.n_removed > 0)
    for least in (1, 3, 6):
        want = plain_runs([(i, t, 0) for i, t in rows], min_lines=least)
        for r in line_dedup.dedup_lines(df, min_lines=least).collect():
            assert (r.text, r.n_removed) == want[r.doc_id, dict(rows)[r.doc_id]]


def test_ranks_are_those_of_the_sorted_suffixes(spark):
    """Each round's ranks put the suffixes in the order of their first h line ids, and an interval's depth is what its suffixes share."""
    rng = np.random.default_rng(8)
    rows = [(i, "\n".join(rng.choice(["p", "q", "r"], 12))) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    suffixes = line_dedup.line_suffixes(df, 10)
    ids = {(r.doc_id, r.nth): (r.k1, r.k2) for r in suffixes.collect()}
    level, h = line_dedup._ranked(suffixes), 1
    for _ in range(3):
        found = {(r.doc_id, r.nth): r.rank for r in level.collect()}
        prefix = {s: tuple(ids[s[0], s[1] + k] for k in range(h)) for s in ids if s[1] + h <= 12}
        times = defaultdict(int)
        for x in prefix.values():
            times[x] += 1
        assert found.keys() == {s for s, x in prefix.items() if times[x] > 1}
        order = sorted(found, key=lambda s: prefix[s])
        for a, b in zip(order, order[1:], strict=False):
            assert (found[a] == found[b]) == (prefix[a] == prefix[b]) and found[a] <= found[b]
        level, h = line_dedup._ranked(line_dedup._ahead(level, h)), 2 * h


def test_depth_comes_from_the_doubling(spark):
    line = lambda n: "\n".join(f"row {i}" for i in range(n))
    rows = [(0, line(40)), (1, "x\n" + line(39) + "\ny"), (2, "row 3\nrow 4\nz"), (3, "a\nb")]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i].depth for i in range(4)] == [0, 32, 2, 0] and [found[i].n_runs for i in range(4)] == [0, 1, 1, 0]


def test_line_runs_of_hot_classes(spark):
    n = 2500  # over the least size of a hot class
    rows = [(i, f"before {i}\nhot line\nhot next\n\nafter {i // 2}") for i in range(n)]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0].text == rows[0][1] and len(found) == n
    for i in range(1, n):
        # Odd documents also share the last line with the one before, which lengthens the run to it over the blank line.
        assert found[i].text == (f"before {i}" if i % 2 else f"before {i}\n\nafter {i // 2}")


def test_line_runs_odd_tables(odd_documents, no_documents):
    found = line_dedup.dedup_lines(odd_documents)
    by = defaultdict(list)
    for r in found.collect():
        by[r.doc_id].append(r)
    assert sum(map(len, by.values())) == odd_documents.count()
    assert [r.n_removed for r in by[1]] == [0, 0] and by[8][0].n_removed == 3000 and by[8][0].text == "" and by[4][0].n_removed == 0
    assert by[2][0].text == "" and by[2][0].n_lines == 1
    assert line_dedup.dedup_lines(no_documents).count() == 0
    kept = line_dedup.without_repeated_lines(odd_documents)
    assert kept.columns == odd_documents.columns and 8 not in {r.doc_id for r in kept.collect()}


def test_no_python_in_line_dedup(documents):
    plan = line_dedup.dedup_lines(documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_runs_have_a_line(documents):
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(documents, min_lines=0)


def test_line_dedup_of_long_texts_is_linear(spark):
    text = "\n".join(f"line {i % 7000}" for i in range(30_000))
    r = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_lines == 30_000 and r.n_removed == 23_000 and r.text == "\n".join(f"line {i}" for i in range(7000))


