"""Harmonic packing of token sequences.

A length in (capacity/(j+1), capacity/j] is of class j, and a bin of class j takes
j pieces, whatever other workers do. Documents are cut so that little is lost:
whole bins first; a remainder over `tail` gives pieces of the largest exact class
sizes; what is left, at most `tail` tokens, goes to its own class. A worker that
has read its rows joins the pieces of its unfilled bins and cuts them at the
capacity; the last of these sequences is cut into powers of two, which need no
padding.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fluxbar.llm.common import give_back, id_and_text, pieces, struct

CAPACITY = 4096
#: The word pattern and the white space of the tokenizer's pre-tokenization.
SPACES = r"\t-\r \x85\xa0  -     　"
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"


def _latin_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each Latin-1 character: 0 space, 1 letter, 2 number, 3 other; and its lower case."""
    chars = [chr(i) for i in range(256)]
    kind = [0 if c in "\t\n\x0b\x0c\r \x85\xa0" else {"L": 1, "N": 2}.get(unicodedata.category(c)[0], 3) for c in chars]
    return np.array(kind, np.uint8), np.array([ord(c.lower()) for c in chars], np.uint8)


LATIN_KIND, LATIN_LOWER = _latin_tables()


def latin_words(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The pre-tokens of Latin-1 texts, in Latin-1 and lower case, and how many each text has."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    c = LATIN_LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    kind = LATIN_KIND[c]
    start = (kind > 0) & ((kind == 2) | (kind != np.concatenate([[0], kind[:-1]])))
    # An apostrophe that is a run by itself takes the ending after it along.
    quote = np.flatnonzero(start & (c == 39))
    for ending in (x.strip("'").encode() for x in SUFFIXES.split("|")):
        hit = quote[quote + len(ending) < len(c)]
        for k, x in enumerate(ending):
            hit = hit[c[hit + 1 + k] == x]
        start[hit + 1] = False
        rest = hit + 1 + len(ending)
        rest = rest[rest < len(c)]
        start[rest[kind[rest] == 1]] = True
    solid = kind > 0
    place = np.cumsum(solid) - 1
    at = np.flatnonzero(start)
    offsets = np.concatenate([place[at], [int(solid.sum())]]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(c[solid])])
    return words, np.diff(np.searchsorted(at, np.concatenate([[0], np.cumsum(size)])))


class Merges:
    """Byte-pair merges of many words at once: in each round every word merges its pair of least rank, the leftmost if several."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves; the others follow from 256 on
        shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*plain}))}
        self._byte = np.array([[vocab[shown[b]], vocab[shown[b] + "</w>"]] for b in range(256)], np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self._made = np.array([vocab[a + b] for a, b in pairs] + [0], np.int64)
        self.none = len(pairs)
        self._bits = max(8, (4 * len(pairs)).bit_length())  # a quarter full at most
        self._key, self._rank = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, self.none, np.int32)
        left, probe = np.arange(len(pairs)), 0
        while len(left):
            slot = self._slot(keys[left], probe)
            free = self._key[slot] < 0
            self._key[slot[free]] = keys[left[free]]
            won = free & (self._key[slot] == keys[left])
            self._rank[slot[won]] = left[won]
            left, probe = left[~won], probe + 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self._bits)) + np.uint64(probe)).astype(np.int64) & ((1 << self._bits) - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, `none` if it isn't merged."""
        keys = a.astype(np.int64) << 20 | b
        slot = self._slot(keys, 0)
        found, out = self._key[slot], self._rank[slot]
        out[found != keys] = self.none
        left, probe = np.flatnonzero((found != keys) & (found >= 0)), 1
        while len(left):
            slot = self._slot(keys[left], probe)
            hit = self._key[slot] == keys[left]
            out[left[hit]] = self._rank[slot[hit]]
            left, probe = left[~hit & (self._key[slot] >= 0)], probe + 1
        return out

    def apply(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has. data: the words' bytes; no word is empty."""
        width, n = int(size.max()), len(size)
        size = size.copy()
        raw = data[np.minimum(start[:, None] + np.arange(width), len(data) - 1)]
        sym = self._byte[raw, 0].astype(np.int32)
        sym[np.arange(n), size - 1] = self._byte[raw[np.arange(n), size - 1], 1]
        col = np.arange(width)
        rank = np.full((n, width), self.none, np.int32)
        r, c = np.nonzero(col[None, :] < size[:, None] - 1)
        rank[r, c] = self.rank(sym[r, c], sym[r, c + 1])
        out, live, left = np.zeros((n, width), np.int32), np.arange(n), size.copy()
        while True:
            at = rank.argmin(1)
            row = np.arange(len(live))
            best = rank[row, at]
            done = best == self.none
            if done.any():
                out[live[done], : sym.shape[1]] = sym[done]
                size[live[done]] = left[done]
                keep = ~done
                live, left, sym, rank, at, best = live[keep], left[keep], sym[keep], rank[keep], at[keep], best[keep]
                if not len(live):
                    break
                row = np.arange(len(live))
            # The pair becomes one symbol; what follows moves up a place.
            sym[row, at] = self._made[best]
            move = np.minimum(col[None, : sym.shape[1]] + (col[None, : sym.shape[1]] > at[:, None]), sym.shape[1] - 1)
            sym, rank = np.take_along_axis(sym, move, 1), np.take_along_axis(rank, move, 1)
            left = left - 1
            has = np.flatnonzero(at < left - 1)
            rank[row, at] = self.none
            rank[has, at[has]] = self.rank(sym[has, at[has]], sym[has, at[has] + 1])
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self.rank(sym[has, at[has] - 1], sym[has, at[has]])
            rank[row, left - 1] = self.none
            if left.max() < sym.shape[1]:
                sym, rank = sym[:, : left.max()], rank[:, : left.max()]
        return out[col[None, :] < size[:, None]].astype(np.uint32), size


class WordTokenizer:
    """Token ids of texts by a word-level BPE file.

    The file's normalizer and word split are applied to whole texts: by Arrow to
    those within Latin-1, else by the regex library. A batch's distinct words are
    looked up in a table that keeps the first `most` ever met; the merges of others
    are found many words at a time. Words over 48 bytes and texts with special
    tokens go to the library's own encoder.
    """

    def __init__(self, path: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path)
        self._merges = Merges(path)
        self._word = regex.compile(rf"{SUFFIXES}|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
        self._special = [t.content for t in self._own.get_added_tokens_decoder().values()]
        self._most, self._at = most, {}
        self._ids, self._start, self._len = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self._own.encode(text, add_special_tokens=False).ids, np.uint32)

    def _split(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        return self._word.findall("".join(c.lower() for c in text) if "Σ" in text else text.lower())

    def _work_out(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in order, and how many each has."""
        words = pa.concat_arrays([words])  # offsets from 0
        offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).astype(np.int64)
        data, size = np.frombuffer(words.buffers()[2], np.uint8), np.diff(offsets)
        order = np.argsort(size, kind="stable")
        short = order[: np.searchsorted(size[order], 48, "right")]
        ids, count = [], np.zeros(len(words), np.int64)
        for a in range(0, len(short), 4000):
            at = short[a : a + 4000]
            got, count[at] = self._merges.apply(data, offsets[at], size[at])
            ids.append(got)
        for i in order[len(short) :]:
            ids.append(self._library(words[int(i)].as_py().decode()))
            count[i] = len(ids[-1])
        # From the order of lengths back to that of the words.
        start = np.zeros(len(words), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        return _gather(np.concatenate(ids), start, count), count

    def _encode(self, words: pa.BinaryArray, counts: np.ndarray, latin: bool) -> list[np.ndarray]:
        """Ids of each text. counts: how many words each has; latin: the words are in Latin-1, not UTF-8."""
        coded = words.dictionary_encode()
        if not len(coded):
            return [np.zeros(0, np.uint32)] * len(counts)
        distinct = coded.dictionary.to_pylist()
        if latin:
            distinct = b"\n".join(distinct).decode("latin-1").encode().split(b"\n")
        at = np.fromiter(map(self._at.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = [distinct[i] for i in np.flatnonzero(at < 0)]
        ids, start, size = self._ids, self._start, self._len
        if len(new):
            got, count = self._work_out(pa.array(new, pa.binary()))
            start = np.concatenate([start, len(ids) + np.cumsum(count) - count])
            ids, size = np.concatenate([ids, got]), np.concatenate([size, count])
            at[at < 0] = len(self._at) + np.arange(len(new))
            if len(size) <= self._most:
                self._at.update(zip(new, range(len(self._at), len(size)), strict=True))
                self._ids, self._start, self._len = ids, start, size
        at = at[coded.indices.to_numpy()]
        count = np.concatenate([[0], np.cumsum(size[at])])
        cut = count[np.concatenate([[0], np.cumsum(counts)])]
        flat = _gather(ids, start[at], size[at])
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit numbers."""
        out: list[np.ndarray] = [None] * len(texts)
        latin, wide = {}, {}
        for i, text in enumerate(texts):
            if any(token in text for token in self._special):
                out[i] = self._library(text)
            else:
                try:
                    latin[i] = text.encode("latin-1")
                except UnicodeEncodeError:
                    wide[i] = self._split(text)
        if latin:
            words, counts = latin_words(list(latin.values()))
            for i, ids in zip(latin, self._encode(words, counts, True), strict=True):
                out[i] = ids
        if wide:
            words = pa.array([w.encode() for ws in wide.values() for w in ws], pa.binary())
            for i, ids in zip(wide, self._encode(words, np.array([len(ws) for ws in wide.values()]), False), strict=True):
                out[i] = ids
        return out


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after another."""
    ends = np.cumsum(size)
    return values[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each file and worker process, so that its table serves later tasks too."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cuts(length: int, capacity: int = CAPACITY, tail: int = 256) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest > tail:
        size = capacity // -(-capacity // rest)  # the largest exact class size that fits
        out.append(size)
        rest -= size
    return out + [rest] * (rest > 0)


class Packer:
    """One worker's open bins. Rows that come out: (doc_id, start, ids, doc_tokens, sequence number, offset)."""

    def __init__(self, capacity: int = CAPACITY, tail: int = 256):
        self.capacity, self.tail, self.sequences = capacity, tail, 0
        self.open: dict[int, list] = {}

    def _close(self, bin_):
        offset = 0
        for doc_id, start, ids, total in bin_:
            yield doc_id, start, ids, total, self.sequences, offset
            offset += len(ids)
        self.sequences += 1

    def add(self, doc_id, ids: np.ndarray):
        start = 0
        for size in cuts(len(ids), self.capacity, self.tail):
            bin_ = self.open.setdefault(kind := self.capacity // size, [])
            bin_.append((doc_id, start, ids[start : start + size].copy(), len(ids)))
            start += size
            if len(bin_) == kind:
                yield from self._close(self.open.pop(kind))

    def finish(self):
        """What the unfilled bins hold, joined, cut at the capacity, and at last at powers of two."""
        rest = [piece for kind in sorted(self.open) for piece in self.open[kind]]
        left = sum(len(p[2]) for p in rest)
        self.open, bin_ = {}, []
        room = want = self.capacity if left >= self.capacity else 1 << max(0, left.bit_length() - 1)
        for doc_id, start, ids, total in rest:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                bin_.append((doc_id, start, part, total))
                start, room = start + len(part), room - len(part)
                if not room:
                    yield from self._close(bin_)
                    left, bin_ = left - want, []
                    room = want = self.capacity if left >= self.capacity else 1 << max(0, left.bit_length() - 1)


SCHEMA = struct("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, tail: int = 256, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of docs; with_ids adds its token ids.

    A document is the ids of its whole text (null: empty) and end_id, so an empty
    one is a single id. Each partition packs alone and numbers its sequences from
    its own number times 2**32: nothing is shuffled, and a lost task is run again
    with the same result. A worker holds less than one bin of each class. A null
    doc_id stays null, repeated rows are packed each, other columns are ignored.
    """

    schema = struct("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>") if with_ids else SCHEMA

    def batch_of(rows) -> pa.RecordBatch:
        doc, start, ids, total, seq, offset = zip(*rows, strict=True) if rows else ((),) * 6
        cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
        cols += [pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
        if with_ids:
            cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches):
        own, packer, rows = tokenizer(tokenizer_path), Packer(capacity, tail), []
        packer.sequences = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            for part in pieces(batch, 2_000_000):
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist()), strict=True):
                    rows += packer.add(doc_id, np.append(ids, np.uint32(end_id)))
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
        yield batch_of(rows + list(packer.finish()))
        del rows, packer
        give_back()

    return id_and_text(docs).mapInArrow(run, schema)
