"""Packing by lexical retrieval.

The statistics of BM25 (document frequencies, number and average length of documents) are
those of all documents. These are sorted by their heaviest terms, wherever they were read,
and cut into shards in that order. A shard's inverted index holds the weights; each seed
document fills whole windows by itself, and its rest is followed by unused neighbours in
the order of their score until the window is full. The last neighbour is cut there, and its
rest is the next seed. Where no unused document of the shard shares a term with the seed,
the next document in the order becomes the seed of the open window.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONG_WORD, ByteBPE, tokenizer_path
from .common import SLICE, materialise, once_per_worker, runs

FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words of Latin letters up to U+017F (but U+0130, whose lower case is two characters), with marks after that are never part of a contraction or a special token.
MARKS = "!#$%&()*+,./:;=?@^_~-"
PLAIN = f"^[A-Za-zªµºÀ-ÖØ-öø-įı-ſ]+[{re.escape(MARKS)}]*$"


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of each, one after another."""
    ends = np.cumsum(size)
    return pool[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class HashedBPE(ByteBPE):
    """ByteBPE that finds a pair's rank by one probe of a hash table; places that several pairs share are left to the binary search."""

    BITS, FACTOR = 19, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        super().__init__(path)
        place = self.place(self.keys)
        self.held, self.rank_at = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, np.int64)
        self.held[place], self.rank_at[place] = self.keys, self.ranks
        self.shared = np.bincount(place, minlength=1 << self.BITS) > 1

    def place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * self.FACTOR >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        place = self.place(key)
        own = self.held[place] == key
        rank = np.where(own, self.rank_at[place], len(self.keys))
        unsure = np.flatnonzero(self.shared[place] & ~own)
        rank[unsure] = super().rank(left[unsure], right[unsure])
        return rank


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class WordIds:
    """The ids that the tokenizers library gives texts, found once for each distinct white-space separated word.

    A run of Latin letters is one token run in that library, which the batched merge rounds of ByteBPE
    turn into the same ids with the same file; words of anything else go to the library itself. Up to
    `remember` words are kept from text to text.
    """

    def __init__(self, path: str, remember: int = 600_000):
        from tokenizers import Tokenizer

        self.merges = HashedBPE(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each text, by the library."""
        ids = [np.array(e.ids, np.uint32) for k in range(0, len(texts), 20_000) for e in self.tokenizer.encode_batch_fast(texts[k : k + 20_000], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(i) for i in ids], np.int64)

    def merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for words of lower-case letters, or of marks; very long words apart."""
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(size) and size.max() > LONG_WORD:
            coded = [w.encode() for w in words.to_pylist()]
            ids = [np.frombuffer(c, "<u4") for c in self.merges.merge([c.decode() for c in coded])]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(i) for i in ids], np.int64)
        _, ends, data = words.buffers()
        ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1]
        flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
        ids, counts = self.merges.merge_flat(flat, size)
        return ids.astype(np.uint32), counts

    def learn(self, words: pa.Array) -> np.ndarray:
        """The slots of words, which are not known yet and get the next ones."""
        plain = pc.match_substring_regex(words, PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        odd = words.filter(pc.invert(plain))
        words = words.filter(plain)
        low = pc.utf8_lower(words)
        ids, sizes = [], []
        for part in (pc.utf8_rtrim(low, characters=MARKS), pc.replace_substring_regex(low, pattern="^[A-Za-zªµºÀ-ÖØ-öø-ſ]+", replacement="")):
            coded = part.dictionary_encode()
            own, n = self.merged(coded.dictionary)
            which = coded.indices.to_numpy()
            ids.append(own)
            sizes.append((_offsets(n)[which], n[which]))
        (at, n), (tail_at, tail_n) = sizes
        both = gathered(np.concatenate(ids), np.stack([at, tail_at + len(ids[0])], 1).ravel(), np.stack([n, tail_n], 1).ravel())
        more, more_n = self.library(odd.to_pylist())
        slots = np.empty(len(is_plain), np.int64)
        slots[is_plain] = len(self.words) + np.arange(len(words))
        slots[~is_plain] = len(self.words) + len(words) + np.arange(len(odd))
        self.words = pa.concat_arrays([self.words, words, odd])
        self.ids = np.concatenate([self.ids, both, more])
        self.size = np.concatenate([self.size, n + tail_n, more_n])
        self.start = _offsets(self.size)
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        listed = pc.ascii_split_whitespace(texts)
        words = listed.flatten().dictionary_encode()
        if len(self.words) > self.remember:
            self.forget()
        known = pc.index_in(words.dictionary, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            known[fresh] = self.learn(words.dictionary.take(pa.array(fresh)))
        slot = known[words.indices.to_numpy()]
        size = self.size[slot]
        ends = np.concatenate([[0], np.cumsum(size)])
        per_text = np.concatenate([[0], np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False))])
        return gathered(self.ids, self.start[slot], size), np.diff(ends[per_text])


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int, kind: str) -> pa.Array:
    """The ids of each text and an end id as binary values of numbers of that kind."""
    flat = np.full(len(ids) + len(counts), end_id, kind)
    keep = np.ones(len(flat), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    flat[keep] = ids
    ends = flat.itemsize * np.concatenate([[0], np.cumsum(counts + 1)])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def tallied(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms, ascending, and how often each comes."""
    ids = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.diff(np.append(first, len(ids)))


#: Bytes of text that are encoded at a time, or else a single text.
ENCODED_BYTES = 4_000_000


#: Names of the number of documents and of all their ids, among the terms.
STATISTICS = (-2, -1)


class Corpus:
    """What BM25 must know of all documents: the document frequency of each term (df, by id), their number and average length."""

    def __init__(self, df: np.ndarray, n: int, average: float, k1: float = 1.2, b: float = 0.75):
        self.df, self.n, self.average, self.k1, self.b = df, n, max(1.0, average), k1, b
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def weight(self, terms: np.ndarray, tf: np.ndarray, size) -> np.ndarray:
        return self.idf[terms] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * size / self.average))

    def heaviest(self, docs: list[np.ndarray], n: int) -> list[np.ndarray]:
        """The n terms of greatest weight that another document has too, of every document (the first of them, the second and so on); -1 where there are fewer."""
        doc, terms, tf = flat_tallies(docs)
        shared = self.df[terms] > 1
        doc, terms, tf = doc[shared], terms[shared], tf[shared]
        weight = self.weight(terms, tf, np.array([len(d) for d in docs])[doc])
        out = []
        for _ in range(n):
            top = np.full(len(docs), -1)
            if len(doc):
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                most = np.repeat(np.maximum.reduceat(weight, first), np.diff(np.append(first, len(doc))))
                at = np.flatnonzero(weight == most)[::-1]
                top[doc[at]] = terms[at]  # of equal weights the least term, which is written last
                weight[terms == top[doc]] = -1.0
                top[doc[first][np.maximum.reduceat(weight, first) < -1.0]] = -1
                left = weight >= 0
                doc, terms, weight = doc[left], terms[left], weight[left]
            out.append(top)
        return out


def flat_tallies(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and how often it comes there, by document and term."""
    key = np.repeat(np.arange(len(docs), dtype=np.int64), [len(d) for d in docs]) << 32
    key |= np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(np.append(first, len(key)))


def statistics(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Terms with their document frequencies, and under STATISTICS the number of documents and of ids in all."""
    df = np.bincount(flat_tallies(docs)[1], minlength=1)
    terms = np.flatnonzero(df)
    return np.append(terms, STATISTICS), np.append(df[terms], [len(docs), sum(map(len, docs))])


def corpus_of(coded: DataFrame) -> Corpus:
    """The statistics of all rows of coded: the sums of those that were written beside the documents; the driver gets one row for each term of the vocabulary."""

    def run(batches):
        sums: Counter[int] = Counter()
        for batch in batches:
            for packed in batch.column("ids").to_pylist():
                terms, n = np.frombuffer(packed, "<i8").reshape(2, -1).tolist()
                sums.update(dict(zip(terms, n)))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["term", "n"])

    sums = {r.term: r.n for r in coded.where("row < 0").select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, size = (sums.pop(k, 0) for k in STATISTICS)
    df = np.zeros(1 + max(sums, default=0), np.int64)
    df[list(sums)] = list(sums.values())
    return Corpus(df, n, size / max(1, n))


class Bm25Shard:
    """An inverted index over the documents of a shard: postings by term with their BM25 weights, by the statistics of corpus (else of the shard)."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        if corpus is None:
            terms, n = statistics(docs)
            corpus = Corpus(np.bincount(terms[:-2], n[:-2], 1 + max(terms)), n[-2], n[-1] / max(1, n[-2]))
        pairs = [tallied(d) for d in docs]
        self.terms = [p[0] for p in pairs]
        term = np.concatenate([p[0] for p in pairs]).astype(np.int64)
        tf = np.concatenate([p[1] for p in pairs]).astype(float)
        doc = np.repeat(np.arange(len(docs)), [len(p[0]) for p in pairs])
        size = np.array([len(d) for d in docs], float)
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        self.vocabulary, start, df = np.unique(term[order], return_index=True, return_counts=True)
        self.start, self.df = start, df
        self.weight = corpus.weight(term[order], tf[order], size[self.doc]).astype(np.float32)
        self.n = len(docs)
        # Terms of an eighth of the documents or more are rows of a matrix: adding those is cheaper than their postings.
        common = np.flatnonzero(8 * df >= self.n) if self.n >= 64 else np.zeros(0, np.int64)
        self.row = np.full(len(self.vocabulary), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        at = np.repeat(start[common] - (np.cumsum(df[common]) - df[common]), df[common]) + np.arange(int(df[common].sum()))
        self.dense[np.repeat(np.arange(len(common)), df[common]), self.doc[at]] = self.weight[at]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.vocabulary, terms)
        row = self.row[k]
        k = k[row < 0]
        size = self.df[k]
        ends = np.cumsum(size)
        at = np.repeat(self.start[k] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.bincount(self.doc[at], self.weight[at], self.n) + self.dense[row[row >= 0]].sum(0)


class Packer:
    """Fills windows of `window` ids from shards, one after another; the open window goes on in the next shard."""

    def __init__(self, window: int, first_sequence: int, corpus: Corpus | None = None):
        self.window, self.sequence, self.used, self.corpus = window, first_sequence, 0, corpus
        self.open: list[tuple[int, int, np.ndarray, int]] = []  # doc, start, ids, ids of the whole document

    def put(self, doc: int, ids: np.ndarray, start: int, room: int, out: list) -> int:
        """Put up to `room` ids of a document from `start` on; where the next ones start."""
        total = len(ids)
        end = min(total, start + room)
        self.open.append((doc, start, ids[start:end], total))
        self.used += end - start
        if self.used == self.window:
            self.close(out, [self.window])
        return end

    def close(self, out: list, sizes: list[int]) -> None:
        """Write the open pieces as sequences of these sizes."""
        offset, k = 0, 0
        for doc, start, ids, total in self.open:
            at = 0
            while at < len(ids):
                n = min(len(ids) - at, sizes[k] - offset)
                out.append((doc, start + at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), total, self.sequence, offset))
                at, offset = at + n, offset + n
                if offset == sizes[k]:
                    self.sequence, offset, k = self.sequence + 1, 0, k + 1
        self.open, self.used = [], 0

    def shard(self, docs: list[tuple[int, np.ndarray]], out: list) -> None:
        index = Bm25Shard([ids[:-1] for _, ids in docs], self.corpus)
        unused = np.ones(len(docs), bool)
        seed = 0
        while unused.any():
            while not unused[seed]:
                seed += 1
            now, start = seed, 0
            while now is not None:
                unused[now] = False
                doc, ids = docs[now]
                size = len(ids)
                while size - start >= self.window - self.used or start < size and not unused.any():
                    start = self.put(doc, ids, start, self.window - self.used, out)
                    if start == size:
                        break
                now, start = self.fill(docs, index, unused, now, start, out) if start < size else (None, 0)

    def fill(self, docs, index, unused, seed, start, out):
        """Put the rest of seed, then its best unused neighbours that share a term with it; the document that is cut and where, or (None, 0)."""
        doc, ids = docs[seed]
        self.put(doc, ids, start, self.window, out)
        score = index.scores(index.terms[seed])
        left = np.flatnonzero(unused & (score > 0))
        for k in left[np.argsort(-score[left], kind="stable")]:
            doc, ids = docs[k]
            unused[k] = False
            end = self.put(doc, ids, 0, self.window - self.used, out)
            if not self.open:
                return (int(k), end) if end < len(ids) else (None, 0)
        return None, 0

    def add(self, doc: int, start: int, ids: np.ndarray, total: int, out: list) -> None:
        """Put ids of a document, from `start` on, into this window and the next ones."""
        while len(ids):
            part, ids = np.split(ids, [self.window - self.used])
            self.open.append((doc, start, part, total))
            start += len(part)
            self.used += len(part)
            if self.used == self.window:
                self.close(out, [self.window])

    def finish(self, out: list) -> None:
        """The last, unfilled window becomes sequences whose sizes are powers of two, which need no padding."""
        self.close(out, [1 << k for k in range(self.used.bit_length() - 1, -1, -1) if self.used >> k & 1])


#: Shards of a range; ranges beyond which they get longer instead of more, and the ids that one may have.
RANGE_SHARDS, RANGES, RANGE_IDS = 2, 20_000, 128_000_000
#: Ranges whose last, unfilled windows are put together by one task.
TAILS = 2048


def ranges_of(documents: int, ids: float, shard_docs: int) -> int:
    """How many ranges documents are dealt into: by their number alone, whatever the cluster's settings."""
    return max(1, min(RANGES, -(-documents // (RANGE_SHARDS * shard_docs))), -(-int(ids) // RANGE_IDS))


def names_of(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def pieces(rows: list[tuple], ids: list[bytes] | None = None) -> pa.RecordBatch:
    """Rows of FIELDS, with the ids of those that wait for a sequence."""
    columns = list(zip(*rows)) or [()] * len(names_of(FIELDS))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(ids or [None] * len(rows), pa.binary())], names=[*names_of(FIELDS), "ids"])


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1


def pack(docs: DataFrame, window: int = 4096, end_id: int = 2, shard_docs: int = 2048, shard_ids: int = 8_000_000, path: str | None = None) -> DataFrame:
    """One row for each piece of each document: where it lies in its document and in its sequence.

    Null texts are empty documents, which hold only the end id; repeated rows are packed each. All
    documents are encoded once into the shared folder, and dealt by ranges of their three heaviest terms
    (and their own number, so a common key is no large task). Shards are up to shard_docs documents
    and about shard_ids ids that follow each other in a range, so no task holds more than a shard and a
    batch. The ranges follow from the number of documents, so that the session's settings don't change
    what meets; their bounds are drawn keys, 8 to 64 for each. The last, unfilled windows of TAILS ranges
    are put together; only what is left of these, in powers of two, is shorter than the window: there is
    no padding. Documents of equal weight for a seed follow in the order of their range; columns but
    doc_id and text aren't read; an empty table has no pieces; a text of any length is cut as often as
    need be.
    """

    kind = "<u2" if max(vocabulary_size(path or tokenizer_path("word_bpe_49k.json")), end_id + 1) <= 1 << 16 else "<u4"

    def encode(batches):
        words = once_per_worker(("word_bpe", path), lambda: WordIds(path or tokenizer_path("word_bpe_49k.json")))
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column("text").fill_null("")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for a, b in runs(sizes, ENCODED_BYTES):
                ids, counts = words.encode(texts.slice(a, b - a))
                coded = with_end(ids, counts, end_id, kind)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(range(row + a, row + b), pa.int64()), coded], names=names)
                # A row of statistics, for these documents; it has no document's number.
                about = np.stack(statistics(np.split(ids, np.cumsum(counts)[:-1]))).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1]), pa.array([about], pa.binary())], names=names)
            row += len(texts)

    names = ["doc_id", "row", "ids"]
    coded = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, row long, ids binary"), "ids")
    corpus = corpus_of(coded)
    coded = coded.where("row >= 0")
    parts = ranges_of(corpus.n, corpus.n * corpus.average, shard_docs)
    per_range = min(64, max(8, 640_000 // parts))

    def keyed(batches, bounds):
        for batch in batches:
            ids = [np.frombuffer(c, kind)[:-1] for c in batch.column("ids").to_pylist()]
            tops = [k for a, b in runs([len(i) for i in ids], SLICE) for k in zip(*[t.tolist() for t in corpus.heaviest(ids[a:b], 3)])]
            keys = [(*t, row) for t, row in zip(tops, batch.column("row").to_pylist())]
            part = [bisect_right(bounds, k) for k in keys]
            columns = list(zip(*keys)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(part, pa.int32())], names=[*names, "k1", "k2", "k3", "part"])

    with_keys = "doc_id long, row long, ids binary, k1 long, k2 long, k3 long, part int"
    drawn = coded.sample(min(1.0, per_range * parts / max(1, corpus.n)), 1).mapInArrow(lambda b: keyed(b, []), with_keys).select("k1", "k2", "k3", "row").limit(4 * per_range * parts).collect()
    drawn = sorted(map(tuple, drawn))
    alike = Counter(d[:3] for d in drawn)
    bounds = [drawn[len(drawn) * k // parts] for k in range(1, parts)] if drawn else []
    bounds = [b if alike[b[:3]] > per_range else (*b[:3], -1) for b in bounds]  # documents of equal terms stay together, unless they are more than a range

    def run(batches):
        packer = Packer(window, TaskContext.get().partitionId() << 36, corpus)
        shard: list[tuple[int, np.ndarray]] = []
        held = 0

        for batch in batches:
            out: list = []
            for doc in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                shard.append((doc[0], np.frombuffer(doc[1], kind)))
                held += len(shard[-1][1])
                if len(shard) >= shard_docs or held >= shard_ids:
                    packer.shard(shard, out)
                    shard, held = [], 0
            yield pieces(out)
        out = []
        if shard:
            packer.shard(shard, out)
        yield pieces(out)
        tail = [(doc, start, len(ids), 0, total, packer.sequence, k) for k, (doc, start, ids, total) in enumerate(packer.open)]
        yield pieces(tail, [ids.astype("<u4").tobytes() for _, _, ids, _ in packer.open])

    def join_tails(batches):
        packer = Packer(window, (1 << 62) + (TaskContext.get().partitionId() << 36))
        for batch in batches:
            out: list = []
            for doc, start, total, ids in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")]):
                packer.add(doc, start, np.frombuffer(ids, "<u4"), total, out)
            yield pieces(out).select(names_of(FIELDS))
        out = []
        packer.finish(out)
        yield pieces(out).select(names_of(FIELDS))

    dealt = coded.mapInArrow(lambda b: keyed(b, bounds), with_keys).repartitionById(parts, "part").sortWithinPartitions("k1", "k2", "k3", "row")
    packed = materialise(dealt.select("doc_id", "ids").mapInArrow(run, FIELDS + ", ids binary"), "packed")
    tails = packed.where("ids is not null").withColumn("group", F.floor(F.col("sequence_id") / (TAILS << 36)).cast("int"))
    tails = tails.repartitionById(-(-parts // TAILS), "group").sortWithinPartitions("sequence_id", "offset").select("doc_id", "start", "doc_tokens", "ids")
    return packed.where("ids is null").drop("ids").unionByName(tails.mapInArrow(join_tails, FIELDS))
