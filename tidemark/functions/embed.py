"""The hashing embedder, and vector similarity."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalise


def fnv_bucket(c: str | Column, dim: int = 512) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes modulo dim, a power of two: only the low bits of offset and prime matter."""
    low = dim - 1
    offset, prime = 0xCBF29CE484222325 & low, 0x100000001B3 & low
    text = F.col(c) if isinstance(c, str) else c
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(F.hex(F.encode(text, "utf-8")), 2 * i - 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.octet_length(text) == 0, F.lit(offset)).otherwise(F.aggregate(octets, F.lit(offset), lambda h, b: (h.bitwiseXOR(b) * F.lit(prime)).bitwiseAND(F.lit(low))))


OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def bucket_of(gram: str, dim: int) -> int:
    h = OFFSET
    for b in gram.encode():
        h = (h ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return h % dim


@dataclass(frozen=True)
class Features:
    """What is counted in a text: character n-grams of `grams[0]` to `grams[1]`, and with `words` its words of two or more characters, each `repeats` times."""

    grams: tuple[int, int] = (1, 3)
    words: bool = True
    repeats: int = 3

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, list[tuple[str, int]]]:
        """Start and length of the first of each distinct n-gram, how often it comes, and the words with their counts."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, counts = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
        for n in range(self.grams[0], min(self.grams[1], len(points)) + 1):
            rows = np.stack([points[k : len(points) - n + 1 + k] for k in range(n)], 1)
            _, first, count = np.unique(rows, axis=0, return_index=True, return_counts=True) if n > 3 else np.unique(self._packed(rows), return_index=True, return_counts=True)
            starts.append(np.stack([first, np.full(len(first), n)], 1))
            counts.append(count)
        words = Counter(w for w in re.findall("[a-z0-9]+", text) if len(w) >= 2) if self.words else {}
        return np.concatenate(starts), np.concatenate(counts), [(f"w:{w}", c * self.repeats) for w, c in words.items()]

    @staticmethod
    def _packed(rows: np.ndarray) -> np.ndarray:
        """Up to three code points, of 21 bits each, as one number."""
        key = np.zeros(len(rows), np.uint64)
        for column in rows.T:
            key = key << np.uint64(21) | column.astype(np.uint64)
        return key

    def names(self, text: str) -> list[str]:
        """The distinct features by name."""
        starts, _, words = self.of(text)
        return [*(text[a : a + n] for a, n in starts.tolist()), *(w for w, _ in words)]


def buckets(text: str, starts: np.ndarray, dim: int) -> np.ndarray:
    """bucket_of the n-grams of a text that start and are as long as given: all advance by a byte at a time."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    at, end = first[starts[:, 0]], first[starts.sum(1)]
    return (hashes(data, first[starts[:, 0]], first[starts.sum(1)]) % np.uint64(dim)).astype(np.int64)


def hashes(data: np.ndarray, at: np.ndarray, end: np.ndarray, begun: int = OFFSET) -> np.ndarray:
    """FNV-1a of the bytes of data from each `at` to its `end`, after those that led to the number `begun`."""
    h = np.full(len(at), begun, np.uint64)
    left = np.flatnonzero(at < end)
    at = at[left]
    while len(left):
        h[left] = (h[left] ^ data[at].astype(np.uint64)) * np.uint64(PRIME)
        more = at + 1 < end[left]
        at, left = at[more] + 1, left[more]
    return h


@dataclass(frozen=True)
class Idf:
    """Inverse document frequencies by feature name; unseen is that of a feature which no document has."""

    known: dict[str, float]
    unseen: float


#: Characters and texts that are embedded at a time.
SLICE_CHARS, SLICE_TEXTS = 200_000, 1_024


#: The hash of what is before a word in its feature's name.
_BEFORE_WORD = bucket_of("w:", 1 << 64)
#: Which bytes are letters or digits of a word.
_WORD = np.array([chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" for b in range(256)])
#: Numbers below this are looked up in a table; cells up to TABLE_SHARE times what is counted too.
TABLE_SIZE, TABLE_SHARE = 1 << 22, 8


def _distinct(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and which of them each key is."""
    if below > TABLE_SIZE:
        return np.unique(keys, return_inverse=True)
    there = np.zeros(below, bool)
    there[keys] = True
    found = np.flatnonzero(there)
    place = np.zeros(below, np.int64)
    place[found] = np.arange(len(found))
    return found, place[keys]


def _tally(owner: np.ndarray, which: np.ndarray, owners: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, kind and count of each pair of these that there is."""
    cells = owner * kinds + which
    if owners * kinds <= TABLE_SHARE * len(cells):
        counts = np.bincount(cells, minlength=0)
        at = np.flatnonzero(counts)
        counts = counts[at]
    else:
        cells.sort()
        first = np.flatnonzero(np.diff(cells, prepend=-1))
        at, counts = cells[first], np.diff(first, append=len(cells))
    return at // max(kinds, 1), at % max(kinds, 1), counts


@dataclass(frozen=True)
class HashingEmbedder:
    """A Column function text -> unit vector (array<float>); the zero vector for texts without features. Works on Arrow batches.

    vectors() embeds prepared texts outside a plan: a row each.
    """

    dim: int = 512
    idf: Idf | None = None
    kind: Features = Features()

    @staticmethod
    def prepared(c: str | Column) -> Column:
        return normalise(c)

    def __call__(self, c: str | Column) -> Column:
        @F.pandas_udf("array<float>")
        def embed(texts):
            return pd.Series([v for part in self.parts(texts) for v in part], dtype="object")

        return embed(self.prepared(c))

    def vectors(self, texts) -> np.ndarray:
        return np.concatenate([np.zeros((0, self.dim), np.float32), *self.parts(texts)])

    def parts(self, texts) -> Iterator[np.ndarray]:
        """Vectors of as many texts at a time as have SLICE_CHARS characters."""
        seen: dict[str, int] = {}
        held, chars = [], 0
        for text in texts:
            held.append(text or "")
            chars += len(held[-1])
            if chars >= SLICE_CHARS or len(held) >= SLICE_TEXTS:
                yield self._unit(held, seen)
                held, chars = [], 0
        if held:
            yield self._unit(held, seen)

    def _unit(self, texts: list[str], seen: dict[str, int]) -> np.ndarray:
        at, weight = zip(*self._together(texts)) if self.idf is None and self.kind.grams[1] <= 3 else zip(*(self._weighted(k, t, seen) for k, t in enumerate(texts)))
        v = np.bincount(np.concatenate(at), np.concatenate(weight), len(texts) * self.dim).reshape(len(texts), self.dim)
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return (v / np.where(norm == 0, 1, norm)).astype(np.float32)

    def _together(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cells (text and bucket) and weights of each distinct feature of each text, n-grams of up to three characters: all texts at once, each distinct feature hashed once."""
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths + 1) - 1  # where the line feed after each text is
        yield np.zeros(0, np.int64), np.zeros(0)
        known, codes = _distinct(points.astype(np.int64), int(points.max(initial=0)) + 1)
        owner, left = np.repeat(np.arange(len(texts)), lengths + 1)[: len(points)], np.repeat(ends, lengths + 1)[: len(points)]
        for n in range(self.kind.grams[0], self.kind.grams[1] + 1):
            starts = np.flatnonzero(np.arange(len(points)) + n <= left)
            key = np.zeros(len(starts), np.int64)
            for k in range(n):
                key = key * len(known) + codes[starts + k]
            grams, which = _distinct(key, len(known) ** n)
            letters = known[np.stack([grams // len(known) ** (n - 1 - k) % len(known) for k in range(n)], 1)] if len(grams) else np.zeros((0, n))
            bucket = buckets(letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), np.stack([np.arange(len(grams)) * n, np.full(len(grams), n)], 1), self.dim)
            text, gram, counts = _tally(owner[starts], which, len(texts), len(grams))
            yield text * self.dim + bucket[gram], 1 + np.log(counts)
        if self.kind.words:
            yield self._words(joined.encode("utf-8", "surrogatepass"), texts)

    def _words(self, data: bytes, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cell and weight of each distinct word of each text; data: the texts' bytes, a line feed between two."""
        octets = np.frombuffer(data, np.uint8)
        flags = np.zeros(len(octets) + 2, bool)
        part = flags[1:-1]
        np.take(_WORD, octets, out=part)
        edges = np.flatnonzero(flags[1:] != flags[:-1])
        begin, size = edges[::2], edges[1::2] - edges[::2]
        part[begin[size == 1]] = False
        begin, size = begin[size > 1], size[size > 1]
        kept, offsets = octets[part], np.concatenate([[0], np.cumsum(size)])
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(kept)).dictionary_encode()
        _, starts, letters = words.dictionary.buffers()
        starts = np.frombuffer(starts, np.int64)[: len(words.dictionary) + 1]
        bucket = (hashes(np.frombuffer(letters or b"", np.uint8), starts[:-1], starts[1:], _BEFORE_WORD) % np.uint64(self.dim)).astype(np.int64)
        ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
        text, word, counts = _tally(np.searchsorted(ends, begin, "right"), words.indices.to_numpy().astype(np.int64), len(texts), len(bucket))
        return text * self.dim + bucket[word], 1 + np.log(counts * float(self.kind.repeats))

    def _weighted(self, k: int, text: str, seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Cell and weight of each distinct feature of the k-th text, by name."""
        starts, counts, words = self.kind.of(text)
        names = [w for w, _ in words]
        seen.update((w, bucket_of(w, self.dim)) for w in names if w not in seen)
        at = np.concatenate([buckets(text, starts, self.dim), np.array([seen[w] for w in names], np.int64)])
        weight = 1 + np.log(np.concatenate([counts, np.array([c for _, c in words], np.int64)]).astype(float))
        if self.idf is not None:
            weight *= [self.idf.known.get(f, self.idf.unseen) for f in [*(text[a : a + n] for a, n in starts.tolist()), *names]]
        return k * self.dim + at, weight


def hashing_embedder(dim: int = 512, idf: Idf | None = None, kind: Features = Features()) -> HashingEmbedder:
    return HashingEmbedder(dim, idf, kind)


#: Vectors that a task keeps for the pairs to come.
HELD_VECTORS = 20_000


def text_cosine(embedder, a: str, b: str) -> Column:
    """Cosine of the vectors of two prepared texts. Each distinct text of a run of pairs is embedded once.

    Called nondeterministic, as Spark would else take every pair through Python once for a filter on it and once more for its value.
    """

    @F.pandas_udf("double")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known, vectors = pd.Index([]), np.zeros((0, 0), np.float32)
        for old, new in batches:
            texts = pd.concat([old, new]).fillna("")
            fresh = pd.Index(texts.unique()).difference(known, sort=False)
            if len(known) + len(fresh) > HELD_VECTORS:
                known, vectors = known[:0], vectors[:0]
                fresh = pd.Index(texts.unique())
            if len(fresh):
                made = embedder.vectors(fresh)
                known, vectors = known.append(fresh), np.concatenate([vectors.reshape(-1, made.shape[1]), made])
            at = known.get_indexer(texts)
            i, j = at[: len(old)], at[len(old) :]
            yield pd.Series(np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", vectors[i[k : k + 1024]].astype(float), vectors[j[k : k + 1024]].astype(float)) for k in range(0, len(i), 1024))]))

    return similar.asNondeterministic()(a, b)


def model_embedder(load: Callable[[], object]) -> Callable[[str | Column], Column]:
    """A Column function for a sentence model: load() gives, once in each Python worker, an object whose encode(list of texts) returns unit vectors."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(np.asarray(model.encode(texts.fillna("").tolist()), np.float32)))

    return lambda c: embed(F.col(c) if isinstance(c, str) else c)


#: Features whose frequencies a task holds; more go on to the sums that Spark keeps in each task.
HELD_FEATURES = 50_000


def fit_idf(docs: DataFrame, text: str = "content", smooth: float = 1.0, kind: Features = Features()) -> DataFrame:
    """feature, df, idf over all documents: ln((N + s) / (df + s)) + 1. Frequencies are added up by runs of documents and in each task before they are shuffled."""

    def count(batches):
        for batch in batches:
            df = Counter()
            for k, t in enumerate(batch["t"], 1):
                df.update(kind.names(t or ""))
                if len(df) >= HELD_FEATURES or k == len(batch):
                    yield pd.DataFrame({"feature": list(df), "df": np.fromiter(df.values(), np.int64, len(df))})
                    df = Counter()

    n = docs.select(F.count("*").alias("n"))
    df = docs.select(normalise(text).alias("t")).mapInPandas(count, "feature string, df long").groupBy("feature").agg(F.sum("df").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("feature", "df", (F.log((F.col("n") + smooth) / (F.col("df") + smooth)) + 1).alias("idf"))


def collect_idf(fitted: DataFrame, documents: int, smooth: float = 1.0, most: int = 1_000_000) -> Idf:
    """fit_idf's result for hashing_embedder; more than `most` features are refused, as every Python worker holds them."""
    rows = fitted.select("feature", "idf").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} features: fit on a sample, or count fewer kinds of features")
    return Idf({r.feature: r.idf for r in rows}, math.log((documents + smooth) / smooth) + 1)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Dot product of two unit vectors, summed in double."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
