"""Byte-level BPE encoding and decoding with a public vocabulary.

Distinct words of a batch are merged together: the symbols of all words lie in one flat
array, each round looks up every neighbouring pair by binary search over the sorted pair
keys, and merges the lowest-ranked pair of each word. Texts are then put together from the
words' ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re as std_re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import append_columns, once_per_worker, slices

FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more symbols are merged one by one with a heap, in n log n.
LONG_WORD = 512


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + odd.index(b)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder for a tokenizer file. Words met before are kept, up to `remember` of them."""

    def __init__(self, path: str, remember: int = 700_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        mark = spec["model"].get("end_of_word_suffix") or ""
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + mark] for c in letters], np.int64) if mark else None
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.tokens = [b""] * self.size
        for token, k in vocab.items():
            self.tokens[k] = bytes(byte[c] for c in token.removesuffix(mark) if c in byte)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, k in self.special.items():
            self.tokens[k] = content.encode()
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.split_special = std_re.compile("(" + "|".join(map(std_re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(WORDS)
        self.known: dict[str, bytes] = {}
        self.remember = remember

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair by binary search; the number of merges where there is none."""
        key = left * self.size + right
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.ranks[k], len(self.keys))

    def merge_flat(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has, in rounds over all words at once; flat: their bytes, sizes: of each."""
        none = len(self.keys)
        symbols = self.first[flat]
        if self.last is not None:  # a word's last byte carries the mark of its end
            ends = np.cumsum(sizes)[sizes > 0] - 1
            symbols[ends] = self.last[flat[ends]]
        n_words = len(sizes)
        owner = np.repeat(np.arange(n_words), sizes)
        rank = np.full(len(symbols), none)
        if len(symbols) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(symbols)]]))
            lowest = np.minimum.reduceat(rank, starts)
            over = np.repeat(lowest == none, sizes)
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                symbols, owner, rank = symbols[~over], owner[~over], rank[~over]
                if not len(symbols):
                    break
                sizes, lowest = sizes[lowest < none], lowest[lowest < none]
            hit = rank == np.repeat(lowest, sizes)
            if (hit[1:] & hit[:-1]).any():
                # Of overlapping hits, as in "aaa", every other one from the left merges.
                at = np.arange(len(hit))
                hit &= (at - np.maximum.accumulate(np.where(hit, -1, at))) % 2 == 1
            where = np.flatnonzero(hit)
            symbols[where] = self.merged[rank[where]]
            keep = np.ones(len(hit), bool)
            keep[where + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            where -= np.arange(len(where))
            for at in (where, where[where > 0] - 1):  # only pairs with a merged symbol have another rank now
                last = at == len(symbols) - 1
                right = np.where(last, at, at + 1)
                rank[at] = np.where(last | (owner[at] != owner[right]), none, self.rank(symbols[at], symbols[right]))
        owner = np.concatenate([np.zeros(0, np.int64), *done_owner])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([np.zeros(0, np.int64), *done_symbols])[order], np.bincount(owner, minlength=n_words)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (little-endian unsigned 32-bit)."""
        ids, counts = self.merge_flat(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64))
        flat = ids.astype("<u4").tobytes()
        ends = [0, *(4 * np.cumsum(counts)).tolist()]
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def symbols_of(self, word: bytes) -> np.ndarray:
        """The first symbols of a word, a byte each; the last one carries the mark of its end if the vocabulary has one."""
        flat = np.frombuffer(word, np.uint8)
        symbols = self.first[flat]
        if self.last is not None:
            symbols[-1:] = self.last[flat[-1:]]
        return symbols

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: a heap of pairs over a linked list."""
        ids = self.symbols_of(word).tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        table = self.pair_table()
        heap = [(table[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in table]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j < 0 or table.get((ids[k], ids[j])) != rank:
                continue
            ids[k], ids[j] = int(self.merged[rank]), -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (ids[a], ids[b]) in table:
                    heapq.heappush(heap, (table[ids[a], ids[b]], a))
        return np.array([x for x in ids if x >= 0], np.int64)

    def pair_table(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_pairs"):
            self._pairs = {(int(k // self.size), int(k % self.size)): int(r) for k, r in zip(self.keys, self.ranks)}
        return self._pairs

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word; very long ones apart."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [c for c in coded if len(c) <= LONG_WORD]
        ids = iter(self.merge_words(short))
        return [next(ids) if len(c) <= LONG_WORD else self.merge_long(c).astype("<u4").tobytes() for c in coded]

    def words_of(self, piece: str) -> list[str]:
        """A piece split by the pattern; letters, with at most a space before and full stops and commas after, need no search."""
        if not piece:
            return []
        word = piece.rstrip(".,")
        if word.isalpha() or word[:1] == " " and word[1:].isalpha():
            return [word, piece[len(word) :]] if len(word) < len(piece) else [piece]
        return self.words.findall(piece)

    def learn(self, pieces: set[str], before: str, known: dict[str, bytes]) -> None:
        """Make the ids of pieces with `before` in front known."""
        split = {p: self.words_of(before + p) for p in pieces}
        fresh = list(set().union(*split.values()))
        ids = dict(zip(fresh, self.merge(fresh)))
        known.update((p, ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words])) for p, words in split.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Texts are cut before single spaces, where the pattern always cuts too; texts with runs of
        spaces or special tokens go through the pattern as a whole.
        """
        whole = [k for k, t in enumerate(texts) if "  " in t or t[-1:] == " " or any(s in t for s in self.special)]
        skip = set(whole)
        cut = [[] if k in skip else t.split(" ") for k, t in enumerate(texts)]
        if len(self.known) > self.remember:
            self.known.clear()
        fresh = set().union(*[c[1:] for c in cut]).difference(self.known)
        self.learn(fresh, " ", self.known)
        heads = list({c[0] for c in cut if c})
        parts = {k: self.split_special.split(texts[k]) for k in whole}
        words = {k: [[] if j % 2 else self.words.findall(p) for j, p in enumerate(ps)] for k, ps in parts.items()}
        first: dict[str, bytes] = {}
        self.learn(set(heads), "", first)
        rest = list(set().union(*[w for ws in words.values() for w in ws]))
        rest = dict(zip(rest, self.merge(rest)))
        get = self.known.__getitem__
        out = [first[c[0]] + b"".join(map(get, c[1:])) if c else b"" for c in cut]
        for k, ps in parts.items():
            out[k] = b"".join(self.special[p].to_bytes(4, "little") if j % 2 else b"".join([rest[w] for w in words[k][j]]) for j, p in enumerate(ps))
        return out

    def decode(self, coded: list[bytes]) -> list[str]:
        """Text of each sequence of ids; bytes that aren't UTF-8 become U+FFFD."""
        ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
        size = self.lengths[ids]
        ends = np.cumsum(size)
        flat = self.bytes[np.repeat(self.offsets[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(int)]
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """docs with n_tokens and the digests of the ids and of the decoded text; with keep_ids also ids (array).

    Null texts are encoded as empty ones: no tokens. The special token's string in a text is that
    token. Texts of any length are encoded whole, repeated rows each, an empty table gives none; docs'
    columns of the new ones' names give way, all others stay. path: the tokenizer file on the executors, by default the public byte-level vocabulary.
    """

    def run_all(batches_path):
        def run(batch):
            bpe = once_per_worker(("byte_bpe", batches_path), lambda: ByteBPE(batches_path or tokenizer_path("byte_bpe_50k.json")))
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n, ids, back, arrays = [], [], [], []
            for a, b in slices(texts, 2_000_000):
                coded = bpe.encode(texts[a:b])
                n += [len(c) // 4 for c in coded]
                ids += [hashlib.sha256(c).hexdigest() for c in coded]
                back += [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode(coded)]
                if keep_ids:
                    arrays += [np.frombuffer(c, "<u4").astype(np.int32) for c in coded]
            return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string()), *([pa.array(arrays, pa.list_(pa.int32()))] if keep_ids else [])]

        return run

    return append_columns(docs, FIELDS + ", ids array<int>" * keep_ids, run_all(path))
