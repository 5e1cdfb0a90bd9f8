"""Alignment of two tokenizers by a dictionary of groups.

A text's tokens by A (byte-level, of a space and the text) and by B (pieces, which add that
space) are cut into groups where tokens of both end at one byte. Each distinct group is named by
its ids, `a1,a2|b1`: the name is the dictionary's key and its content. A document becomes its
groups' names and how often it has each. Links (all pairs of an A and a B token of one group) are
expanded once for each distinct group: within a batch, to count the documents that hold an id
pair, and over the corpus, to give each group the sums over its links. Documents then add up
their groups' sums by a join on the name, in which the commonest groups, a bounded number, are
broadcast, so that the shuffled rest has no key of many rows.

Null and empty texts, and those whose tokens' bytes aren't a space and the text, have no tokens:
zeros, and '' for the digest. Repeated documents are documents of their own and count as such.
Texts of any length are encoded whole, each in the task that reads it; a group's links are kept
as pairs of distinct ids with their number. An empty table has no rows. Other columns are left
alone.
"""

from __future__ import annotations

import base64
import hashlib
import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import byte_letters, tokenizer_path
from .common import SLICE, U64, materialise, mix, once_per_worker, runs, slices

#: Characters of which letters and digits are the same in all versions of Unicode that tokenizers know; texts with others go to the slower library.
SETTLED = r"\u0000-\u052F\u2000-\u206F\u20A0-\u20BF\u3040-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3"
#: The commonest groups up to this many are broadcast, and tables of pairs up to this many rows; about 100 bytes a row.
HEAD, BROADCAST_PAIRS = 200_000, 300_000
#: Links that a step of counting holds at a time.
LINKS = 2_000_000


class Tokens:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, ranks_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.fast = tiktoken.Encoding("a", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(a_path)
        self.exact.encode_special_tokens = True
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.a_bytes = [b""] * (1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, k in spec["model"]["vocab"].items():
            self.a_bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        named = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(named)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.unsettled = regex.compile(f"[^{SETTLED}]")

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The ids of each text by A and by B; None if it has no tokens."""
        spaced = [" " + t for t in texts]
        slow = [k for k, t in enumerate(texts) if t and self.unsettled.search(t)]
        exact = dict(zip(slow, self.exact.encode_batch([spaced[k] for k in slow], add_special_tokens=False))) if slow else {}
        by_b = self.pieces.encode(texts, num_threads=1) if texts else []
        out = []
        for k, (t, b) in enumerate(zip(spaced, by_b)):
            a = exact[k].ids if k in exact else self.fast.encode_ordinary(t) if texts[k] else []
            whole = t.encode()
            same = texts[k] and b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((a, b) if same else None)
        return out


def cut(a_ids: np.ndarray, b_ids: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end in a_ids and in b_ids: after tokens of both that end at one byte."""
    a_ends, b_ends = np.cumsum(a_sizes[a_ids]), np.cumsum(b_sizes[b_ids])
    at = np.searchsorted(b_ends, a_ends)
    common = b_ends[at] == a_ends
    return np.flatnonzero(common) + 1, at[common] + 1


def interned(a_ids: np.ndarray, b_ids: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The names of the distinct groups, and each group's number among them."""
    def summed(ids, cuts, salt):
        starts = np.concatenate([[0], cuts[:-1]])
        place = np.arange(len(ids)) - np.repeat(starts, cuts - starts)
        return np.add.reduceat(mix((ids.astype(U64) << U64(32)) + mix(place.astype(U64) + U64(salt))), starts)

    two = [summed(a_ids, a_cuts, s) * U64(3) + summed(b_ids, b_cuts, s + 1) for s in (11, 77)]
    _, first, group = np.unique(two[0], return_index=True, return_inverse=True)
    if (two[1] != two[1][first][group]).any():  # one in 2 ** 64: tell them apart by both hashes
        _, first, group = np.unique(np.stack(two, 1), axis=0, return_index=True, return_inverse=True)
        group = group.reshape(-1)
    names = []
    a, b = a_ids.tolist(), b_ids.tolist()
    a_at, b_at = [0, *a_cuts.tolist()], [0, *b_cuts.tolist()]
    for k in first.tolist():
        names.append(f"{','.join(map(str, a[a_at[k] : a_at[k + 1]]))}|{','.join(map(str, b[b_at[k] : b_at[k + 1]]))}")
    return names, group


def links_of(name: str) -> list[tuple[int, int, int]]:
    """The distinct id pairs of a group, with how many links are of each."""
    sides = [np.unique(np.array(side.split(","), np.int64), return_counts=True) for side in name.split("|")]
    (a, na), (b, nb) = ((ids.tolist(), n.tolist()) for ids, n in sides)
    return [(x, y, n * m) for x, n in zip(a, na) for y, m in zip(b, nb)]


#: A document by its groups: `names` are distinct, `times` says how often it has each.
GROUPED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, names array<string>, times array<long>"


def group_documents(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id and GROUPED of each row of docs (doc_id, text). paths: A's tokenizer file and its ranks, and B's, on the executors."""
    import pyarrow as pa

    schema = StructType([*docs.select("doc_id").schema, *StructType.fromDDL(GROUPED)])

    def grouped(tokens, texts):
        coded = tokens.encode(texts)
        held = [k for k, c in enumerate(coded) if c]
        n = len(texts)
        sums = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        digests, of, names, times, sizes = [""] * n, np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(n, np.int64)
        if held:
            a_ids, b_ids = (np.concatenate([np.array(coded[k][side], np.int64) for k in held]) for side in (0, 1))
            sums["n_a"][held], sums["n_b"][held] = ([len(coded[k][side]) for k in held] for side in (0, 1))
            a_cuts, b_cuts = cut(a_ids, b_ids, tokens.a_sizes, tokens.b_sizes)
            names, group = interned(a_ids, b_ids, a_cuts, b_cuts)
            ends = np.searchsorted(a_cuts, np.cumsum(sums["n_a"][held])) + 1
            starts = np.concatenate([[0], ends[:-1]])
            sums["n_groups"][held] = ends - starts
            sums["n_links"][held] = np.add.reduceat(np.diff(a_cuts, prepend=0) * np.diff(b_cuts, prepend=0), starts)
            listed = group.tolist()
            for k, s, e in zip(held, starts.tolist(), ends.tolist()):
                digests[k] = hashlib.sha256(";".join([names[g] for g in listed[s:e]]).encode()).hexdigest()
            pairs, times = np.unique(np.repeat(held, ends - starts) * len(names) + group, return_counts=True)
            of = pairs % len(names)
            sizes = np.bincount(pairs // len(names), minlength=n)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        said = pa.array(names, pa.string()).take(pa.array(of))
        return [*(pa.array(v) for v in sums.values()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, said), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]

    def run(batches):
        own = paths or tuple(map(tokenizer_path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
        tokens = once_per_worker(("alignment", own), lambda: Tokens(*own))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts, SLICE):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *grouped(tokens, texts[a:b])], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(grouped: DataFrame) -> DataFrame:
    """a, b, n: how many documents hold each id pair linked. A task sends a row for each pair of a slice of its documents."""
    import pyarrow as pa

    def counted(names, sizes):
        """Of pairs that lie in one of the slice's groups, that group's documents; the others' documents are told apart."""
        held = names.dictionary_encode()
        group, kinds = held.indices.to_numpy(), held.dictionary.to_pylist()
        links = [[x[:2] for x in links_of(name)] for name in kinds]
        width = np.array([len(x) for x in links], np.int64)
        flat = np.array([p for x in links for p in x], np.int64).reshape(-1, 2)
        pairs, pair = np.unique(flat[:, 0] << 32 | flat[:, 1], return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        alone = np.bincount(pair, minlength=len(pairs))[pair] == 1
        documents = np.bincount(group, minlength=len(kinds))
        np.add.at(n, pair[alone], np.repeat(documents, width)[alone])
        # The other links, group by group, dealt to the documents that have the group.
        owner = np.repeat(np.arange(len(kinds)), width)[~alone]
        rest, many = pair[~alone], np.bincount(owner, minlength=len(kinds))
        first = np.cumsum(many) - many
        per_row = many[group]
        row_doc = np.repeat(np.repeat(np.arange(len(sizes)), sizes), per_row)
        at = np.repeat(first[group] - (np.cumsum(per_row) - per_row), per_row) + np.arange(per_row.sum())
        met = np.unique(row_doc * len(pairs) + rest[at]) if len(at) else np.zeros(0, np.int64)
        n += np.bincount(met % max(len(pairs), 1), minlength=len(pairs))
        return [pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(n)]

    def run(batches):
        for batch in batches:
            names = batch.column("names")
            sizes = names.value_lengths().to_numpy()
            for a, b in runs(sizes.tolist(), LINKS // 8):
                part = names.slice(a, b - a).flatten()
                if len(part):
                    yield pa.RecordBatch.from_arrays(counted(part, sizes[a:b]), names=["a", "b", "n"])

    return grouped.select("names").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def expanded(names: DataFrame) -> DataFrame:
    """name, a, b, links of each distinct group."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            listed = batch.column("name").to_pylist()
            for s, e in runs([len(x) for x in listed], 200_000):
                rows = [(name, *x) for name in listed[s:e] for x in links_of(name)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["name", "a", "b", "links"])

    return names.select("name").mapInArrow(run, "name string, a long, b long, links long")


def sized(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has no more rows than that."""
    return F.broadcast(df) if df.count() <= most else df


def group_sums(grouped: DataFrame) -> DataFrame:
    """name, documents, count_sum, n_best of each distinct group: over its links, the sum of their pairs' counts, and how many have the highest of their A id."""
    counts = materialise(pair_counts(grouped), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("best"))  # at most a row for each of A's ids
    dictionary = materialise(grouped.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("documents")), "groups")
    links = expanded(dictionary).join(sized(counts, BROADCAST_PAIRS), ["a", "b"]).join(F.broadcast(best), "a")
    sums = links.groupBy("name").agg(F.sum(F.col("links") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)).alias("n_best"))
    return materialise(dictionary.join(sums, "name"), "group-sums")


def align(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text)."""
    grouped = materialise(group_documents(docs, paths).withColumn("row", F.monotonically_increasing_id()), "grouped")
    sums = group_sums(grouped)
    had = grouped.select("row", F.explode(F.arrays_zip("names", "times")).alias("g")).select("row", F.col("g.names").alias("name"), F.col("g.times").alias("times"))
    columns = ["row", *[(F.col("times") * F.col(c)).alias(c) for c in ("count_sum", "n_best")]]
    if sums.count() <= HEAD:
        met = had.join(F.broadcast(sums), "name").select(*columns)
    else:
        head = materialise(sums.orderBy(F.desc("documents"), "name").limit(HEAD), "common-groups")
        rare = had.join(F.broadcast(head.select("name")), "name", "left_anti").join(sums, "name")
        met = had.join(F.broadcast(head), "name").select(*columns).unionByName(rare.select(*columns))
    added = met.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return grouped.drop("names", "times").join(added, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
