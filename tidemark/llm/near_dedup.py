"""Near-duplicate detection by BagMinHash.

A text is a multiset of shingles of five words. Each shingle's weight axis is cut at the
powers of two; every piece of it has a Poisson process of its own whose points carry a
signature slot and a place within the piece, and points beyond the shingle's weight are
thinned out. A slot keeps its least point, so two signatures agree in a slot with the
probability of the weighted Jaccard similarity of the multisets. Bands of slots give
candidates; their multisets are then compared exactly.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, U64, fresh, materialise, mix, release, slices

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 38, 6
GOLDEN, WORD_BASE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
SPACES = b" \t\n\x0b\x0c\r"
SPACE = np.zeros(256, bool)
SPACE[list(SPACES)] = True
SPACE_RUN = re.compile(rb"[ \t-\r]")
#: Words of more bytes than this are hashed by themselves.
LONG_WORD = 4096


def _long_word(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each white-space separated word of a buffer that ends in white space: its bytes times powers of an odd base, from prefix sums modulo 2**64."""
    flat = np.frombuffer(data, np.uint8)
    space = SPACE[flat]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return starts, np.zeros(0, U64)
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    size = ends - starts
    power = np.cumprod(np.full(min(int(size.max()), LONG_WORD), WORD_BASE, U64))
    place = np.arange(len(flat), dtype=np.int32)
    place[starts[0] :] -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(flat))))
    np.minimum(place, len(power) - 1, out=place)
    term = power[place]
    del place
    term *= flat.astype(U64) + U64(1)
    term[space] = 0
    np.cumsum(term, out=term)
    word = term[ends] - np.where(starts > 0, term[starts - 1], U64(0))
    word = mix(word + size.astype(U64) * GOLDEN)
    for k in np.flatnonzero(size > LONG_WORD):
        word[k] = _long_word(data[starts[k] : ends[k]])
    return starts, word


def _words(data: bytes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """_word_hashes of a buffer of any length, in parts of about `most` bytes that end in white space."""
    starts, words, at = [], [], 0
    while at < len(data):
        found = SPACE_RUN.search(data, min(at + most, len(data) - 1))
        end = found.end()
        if end - at > 2 * most:  # a very long word: what is before it first, then itself
            before = max(data.rfind(SPACES[k : k + 1], at, at + most) for k in range(len(SPACES)))
            if before < 0:
                starts.append(np.array([at]))
                words.append(np.array([_long_word(data[at : end - 1])], U64))
                at = end
                continue
            end = before + 1
        start, word = _word_hashes(data[at:end])
        starts.append(start + at)
        words.append(word)
        at = end
    return np.concatenate(starts), np.concatenate(words)


def shingles(texts: list[str], words: int = WORDS, most: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count): the multisets of hashed shingles of all texts, sorted by text and shingle.

    Words are separated by ASCII white space. Texts of 1 to words - 1 words have one shingle, of all of them.
    Beside the texts, the words' hashes are all that is held of long ones.
    """
    coded = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    if not coded:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    ends = np.cumsum([len(c) for c in coded])
    starts, word = _words(b"".join(coded), most)
    del coded
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    owner = np.searchsorted(ends, starts, side="right")
    per_text = np.bincount(owner, minlength=len(texts))
    left = np.repeat(np.cumsum(per_text), per_text) - np.arange(len(word))  # words from here to the text's end
    code = np.zeros(len(word), U64)
    for k in range(words):
        code *= WORD_BASE
        code[: len(word) - k] += np.where(left[: len(word) - k] > k, word[k:], U64(k + 1))
        code[len(word) - k :] += U64(k + 1)
        code = mix(code)
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    use = (left >= words) | first & (per_text[owner] < words)
    owner, code = owner[use], code[use]
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])]))
    return owner[new], code[new], np.diff(np.concatenate([new, [len(code)]]))


def bag_minhash(owner: np.ndarray, code: np.ndarray, count: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """Signatures (texts x slots): the least point of each slot, as its time; infinite without shingles.

    Processes are advanced together, a point at a time, and leave once they are past the largest
    slot of their text: no later point of theirs can matter.
    """
    sig = np.full((texts, slots), np.inf)
    pieces, at = [], 0
    while True:  # [0, 1), [1, 2), [2, 4), [4, 8) ... as far as the largest count
        low, high = (0, 1) if at == 0 else (1 << at - 1, 1 << at)
        reach = np.flatnonzero(count > low)
        if not len(reach):
            break
        pieces.append((owner[reach], mix(code[reach] + GOLDEN * np.full(1, at + 1, U64)), np.full(len(reach), high - low), count[reach] - low))
        at += 1
    if not pieces:
        return sig
    text, state, size, weight = (np.concatenate(x) for x in zip(*pieces))
    time = np.zeros(len(text))
    with np.errstate(over="ignore"):
        while len(text):
            state = state + GOLDEN
            draw = mix(state)
            time = time - np.log((draw >> U64(11)).astype(float) / (1 << 53) + 2.0**-54) / size
            more = mix(draw ^ WORD_BASE)
            slot = ((more & U64(0xFFFFFFFF)) * U64(slots) >> U64(32)).astype(np.int64)
            inside = ((more >> U64(32)) * size.astype(U64) >> U64(32)).astype(np.int64) < weight
            np.minimum.at(sig.reshape(-1), (text * slots + slot)[inside], time[inside])
            alive = time < sig.max(1)[text]
            text, state, size, weight, time = text[alive], state[alive], size[alive], weight[alive], time[alive]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of each signature."""
    bits = sig.view(U64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * GOLDEN, bits.shape[:2])
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key * WORD_BASE + bits[:, :, r])
    return key.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least over sum of largest counts of two sorted multisets."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both) if total > both else 0.0


#: Bits kept of each slot for the quick estimate, and slots in the first word of each of their planes.
PLANES, WIDTH = 4, 64


def bit_planes(sig: np.ndarray) -> np.ndarray:
    """Bit p of every slot, PLANES bits of a slot's hash in all, packed into longs: planes x words for each signature."""
    with np.errstate(over="ignore"):
        slots = mix(sig.view(U64).reshape(sig.shape))
    words = -(-sig.shape[1] // WIDTH)
    out = np.zeros((len(sig), PLANES, words), U64)
    for p in range(PLANES):
        bit = (slots >> U64(p)) & U64(1)
        for j in range(sig.shape[1]):
            out[:, p, j // WIDTH] |= bit[:, j] << U64(j % WIDTH)
    return out.reshape(len(sig), PLANES * words).view(np.int64)


def least_agreement(slots: int, similarity: float) -> int:
    """Slots that must agree in their kept bits: 4.3 standard deviations below what texts of just this similarity have on average."""
    share = similarity + (1 - similarity) / (1 << PLANES)
    return int(slots * share - 4.3 * (slots * share * (1 - share)) ** 0.5)


def alike(a: str, b: str, slots: int, similarity: float):
    """Whether the planes and sizes of two texts, named by prefix, leave a similarity of `similarity` possible."""
    words = -(-slots // WIDTH)
    parts = []
    for w in range(words):
        differ = " | ".join(f"({a}planes[{p * words + w}] ^ {b}planes[{p * words + w}])" for p in range(PLANES))
        parts.append(f"bit_count({differ})")
    return F.expr(f"{slots} - ({' + '.join(parts)}) >= {least_agreement(slots, similarity)} and {a}size >= {similarity}D * {b}size and {b}size >= {similarity}D * {a}size")


#: Bits of an odd sketch.
SKETCH_BITS = 2048


def odd_sketches(owner: np.ndarray, code: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """Odd sketches (texts x longs): every occurrence of a shingle flips one bit, so the bits in which two differ are at most as many as their multisets' differences."""
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        bit = (mix(np.repeat(code, count) + GOLDEN * (nth.astype(U64) + U64(1))) % U64(SKETCH_BITS)).astype(np.int64)
    out = np.zeros(texts * (SKETCH_BITS // 64), U64)
    np.bitwise_xor.at(out, np.repeat(owner, count) * (SKETCH_BITS // 64) + bit // 64, U64(1) << (bit % 64).astype(U64))
    return out.reshape(texts, -1).view(np.int64)


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """rep, odd of each row of texts (rep, text)."""

    def run(batches):
        for batch in batches:
            reps, texts = batch.column("rep").to_numpy(), batch.column("text").to_pylist()
            for a, b in slices(texts):
                odd = odd_sketches(*shingles(texts[a:b], words), b - a)
                listed = pa.FixedSizeListArray.from_arrays(pa.array(odd.ravel(), pa.int64()), odd.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(reps[a:b], pa.int64()), listed], names=["rep", "odd"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, odd array<long>")


def near(a: str, b: str, similarity: float):
    """Whether the odd sketches and sizes of two texts, named by prefix, leave a similarity of `similarity` possible.

    That similarity allows `most` differences. The sketches differ in no more bits than that, and, as
    differences cancel each other out, with a chance of 0.99999 in no more than 4.3 standard deviations above
    what is expected of `most`; the second bound is the lower one for sizes of several thousand only.
    """
    # Written out, the sum would make a method too long for the JVM to compile.
    differ = f"aggregate(zip_with({a}odd, {b}odd, (x, y) -> bit_count(x ^ y)), 0, (sum, x) -> sum + x)"
    most = f"(({a}size + {b}size) * {(1 - similarity) / (1 + similarity)!r}D + 1e-6D)"
    expected = f"({SKETCH_BITS / 2}D * (1 - exp(-2 * {most} / {SKETCH_BITS}D)) + {4.3 * SKETCH_BITS**0.5 / 2}D)"
    return F.expr(f"({differ}) <= least({most}, {expected})")


def _listed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as an array of lists."""
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.int64()), x.shape[1]).cast(pa.list_(pa.int64()))


def signatures(texts: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """digest, keys (of the bands; none without words), planes, size (shingles) of each distinct text of texts (digest, text); copies within a batch are hashed once."""

    def run(batches):
        for batch in batches:
            distinct = dict(zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()))
            digests, texts = list(distinct), list(distinct.values())
            for a, b in slices(texts):
                owner, code, count = shingles(texts[a:b], words)
                size = np.bincount(owner, count, b - a).astype(np.int64)
                sig = bag_minhash(owner, code, count, b - a, bands * rows)
                some = size > 0
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]), pa.int32()), pa.array(band_keys(sig[some], bands, rows).ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(digests[a:b], pa.binary()), keys, _listed(bit_planes(sig)), pa.array(size, pa.int64())], names=["digest", "keys", "planes", "size"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, keys array<long>, planes array<long>, size long").dropDuplicates(["digest"])


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """pairs (a, b) with the similarity of their multisets, where it is at least `similarity`."""

    def run(batches):
        for batch in batches:
            a, b, left, right = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            found: list[tuple[int, int, float]] = []
            for x, y in slices([l + r for l, r in zip(left, right)]):
                distinct = list(dict.fromkeys([*left[x:y], *right[x:y]]))
                owner, code, count = shingles(distinct, words)
                bounds = np.searchsorted(owner, np.arange(len(distinct) + 1))
                bag = {t: (code[i:j], count[i:j]) for t, i, j in zip(distinct, bounds, bounds[1:])}
                for k in range(x, y):
                    s = weighted_jaccard(bag[left[k]], bag[right[k]])
                    if s >= similarity:
                        found.append((a[k], b[k], s))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["a", "b", "similarity"])

    joined = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (its least node) of every node of edges (a, b).

    Large-star and small-star steps alternate until only stars are left; every step is written to
    the shared folder. Least neighbours are pre-aggregated, and written before they are joined, so
    that Spark can split the join at a hot node.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    while not _only_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        large = materialise(large, label)
        release(now, least)
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), label)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), label)
        release(large, low)
    ends = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = now.select(F.col("v").alias("node")).distinct().join(ends.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    found = materialise(ends.unionByName(roots.select("node", "component")), label)
    release(now)
    return found


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node of edges (u, v), v < u, has one lesser neighbour, or greater ones only: the state that the steps leave as it is."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


#: Rows of a block of a bucket's texts: what one task of the last step compares is at most a block by a block at a time.
BLOCK = 256


def similar_texts(found: DataFrame, texts_of, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The classes (node, component) into which links between similar texts join those of found (rep, keys, planes, size); texts_of(reps): their rep and text.

    1. In each bucket, every text is compared with the bucket's centre, the text that meets most others
       in its buckets: a pair a row, however large the bucket is. 2. In buckets that still hold several
       components, texts outside the largest are compared with eight more centres. 3. What is then left
       outside is compared with all texts of other components in its bucket, block by block, so no link
       between components is lost. Before texts are compared, sizes and the kept bits of the signatures
       must leave the similarity possible (a link of just that similarity passes with a chance of 0.99999),
       in steps 2 and 3 the odd sketches of the texts too: in a large group whose texts are a little less
       similar than that to each other, nearly all pairs end there.
    """
    slots = bands * rows
    keys = found.select("rep", F.explode("keys").alias("key"))
    crowd = materialise(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowds")
    buckets = materialise(keys.join(crowd, "key"), "buckets")
    known = found.select("rep", "planes", "size").join(buckets.groupBy("rep").agg(F.sum("n").alias("score")), "rep")
    shared = materialise(buckets.select("key", "rep").join(known, "rep"), "shared")
    texts = materialise(texts_of(shared.select("rep").distinct()), "texts")
    release(crowd, buckets)

    row = F.struct("rep", "planes", "size")
    rank = F.struct("score", F.xxhash64("rep").alias("h"))
    ordered = lambda pairs: pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    close = alike("", "c.", slots, similarity)

    centres = materialise(shared.groupBy("key").agg(F.max_by(row, rank).alias("c")), "centres")
    pairs = shared.join(centres, "key").where((F.col("rep") != F.col("c.rep")) & close).select(F.col("rep").alias("x"), F.col("c.rep").alias("y"))
    tested = materialise(ordered(pairs), "pairs")
    links = materialise(_verified(tested, texts, words, similarity).select("a", "b"), "links")
    component = connected(links)
    release(links, centres)

    held = materialise(_open_buckets(shared, component), "open")
    odd = materialise(sketches(texts.join(held.select("rep").distinct(), "rep", "left_semi"), words), "sketches")
    open_ = materialise(held.join(odd, "rep"), "open")
    release(shared, held, odd)
    centres = open_.groupBy("key", F.pmod(F.xxhash64("rep"), F.lit(8)).alias("part")).agg(F.max_by(F.struct("rep", "planes", "size", "component", "odd"), rank).alias("c"))
    centres = materialise(centres, "centres")
    pairs = open_.where("component <> main").join(centres, "key").where((F.col("component") != F.col("c.component")) & close & near("", "c.", similarity)).select(F.col("rep").alias("x"), F.col("c.rep").alias("y"))
    more = materialise(ordered(pairs).join(tested, ["a", "b"], "left_anti"), "pairs")
    component = _extended(component, _verified(more, texts, words, similarity).select("a", "b"))
    release(centres)

    left = materialise(_open_buckets(open_.drop("component", "main"), component), "open")
    release(open_)
    last = ordered(_across(left, alike("o.", "c.", slots, similarity) & near("o.", "c.", similarity)))
    last = materialise(last.join(tested.unionByName(more), ["a", "b"], "left_anti"), "pairs")
    release(left, tested, more)
    component = _extended(component, _verified(last, texts, words, similarity).select("a", "b"))
    release(last, texts)
    return component


def _across(left: DataFrame, possible: Column) -> DataFrame:
    """Pairs x, y of texts of one bucket and different components, each with x outside the bucket's largest, for which `possible` (on o and c) holds.

    Both sides are dealt into blocks, and a block meets a block: however large a bucket is, no task
    needs it whole, and a text is copied only as often as there are blocks on the other side.
    """
    sizes = left.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("all"), F.ceil(F.count_if(F.expr("component <> main")) / F.lit(BLOCK)).cast("int").alias("out"))
    sizes = materialise(sizes, "blocks")
    dealt = left.join(sizes, "key").withColumn("h", F.xxhash64("rep"))
    own = F.struct("rep", "planes", "size", "component", "main", "odd")
    outside = dealt.where("component <> main").select("key", F.expr("cast(pmod(h, out) as int)").alias("i"), F.explode(F.expr("sequence(0, all - 1)")).alias("j"), own.alias("o"))
    rest = dealt.where("out > 0").select("key", F.explode(F.expr("sequence(0, out - 1)")).alias("i"), F.expr("cast(pmod(h, all) as int)").alias("j"), own.alias("c"))
    pairs = outside.join(rest, ["key", "i", "j"]).where(F.expr("o.component <> c.component and (c.component = o.main or o.rep < c.rep)") & possible)
    return pairs.select(F.col("o.rep").alias("x"), F.col("c.rep").alias("y"))


def _extended(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components with new links (a, b); without any, they stay as they are. Every node starts from its component's least one, so few rounds are needed."""
    links = materialise(links, "links")
    if links.isEmpty():
        release(links)
        return components
    stars = components.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = connected(stars.unionByName(links))
    release(links, components)
    return found


def _open_buckets(shared: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of shared in buckets of several components, with their own component and the bucket's largest (main)."""
    placed = shared.join(components, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("m.component").alias("main"))
    return placed.join(materialise(largest, "largest"), "key")


def text_digest(text: Column) -> Column:
    """128 bits of the text's SHA-256: that any two of 10**11 texts share them has a chance of 2 in 10**17."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _row_key(doc_id: Column, digest: Column) -> Column:
    """128 bits that name a row by its id, which may be null, and its text."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.hex(digest))))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size (rows), is_kept, digest (of the text) of every row of docs.

    Rows of equal text, null being empty, are one class; texts without words are similar to nothing
    else. Classes are the connected components of weighted Jaccard similarity of at least 0.8 of the
    multisets of five-word shingles. is_kept holds for the row of the least doc_id (nulls last) of
    each class, of the least digest where that id is repeated, and for exact repetitions of that row.
    Equal texts are compared once, and never expanded into pairs. Very long texts are hashed in parts,
    an empty table gives no rows, and columns other than doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text_digest(text).alias("digest"), text.alias("text"))
    rows = materialise(own.select("doc_id", "digest"), "rows")
    sized = {k: options.get(k, v) for k, v in (("words", WORDS), ("bands", BANDS), ("rows", ROWS))}
    # Numbers are unique, and stay what they are once they are written.
    found = materialise(signatures(own, **sized).withColumn("rep", F.monotonically_increasing_id()), "signatures")
    no_id = F.col("doc_id").isNull().alias("no_id")
    per_text = rows.groupBy("digest").agg(F.min(F.struct(no_id, "doc_id")).alias("least"), F.count("*").alias("n"))
    numbered = materialise(per_text.join(found.select("digest", "rep"), "digest"), "numbered")

    def texts_of(reps: DataFrame) -> DataFrame:
        """Each text from the row of its least doc_id."""
        wanted = numbered.join(reps, "rep").select(_row_key(F.col("least.doc_id"), F.col("digest")).alias("key"), "rep")
        return own.select(_row_key(F.col("doc_id"), F.col("digest")).alias("key"), "text").join(wanted, "key").select("rep", "text").dropDuplicates(["rep"])

    component = similar_texts(found, texts_of, **options)
    placed = numbered.join(component, F.col("rep") == F.col("node"), "left").select("digest", "least", "n", F.coalesce("component", "rep").alias("component"))
    placed = materialise(placed, "placed")
    release(found, numbered, component)
    keeper = F.min(F.struct(F.col("least.no_id"), F.col("least.doc_id"), "digest")).alias("keeper")
    classes = materialise(placed.groupBy("component").agg(keeper, F.sum("n").alias("class_size")), "classes")
    judged = materialise(placed.select("digest", "component").join(classes, "component").drop("component"), "judged")
    release(placed, classes)
    kept = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("digest") == F.col("keeper.digest"))
    return rows.join(judged, "digest").select("doc_id", F.col("keeper.doc_id").alias("class_id"), "class_size", kept.alias("is_kept"), "digest")


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one for each class, whole and with all columns, whatever their names.

    Of rows that repeat both id and text one stays; which one's other columns, isn't defined.
    """
    kept = near_duplicates(docs, **options).where("is_kept")
    (key,) = fresh(docs, "row_key")
    kept = kept.select(_row_key(F.col("doc_id"), F.col("digest")).alias(key))
    keyed = docs.withColumn(key, _row_key(docs["doc_id"], text_digest(F.coalesce(docs["text"], F.lit("")))))
    return keyed.dropDuplicates([key]).join(kept, key, "left_semi").select(*docs.columns)
