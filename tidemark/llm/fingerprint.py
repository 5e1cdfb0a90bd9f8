"""Order MinHash fingerprints, in DataFrame functions only.

A text is a sequence of words; a long run without white space, as in scripts that don't
space their words, counts as its characters. Its k-mers of words are numbered by
occurrence, so that repeats count, and hashed. Each of SLOTS hash functions selects the
two numbered k-mers of least hash among all of the text, keeps them in text order, and
hashes that tuple. Two texts' likeness is the share of slots whose tuples agree. It falls
with edit distance: moved k-mers break a tuple as changed ones do.

The hash functions are TURNS turns each of BASES independent hashes: function t of base b
is (h_b(x) - t / TURNS) modulo 1. One sort by h_b therefore serves all its turns, as the
least two under a turn are the next two from t / TURNS on, around the circle. Each
function by itself orders the k-mers uniformly; those of one base depend on each other
only in texts of few k-mers, whose estimate then varies more and stays unbiased.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh
from .quality_rules import split_words

K, LONG_RUN, BASES, TURNS = 3, 24, 2, 32
SLOTS = BASES * TURNS
#: A k-mer as a positive long: 37 bits of hash, of which the first name the turn from which it is found, 26 of position.
TURN_BITS, HASH_BITS, PLACE_BITS = 5, 37, 26
#: Hexadecimal digits of a slot's tuple.
DIGITS = 4


def _key(hashed: Column, place: Column) -> Column:
    """The 37 high bits of the hash before the position."""
    return F.shiftleft(F.shiftrightunsigned(hashed, 64 - HASH_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def _hash(key: Column) -> Column:
    return F.shiftrightunsigned(key, PLACE_BITS)


def _turn(key: Column) -> Column:
    return F.shiftrightunsigned(key, PLACE_BITS + HASH_BITS - TURN_BITS)


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`, the fingerprint of the whole column `text`: DIGITS hexadecimal digits of each slot's tuple.

    Null and empty texts and those of white space have the empty fingerprint. Texts of fewer than K
    words have one k-mer of all their words, and one k-mer is a tuple by itself. Stages that name an
    array more than once keep the optimizer from computing it more than once; their columns have names
    that df hasn't.
    """
    own = [c for c in df.columns if c != name]
    words, hashes, sorted_, repeated, runs, numbered, *bases = fresh(df, "words", "hashes", "sorted", "repeated", "runs", "numbered", *[f"base{b}" for b in range(BASES)])
    out = df.withColumn(words, split_words(F.coalesce(F.col(text), F.lit(""))))
    letters = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG_RUN, F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0))).otherwise(F.array(w))))
    units = F.when(F.exists(words, lambda w: F.length(w) > LONG_RUN), letters).otherwise(F.col(words))
    out = out.select(*df.columns, F.transform(units, lambda w: F.xxhash64(w)).alias(hashes))
    h, size = F.col(hashes), F.size(hashes)
    kmers = F.transform(F.slice(h, 1, size - (K - 1)), lambda x, i: _key(F.xxhash64(x, *[F.get(h, i + k) for k in range(1, K)]), i))
    short = F.array(_key(F.xxhash64(h), F.lit(0)))
    out = out.select(*df.columns, F.sort_array(F.when(size >= K, kmers).when(size > 0, short).otherwise(F.array().cast("array<bigint>"))).alias(sorted_))
    # Equal k-mers lie together, in text order. The first keeps its hash; later ones take one of hash and number.
    keys, n = F.col(sorted_), F.size(sorted_)
    out = out.withColumn(repeated, F.size(F.array_distinct(F.transform(keys, _hash))) < n)
    starts = F.filter(F.transform(keys, lambda x, i: F.when((i == 0) | (_hash(x) != F.coalesce(_hash(F.get(keys, i - 1)), F.lit(-1))), i)), lambda i: i.isNotNull())
    out = out.withColumn(runs, F.when(F.col(repeated), starts))
    at, n_runs = F.col(runs), F.size(runs)
    stop = lambda j: F.coalesce(F.get(at, j + 1), n)
    first = F.transform(at, lambda a: F.get(keys, a))
    later = F.flatten(F.transform(F.filter(F.transform(at, lambda a, j: F.struct(a.alias("a"), stop(j).alias("b"))), lambda r: r["b"] > r["a"] + 1), lambda r: F.transform(F.sequence(r["a"] + 1, r["b"] - 1), lambda i: _key(F.xxhash64(_hash(F.get(keys, i)), i - r["a"]), _place(F.get(keys, i))))))
    out = out.select(*df.columns, F.when(n_runs > 0, F.concat(first, later)).otherwise(keys).alias(numbered))
    # Each base's own order, and of it the two least from each turn up to the next.
    rehashed = lambda b: lambda x: _key(F.xxhash64(_hash(x), F.lit(b)), _place(x))
    for b, base in enumerate(bases):
        out = out.withColumn(base, F.sort_array(F.transform(numbered, rehashed(b))))
    out = out.select(*df.columns, *bases)
    least = lambda c: F.filter(c, lambda x, i: (i < 2) | (_turn(x) != F.coalesce(_turn(F.get(F.col(c), i - 2)), F.lit(-1))))
    out = out.select(*df.columns, *[F.when(F.size(c) > 0, least(c)).alias(c) for c in bases])

    def digits_of(two: Column, turn: Column) -> Column:
        """The digits of the two least from a turn on: a binary search over at most two keys a turn, then around the circle."""
        steps = F.array(*[F.lit(1 << k) for k in range(TURN_BITS + 1, -1, -1)])
        found = F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.coalesce(_turn(F.get(two, i + step - 1)) < turn, F.lit(False)), i + step).otherwise(i))
        x, y = F.get(two, F.pmod(found, F.size(two))), F.get(two, F.pmod(found + 1, F.size(two)))
        pair = F.when(_place(x) < _place(y), F.xxhash64(_hash(x), _hash(y))).when(_place(x) > _place(y), F.xxhash64(_hash(y), _hash(x))).otherwise(F.xxhash64(_hash(x)))
        return F.lpad(F.lower(F.hex(F.shiftrightunsigned(pair, 64 - 4 * DIGITS))), DIGITS, "0")

    turns = F.sequence(F.lit(0), F.lit(TURNS - 1))
    digits = [F.array_join(F.transform(turns, (lambda two: lambda t: digits_of(two, t))(F.col(c))), "") for c in bases]
    return out.select(*own, F.coalesce(F.when(F.size(bases[0]) > 0, F.concat(*digits)), F.lit("")).alias(name))


def likeness(a: str | Column, b: str | Column) -> Column:
    """The share of equal slots; two empty fingerprints are alike (1), one empty is not (0)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    slot = lambda x, i: F.substring(x, i, F.lit(DIGITS))
    equal = F.size(F.filter(F.sequence(F.lit(1), F.lit(SLOTS * DIGITS), F.lit(DIGITS)), lambda i: slot(a, i) == slot(b, i)))
    return F.when((a == "") | (b == ""), F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(equal / SLOTS).cast("double")


#: Blocks of ids are cut at so many sampled ids at most, so the cuts take at most half a megabyte; and how many ids are drawn for each.
MOST_BLOCKS, DRAWN = 65_536, 16
#: Null ids come first.
LEAST_ID = -(2**63)


def cuts_of(docs: DataFrame, block_rows: int) -> list[int]:
    """Ascending ids that cut docs into blocks of about block_rows rows; an id that floods the table comes more than once."""
    n = docs.count()
    parts = min(MOST_BLOCKS, max(1, n // block_rows))
    if parts == 1:
        return []
    drawn = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id")).sample(min(1.0, DRAWN * parts / n), 1).limit(4 * DRAWN * MOST_BLOCKS).collect()
    ids = sorted(r.id for r in drawn)
    return [ids[len(ids) * k // parts] for k in range(1, parts)] if ids else []


def _block(cuts: Column, doc_id: Column, h: Column) -> Column:
    """The block of a row by binary search over the cuts: how many are at most its id; rows of an id that is several cuts are spread over their blocks by h."""

    def count(passes):
        steps = F.array(*[F.lit(1 << k) for k in range(MOST_BLOCKS.bit_length() - 1, -1, -1)])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(passes(F.get(cuts, at + step - 1)), F.lit(False)), at + step).otherwise(at))

    least, most = count(lambda cut: cut < doc_id), count(lambda cut: cut <= doc_id)
    spread = least + 1 + F.floor(h / F.lit(2.0**63) * (most - least)).cast("int")
    return F.when(most - least < 2, most).otherwise(F.least(spread, most))


def with_next_text(docs: DataFrame, block_rows: int = 500) -> DataFrame:
    """doc_id, text (null: empty) of every row, and next_text of the next row by doc_id (null first); after the last comes the first.

    Rows of one id follow each other by a hash of their text. Rows are dealt once, into blocks of
    ids; a block's first row also goes to the block before, as the row that follows its last one.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    cuts = docs.sparkSession.range(1).select(F.from_json(F.lit(json.dumps(cuts_of(docs, block_rows))), "array<bigint>").alias("cuts"))
    rows = rows.crossJoin(F.broadcast(cuts))  # one row, of MOST_BLOCKS ids at most
    rows = rows.withColumn("block", _block(F.col("cuts"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)), F.col("h"))).drop("cuts")
    firsts = rows.groupBy("block").agg(F.min(F.struct("doc_id", "h")).alias("first"))  # a row a block, MOST_BLOCKS at most
    before = F.coalesce(F.lag("block").over(Window.orderBy("block")), F.max("block").over(Window.partitionBy()))
    firsts = firsts.select(F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"), before.alias("to"))
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("to").alias("block"), F.lit(True).alias("guest"))
    dealt = rows.join(F.broadcast(firsts), rows.doc_id.eqNullSafe(firsts.first_id) & (rows.h == firsts.first_h), "left")
    dealt = dealt.select("doc_id", "text", "h", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at"))
    dealt = dealt.select("doc_id", "text", "h", F.col("at.block").alias("block"), F.col("at.guest").alias("guest"))
    return dealt.withColumn("next_text", F.lead("text").over(in_block()))


def in_block():
    return Window.partitionBy("block").orderBy("guest", "doc_id", "h", "text")


def fingerprint_documents(docs: DataFrame, block_rows: int = 500) -> DataFrame:
    """Every row of docs: fingerprints of its text and of its edited text, whose last half is the next document's first part, and likenesses.

    A single row is its own next one, an empty table gives no rows. Empty and null texts have the empty
    fingerprint. Rows of one id follow each other by a hash of their text, so equal rows follow each
    other. Columns other than doc_id and text are not read. Very long texts are arrays of their words.
    """
    rows = with_next_text(docs, block_rows)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("n_chars", F.length("text").cast("long"))
    rows = with_fingerprint(rows.drop("next_text"), "text", "fingerprint")
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(in_block())).where(~F.col("guest"))
    rows = with_fingerprint(rows.select("doc_id", "n_chars", "edited", "fingerprint", "next_fingerprint"), "edited", "edited_fingerprint")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
