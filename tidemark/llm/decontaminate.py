"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of each window of `length` words the least hash of its k-grams of words is the fingerprint, so
any span of `length` words that a document and an item share gives both the same one. Document
positions whose fingerprint some item has are extended to the whole window and compared word
by word; windows that pass mark their words as hit.

Documents are read once where the items' windows are few enough to broadcast (their number is
counted first); texts aren't shuffled then. Beyond that, a shuffled join of fingerprints leaves
the documents that share one, and only these are shuffled and compared. Everything after is by
text, so that copies are looked at once; documents that hold the same windows share one list of
items.

Null and empty texts have no words and no hits. Items of fewer than `length` words are one
window of all their words. Repeated documents each get their row; repeated items count once by
id, and an item without id marks words but is in no list. Other columns are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII that is no letter and no digit.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LENGTH, GRAM = 10, 5
#: Windows of items, and texts with hits, up to this many rows are broadcast: 200 bytes each at most but for long words.
BROADCAST_ROWS = 200_000


def word_list(text: str) -> Column:
    """The words of a text, A to Z in lower case."""
    return _inner(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BETWEEN))[0]


def word_count(text: str) -> Column:
    return _inner(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN))[1].cast("long")


def _inner(parts: Column) -> tuple[Column, Column]:
    """The parts of a split text without the empty ones, which only its ends can have, and how many there are."""
    first, last = (F.when(F.element_at(parts, k) == "", 1).otherwise(0) for k in (1, -1))
    n = F.greatest(F.size(parts) - first - last, F.lit(0))
    return F.slice(parts, first + 1, n), n


def with_fingerprints(df: DataFrame, lengths: list[int], gram: int = GRAM) -> DataFrame:
    """df (words) with fps: for each length in turn, the fingerprint of every window of so many words."""

    def spread(of: str, n: int, merge) -> Column:
        """merge() of each element and the n - 1 after it; what begins too late for that is cut off later."""
        return F.transform(of, lambda x, i: merge(x, *[F.get(of, i + j) for j in range(1, n)]))

    def within(fps: Column, length: int) -> Column:
        return F.slice(fps, 1, F.greatest(F.size("words") - (length - 1), F.lit(0)))

    for k in sorted({min(gram, n) for n in lengths}):
        df = df.withColumn(f"grams_{k}", spread("words", k, F.xxhash64))
    parts = []
    for n in lengths:
        k = min(gram, n)
        width = n - k + 1
        parts.append(within(spread(f"grams_{k}", width, F.least) if width > 1 else F.col(f"grams_{k}"), n))
    return df.withColumn("fps", F.concat(*parts)).drop(*[f"grams_{k}" for k in range(gram + 1)])


def placed(lengths: list[int]) -> tuple[Column, Column]:
    """Of a position in fps (`at`): the length of its window, and where it begins."""
    length, start, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for n in reversed(lengths):
        begins = reduce(lambda a, b: a + b, [F.greatest(F.size("words") - (m - 1), F.lit(0)) for m in lengths[: lengths.index(n)]], before)
        length = F.when(F.col("at") >= begins, F.coalesce(length, F.lit(n))).otherwise(length)
        start = F.when(F.col("at") >= begins, F.coalesce(start, F.col("at") - begins)).otherwise(start)
    return length, start


def windows_at(df: DataFrame, lengths: list[int], among: DataFrame | None = None) -> DataFrame:
    """A row for each window of df's words: its start, length, fingerprint and text; among: fingerprints, the only ones wanted."""
    # The outer form: Spark would push a test of size(fps) below it, and with it the lists' whole computation.
    rows = df.select(*df.columns, F.posexplode_outer("fps").alias("at", "fp")).drop("fps")
    if among is not None:
        rows = rows.join(F.broadcast(among), "fp", "left_semi")
    length, start = placed(lengths)
    rows = rows.withColumn("length", length).withColumn("start", start)
    return rows.withColumn("window", F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ")).drop("words", "at")


def item_windows(items: DataFrame, length: int = LENGTH) -> tuple[list[int], DataFrame]:
    """The lengths of the windows of items (item_id, text), and item_id, fp, window (words joined by a space) of each."""
    words = items.select("item_id", word_list("text").alias("words")).where(F.size("words") > 0)
    lengths = sorted((r.n for r in words.select(F.least(F.size("words"), F.lit(length)).alias("n")).distinct().collect()), reverse=True)
    found = [windows_at(with_fingerprints(words.where(F.size("words") >= n if n == length else F.size("words") == n), [n]), [n]).select("item_id", "fp", "window") for n in lengths]
    return lengths, reduce(DataFrame.unionByName, found) if found else items.select("item_id", F.lit(0).cast("long").alias("fp"), F.lit("").alias("window")).where("false")


def shared_windows(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """key, start, length, window of the occurrences in docs (key, text) of windows (fp, window; distinct)."""
    def marked(d):
        return with_fingerprints(d.select("key", word_list("text").alias("words")), lengths)

    fps = windows.select("fp").distinct()
    if windows.count() <= BROADCAST_ROWS:
        return windows_at(marked(docs), lengths, fps).join(F.broadcast(windows.select("window")), "window").select("key", "start", "length", "window")
    selected = marked(docs).select("key", F.explode_outer(F.array_distinct("fps")).alias("fp"))
    sharing = selected.join(fps, "fp").select("key").distinct()
    return windows_at(marked(docs.join(sharing, "key", "left_semi")), lengths).join(windows, ["fp", "window"]).select("key", "start", "length", "window")


def covered(spans: Column) -> Column:
    """How many positions lie in spans, sorted (start, length)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def take(seen, span):
        end = F.greatest(seen["end"], span["start"] + span["length"])
        return F.struct(end.alias("end"), (seen["n"] + end - F.greatest(seen["end"], span["start"])).alias("n"))

    return F.aggregate(spans, zero, take, lambda seen: seen["n"])


def decontaminate(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs (doc_id, text), held against items (item_id, text)."""
    texts = docs.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("key"))
    lengths, occurring = item_windows(items, length)
    occurring = materialise(occurring.distinct(), "item-windows")
    if lengths:
        hits = shared_windows(texts.where("text is not null").select("key", "text"), occurring.select("fp", "window").distinct(), lengths)
    else:
        hits = texts.select("key", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("window")).where("false")
    by_text = hits.distinct().groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_sort(F.collect_set("window")).alias("windows"))
    by_text = materialise(by_text.select("key", covered(F.col("spans")).alias("n_hit"), "windows", F.sha2(F.array_join("windows", "\n"), 256).alias("held")), "texts-with-hits")
    lists = by_text.groupBy("held").agg(F.any_value("windows").alias("windows")).select("held", F.explode("windows").alias("window"))
    lists = lists.join(occurring.select("window", F.col("item_id").cast("string").alias("item")).distinct(), "window").groupBy("held").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = by_text.select("key", "n_hit", "held").join(lists.select("held", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "held").drop("held")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    counted = texts.select("doc_id", "key", word_count("text").alias("n_words"))
    none = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)}
    own = [F.coalesce(F.col(c), other).alias(c) for c, other in none.items()]
    return counted.join(found, "key", "left").select("doc_id", "n_words", *own, (F.coalesce("n_hit", none["n_hit"]) > 0).alias("contaminated"))


#: The same by comparing every window of every document with every item's windows.
SQL = r"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from {docs}),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from {items}),
iw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') as t from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from i where len(w) > 0)),
dw as (select doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') as t from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from iw) where len(w) >= n)),
h as (select doc_id, s, dw.n, item_id from dw join iw using (t)),
hw as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from h) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct doc_id, item_id::varchar as x from h) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (doc_id) left join it using (doc_id)"""
