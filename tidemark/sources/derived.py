"""What is derived from facts when they are written: postings, blocking keys and sketches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_tokens
from ..operators.bm25 import Index, search, term_counts, tokens_of
from .scratch import dealt
from .store import View, Write, day_of

#: Random projections of the stored vectors' signatures.
BITS = 512
#: Terms, keys or ids up to this many go into a scan as a list, where file statistics skip what has none of them; more are joined.
LISTED = 5_000


def signature_of(vector: str | Column) -> Column:
    """On which sides of BITS random planes a vector lies, as array<long>: the more bits two have in common, the smaller their angle.

    The planes are the same for one number of dimensions, and blind to what all non-negative vectors have in common.
    """

    @F.pandas_udf("array<long>")
    def signed(vectors: pd.Series) -> pd.Series:
        return pd.Series(_sides(np.stack(vectors)) if len(vectors) else [], dtype="object")

    return signed(vector)


def _sides(v: np.ndarray) -> list[np.ndarray]:
    planes = np.random.default_rng(v.shape[1]).normal(size=(BITS, v.shape[1]))
    return list(np.packbits(v @ (planes - planes.mean(1, keepdims=True)).T > 0, axis=1).view(np.int64))


def keys_of(sketches: DataFrame, least: float) -> DataFrame:
    """key, id, seq: entities, and tokens first in a fixed order, as many as two sets of Jaccard `least` or more share one of."""
    m = F.size("tokens")
    order = F.transform(F.sort_array(F.transform("tokens", lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t")))), lambda x: F.concat(F.lit("t:"), x["t"]))
    first = F.slice(order, 1, F.greatest(m - F.ceil(F.lit(least) * m).cast("int") + 1, F.lit(0)))
    entities = F.transform(F.array_distinct(F.coalesce("entity_ids", F.array().cast("array<string>"))), lambda e: F.concat(F.lit("e:"), e))
    # Outer, as Spark guards an inner one by a filter that makes all keys once more.
    return sketches.select("id", "seq", F.explode_outer(F.concat(entities, first)).alias("key")).where("key is not null")


def sketches_of(facts: DataFrame, embedder) -> DataFrame:
    """Token set and vector of each fact, with what decides whether it is active."""
    own = ["id", "seq", content_tokens(F.coalesce("content", F.lit(""))).alias("tokens"), "entity_ids", "effective_at", "deprecated"]
    if not hasattr(embedder, "vectors"):
        return facts.select(*own, embedder("content").alias("v")).withColumn("signature", signature_of("v"))

    @F.pandas_udf("struct<v: array<float>, signature: array<long>>")
    def both(texts: pd.Series) -> pd.DataFrame:
        v = embedder.vectors(texts)
        return pd.DataFrame({"v": list(v), "signature": _sides(v)})

    # In one function, as Spark would chain two and embed the text for each.
    sketched = facts.select(*own, both(embedder.prepared("content")).alias("sketch"))
    return sketched.select("*", "sketch.v", "sketch.signature").drop("sketch")


def add_facts(write: Write, facts: DataFrame, embedder, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Appends facts and all that is derived from them: the facts, keys and sketches as they are stored."""
    stored = write.append("facts", facts.withColumn("since", day_of(F.least("effective_at", "created_at"))))
    read = dealt(stored)
    tokens = tokens_of(read.select(F.struct("id", "seq").alias("doc_id"), F.col("content").alias("text")))
    postings = write.append("postings", term_counts(tokens).select("term", "doc_id.id", "doc_id.seq", "tf", "dl"))
    write.count(facts=stored.count(), tokens=postings.agg(F.sum("tf")).first()[0] or 0)
    sketches = write.append("sketches", sketches_of(read, embedder))
    return stored, write.append("keys", keys_of(sketches, least)), sketches


def bury(write: Write, ids: DataFrame, until: int) -> None:
    """No version of these ids (a column id) up to the number `until` counts any more."""
    dead = write.live("facts").join(ids, "id", "left_semi").where(F.col("seq") <= until)
    sizes = tokens_of(dead.select(F.col("id").alias("doc_id"), F.col("content").alias("text"))).agg(F.count("*").alias("n"), F.sum("dl").alias("length")).first()
    write.count(facts=-sizes.n, tokens=-(sizes.length or 0))
    write.append("tombstones", ids.select("id", F.lit(until).alias("seq")))


def listed(rows: DataFrame, column: str, wanted: DataFrame, among: str) -> DataFrame:
    """Rows whose column is one of wanted's: as a list that is pushed into the scan, or by a join if there are many."""
    few = wanted.select(among).distinct().limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        return rows.where(F.col(column).isin([r[0] for r in few])) if few else rows.where("false")
    return rows.join(wanted.select(F.col(among).alias(column)).distinct(), column, "left_semi")


def stored_index(view: View, asked: DataFrame) -> Index:
    """The postings of the terms that are asked for (a column term), their document frequencies, and the store's statistics. No content is read."""
    postings = view.live("postings", listed(view.log("postings"), "term", asked, "term")).select(F.col("id").alias("doc_id"), "term", "tf", "dl")
    n, tokens = (view.counts.get(c, 0) for c in ("facts", "tokens"))
    stats = view.spark.createDataFrame([(n, tokens / n if n else 0.0)], "n long, avgdl double")
    return Index(postings, postings.groupBy("term").agg(F.count("*").alias("df")), stats)


def search_stored(view: View, queries: DataFrame, k: int | None = 20) -> DataFrame:
    """bm25.search over the stored postings: query_id, doc_id, bm25, rank."""
    from ..operators.bm25 import asked_terms

    return search(stored_index(view, asked_terms(queries)), queries, k)


def vectors_of(view: View) -> DataFrame:
    """doc_id, embedding, signature of every live fact."""
    return view.live("sketches").select(F.col("id").alias("doc_id"), F.col("v").alias("embedding"), "signature")
