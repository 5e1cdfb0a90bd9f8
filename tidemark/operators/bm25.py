"""Sparse retrieval: a postings table and BM25."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import LOWER, UPPER, ascii_fold, document_tokens, search_tokens
from ..sources.scratch import dealt, written

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Index:
    """postings: doc_id, term, tf, dl; terms: term, df; stats: one row, n and avgdl."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def tokens_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, dl, tokens of each document; a null text is an empty one."""
    rows = dealt(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    tokens = rows.select("doc_id", document_tokens("text").alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"), "tokens")


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The postings of all terms: every document's tokens are counted in the task that reads it, then by document and term."""
    tokens = tokens_of(docs, doc_id, text)
    postings = tokens.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    return Index(postings, postings.groupBy("term").agg(F.count("*").alias("df")), tokens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf: a term repeated in a query counts as often."""
    return queries.select("query_id", F.explode(search_tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


#: Stands for a document as a whole among its terms; no token is empty.
WHOLE = ""
#: Distinct terms of all questions up to this many are broadcast, a short string each; beyond, the join is a shuffled one.
BROADCAST_TERMS = 200_000


def search_documents(docs: DataFrame, queries: DataFrame, k: int | None = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """search() of documents (doc_id, text) that have no index: one scan of the texts.

    Only terms that some question has leave the task that reads a document, and a row for the document
    as a whole. Those rows give the terms' document frequencies, the number of documents and their
    average length, over all documents.
    """
    asked = asked_terms(queries)
    distinct = asked.select("term").distinct().unionByName(queries.sparkSession.createDataFrame([(WHOLE,)], "term string"))
    if distinct.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        distinct = F.broadcast(distinct)
    occurring = tokens_of(docs, doc_id, text).select("doc_id", "dl", F.explode(F.array_append("tokens", F.lit(WHOLE))).alias("term"))
    postings = occurring.join(distinct, "term").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    # Lengths and counts are both taken on, and no filter parts the ways, so that the scan's one exchange serves the sums and the postings.
    terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("length"), F.sum("tf").alias("occurrences")).where("occurrences > 0")
    whole = lambda c: F.max(F.when(F.col("term") == WHOLE, c))
    stats = terms.agg(whole(F.col("df")).alias("n"), whole(F.col("length") / F.col("df")).alias("avgdl"))
    return _ranked(Index(postings, terms.select("term", "df"), stats), asked, k)


#: Of questions' weights, terms times questions, a task holds up to this many, 8 bytes each.
HELD_WEIGHTS = 4_000_000
#: Documents that meet the weights at a time: so many times the terms, and times the questions, are held.
SCORED_NUMBERS = 1_000_000


def lists_of(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of tokens of each row, and all tokens; a null row has none."""
    return pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64), tokens.flatten()


def counted(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, size, codes, tfs of rows (doc_id, tokens): how many tokens, and how often each of the terms (by position) is among them. Nothing is shuffled."""

    def count(batches):
        known = pa.array(terms, pa.string())
        for batch in batches:
            size, flat = lists_of(batch.column("tokens"))
            code = pc.fill_null(pc.index_in(flat, known), -1).to_numpy()
            has = np.flatnonzero(code >= 0)
            cells, tf = np.unique(np.repeat(np.arange(len(size)), size)[has] * len(terms) + code[has], return_counts=True)
            offsets = pa.array(np.searchsorted(cells, np.arange(len(size) + 1) * len(terms)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (cells % max(len(terms), 1), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), *lists], names=["doc_id", "size", "codes", "tfs"])

    ints = ArrayType(IntegerType())
    schema = StructType([tokens.schema["doc_id"], StructField("size", LongType()), StructField("codes", ints), StructField("tfs", ints)])
    return tokens.select("doc_id", "tokens").mapInArrow(count, schema)


def term_counts(tokens: DataFrame) -> DataFrame:
    """doc_id, dl, term, tf of rows (doc_id, dl, tokens), each in the batch that holds its document. Nothing is shuffled."""

    def count(batches):
        for batch in batches:
            size, flat = lists_of(batch.column("tokens"))
            coded = flat.dictionary_encode()
            kinds = max(len(coded.dictionary), 1)
            cells, tf = np.unique(np.repeat(np.arange(len(size)), size) * kinds + coded.indices.to_numpy(), return_counts=True)
            own = pa.array(cells // kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("dl").take(own), coded.dictionary.take(pa.array(cells % kinds)), pa.array(tf, pa.int64())], names=["doc_id", "dl", "term", "tf"])

    schema = StructType([tokens.schema["doc_id"], tokens.schema["dl"], StructField("term", StringType()), StructField("tf", LongType())])
    return tokens.select("doc_id", "dl", "tokens").mapInArrow(count, schema)


def best_scored(rows: DataFrame, queries: list, query_type, weights: np.ndarray, k: int, share=None) -> DataFrame:
    """query_id, doc_id, score of the k best documents of each question, and of some more, of rows as counted() gives them that share a term with it.

    A score, rounded to 9 digits, sums a row's shares share(tf, size) of its terms (without: 1 each) by
    their weights, terms by questions. A batch of documents is one product of matrices, of which each
    question's k best are left; ties go to the least doc_id.
    """

    def run(batches):
        step = max(1, SCORED_NUMBERS // max(1, *weights.shape))
        for batch in batches:
            order = np.empty(batch.num_rows, np.int64)
            order[pc.array_sort_indices(batch.column("doc_id"), null_placement="at_start").to_numpy()] = np.arange(batch.num_rows)
            found = []
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                m, codes = lists_of(part.column("codes"))
                tf = part.column("tfs").flatten().to_numpy()
                own = np.repeat(np.arange(part.num_rows), m)
                held = np.zeros((part.num_rows, len(weights)))
                held[own, codes.to_numpy()] = 1 if share is None else share(tf, np.repeat(part.column("size").to_numpy(), m))
                score = np.round(held @ weights, 9)
                least = np.partition(score, part.num_rows - k, axis=0)[part.num_rows - k] if part.num_rows > k else 0
                d, q = np.nonzero((score > 0) & (score >= least))
                found.append((q, d + at, score[d, q]))
            q, d, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            by = np.lexsort((order[d], -score, q))
            q, d, score = q[by], d[by], score[by]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield pa.RecordBatch.from_arrays([pc.take(asked, pa.array(q[best])), pc.take(batch.column("doc_id"), pa.array(d[best])), pa.array(score[best])], names=["query_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    asked = pa.array(queries, to_arrow_type(query_type))
    schema = StructType([StructField("query_id", query_type), rows.schema["doc_id"], StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def few_asked(asked: DataFrame, term: str) -> tuple[list, list, list] | None:
    """Rows of asked (query_id, term, ...), its questions and its terms in order; None where the terms times the questions, or the rows, are more than HELD_WEIGHTS."""
    rows = asked.limit(HELD_WEIGHTS // 8 + 1).collect()
    queries, terms = sorted({r.query_id for r in rows}, key=lambda q: (q is not None, q)), sorted({r[term] for r in rows})
    return (rows, queries, terms) if len(rows) <= HELD_WEIGHTS // 8 and len(queries) * len(terms) <= HELD_WEIGHTS else None


def search_counted(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """search_documents() as a part of larger plans, where Spark may not see that one scan of the texts serves them all.

    How often each document has each of the questions' terms is counted where it is read, and stored, a
    row each; frequencies, lengths and scores come from there. Many questions go to search_documents().
    """
    asked = asked_terms(queries)
    few = few_asked(asked, "term")
    if few is None:
        return search_documents(docs, queries, k, doc_id, text)
    rows, ids, terms = few
    kept = written(counted(tokens_of(docs, doc_id, text), terms), "counted-terms")
    stats = kept.agg(F.count("*").alias("n"), F.avg("size").alias("avgdl")).first()
    df = np.zeros(len(terms))
    for r in kept.select(F.explode("codes").alias("code")).groupBy("code").count().collect():
        df[r[0]] = r[1]
    idf = np.maximum(np.log((stats.n - df + 0.5) / (df + 0.5)), 1e-6)
    weights = np.zeros((len(terms), len(ids)))
    place, column = {t: n for n, t in enumerate(terms)}, {q: n for n, q in enumerate(ids)}
    for r in rows:
        weights[place[r.term], column[r.query_id]] = r.qtf * idf[place[r.term]]
    avgdl = stats.avgdl or 1.0
    found = best_scored(kept, ids, queries.schema["query_id"].dataType, weights, k, lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)))
    ranked = found.select("query_id", "doc_id", F.col("score").alias("bm25"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), "doc_id")).cast("long"))
    return ranked.where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int | None = 20) -> DataFrame:
    """query_id, doc_id, bm25, rank of the k best documents of each query (query_id, text); None: of all that match.

    A term repeated in a query counts as often; the inverse document frequency is at least 1e-6. Only the
    questions' terms are taken from the index, by a join that Spark broadcasts where it finds them few.
    """
    return _ranked(index, asked_terms(queries), k)


def _ranked(index: Index, asked: DataFrame, k: int | None) -> DataFrame:
    hits = index.postings.join(asked.join(index.terms, "term").crossJoin(F.broadcast(index.stats)), "term")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    tf = F.col("tf").cast("double")
    weight = F.col("qtf") * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 9).alias("bm25"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), "doc_id")).cast("long"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def like_search(docs: DataFrame, pattern: str, limit: int, text: str = "text", newest: str = "doc_id") -> DataFrame:
    """The fallback: substring match, cases of A to Z apart, % and _ of the pattern being wildcards and nothing an escape; newest first."""
    folded = pattern.translate({ord(u): low for u, low in zip(UPPER, LOWER)})
    found = F.like(ascii_fold(text), F.lit(f"%{folded}%"), F.lit("\x00"))
    return docs.where(found).orderBy(F.desc(newest)).limit(limit)
