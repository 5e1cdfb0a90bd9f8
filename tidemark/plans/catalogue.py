"""Registered queries of the engine's operators over the standard tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embed, text
from ..operators import bm25, conflict, evaluate, graph, retrieve, substring, temporal
from ..schema import EngineConfig
from ..sources import derived, store
from ..sources.scratch import dealt, new_folder
from .views import ALL_RELATIONS, FACTS, RELATIONS, STATE, all_entities, all_relations, entities, facts, relations, table, valid_sql

AT, START, END, LATE = "2024-01-15 00:00:00", "2024-01-10 00:00:00", "2024-01-20 00:00:00", "2024-01-29 00:00:00"
TS = {k: f"timestamp '{v}'" for k, v in (("at", AT), ("start", START), ("end", END), ("late", LATE))}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def shown() -> list:
    return ["id", "content", stamp("created_at")]


SHOWN_SQL = "id, content, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at"

# -- temporal views


@query(f"with {STATE} select {SHOWN_SQL} from state where {valid_sql(TS['at'])}")
def active_at(spark, sf):
    return temporal.active_at(facts(spark, sf), AT).select(*shown())


@query(f"with {FACTS} select {SHOWN_SQL} from facts where not deprecated")
def list_active(spark, sf):
    return temporal.list_facts(facts(spark, sf)).select(*shown())


@query(f"with {FACTS} select {SHOWN_SQL}, deprecated, replaced_by from facts where id = 42")
def recall(spark, sf):
    return facts(spark, sf).where(F.col("id") == 42).select(*shown(), "deprecated", "replaced_by")


@query(f"with {STATE} select {SHOWN_SQL} from state where effective_at between {TS['start']} and {TS['end']} and (not deprecated or coalesce(ended > {TS['start']}, true))")
def effective_between(spark, sf):
    return temporal.effective_between(facts(spark, sf), START, END).select(*shown())


@query(f"with {FACTS} select {SHOWN_SQL}, deprecated from facts where user_id = 7 order by facts.created_at desc, id desc limit 50")
def replay(spark, sf):
    return temporal.replay(facts(spark, sf), F.array_contains("entity_ids", "u7"), 50).select(*shown(), "deprecated")


@query(f"with {FACTS} select {SHOWN_SQL} from facts where user_id = 7 and facts.created_at <= {TS['at']}")
def knowledge_at(spark, sf):
    return temporal.knowledge_at(facts(spark, sf), AT, F.array_contains("entity_ids", "u7")).select(*shown())


@query(f"with {FACTS} select event_type, count(*) as n from facts where not deprecated and effective_at <= {TS['late']} group by event_type")
def is_effective(spark, sf):
    return facts(spark, sf).where(temporal.is_effective(LATE)).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""with {FACTS}, v as (select id, user_id, event_type, row_number() over w as version, lead(facts.created_at) over w as valid_to from facts window w as (partition by user_id, event_type order by facts.created_at, id))
select id, version, strftime(valid_to, '%Y-%m-%d %H:%M:%S') as valid_to from v""")
def version_chain(spark, sf):
    return temporal.version_chain(facts(spark, sf), ["user_id", "event_type"]).select("id", "version", stamp("valid_to"))


@query(f"with {STATE} select count(*) as n, count(ended) as n_ended, count(*) filter (where deprecated and replaced_by is null) as n_gone, count(*) filter (where replaced_by is not null and ended is null) as n_dangling from state")
def successors(spark, sf):
    s = temporal.with_successor(facts(spark, sf))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return s.agg(F.count("*").alias("n"), F.count("successor_id").alias("n_ended"), count(F.col("deprecated") & F.col("replaced_by").isNull(), "n_gone"), count(F.col("replaced_by").isNotNull() & F.col("successor_id").isNull(), "n_dangling"))


# -- text


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in dict.fromkeys(words))


def content_sql(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: len(x) > 1 and x not in ({quoted(text.TOPIC_STOP)})))"


def search_sql(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: len(x) > 2 and x not in ({quoted(text.SEARCH_STOP)}))"


def overlap_sql(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: len(x) > 2 and x not in ({quoted(text.OVERLAP_STOP)})))"


@query(f"with t as (select doc_id, list_sort({content_sql('text')}) as t from documents) select doc_id, len(t) as n, md5(array_to_string(t, ' ')) as digest from t")
def content_tokens(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.array_sort(text.content_tokens("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f"select item_id, array_to_string({search_sql('text')}, ' ') as tokens from benchmark")
def search_tokens(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(text.search_tokens("text"), " ").alias("tokens"))


DOC_TOKENS = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}\\p{Co}]+')"


@query(f"select doc_id, len({DOC_TOKENS}) as n, md5(array_to_string({DOC_TOKENS}, ' ')) as digest from documents")
def document_tokens(spark, sf):
    t = dealt(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", text.document_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("select conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as normal from conversations")
def normalise(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.normalise("text").alias("normal"))


@query("with g as (select item_id, unnest(list_transform(range(1, len(lower(text)) - 1), lambda i: substr(lower(text), i, 3))) as gram from benchmark) select gram, count(*) as n, count(distinct item_id) as n_items from g group by gram")
def ngram_features(spark, sf):
    g = table(spark, sf, "benchmark").select("item_id", F.explode(text.char_ngrams(F.lower("text"), 3)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"))


@query("""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from benchmark)
select word, list_reduce(list_concat([293], list_transform(range(1, len(word) + 1), lambda i: ascii(substr(word, i, 1)))), lambda h, b: (xor(h, b) * 435) & 511)::bigint as bucket from w""")
def fnv_bucket(spark, sf):
    w = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", embed.fnv_bucket("word", 512).cast("long").alias("bucket"))


BM25 = f"""
lens as (select doc_id, len({DOC_TOKENS}) as dl from documents), stats as (select count(*) as n, avg(dl) as avgdl from lens),
post as (select doc_id, term, count(*) as tf from (select doc_id, unnest({DOC_TOKENS}) as term from documents) group by 1, 2),
dfs as (select term, count(*) as df from post group by 1),
qt as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({search_sql('text')}) as term from benchmark) group by 1, 2),
sc as (select query_id, doc_id, round(sum(qtf * greatest(ln((n - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 9) as bm25
  from qt join post using (term) join dfs using (term) join lens using (doc_id), stats group by 1, 2),
sparse as (select query_id, doc_id, bm25, row_number() over (partition by query_id order by bm25 desc, doc_id) as rank from sc)
"""


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _sparse(spark, sf, k):
    return bm25.search_counted(table(spark, sf, "documents"), _questions(spark, sf), k)


@query(f"with {BM25} select query_id, doc_id, round(bm25, 6) as bm25, rank from sparse where rank <= 10")
def bm25_topk(spark, sf):
    return bm25.search_documents(table(spark, sf, "documents"), _questions(spark, sf), 10).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), "rank")


@query(f"with {BM25} select n, round(avgdl, 6) as avgdl, (select count(*) from dfs) as n_terms, (select sum(tf)::bigint from post) as n_tokens from stats")
def postings_stats(spark, sf):
    i = bm25.build_index(table(spark, sf, "documents"))
    return i.stats.select("n", F.round("avgdl", 6).alias("avgdl")).crossJoin(i.terms.agg(F.count("*").alias("n_terms"))).crossJoin(i.postings.agg(F.sum("tf").alias("n_tokens")))


@query("select doc_id from documents where text ilike '%license%' order by doc_id desc limit 20")
def like_fallback(spark, sf):
    return bm25.like_search(table(spark, sf, "documents"), "license", 20).select("doc_id")


# -- dense and hybrid

DENSE = """
nearest as (select q.vec_id as query_id, v.vec_id as doc_id, round(list_sum(list_transform(range(1, 65), lambda i: v.embedding[i]::double * q.embedding[i]::double)), 6) as sim
  from embeddings v, embeddings q where {where}),
dense as (select query_id, doc_id, sim, row_number() over (partition by query_id order by sim desc, doc_id desc) as rank from nearest)
"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query(f"with {DENSE.format(where='q.vec_id % 100 = 0')} select query_id, doc_id, sim, rank from dense where rank <= 10")
def cosine_topk(spark, sf):
    v = _vectors(spark, sf)
    return retrieve.dense_candidates(v, v.where(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "query_id"), 10)


DENSE_ASKED = DENSE.format(where="q.vec_id in (select item_id from benchmark)")
FUSED = f"""{BM25}, {DENSE_ASKED},
fused as (select query_id, doc_id, coalesce(1e0 / (60 + s.rank), 0) + coalesce(1e0 / (60 + d.rank), 0) as score, s.rank as sr, d.rank as dr, d.sim
  from (select * from sparse where rank <= 15) s full join (select * from dense where rank <= 15) d using (query_id, doc_id))
"""
DOC_FACTS = """
df0 as (select doc_id as id, timestamp '2024-01-01' + to_days((doc_id % 60)::integer) as effective_at, timestamp '2024-01-02' + to_days((doc_id % 60)::integer) as created_at,
  doc_id % 7 = 0 as deprecated, case when doc_id % 14 = 7 then doc_id + 1 end as replaced_by from documents),
state as (select f.*, r.created_at as ended from df0 f left join df0 r on f.replaced_by = r.id)
"""


def _doc_facts(spark, sf, *more):
    day = lambda start: F.lit(start).cast("timestamp_ntz") + F.make_dt_interval((F.col("doc_id") % 60).cast("int"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), day("2024-01-01").alias("effective_at"), day("2024-01-02").alias("created_at"), (F.col("doc_id") % 7 == 0).alias("deprecated"),
        F.when(F.col("doc_id") % 14 == 7, F.col("doc_id") + 1).alias("replaced_by"), F.array("source").alias("entity_ids"), "source", *more,
    )


def _fused(spark, sf):
    v = _vectors(spark, sf)
    asked = v.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    return retrieve.fuse(_sparse(spark, sf, 15), retrieve.dense_candidates(v, asked, 15))


@query(f"with {FUSED} select query_id, doc_id, round(score, 9) as score, sr as sparse_rank, dr as dense_rank from fused")
def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "doc_id", F.round("score", 9).alias("score"), "sparse_rank", "dense_rank")


def _ranked_sql(where: str, score: str = "round(score, 9)", more: str = "") -> str:
    return f"""with {FUSED}, {DOC_FACTS}, adj as (select query_id, doc_id, {score} as score, sr, dr from fused join state on doc_id = id where {where}),
ranked as (select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, sr nulls last, dr nulls last) as rank from adj) select * from ranked where rank <= 5"""


def _shown(df):
    return df.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


NOW = "timestamp '2024-02-01'"
FRESH = f"score * (1 + 0.5e0 * exp(-greatest(0e0, (epoch({NOW}) - epoch(effective_at)) / 86400e0) / 30e0))"


@query(_ranked_sql(valid_sql(TS["at"]), "score"))
def hybrid_at(spark, sf):
    return _shown(retrieve.hybrid(_fused(spark, sf), _doc_facts(spark, sf), 5, at=AT))


@query(_ranked_sql(valid_sql(NOW), f"round({FRESH}, 9)"))
def hybrid_now_fresh(spark, sf):
    return _shown(retrieve.hybrid(_fused(spark, sf), _doc_facts(spark, sf), 5, EngineConfig(freshness_weight=0.5), now="2024-02-01 00:00:00"))


@query(_ranked_sql("true", f"round(case when {valid_sql(NOW)} then {FRESH} else score * 0.02e0 end, 9)"))
def hybrid_demote(spark, sf):
    return _shown(retrieve.hybrid(_fused(spark, sf), _doc_facts(spark, sf), 5, EngineConfig(freshness_weight=0.5, current_state_demote=True), now="2024-02-01 00:00:00"))


@query(_ranked_sql(f"effective_at <= {TS['at']}", "score"))
def ablation_no_deprecation(spark, sf):
    """The search as if nothing was ever replaced."""
    kept = _doc_facts(spark, sf).withColumn("deprecated", F.lit(False)).withColumn("replaced_by", F.lit(None).cast("long"))
    return _shown(retrieve.hybrid(_fused(spark, sf), kept, 5, at=AT))


@query(_ranked_sql(f"{valid_sql(TS['at'])} and score >= 0.014e0 and id in (select doc_id from documents where source in ('src1', 'src2', 'src3'))", "score"))
def entity_filter(spark, sf):
    return _shown(retrieve.hybrid(_fused(spark, sf), _doc_facts(spark, sf), 5, at=AT, min_score=0.014, entities=["src1", "src2", "src3"]))


@query(f"""with {DENSE_ASKED}, r as (select query_id, doc_id, round(1e0 / (60 + rank) + 0.5e0 * sim, 9) as score from dense where rank <= 10)
select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, doc_id) as rank from r""")
def rerank(spark, sf):
    v = _vectors(spark, sf)
    asked = v.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    found = retrieve.dense_candidates(v, asked, 10).withColumn("score", 1 / (60 + F.col("rank")))
    return _shown(retrieve.rerank(found))


@query("""with g as (select distinct item_id, unnest(list_concat(list_concat(list_concat(
    list_transform(range(1, len(t) + 1), lambda i: substr(t, i, 1)), list_transform(range(1, len(t)), lambda i: substr(t, i, 2))),
    list_transform(range(1, len(t) - 1), lambda i: substr(t, i, 3))), list_transform(list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda w: len(w) > 1), lambda w: concat('w:', w)))) as feature
  from (select item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as t from benchmark))
select feature, count(*) as df, round(ln(((select count(*) from benchmark) + 1e0) / (count(*) + 1e0)) + 1, 6) as idf from g group by feature""")
def fit_idf(spark, sf):
    return embed.fit_idf(table(spark, sf, "benchmark"), "text").select("feature", "df", F.round("idf", 6).alias("idf"))


IDF_DOCUMENTS = ORACLE_SQL["fit_idf"].replace("benchmark", "documents").replace("item_id", "doc_id")


@query(IDF_DOCUMENTS)
def fit_idf_documents(spark, sf):
    return embed.fit_idf(table(spark, sf, "documents"), "text").select("feature", "df", F.round("idf", 6).alias("idf"))


# -- conflicts

TOKEN_FACTS = f"tf as (select *, {content_sql('content')} as tk from facts)"
SIM, JAC = "len(list_intersect(a.tk, b.tk)) / sqrt(len(a.tk)::double * len(b.tk))", "len(list_intersect(a.tk, b.tk))::double / len(list_distinct(list_concat(a.tk, b.tk)))"
JUDGE = "case when jac < 0.2e0 then 0.1e0 * sim else sim * (0.4e0 + 0.6e0 * least(2 * jac, 1e0)) end"
SEMANTIC = "case when jac >= 0.85e0 then 0.1e0 * sim when jac >= 0.7e0 and sim >= 0.8e0 then sim when jac >= 0.2e0 then sim * (0.4e0 + 0.6e0 * least(2 * jac, 1e0)) else 0.1e0 * sim end"


def _conflict_sql(judge: str) -> str:
    return f"""with {FACTS}, {TOKEN_FACTS}, pairs as (select a.id as old_id, b.id as new_id, b.seq as new_seq, {SIM} as sim, {JAC} as jac
  from tf a join tf b on a.user_id = b.user_id and a.event_type = b.event_type and a.seq < b.seq),
scored as (select old_id, new_id, new_seq, {judge} as score from pairs), found as (select * from scored where score >= 0.55e0)"""


def _typed(spark, sf):
    """Facts whose one entity is the user's event type."""
    return facts(spark, sf).withColumn("entity_ids", F.slice("entity_ids", 2, 1))


@query(_conflict_sql(JUDGE) + " select old_id, new_id, round(score, 6) as score from found")
def conflict_pairs(spark, sf):
    return conflict.conflicts(_typed(spark, sf), by="entities").select("old_id", "new_id", F.round("score", 6).alias("score"))


@query(_conflict_sql(SEMANTIC) + " select old_id, new_id, round(score, 6) as score from found")
def semantic_judge(spark, sf):
    return conflict.conflicts(_typed(spark, sf), judge=conflict.semantic_judge, by="entities").select("old_id", "new_id", F.round("score", 6).alias("score"))


@query(_conflict_sql(JUDGE) + " select old_id, arg_min(new_id, new_seq) as new_id from found group by old_id")
def resolve_batch(spark, sf):
    return conflict.resolve(conflict.conflicts(_typed(spark, sf), by="entities")).select("old_id", "new_id")


@query(f"""with t as (select conv_id * 1000 + turn as id, {content_sql('text')} as tk from conversations),
pairs as (select a.id as old_id, b.id as new_id, {SIM} as sim, {JAC} as jac from t a join t b on a.id < b.id and list_has_any(a.tk, b.tk))
select old_id, new_id, round({JUDGE}, 6) as score from pairs where jac >= 0.15e0 and {JUDGE} >= 0.02e0""")
def conflict_tokens(spark, sf):
    c = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    f = c.select("id", F.col("id").alias("seq"), F.col("text").alias("content"), F.array().cast("array<string>").alias("entity_ids"))
    return conflict.conflicts(f, threshold=0.02, related=0.15, by="tokens").select("old_id", "new_id", F.round("score", 6).alias("score"))


def embedder_conflicts(spark, sf):
    """Scored by the embedder, as the facade does it; tests hold it against a plain computation."""
    return conflict.conflicts(_typed(spark, sf), by="entities", embedder=embed.hashing_embedder()).select("old_id", "new_id", F.round("score", 4).alias("score"))


def hashing_embed(spark, sf):
    """The nonzero buckets of every whole document; tests hold the vectors against a plain computation."""
    v = dealt(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", embed.hashing_embedder()("text").alias("v"))
    # Outer, as Spark guards an inner one by a filter that embeds every text once more.
    return v.select("doc_id", F.posexplode_outer("v").alias("bucket", "weight")).where("weight <> 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("weight").cast("double"), 5).alias("weight"))


@query(f"""with {FACTS}, {TOKEN_FACTS}, b as (select {content_sql("'user 7 click value 100'")} as tk), s as (select a.id, a.user_id, {SIM} as sim, {JAC} as jac from tf a, b where not deprecated)
select id, round({JUDGE}, 6) as score from s where (user_id = 7 or jac >= 0.25e0) and {JUDGE} >= 0.55e0""")
def conflict_preview(spark, sf):
    return conflict.preview("user 7 click value 100", ["u7"], facts(spark, sf).where("not deprecated")).select("id", F.round("score", 6).alias("score"))


@query(f"""with t as (select doc_id, source, {content_sql('text')} as tk from documents), h as (select doc_id, source, tk, count(*) over (partition by array_to_string(list_sort(tk), ' ')) as copies from t where len(tk) > 0)
select copies, count(*) as n from h group by copies""")
def equal_token_sets(spark, sf):
    t = table(spark, sf, "documents").select(F.array_sort(text.content_tokens("text")).alias("tk")).where(F.size("tk") > 0)
    return t.groupBy(F.sha2(F.array_join("tk", " "), 256)).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.sum("copies").alias("n"))


# -- graph


@query(f"with {RELATIONS} select t as start, s as id, 1::bigint as hops from rel where t like 'n%' union all select s, t, 1 from rel where s like 'n%'")
def neighbors_d1(spark, sf):
    return graph.neighbors(relations(spark, sf), entities(spark, sf).where("id like 'n%'"), 1)


@query(f"""with {RELATIONS}, l as (select s as u, t as v from rel union select t, s from rel), one as (select distinct u as start, v as id from l where u like 'r%'),
two as (select distinct one.start, l.v as id from one join l on one.id = l.u where l.v <> one.start except select start, id from one)
select start, id, 1::bigint as hops from one union all select start, id, 2 from two""")
def neighbors_d2(spark, sf):
    return graph.neighbors(relations(spark, sf), entities(spark, sf).where("id like 'r%'"), 2)


@query(f"""with recursive {RELATIONS}, p(start, target, hops, path) as (select s, t, 1::bigint, s || '>' || t from rel where s like 's%'
  union all select p.start, rel.t, p.hops + 1, p.path || '>' || rel.t from p join rel on p.target = rel.s where p.hops < 5)
select start, target, hops, path from p""")
def paths(spark, sf):
    found = graph.paths(relations(spark, sf), entities(spark, sf).where("id like 's%'"), max_depth=5)
    return found.select("start", "target", "hops", F.array_join("path", ">").alias("path"))


@query(f"with {RELATIONS} select (select count(*) from (select s from rel union select t from rel)) as n_nodes, (select count(distinct (s, t)) from rel) as n_edges")
def graph_summary(spark, sf):
    return graph.summary(entities(spark, sf).where("id like 'n%'"), relations(spark, sf))


# The same over all edges and from all nodes.


@query(f"with {ALL_RELATIONS} select t as start, s as id, 1::bigint as hops from arel union all select s, t, 1 from arel")
def neighbors_all(spark, sf):
    return graph.neighbors(all_relations(spark, sf), all_entities(spark, sf), 1)


@query(f"""with recursive {ALL_RELATIONS}, p(start, target, hops, path) as (select s, t, 1::bigint, s || '>' || t from arel
  union all select p.start, arel.t, p.hops + 1, p.path || '>' || arel.t from p join arel on p.target = arel.s where p.hops < 5)
select start, target, hops, path from p""")
def paths_all(spark, sf):
    found = graph.paths(all_relations(spark, sf), all_entities(spark, sf), max_depth=5)
    return found.select("start", "target", "hops", F.array_join("path", ">").alias("path"))


@query(f"""with recursive {ALL_RELATIONS}, p(start, target, hops, path) as (select s, t, 1::bigint, s || '>' || t from arel
  union all select p.start, arel.t, p.hops + 1, p.path || '>' || arel.t from p join arel on p.target = arel.s where p.hops < 5)
select start, target, hops, path from p where target in (select concat('n', n_nationkey) from nation where n_regionkey = 1)""")
def paths_to(spark, sf):
    """From all nodes to the nations of one region: what can't reach them isn't carried on."""
    targets = table(spark, sf, "nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    found = graph.paths(all_relations(spark, sf), all_entities(spark, sf), targets, max_depth=5)
    return found.select("start", "target", "hops", F.array_join("path", ">").alias("path"))


@query(f"with {ALL_RELATIONS} select (select count(*) from (select id from ent union select s from arel union select t from arel)) as n_nodes, (select count(*) from (select distinct s, t from arel)) as n_edges")
def graph_summary_all(spark, sf):
    return graph.summary(all_entities(spark, sf), all_relations(spark, sf))


@query("select o_orderkey as id, 0::bigint as pos, concat('c', o_custkey) as entity_id, c_name as name from orders join customer on o_custkey = c_custkey")
def entities_of_facts(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.concat(F.lit("c"), "o_custkey"), F.lit("missing")).alias("entity_ids"))
    return graph.entities_of(f, entities(spark, sf))


@query("""with v as (select concat('c', c_custkey) as id, 0 as seq, c_name as name from customer union all select concat('c', o_custkey), o_orderkey, concat('order ', o_orderkey) from orders)
select id, arg_max(name, seq) as name, max(seq)::bigint as seq from v group by id""")
def entity_upsert(spark, sf):
    known = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit(0).cast("long").alias("seq"), F.col("c_name").alias("name"))
    incoming = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("order "), "o_orderkey").alias("name"))
    return store.upserted(known, incoming)


# -- evaluation

GOLD = "gold as (select item_id as query_id, doc_id from benchmark b join documents d on contains(d.text, b.text))"


def _gold(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    d = table(spark, sf, "documents")
    met = substring.containing(d.select(F.col("doc_id").alias("id"), "text"), b.withColumnRenamed("item_id", "passage_id"))
    return met.select(F.col("passage_id").alias("query_id"), F.col("id").alias("doc_id"))


FIRST = f"with {BM25}, {GOLD}, first as (select query_id, min(rank) filter (where rank <= 10) as r from gold left join sparse using (query_id, doc_id) group by query_id)"


@query(FIRST + " select " + ", ".join(f"round(avg(case when r <= {k} then 1e0 else 0e0 end), 6) as recall_at_{k}" for k in evaluate.KS) + ", round(avg(coalesce(1e0 / r, 0e0)), 6) as mrr, round(avg(case when r = 1 then 1e0 else 0e0 end), 6) as acc_at_1 from first")
def recall_and_mrr(spark, sf):
    return evaluate.recall_and_mrr(_sparse(spark, sf, max(evaluate.KS)), _gold(spark, sf))


@query(FIRST + " select query_id from first where r is null")
def misses(spark, sf):
    return evaluate.misses(_sparse(spark, sf, 10), _gold(spark, sf))


@query(f"""with {BM25}, {DENSE_ASKED}, {GOLD}, lists as (select 'sparse' as strategy, query_id, doc_id, rank from sparse where rank <= 10 union all select 'dense', query_id, doc_id, rank from dense where rank <= 10),
strategies as (select unnest(['sparse', 'dense']) as strategy), asked as (select query_id, min(lang) as topic from gold join documents using (doc_id) group by query_id),
first as (select strategy, gold.query_id, min(rank) as r from strategies cross join gold left join lists using (strategy, query_id, doc_id) group by all),
shown as (select strategy, lists.query_id, avg(coalesce(lang = topic and gold.doc_id is null, false)::int::double) as wrong from lists left join documents using (doc_id) join asked using (query_id) left join gold using (query_id, doc_id) where rank <= 5 group by all)
select strategy, {", ".join(f"round(avg(case when r <= {k} then 1e0 else 0e0 end), 6) as recall_at_{k}" for k in evaluate.KS)}, round(avg(coalesce(1e0 / r, 0e0)), 6) as mrr, round(avg(case when r = 1 then 1e0 else 0e0 end), 6) as acc_at_1,
  round(avg(coalesce(wrong, 0e0)), 6) as anachronism_at_5 from first left join shown using (strategy, query_id) group by strategy""")
def compare_strategies(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("topic"))
    gold = _gold(spark, sf)
    gold = gold.join(gold.join(docs, "doc_id").groupBy("query_id").agg(F.min("topic").alias("topic")), "query_id")
    v = _vectors(spark, sf)
    asked = v.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    return evaluate.compare({"sparse": _sparse(spark, sf, 10), "dense": retrieve.dense_candidates(v, asked, 10)}, gold, docs)


@query(f"""with {BM25}, {GOLD}, q as (select query_id, min(lang) as asked from gold join documents using (doc_id) group by query_id),
s as (select sparse.query_id, lang = asked and gold.doc_id is null as wrong from sparse join documents using (doc_id) join q using (query_id) left join gold using (query_id, doc_id) where rank <= 5)
select query_id, round(avg(wrong::int::double), 6) as anachronism from s group by query_id""")
def anachronism(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("topic"))
    gold = _gold(spark, sf)
    asked = gold.join(docs, "doc_id").groupBy("query_id").agg(F.min("topic").alias("topic"))
    shown = evaluate.anachronism(_sparse(spark, sf, 5), docs, gold.join(asked, "query_id"))
    return shown.select("query_id", F.round("anachronism", 6).alias("anachronism"))


PROBES = """probes as (select conv_id as probe_id, case when conv_id % 2 = 0 then 'even' else 'odd' end as suite, list(lower(text) order by turn) as t, ['the', 'la '] as e, case when conv_id % 3 = 0 then []::varchar[] else ['der ', 'que'] end as b from conversations group by conv_id),
graded as (select probe_id, suite, len(list_filter(t, lambda x: contains(x, e[1]) or contains(x, e[2]))) as good, contains(t[1], e[1]) or contains(t[1], e[2]) as top_good,
  case when len(b) > 0 then (contains(t[1], b[1]) or contains(t[1], b[2])) and not (contains(t[1], e[1]) or contains(t[1], e[2])) end as stale,
  case when len(b) > 0 then len(list_filter(t, lambda x: contains(x, b[1]) or contains(x, b[2]))) > 0 end as leaked, len(t) as k, list_sum(list_transform(t, lambda x: len(x) // 4)) as tokens from probes)"""


def _graded(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    probes = c.select(F.col("conv_id").alias("probe_id"), F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("suite"), "texts", words("the", "la ").alias("expected"), F.when(F.col("conv_id") % 3 == 0, words()).otherwise(words("der ", "que")).alias("banned"))
    return evaluate.grade(probes)


@query(f"with {PROBES} select probe_id, (good > 0)::int as hit, top_good::int as hit_at_1, round(good / k::double, 6) as precision, stale::int as stale_at_1, leaked::int as leaked, tokens::bigint as tokens from graded")
def probe_grade(spark, sf):
    return _graded(spark, sf).select("probe_id", "hit", "hit_at_1", F.round("precision", 6).alias("precision"), "stale_at_1", "leaked", "tokens")


@query(f"with {PROBES} select suite, round(avg((good > 0)::int), 3) as recall, round(avg(top_good::int), 3) as recall_at_1, round(avg(good / k::double), 3) as precision, round(avg(stale::int), 3) as staleness_at_1, round(avg(leaked::int), 3) as leak_rate, 0e0 as abstention, count(*) as n from graded group by rollup (suite)")
def probe_rollup(spark, sf):
    return evaluate.roll_up(_graded(spark, sf))


@query("select conv_id, string_agg(role || ': ' || trim(text), chr(10) order by turn) as text from conversations where trim(text) <> '' group by conv_id")
def session_text(spark, sf):
    return evaluate.session_text(table(spark, sf, "conversations"))


@query(f"""with {DENSE_ASKED}, p as (select query_id, doc_id from dense where rank <= 25), r as (select query_id, doc_id, row_number() over (partition by query_id order by timestamp '2024-01-02' + to_days((doc_id % 60)::integer) desc, doc_id desc) as rank from p)
select * from r where rank <= 5""")
def recency_baseline(spark, sf):
    v = _vectors(spark, sf)
    asked = v.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    pool = retrieve.dense_candidates(v, asked, 25).withColumn("created_at", F.col("doc_id") % 60)
    return retrieve.recency(pool, 5).select("query_id", "doc_id", "rank")


@query(f"""with d as (select doc_id, unnest({overlap_sql('text')}) as t from documents), q as (select item_id as query_id, unnest({overlap_sql('text')}) as t from benchmark),
h as (select query_id, doc_id, count(*) as overlap from d join q using (t) group by 1, 2),
o as (select b.item_id as query_id, documents.doc_id, coalesce(overlap, 0) as overlap from benchmark b cross join documents left join h on h.query_id = b.item_id and h.doc_id = documents.doc_id),
r as (select *, row_number() over (partition by query_id order by overlap desc, doc_id) as rank from o) select * from r where rank <= 5""")
def grep_baseline(spark, sf):
    d = dealt(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", text.overlap_tokens("text").alias("tokens"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.overlap_tokens("text").alias("tokens"))
    return retrieve.overlap_search(d, q, 5)


@query("select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)")
def passages_in_documents(spark, sf):
    return _gold(spark, sf).withColumnRenamed("query_id", "item_id")


SESSIONS = """sess as (select conv_id as doc_id, string_agg(role || ': ' || trim(text), chr(10) order by turn) as text from conversations where trim(text) <> '' group by conv_id),
asked as (select conv_id as item_id, arg_min(text, turn) as text from conversations where conv_id % 100 = 0 and trim(text) <> '' group by conv_id), """
SESSION_BM25 = BM25.replace("from documents", "from sess").replace("from benchmark", "from asked")


@query(f"""with {SESSIONS}{SESSION_BM25}, texts as (select query_id, rank, sess.text from sparse join sess using (doc_id) where rank <= 10),
first as (select item_id as query_id, min(rank) as r from asked left join texts on query_id = item_id and texts.text = (select text from sess where doc_id = item_id) group by item_id)
select {", ".join(f"round(avg(case when r <= {k} then 1e0 else 0e0 end), 6) as recall_at_{k}" for k in (1, 2, 3, 5, 10))}, round(avg(coalesce(1e0 / r, 0e0)), 6) as mrr, round(avg(case when r = 1 then 1e0 else 0e0 end), 6) as acc_at_1 from first""")
def session_recall(spark, sf):
    """The first turn of every hundredth conversation asks for its session among all; equal sessions count as the first of them by their text."""
    c = table(spark, sf, "conversations")
    sessions = evaluate.session_text(c)
    asked = c.where((F.col("conv_id") % 100 == 0) & (F.trim("text") != "")).groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("text"))
    found = bm25.search_documents(sessions, asked, 10, "conv_id").join(sessions.select(F.col("conv_id").alias("doc_id"), F.col("text").alias("found")), "doc_id")
    # The sessions of a question are those that answer it and those that were found.
    own = asked.select("query_id").join(sessions.select(F.col("conv_id").alias("query_id"), "text"), "query_id").select("query_id", F.col("query_id").alias("session_id"), F.lit(0).cast("long").alias("pos"), "text")
    others = found.where("doc_id <> query_id").select("query_id", F.col("doc_id").alias("session_id"), F.col("rank").alias("pos"), F.col("found").alias("text"))
    haystack = own.unionByName(others).withColumn("openings", F.array().cast("array<string>"))
    return evaluate.session_hits(found.select("query_id", "rank", F.col("found").alias("text")), haystack, own.select("query_id", "session_id"))


# -- mutation


@query(f"""with recursive {FACTS}, way(id, latest, hops) as (select f.id, f.id, 0::bigint from facts f left join facts r on f.replaced_by = r.id where r.id is null
  union all select f.id, way.latest, way.hops + 1 from facts f join way on f.replaced_by = way.id)
select f.id, way.latest, way.hops from facts f left join way using (id)""")
def link_chains(spark, sf):
    return temporal.link_chains(facts(spark, sf))


@query("with v as (select o_custkey as id, o_orderkey as seq, o_orderstatus as status, row_number() over (partition by o_custkey order by o_orderkey desc) as k from orders) select id, seq, status from v where k = 1")
def update_latest(spark, sf):
    return store.latest(table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status")))


@query("select c_custkey as id, c_name as name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def delete_tombstone(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("seq"), F.col("c_name").alias("name"))
    gone = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.lit(2).alias("seq"))
    return store.without(rows, gone).select("id", "name")


@query("""with e as (select l_partkey as old_id, l_orderkey as new_id, l_orderkey * 10 + l_linenumber as at_seq, l_returnflag = 'R' as manual from lineitem)
select old_id, case when bool_or(manual) then arg_max(new_id, at_seq) filter (where manual) else arg_min(new_id, at_seq) end as new_id from e group by old_id""")
def deprecate_log(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("old_id"), F.col("l_orderkey").alias("new_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at_seq"), (F.col("l_returnflag") == "R").alias("manual"))
    return store.chosen(e)


# -- stored facts: written to a store, and read back through what it keeps


def _stored_documents(spark, sf) -> store.View:
    """The documents as facts of a store, with postings, keys and sketches."""
    kept = store.Catalog(spark, new_folder(spark, "documents-store"))
    f = _doc_facts(spark, sf, F.col("text").alias("content"))
    rows = f.withColumn("seq", F.col("id") + 1).withColumn("id", F.lpad(F.col("id").cast("string"), 12, "0")).withColumn("effective_at", F.col("effective_at").cast("timestamp")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    kept.write(lambda write: derived.add_facts(write, rows, embed.hashing_embedder(64), 0.2))
    return kept.view()


@query(f"with {BM25} select query_id, doc_id, round(bm25, 6) as bm25, rank from sparse where rank <= 10")
def stored_bm25(spark, sf):
    found = derived.search_stored(_stored_documents(spark, sf), _questions(spark, sf), 10)
    return found.select("query_id", F.col("doc_id").cast("long").alias("doc_id"), F.round("bm25", 6).alias("bm25"), "rank")


@query(f"with {STATE} select {SHOWN_SQL} from state where {valid_sql(TS['at'])}")
def stored_active_at(spark, sf):
    kept = store.Catalog(spark, new_folder(spark, "facts-store"))
    f = facts(spark, sf).withColumn("effective_at", F.col("effective_at").cast("timestamp")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    kept.write(lambda write: write.append("facts", f.withColumn("since", store.day_of(F.least("effective_at", "created_at")))))
    at = F.lit(AT).cast("timestamp")
    return temporal.active_at(kept.facts(at), at).withColumn("id", F.col("id").cast("long")).select(*shown())

# Without SQL: vectors of 512 sums of logarithms.
QUERIES |= {f.__name__: f for f in (embedder_conflicts, hashing_embed)}
