"""Every engine query against its SQL, on the smallest tables."""

import math
import re
from collections import Counter

import duckdb
import pytest

from tidemark.functions import text
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert ordered(found.select(*columns).collect()) == ordered(want)


def test_graph_queries_start_from_all_nodes(spark):
    starts = {r.start[0] for r in catalogue.QUERIES["paths_all"](spark, SF).select("start").distinct().collect()}
    assert starts == set("opcsn")  # regions have no edge out
    assert {r.start[0] for r in catalogue.QUERIES["neighbors_all"](spark, SF).select("start").distinct().collect()} == set("opcsnr")


def plain_vector(text, dim=512):
    """The hashing embedder by single characters and bytes."""
    t = re.sub(r"\s+", " ", text.lower()).strip()
    counts = Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1))
    for w in re.findall("[a-z0-9]+", t):
        if len(w) >= 2:
            counts["w:" + w] += 3
    v = [0.0] * dim
    for gram, c in counts.items():
        h = 0xCBF29CE484222325
        for b in gram.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        v[h % dim] += 1 + math.log(c)
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm if norm else x for x in v]


def test_vectors_of_whole_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 2500").collect()}
    got = {}
    for r in catalogue.QUERIES["hashing_embed"](spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.bucket] = r.weight
    assert len(texts) > 50
    for i, t in texts.items():
        assert all(abs(x - got.get(i, {}).get(k, 0.0)) < 2e-5 for k, x in enumerate(plain_vector(t)))


def test_conflicts_scored_by_vectors(spark):
    facts = catalogue._typed(spark, SF).select("id", "seq", "content", "entity_ids").collect()
    vectors = {r.id: plain_vector(r.content) for r in facts}
    tokens = {r.id: {w for w in re.findall("[a-z0-9]+", r.content) if len(w) > 1 and w not in text.TOPIC_STOP} for r in facts}
    want = {}
    for k, a in enumerate(facts):
        for b in facts[k + 1 :]:
            if a.entity_ids == b.entity_ids:
                old, new = sorted((a.id, b.id))
                jac, sim = len(tokens[old] & tokens[new]) / len(tokens[old] | tokens[new]), sum(x * y for x, y in zip(vectors[old], vectors[new]))
                score = 0.1 * sim if jac < 0.2 else sim * (0.4 + 0.6 * min(2 * jac, 1))
                if score >= 0.55:
                    want[old, new] = score
    got = {(r.old_id, r.new_id): r.score for r in catalogue.QUERIES["embedder_conflicts"](spark, SF).collect()}
    assert set(got) == set(want) and len(want) > 100 and all(abs(got[p] - want[p]) < 2e-4 for p in want)


def test_search_scans_the_texts_once(spark):
    """The plan of BM25 without an index: one accent fold, whose exchange is used again for the terms' and the documents' statistics."""
    plan = catalogue.QUERIES["bm25_topk"](spark, SF)
    plan.collect()
    text_ = plan._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert text_.count("ArrowEvalPython") == 1 and text_.count("ReusedExchange") == 2


def test_a_stored_search_reads_no_texts(spark):
    """The search of stored postings: no column of texts in its scans, and no fold."""
    view = catalogue._stored_documents(spark, SF)
    plan = catalogue.derived.search_stored(view, catalogue._questions(spark, SF), 10)
    text_ = plan._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text_)
    assert any("term:string" in r for r in read) and not any("content" in r for r in read) and "ArrowEvalPython" not in text_


@pytest.mark.parametrize("name", ["embedder_conflicts", "resolve_batch"])
def test_pairs_are_made_where_their_facts_are(spark, name):
    """Facts are shuffled to their user and type and to their entity, at most resolved pairs after that; nothing of unknown size is broadcast."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") <= 5


@pytest.mark.parametrize("name", ["embedder_conflicts", "resolve_batch", "conflict_pairs", "semantic_judge"])
def test_common_tokens_of_a_pair_are_counted_once(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_intersect(old_tokens") == 1


def test_pairs_go_through_python_once(spark):
    plan = catalogue.QUERIES["embedder_conflicts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_texts_embedded_together_get_their_own_vectors(spark):
    from tidemark.functions import embed

    texts = ["", "a", "über straße 12 12", "日本語 テキスト", "user 7 click value 100", "😀 ok", "user 7 click value 100"] + [f"word{k} " * (k % 50) for k in range(1500)]
    got = embed.hashing_embedder().vectors(texts)
    named = embed.HashingEmbedder(idf=embed.Idf({}, 1.0)).vectors(texts[:20])  # feature by feature
    assert got.shape == (len(texts), 512) and abs(got[:20] - named).max() < 1e-6
    assert all(max(abs(x - y) for x, y in zip(v, plain_vector(t))) < 1e-6 for t, v in [*zip(texts, got)][1:7] + [(texts[1099].strip(), embed.hashing_embedder().vectors([texts[1099].strip()])[0])])


def test_words_of_many_texts_are_hashed_together(monkeypatch):
    """No distinct word costs a loop of its own; the vectors are those of the features one by one."""
    from tidemark.functions import embed

    texts = ["ab ab c 12\nab", "c", "", "x" * 40, "ab-cd_ef é9ab", "\ud800ab 日本語ab"]
    named = embed.HashingEmbedder(idf=embed.Idf({}, 1.0)).vectors(texts)
    monkeypatch.setattr(embed, "bucket_of", None)
    assert abs(embed.hashing_embedder().vectors(texts) - named).max() < 1e-6
    monkeypatch.setattr(embed, "TABLE_SIZE", 1)  # sorted keys in place of tables
    monkeypatch.setattr(embed, "TABLE_SHARE", 0)
    assert abs(embed.hashing_embedder().vectors(texts) - named).max() < 1e-6


def test_every_document_is_embedded_once(spark):
    plan = catalogue.QUERIES["hashing_embed"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "RoundRobinPartitioning" in plan  # one file, in all tasks


@pytest.mark.parametrize("name", ["rrf_fusion", "hybrid_at", "misses"])
def test_searches_in_larger_plans_count_the_texts_once(spark, name):
    """Where a search is joined or united with more, the plan that is left folds no text again."""
    plan = catalogue.QUERIES[name](spark, SF)
    plan.collect()
    assert "ArrowEvalPython [fold" not in plan._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
