"""The facade: writing, replacing, deleting, searching, the graph, the stream and the command line."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import cli, server
from tidemark.functions import embed, text
from tidemark.memory import FactStore
from tidemark.operators import bm25, conflict, evaluate, graph, retrieve, temporal
from tidemark.schema import CURRENT_STATE
from tidemark.sources import store as tables
from tidemark.streaming.ingest import ingest, windowed_counts


@pytest.fixture()
def store(spark, tmp_path):
    return FactStore(spark, str(tmp_path / "db"))


def test_later_fact_replaces_and_history_stays(store):
    a = store.remember("Acme headquarters moved into Lisbon city", ["Acme"], effective_at="2024-01-01", created_at="2024-01-01")
    b = store.remember("Acme headquarters moved into Porto city", ["acme"], effective_at="2024-02-01", created_at="2024-02-01")
    c = store.remember("Bananas ripen faster beside apples", ["Fruit"], effective_at="2024-02-01", created_at="2024-02-01")
    assert store.recall(a)["replaced_by"] == b and not store.recall(c)["deprecated"]
    assert [r.id for r in store.timeline("ACME").collect()] == [a, b]
    assert {r.id for r in store.active("2024-01-15").collect()} == {a}
    assert {r.id for r in store.active("2024-03-01").collect()} == {b, c}
    assert store.timeline("nobody").count() == 0
    assert [r["id"] for r in store.query("Where is the Acme headquarters?", 1)] == [b]
    assert store.query("Where is the Acme headquarters?", 1, at="2024-01-15")[0]["id"] == a
    assert {r.id for r in store.conflicts_for("Acme headquarters moved into Madrid city", ["Acme"]).collect()} == {b}
    assert store.delete(c) and store.recall(c) is None and not store.delete("none")
    store.update(b, content="Acme headquarters stay in Porto")
    assert store.recall(b)["content"].endswith("Porto")
    store.update("none", content="x")
    assert not store.deprecate("none") and store.deprecate(b) and store.recall(b)["deprecated"]


def test_dangling_successor_leaves_a_fact_valid(spark):
    rows = [(1, True, None), (2, True, 99), (3, False, None), (4, True, 3)]
    day = dt.datetime(2024, 1, 1)
    facts = spark.createDataFrame([(i, d, r, day, day) for i, d, r in rows], "id long, deprecated boolean, replaced_by long, effective_at timestamp_ntz, created_at timestamp_ntz")
    assert {r.id for r in temporal.active_at(facts, "2024-01-02 00:00:00").collect()} == {2, 3}
    assert {r.id for r in temporal.active_at(facts, "2024-01-01 00:00:00").collect()} == {2, 3}
    assert {r.id for r in temporal.active_at(facts, "2023-12-31 00:00:00").collect()} == set()
    assert {r.id for r in temporal.effective_between(facts, "2024-01-01 00:00:00", "2024-01-01 00:00:00").collect()} == {1, 2, 3}
    assert temporal.replay(facts, limit=0).count() == 4


def test_batch_resolution_equals_a_sequential_load(spark):
    import random

    rng = random.Random(3)
    words = "alpha beta gamma delta omega sigma".split()
    rows = [(k, k, " ".join(rng.choice(words) for _ in range(4)), [rng.choice("xyz")]) for k in range(40)]
    facts = spark.createDataFrame(rows, "id long, seq long, content string, entity_ids array<string>")
    found = {r.old_id: r.new_id for r in conflict.resolve(conflict.conflicts(facts)).collect()}
    want, active = {}, []
    for k, _, content, ents in rows:
        new = set(content.split())
        for o in list(active):
            old = set(rows[o][2].split())
            jac, sim = len(old & new) / len(old | new), len(old & new) / (len(old) * len(new)) ** 0.5
            score = 0.1 * sim if jac < 0.2 else sim * (0.4 + 0.6 * min(2 * jac, 1))
            if (set(ents) & set(rows[o][3]) or jac >= 0.25) and score >= 0.55:
                want[o] = k
                active.remove(o)
        active.append(k)
    assert found == want


def test_graph_and_summary(store):
    store.add_relation("A", "B", "knows")
    store.add_relation("B", "C", "knows")
    store.add_relation("A", "B", "likes")
    assert [r["name"] for r in store.neighbors("A", 2).orderBy("name").collect()] == ["B", "C"]
    assert [list(r.types) for r in store.paths("A", "C").collect()] == [["likes", "knows"]]
    assert store.summary() == {"n_nodes": 3, "n_edges": 2}


def test_embedder(spark):
    df = spark.createDataFrame([("The capital of France is Paris", "The capital of France is Lyon"), ("old pricing", "new pricing"), ("", "x")], "a string, b string")
    e = embed.hashing_embedder()
    rows = df.select(embed.cosine(e("a"), e("b")).alias("s")).collect()
    assert [round(r.s, 3) for r in rows] == [0.885, 0.704, 0.0]
    grams = ["a", "the", "w:paris", "é", ""]
    got = spark.createDataFrame([(g,) for g in grams], "g string").select("g", embed.fnv_bucket("g").alias("b")).collect()
    assert {r.g: r.b for r in got} == {g: embed.bucket_of(g, 512) for g in grams}


def test_tokenizers(spark):
    df = spark.createDataFrame([("Who is the Café owner on port 80 ?",)], "t string")
    r = df.select(text.search_tokens("t").alias("s"), text.content_tokens("t").alias("c"), text.document_tokens("t").alias("d"), text.normalise("t").alias("n")).first()
    assert r.s == ["caf", "owner", "port"] and "cafe" in r.d and r.n.endswith("80 ?")


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "query_id long, doc_id long, rank long")
    gold = spark.createDataFrame([(1, 2)], "query_id long, doc_id long")
    assert evaluate.recall_and_mrr(empty, gold).first().mrr == 0
    assert [r.query_id for r in evaluate.misses(empty, gold).collect()] == [1]


def test_stream_and_command_line(spark, store, tmp_path, capsys):
    rows = spark.createDataFrame([("f1", "Oslo harbour opened", ["Oslo"], "s", "{}", 0)], "id string, content string, entities array<string>, source string, metadata string, pos int")
    rows = rows.withColumn("effective_at", F.lit("2024-01-01").cast("timestamp")).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    assert store.recall("f1")["content"] == "Oslo harbour opened"
    db = ["--db", store.catalog.base]
    assert cli.main([*db, "list"], spark) == 0 and "Oslo" in capsys.readouterr().out
    assert cli.main([*db, "graph", "--entity", "nobody"], spark) == 1
    assert cli.main([*db, "add", "Oslo harbour closed", "--entity", "Oslo", "--no-resolve", "--show-id", "--effective-at", "2099-01-01"], spark) == 0
    stored, again = capsys.readouterr().out.split("\n")[-3:-1]
    assert stored == f"stored {again}" and not store.recall("f1")["deprecated"]
    assert cli.main([*db, "list"], spark) == 0 and "closed" not in capsys.readouterr().out  # not begun
    assert cli.main([*db, "list", "--all"], spark) == 0 and "closed" in capsys.readouterr().out
    found = server.tools(store)["query"]("harbour in Oslo", 1)[0]
    assert (found["content"], found["id"]) == ("Oslo harbour opened", "f1")
    assert server.tools(store)["remember"]("Bergen has rain").startswith("stored ")


def test_late_rows_fall_into_their_window(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-02 10:00:00"), ("b", "2024-01-01 11:00:00")], "source string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert sorted((r.source, r.window.start.day, r.n) for r in spark.table("windows").collect()) == [("a", 1, 1), ("a", 2, 1), ("b", 1, 1)]


def test_versions_and_events_follow_one_order(store):
    a = store.remember("Delta office moved into Rome centre", ["Delta"], metadata={"k": [1, "é"]})
    b = store.remember("Delta office moved into Turin centre", ["Delta"])
    assert store.recall(a)["replaced_by"] == b and store.recall(a)["metadata"] == {"k": [1, "é"]}
    store.update(a, deprecated=False)
    assert store.recall(a)["deprecated"] is False and store.recall(a)["replaced_by"] is None
    store.deprecate(a, "elsewhere")
    assert (store.recall(a)["deprecated"], store.recall(a)["replaced_by"]) == (True, "elsewhere")
    store.update(a, metadata={"x": 1})
    assert store.recall(a)["deprecated"] and store.recall(a)["metadata"] == {"x": 1}
    assert store.delete(a) and not store.delete(a)
    store.compact()
    assert store.recall(a) is None and store.recall(b)["content"].endswith("Turin centre")


def test_preview_is_what_writing_does(spark, tmp_path):
    """Scores of the preview and of writing are the embedder's, for stored facts and within a batch."""
    texts = ["Omega plant makes red bricks daily", "Omega plant makes blue bricks daily", "A wholly other subject here", "omega PLANT makes red bricks weekly"]
    store = FactStore(spark, str(tmp_path / "db"))
    for t in texts:
        expected = {r.id for r in store.conflicts_for(t).collect()}
        made = store.remember(t)
        assert {r.id for r in store.list(True).where(F.col("replaced_by") == made).collect()} == expected
    batch = FactStore(spark, str(tmp_path / "batch"))
    batch.remember(texts[0])
    rows = spark.createDataFrame([(f"b{k}", t, [], "s", "{}", k) for k, t in enumerate(texts[1:])], "id string, content string, entities array<string>, source string, metadata string, pos int")
    batch.remember_batch(rows.withColumn("effective_at", F.current_timestamp()).withColumn("created_at", F.current_timestamp()))
    state = lambda s: {r.content: r.deprecated for r in s.list(True).collect()}
    assert state(batch) == state(store) and any(state(store).values())


def test_pairs_below_the_judges_bound_are_found(spark):
    rows = [(1, 1, "one two three four five six seven", []), (2, 2, "one b2 c2 d2 e2 f2 g2", [])]
    facts = spark.createDataFrame(rows, "id long, seq long, content string, entity_ids array<string>")
    assert conflict.conflicts(facts, threshold=0.0, related=0.05).count() == 1 and conflict.conflicts(facts, threshold=0.0).count() == 0


def test_entities(store):
    france = store.add_entity("France", {"kind": "country"})
    assert store.add_entity("FRANCE") == france and store.get_entity(france) == store.find_entity("france")
    store.upsert_entity(france, "French Republic", {"kind": "state"})
    store.upsert_entity("x", "Andorra")
    assert store.get_entity(france)["name"] == "French Republic" and store.get_entity(france)["metadata"] == {"kind": "state"} and store.get_entity("none") is None
    assert [r.name for r in store.list_entities().collect()] == ["Andorra", "French Republic"]
    edge = store.add_relation("Andorra", "French Republic", "borders", {"km": 55})
    assert store.list_relations().count() == 1 and store.delete_relation(edge) and store.list_relations().count() == 0 and not store.delete_relation(edge)
    assert [tables.from_json(x) for x in ("", None, "junk", "[1]", '{"a": 1}')] == [{}, {}, {}, {}, {"a": 1}]


def test_wildcards_fold_ascii_only(spark):
    docs = spark.createDataFrame([(1, "\u00c9cole License"), (2, "\u00e9cole"), (3, "50% off\\now"), (4, "LICENSE")], "doc_id long, text string")
    ids = lambda p: [r.doc_id for r in bm25.like_search(docs, p, 9).collect()]
    assert ids("license") == [4, 1] and ids("\u00c9COLE") == [1] and ids("off\\now") == [3] and ids("l_cense") == [4, 1] and ids("5%w") == [3]


def test_both_ways_of_search_agree(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "red red wine, \u00e9cole"), (3, ""), (4, None), (5, "ecole of foxes")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red fox fox"), (2, "ecole"), (3, "nothing here"), (4, "")], "query_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    found = rows(bm25.search_documents(docs, asked, 5))
    assert found == rows(bm25.search(bm25.build_index(docs), asked, 5)) and {r[0] for r in found} == {1, 2}
    assert bm25.search_documents(docs.limit(0), asked, 5).count() == 0


def test_many_questions_go_in_blocks(spark, monkeypatch):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(30, 8))
    vectors = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v / np.linalg.norm(v, axis=1)[:, None])], "doc_id long, embedding array<double>")
    asked = vectors.where("doc_id < 12").withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, retrieve.dense_candidates(vectors, asked, 4).collect()))
    monkeypatch.setattr(retrieve, "BROADCAST_QUERIES", 5)
    assert sorted(map(tuple, retrieve.dense_candidates(vectors, asked, 4).select("query_id", "doc_id", "sim", "rank").collect())) == want


def test_paths_of_no_length_and_overlaps_of_none(spark):
    edges = spark.createDataFrame([("a", "b", "t", 1)], "source_id string, target_id string, type string, seq int")
    start = spark.createDataFrame([("a",)], "id string")
    assert graph.paths(edges, start, max_depth=0).count() == 0 and graph.paths(edges, start, max_depth=1).count() == 1
    docs = spark.createDataFrame([(k, ["w"] if k == 7 else ["z"]) for k in range(9)], "doc_id long, tokens array<string>")
    found = retrieve.overlap_search(docs, spark.createDataFrame([(1, ["w"])], "query_id long, tokens array<string>"), 3)
    assert [(r.doc_id, r.overlap) for r in found.orderBy("rank").collect()] == [(7, 1), (0, 0), (1, 0)]


def test_fitted_weights(spark):
    import math

    docs = spark.createDataFrame([("ab",), ("b",)], "content string")
    idf = embed.collect_idf(embed.fit_idf(docs), 2)
    assert abs(idf.known["a"] - (math.log(3 / 2) + 1)) < 1e-9 and abs(idf.unseen - (math.log(3) + 1)) < 1e-9
    kind = embed.Features(grams=(1, 1), words=False)
    v = spark.createDataFrame([("az",)], "t string").select(embed.hashing_embedder(16, idf, kind)("t").alias("v")).first().v
    want = [0.0] * 16
    want[embed.bucket_of("a", 16)] += idf.known["a"]
    want[embed.bucket_of("z", 16)] += idf.unseen
    norm = sum(x * x for x in want) ** 0.5
    assert all(abs(x - y / norm) < 1e-6 for x, y in zip(v, want))
    with pytest.raises(ValueError):
        embed.collect_idf(embed.fit_idf(docs), 2, most=1)


def test_model_embedder(spark):
    class Model:
        def encode(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    got = spark.createDataFrame([("abc",), (None,)], "t string").select(embed.model_embedder(Model)("t").alias("v")).collect()
    assert [r.v for r in got] == [[3.0, 1.0], [0.0, 1.0]]


def test_loaders_and_generators(spark, tmp_path):
    import json

    facts = {"topics": [{"topic": "t", "facts": [{"content": "x", "entities": ["E"], "effective_at": "2024-01-01T00:00:00+00:00", "created_at": "2024-01-01T02:00:00+02:00"}], "queries": [{"question": "q", "at": "2024-01-02T00:00:00+00:00", "gold": "x"}]}]}
    (tmp_path / "facts.json").write_text(json.dumps(facts))
    rows, questions = tables.read_fact_set(spark, str(tmp_path / "facts.json"))
    assert rows.first().effective_at == rows.first().created_at and questions.first().gold == "x"
    for make, writes, probes in ((tables.supersession_flood, 60, 10), (tables.entity_flood, 40, 8)):
        make(str(tmp_path / "s.json"))
        w, p = tables.read_scenarios(spark, str(tmp_path / "s.json"))
        w = w.orderBy("session_pos").collect()
        assert (len(w), p.count()) == (writes, probes) and any(a.at > b.at for a, b in zip(w, w[1:]))  # writing order isn't that of time
        said = {r.content for r in w}
        assert all(r.banned and set(r.expected) | set(r.banned) <= said for r in p.collect())


def test_strategies_side_by_side(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 3), (3, 30, 11)], "query_id long, doc_id long, rank long")
    gold = spark.createDataFrame([(1, "t", 11), (2, "u", 20), (3, "u", 30)], "query_id long, topic string, doc_id long")
    topics = spark.createDataFrame([(10, "t"), (11, "t"), (20, "u"), (30, "u")], "doc_id long, topic string")
    compared = evaluate.compare({"some": results, "none": results.limit(0)}, gold, topics)
    rows = {r.strategy: r for r in compared.collect()}
    assert (rows["some"].recall_at_2, rows["some"].recall_at_3, rows["some"].mrr, rows["some"].acc_at_1, rows["some"].anachronism_at_5) == (0.333333, 0.666667, 0.277778, 0.0, 0.166667)
    assert rows["none"].mrr == 0 and evaluate.report(compared).count("\n") == 2


def test_results_lead_back_to_sessions(spark):
    sessions = spark.createDataFrame([(1, "s1", 0, "user: hello there", ["hello there"]), (1, "s2", 1, "user: bye", ["bye", ""])], "query_id long, session_id string, pos int, text string, openings array<string>")
    results = spark.createDataFrame([(1, 1, "unknown"), (1, 2, "they said bye to us"), (1, 3, "user: hello there")], "query_id long, rank long, text string")
    answers = spark.createDataFrame([(1, "s1")], "query_id long, session_id string")
    row = evaluate.session_hits(results, sessions, answers).first()
    assert (row.recall_at_1, row.recall_at_3, row.mrr) == (0.0, 1.0, 0.333333)


def test_quickstart(spark, tmp_path, capsys):
    import importlib.util
    from pathlib import Path

    spec = importlib.util.spec_from_file_location("quickstart", Path(__file__).resolve().parents[1] / "examples/quickstart.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    module.main(str(tmp_path / "db"), spark)
    out = capsys.readouterr().out
    assert "opens at nine" in out and "replaced: The harbour office of Lisbon opens at nine" in out and "seven" not in out.split("active:")[1].split("replaced")[0]


def test_demotion_keeps_outdated_facts_last(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "db"), CURRENT_STATE)
    a = store.remember("Zeta rate is nine percent", ["Zeta"], effective_at="2024-01-01")
    b = store.remember("Zeta rate is four percent", ["Zeta"], effective_at="2024-01-02")
    assert [r["id"] for r in store.query("Zeta rate percent", 2)] == [b, a]


def test_moments_of_text(spark):
    """The same in any session's zone."""
    from tidemark.functions.time import parse_time

    said = ["2024-01-01T10:00:00+00:00", "2024-01-01T12:00:00+02:00", "2024-01-01T12:00:00+0200", "2024-01-01T10:00:00Z", "2024-01-01 10:00:00", "2024-01-01T10:00:00.123456", "2024-01-01", "junk", "2024-13-01", "", None, "10:00"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string")
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [r.m for r in df.orderBy("k").select(F.unix_micros(parse_time("s")).alias("m")).collect()]
        spark.conf.set("spark.sql.session.timeZone", before)
        ten, midnight = 1704103200000000, 1704067200000000
        assert got == [ten] * 5 + [ten + 123456, midnight] + [None] * 5


def test_records_go_both_ways(spark, store, tmp_path):
    store.add_records([{"id": "a", "content": "one", "entity_ids": ["e"], "effective_at": "2024-01-01T00:00:00+02:00", "created_at": "2024-01-02", "metadata": {"k": [1, "\u00e9"]}, "deprecated": True, "replaced_by": "b"}, {"id": "b", "content": "two"}, {"content": "three"}])
    kept = list(store.records())
    assert {r["content"] for r in kept} == {"one", "two", "three"} and len({r["id"] for r in kept}) == 3
    one = next(r for r in kept if r["id"] == "a")
    assert one == {"id": "a", "content": "one", "entity_ids": ["e"], "effective_at": "2023-12-31T22:00:00.000000+00:00", "created_at": "2024-01-02T00:00:00.000000+00:00", "source": None, "metadata": {"k": [1, "\u00e9"]}, "deprecated": True, "replaced_by": "b"}
    other = FactStore(spark, str(tmp_path / "other"))
    other.add_records(kept)
    other.add_records([one | {"content": "uno"}])
    assert sorted(map(str, other.records())) == sorted(str(r | {"content": "uno"} if r["id"] == "a" else r) for r in kept)
    assert [r["id"] for r in other.query("two", 1)] == ["b"]


def test_a_failing_strategy_leaves_the_others(spark):
    probes = spark.createDataFrame([(1, "s1", ["old is nine", "new is ten"], ["ten"], ["nine"]), (2, "s2", ["yes"], ["yes"], [])], "probe_id long, suite string, texts array<string>, expected array<string>, banned array<string>")

    def broken():
        raise RuntimeError("no model here")

    lines = evaluate.suite_report({"good": lambda: evaluate.grade(probes), "bad": broken, "none": lambda: evaluate.grade(probes.limit(0))}).split("\n")
    assert [x.split()[0] for x in lines] == ["suite", "s1", "s2", "all", "bad"] and "1.000 | 1.000" in lines[1] and "1.000 | -" in lines[2] and "no model here" in lines[-1]
