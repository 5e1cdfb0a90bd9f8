"""Substring joins, chains of links, targeted paths, the judge of both facts, and the stateful stream."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.embed import cosine
from tidemark.memory import FactStore
from tidemark.operators import conflict, graph, retrieve, substring, temporal
from tidemark.schema import EngineConfig
from tidemark.streaming import timeline


@pytest.mark.parametrize("bound", [substring.BROADCAST_ROWS, 0])
def test_substrings_of_any_length(spark, monkeypatch, bound):
    monkeypatch.setattr(substring, "BROADCAST_ROWS", bound)
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("abc é日 ") for _ in range(n))
    texts = [(k, say(rng.randrange(300))) for k in range(60)] + [(90, None), (91, ""), (92, "a" * 2000), (93, say(50)), (93, "again")]
    passages = [(k, say(n)) for k, n in enumerate([1, 2, 3, 8, 15, 31, 40, 80])]
    for n in (1, 5, 14, 29, 30, 31, 32, 33, 60, 200):
        t = rng.choice([t for _, t in texts if t and len(t) > n])
        a = rng.randrange(len(t) - n)
        passages.append((100 + n, t[a : a + n]))
    passages += [(500, None), (501, ""), (502, "a" * 40), (503, texts[5][1]), (504, texts[5][1])]
    got = substring.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(passages, "passage_id long, passage string"))
    want = sorted((i, p) for i, t in texts for p, q in passages if t and q and q in t)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_links_lead_to_the_last_version(spark):
    rows = [("a", "b"), ("b", "c"), ("c", None), ("d", "c"), ("e", "gone"), ("f", "g"), ("g", "f"), ("h", "f"), ("i", "i"), ("k0", "k1")] + [(f"k{k}", f"k{k + 1}") for k in range(1, 20)]
    got = {r.id: (r.latest, r.hops) for r in temporal.link_chains(spark.createDataFrame(rows, "id string, replaced_by string")).collect()}
    want = {"a": ("c", 2), "b": ("c", 1), "c": ("c", 0), "d": ("c", 1), "e": ("e", 0), **{x: (None, None) for x in "fghi"}} | {f"k{k}": ("k19", 19 - k) for k in range(20)}
    assert got == want and temporal.link_chains(spark.createDataFrame([], "id string, replaced_by string")).count() == 0


def test_paths_to_targets_carry_on_what_can_arrive(spark):
    rng = random.Random(6)
    edges = [(str(rng.randrange(12)), str(rng.randrange(12)), "t", k) for k in range(30)] + [("x", "y", "t", 99)]
    rel = spark.createDataFrame(edges, "source_id string, target_id string, type string, seq int")
    start = spark.createDataFrame([(str(k),) for k in range(12)] + [("x",)], "id string")
    targets = spark.createDataFrame([("3",), ("7",), ("nowhere",)], "id string")
    rows = lambda df: sorted((r.start, r.target, tuple(r.path)) for r in df.collect())
    everything = rows(graph.paths(rel, start, max_depth=4))
    assert rows(graph.paths(rel, start, targets, 4)) == [r for r in everything if r[1] in ("3", "7")]
    left = {r.node: r.left for r in graph.distances(graph.edges(rel), targets, 4).collect()}
    assert left["3"] == left["7"] == 0 and "x" not in left and "y" not in left


def test_a_judge_sees_both_facts(spark, tmp_path):
    def newer_number(old: pd.DataFrame, new: pd.DataFrame, sim: pd.Series, jac: pd.Series) -> pd.Series:
        """Contradicts where the contents end in other words, unless the old fact is pinned."""
        ends = lambda f: f["content"].str.split().str[-1]
        return ((ends(old) != ends(new)) & ~old["metadata"].str.contains("pinned")).astype(float)

    store = FactStore(spark, str(tmp_path / "db"), EngineConfig(dim=64), judge=conflict.PairJudge(newer_number))
    a = store.remember("gate limit is nine", ["Gate"])
    b = store.remember("gate limit is nine", ["Gate"], metadata={"pinned": True})
    assert {r.id for r in store.conflicts_for("gate limit is ten", ["Gate"]).collect()} == {a}
    c = store.remember("gate limit is ten", ["Gate"])
    assert [store.recall(x)["replaced_by"] for x in (a, b, c)] == [c, None, None]
    facts = spark.createDataFrame([("p", 1, "gate limit is nine", ["g"], "{}"), ("q", 2, "gate limit is ten", ["g"], "{}")], "id string, seq long, content string, entity_ids array<string>, metadata string")
    assert [(r.old_id, r.new_id) for r in conflict.conflicts(facts, judge=conflict.PairJudge(newer_number, ("content", "metadata"))).collect()] == [("p", "q")]


def test_versions_of_a_stream_equal_the_batch(spark, tmp_path):
    """Late and repeated rows in several files; a row far ahead lets the others go."""
    rng = random.Random(3)
    rows = [(f"e{k % 3}", f"f{k:02d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * (k // 2))) for k in range(24)]
    sent = rows[:]
    for k in range(0, 20, 4):  # a little out of order, within the watermark
        part = sent[k : k + 6]
        rng.shuffle(part)
        sent[k : k + 6] = part
    sent += [sent[-1], sent[-2], (None, "none", dt.datetime(2024, 1, 5))]
    ahead = [(e, "end", dt.datetime(2025, 1, 1)) for e in ("e0", "e1", "e2")]
    for n, part in enumerate([sent[:9], sent[9:18], sent[18:], ahead, [("e0", "end2", dt.datetime(2025, 2, 1))]]):
        spark.createDataFrame(part, "entity string, id string, effective_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files in the order of their times
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timeline.ROCKSDB)
    try:
        stream = spark.readStream.schema("entity string, id string, effective_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = timeline.entity_versions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        out.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(r.entity, r.id): (r.version, r.replaces) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for e in ("e0", "e1", "e2"):
        own = sorted({r for r in rows if r[0] == e}, key=lambda r: (r[2], r[1]))
        want |= {(e, r[1]): (k + 1, own[k - 1][1] if k else None) for k, r in enumerate(own)}
    assert {k: v for k, v in got.items() if not k[1].startswith("end")} == want


@pytest.mark.parametrize("size", ["40", "64m"])
@pytest.mark.parametrize("indent", [None, 1])
def test_arrays_are_read_in_splits(spark, tmp_path, size, indent):
    """Objects with braces, quotes and escapes in their strings, over splits of a few bytes."""
    import json

    from tidemark.sources.store import read_haystacks

    tricky = ["}", "{", '"}', "a\\\"} , {", "[]", "", "é日", "\\", "x" * 90, "}}}}", "\n} ]"]
    samples = [{"haystack_session_ids": [str(k)], "haystack_sessions": [[{"role": "user", "content": t}, {"content": t * 2, "role": "a"}], []], "answer_session_ids": [], "question": f"{t}{k}", "answer": t, "more": {"deep": [{"x": [1, {}]}]}} for k, t in enumerate(tricky * 3)]
    (tmp_path / "in").mkdir()
    for n, part in enumerate([samples[:20], samples[20:], [], samples[:1]]):
        (tmp_path / f"in/{n}.json").write_text(json.dumps(part, ensure_ascii=False, indent=indent))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = [(r.question, r.answer, [[tuple(x) for x in s] for s in r.haystack_sessions]) for r in read_haystacks(spark, str(tmp_path / "in")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(s["question"], s["answer"], [[(x["role"], x["content"]) for x in y] for y in s["haystack_sessions"]]) for s in samples + samples[:1]]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("least", [0.15, 0.5])
def test_blocks_of_token_sets_lose_no_pair(spark, monkeypatch, least):
    """Common and rare words, copies, empty and long texts over several blocks and tiles, against all pairs."""
    monkeypatch.setattr(conflict, "BLOCK_ROWS", 30)
    monkeypatch.setattr(conflict, "BLOCK_TILE", 7)
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 300:03d}" for _ in range(rng.choice([3, 20, 60]))) for _ in range(110)] + ["", "w001 w002", "w001 w002", None, "the of"]
    facts = [(f"f{k}", 7 * k % 131, t, []) for k, t in enumerate(texts)]
    got = conflict.token_pairs(spark.createDataFrame(facts, "id string, seq long, content string, entity_ids array<string>"), least).collect()
    sets = {i: (s, set((t or "").split()) - {"the", "of"}) for i, s, t, _ in facts}
    want = {(a, b, len(x & y)) for a, (s, x) in sets.items() for b, (r, y) in sets.items() if s < r and x | y and len(x & y) / len(x | y) >= least}
    assert {(r.old_id, r.new_id, r.common) for r in got} == want and len(got) == len(want) > 5
    assert all((r.old_m, r.new_m) == (len(sets[r.old_id][1]), len(sets[r.new_id][1])) for r in got)


@pytest.mark.parametrize("rows", [13, 16, 21, 32, 64])
def test_blocks_of_token_sets_meet_where_they_are_stored(spark, monkeypatch, rows):
    """One to five blocks, each pair of them once; ids that two facts share, and none; no set is shuffled, or written, once for each block it meets."""
    kept, stored = {}, conflict.stored
    monkeypatch.setattr(conflict, "stored", lambda df, label, *by: kept.setdefault(label, stored(df, label, *by)))
    monkeypatch.setattr(conflict, "BLOCK_ROWS", rows)
    monkeypatch.setattr(conflict, "BATCH_PAIRS", 50)
    rng = random.Random(rows)
    facts = [(None if k == 9 else k // 2, " ".join(rng.sample([f"w{w:02d}" for w in range(30)], rng.choice([4, 9])))) for k in range(63)]
    given = spark.createDataFrame(facts, "id long, content string").select("id", F.col("id").alias("seq"), "content")
    found = conflict.token_pairs(given, 0.3)
    known = [(i, set(t.split())) for i, t in facts if i is not None]
    want = sorted((a, b, len(x), len(y), len(x & y)) for a, x in known for b, y in known if a < b and len(x & y) / len(x | y) >= 0.3)
    assert sorted((r.old_id, r.new_id, r.old_m, r.new_m, r.common) for r in found.collect()) == want and len(want) > 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert kept["blocks"].count() == -(-62 // rows) and kept["blocks"].selectExpr("sum(size(sets))").first()[0] == 62


@pytest.mark.parametrize("bound", [2_000, 3])
def test_nearest_vectors_equal_a_plain_sort(spark, monkeypatch, bound):
    """Ties, null and shorter vectors, few vectors, few and many questions; no pair of vectors is made in the plan."""
    monkeypatch.setattr(retrieve, "BROADCAST_QUERIES", bound)
    monkeypatch.setattr(retrieve, "BLOCK_VECTORS", 20)
    rng = random.Random(9)
    rows = [(k, [rng.choice([0.0, 0.1, 0.25, -0.3]) for _ in range(4)]) for k in range(60)] + [(70, None), (71, [0.1, 0.2]), (72, [0.1, None, 0.1, 0.1])]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    queries = vectors.where("doc_id < 7 or doc_id = 70").withColumnRenamed("doc_id", "query_id")
    pairs = vectors.crossJoin(queries.withColumnRenamed("embedding", "q")).select("query_id", "doc_id", F.round(cosine("embedding", "q"), 6).alias("sim"))
    for k in (5, 100):
        order = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.desc("doc_id"))
        want = pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
        found = retrieve.dense_candidates(vectors, queries, k)
        assert sorted(map(repr, map(tuple, found.select("query_id", "doc_id", "sim", "rank").collect()))) == sorted(map(repr, map(tuple, want.collect())))
        assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_tasks_hold_little_of_long_texts(spark):
    """Only anchors of passages leave a text, and a few texts' at a time; sessions get small batches."""
    from tidemark.sources import scratch

    scratch.bounded_batches(spark)
    assert spark.conf.get(scratch.BATCH_CONF) == "8m"
    cuts = list(substring.sliced(["a" * 200_000, "b" * 60_000, "", "c", "d" * 300_000, "e"]))
    assert [(at, len(rows)) for at, rows in cuts] == [(0, 2), (2, 3), (5, 1)]
    texts = spark.createDataFrame([(k, "xyz " * 50 + f"passage number {k} is here and long enough to have an anchor " + "tail " * 50) for k in range(40)], "id long, text string")
    found = substring.containing(texts, spark.createDataFrame([("p", "passage number 7 is here and long enough to have an anchor")], "passage_id string, passage string"))
    assert [tuple(r) for r in found.collect()] == [(7, "p")]


def test_paths_from_many_starts_meet_few_edges_by_broadcast(spark):
    """All paths come by one node: its edges go to the paths, not the paths to it."""
    edges = [(f"s{k}", f"m{k % 9}", "t", 1) for k in range(50)] + [(f"m{k}", "hub", "t", 1) for k in range(9)] + [("hub", "end", "t", 1), ("hub", "m1", "t", 1)]
    rel = spark.createDataFrame(edges, "source_id string, target_id string, type string, seq int")
    start = spark.createDataFrame([(x,) for x in sorted({e[0] for e in edges} | {"none"})], "id string")
    found = graph.paths(rel, start, max_depth=4)
    want, front = [], [(e[0],) for e in {(e[0],) for e in edges}]
    for _ in range(4):
        front = [(*p, t) for p in front for s, t, *_ in edges if s == p[-1] and t not in p]
        want += front
    assert sorted(tuple(r.path) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("bound", [100_000, 20])
def test_entities_that_all_facts_name(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "HOT_FACTS", bound)
    facts = spark.createDataFrame([(k, [f"e{k % 40}", "all", "missing", "e0"]) for k in range(60)] + [(99, []), (98, None)], "id long, entity_ids array<string>")
    entities = spark.createDataFrame([(f"e{k}", f"name {k}") for k in range(30)] + [("all", "everything")], "id string, name string")
    found = graph.entities_of(facts, entities)
    known = {f"e{k}" for k in range(30)} | {"all"}
    want = sorted((k, p, e) for k in range(60) for p, e in enumerate([f"e{k % 40}", "all", "missing", "e0"]) if e in known)
    assert sorted((r.id, r.pos, r.entity_id) for r in found.collect()) == want
    assert found._jdf.queryExecution().executedPlan().toString().count("LeftAnti") >= 1


@pytest.mark.parametrize("held", [4_000_000, 0])
def test_counted_search_equals_the_joined_one(spark, monkeypatch, held):
    """Copies beyond k, null and empty texts and ids, repeated words, batches of three rows, and more questions than a task holds."""
    from tidemark.operators import bm25

    monkeypatch.setattr(bm25, "HELD_WEIGHTS", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    texts = [None, "", "rock rock Rivér", "river bank", "bank bank bank", *["rock of ages"] * 9, "été ETE ete", "nothing asked", "rock river bank ete"]
    docs = spark.createDataFrame([(f"d{k:02d}", t) for k, t in enumerate(texts)] + [(None, "rock")], "doc_id string, text string").repartition(3)
    asked = spark.createDataFrame([(1, "rock rock river"), (2, "ete bank"), (3, "absent"), (4, None), (None, "river")], "query_id long, text string")
    want = bm25.search_documents(docs, asked.where("query_id is not null or text is null"), 4)
    found = bm25.search_counted(docs, asked, 4)
    assert found.columns == want.columns and sorted(map(tuple, found.where("query_id is not null").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert bm25.search_counted(docs, asked.where("false"), 4).count() == 0 and bm25.search_counted(docs.where("false"), asked, 4).count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("held", [4_000_000, 0])
def test_overlap_of_copies_and_of_questions_with_few_hits(spark, monkeypatch, held):
    from tidemark.operators import bm25

    monkeypatch.setattr(bm25, "HELD_WEIGHTS", held)
    words = [["a"], ["a", "b"], *[["b", "c"]] * 9, [], ["d"], None, ["c", "a", "b"]]
    asked = {1: ["a", "b"], 2: ["d"], 3: ["x"], 4: [], 5: ["a", "b", "c"]}
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, tokens array<string>").repartition(4)
    found = retrieve.overlap_search(docs, spark.createDataFrame(list(asked.items()), "query_id long, tokens array<string>"), 5)
    got = {(r.query_id, r.rank): (r.doc_id, r.overlap) for r in found.collect()}
    assert got == {(q, n): (d, c) for q, t in asked.items() for n, (c, d) in enumerate(sorted(((len(set(t) & set(w or [])), d) for d, w in enumerate(words)), key=lambda x: (-x[0], x[1]))[:5], 1)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert held == 0 or plan.count("MapInArrow") == 2 and "Exchange hashpartitioning(t" not in plan  # counted and scored where they are read, once


def test_what_a_store_derives_from_texts_is_made_once(spark):
    """Vectors and signatures come from one embedding, keys from one ordering, and terms are counted with their documents, without a shuffle."""
    from tidemark.functions import embed
    from tidemark.operators import bm25
    from tidemark.sources import derived

    rows = spark.createDataFrame([("a", "rock rock river"), ("b", None), ("c", ""), ("d", "river Été")], "id string, content string")
    facts = rows.select("id", F.lit(1).cast("long").alias("seq"), "content", F.array(F.lit("e")).alias("entity_ids"), F.lit("2024-01-01").cast("timestamp").alias("effective_at"), F.lit(False).alias("deprecated"))
    sketches = derived.sketches_of(facts, embed.hashing_embedder(64))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(sketches).count("ArrowEvalPython") == 1 and "pythonUDF1" not in plan(sketches)
    chained = facts.select("id", embed.hashing_embedder(64)("content").alias("v")).withColumn("signature", derived.signature_of("v"))
    assert {r.id: (r.v, r.signature) for r in sketches.collect()} == {r.id: (r.v, r.signature) for r in chained.collect()}
    assert plan(derived.keys_of(sketches, 0.2)).count("xxhash64") == 1
    tokens = bm25.tokens_of(rows, "id", "content")
    counts = bm25.term_counts(tokens)
    assert sorted(map(tuple, counts.collect())) == [("a", 3, "river", 1), ("a", 3, "rock", 2), ("d", 2, "ete", 1), ("d", 2, "river", 1)] and "Exchange hash" not in plan(counts)
