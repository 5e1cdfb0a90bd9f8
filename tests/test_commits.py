"""Commits, stops between their steps, numbered batches, compaction, and what searches and writes read."""

import pytest
from pyspark.sql import functions as F

from tidemark.memory import FactStore
from tidemark.operators import retrieve
from tidemark.schema import EngineConfig
from tidemark.sources import derived
from tidemark.sources.commits import CommitLog
from tidemark.sources.store import Write


class Stop(Exception):
    pass


@pytest.fixture()
def store(spark, tmp_path):
    return FactStore(spark, str(tmp_path / "db"), EngineConfig(dim=64))


def batch_of(spark, rows):
    df = spark.createDataFrame([(i, text, names, "s", "{}", k) for k, (i, text, names) in enumerate(rows)], "id string, content string, entities array<string>, source string, metadata string, pos int")
    return df.withColumn("effective_at", F.lit("2024-01-02").cast("timestamp")).withColumn("created_at", F.lit("2024-01-03").cast("timestamp"))


FIRST = [("a", "Acme office moved into Lisbon city", ["Acme"]), ("b", "Bananas ripen beside apples", ["Fruit"])]
SECOND = [("c", "Acme office moved into Porto city", ["Acme"]), ("d", "Delta plant makes bricks", ["Delta"])]


def state(store):
    return {(r.id, r.content, r.deprecated, r.replaced_by) for r in store.list(True).collect()}


def test_a_stop_between_any_two_steps_changes_nothing(spark, store, monkeypatch):
    store.remember_batch(batch_of(spark, FIRST))
    before, append, publish = state(store), Write.append, CommitLog.publish
    steps = 0
    while True:
        left = [steps]

        def stopped(self, name, rows):
            if left[0] == 0:
                raise Stop
            left[0] -= 1
            return append(self, name, rows)

        monkeypatch.setattr(Write, "append", stopped)
        monkeypatch.setattr(CommitLog, "publish", lambda self, commit: (_ for _ in ()).throw(Stop()))
        with pytest.raises(Stop):
            store.remember_batch(batch_of(spark, SECOND), batch=("w", 1))
        monkeypatch.setattr(Write, "append", append)
        assert store.catalog.commits.latest().version == 1 and state(store) == before
        if left[0]:
            break  # all was appended, and the commit itself was stopped
        steps += 1
    assert steps - 1 == 6  # entities, facts, postings, sketches, keys, supersession
    with pytest.raises(Stop):
        store.compact()
    assert state(store) == before
    monkeypatch.setattr(CommitLog, "publish", publish)
    store.remember_batch(batch_of(spark, SECOND), batch=("w", 1))
    after = state(store)
    assert {(r[0], r[2], r[3]) for r in after} == {("a", True, "c"), ("b", False, None), ("c", False, None), ("d", False, None)}
    # The same batch again, as a stream replays it, and a batch before it.
    for n in (1, 0):
        store.remember_batch(batch_of(spark, SECOND), batch=("w", n))
    assert state(store) == after and store.catalog.commits.latest().version == 2
    # Without a number it is a new version of the same facts, which replaces what it contradicts once more.
    store.remember_batch(batch_of(spark, SECOND))
    assert state(store) == after and store.catalog.commits.latest().counts["facts"] == 4
    seq = store.catalog.commits.latest().next_seq
    store.compact()
    assert state(store) == after and store.catalog.commits.latest().next_seq >= seq
    assert store.catalog.vacuum(keep=1, age_hours=0) > 10 and state(store) == after
    assert [r["id"] for r in store.query("Where is the Acme office?", 1)] == ["c"]


def test_another_writer_in_between(spark, store):
    """The write begins again from the other one's commit: no number is given out twice."""
    other, calls = FactStore(spark, store.catalog.base, store.config), []

    def build(write):
        calls.append(write.commit.version)
        if len(calls) == 1:
            other.upsert_entity("x", "Xenon")
        seq = write.take()
        write.append("entities", spark.createDataFrame([("y", "Yttrium", "{}", seq)], "id string, name string, metadata string, seq long"))
        return seq

    assert store.catalog.write(build) == 2 and calls == [0, 1]
    assert {(r.id, r.seq) for r in store.list_entities().collect()} == {("x", 1), ("y", 2)}
    assert not store.catalog.commits.publish(store.catalog.commits.read(1))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_searches_and_writes_read_no_contents(spark, store):
    store.remember_batch(batch_of(spark, FIRST))
    view = store.catalog.view()
    asked = spark.createDataFrame([(1, "Lisbon office")], "query_id long, text string")
    found = derived.search_stored(view, asked, 5)
    assert [r.doc_id for r in found.collect()] == ["a"] and "content" not in plan(found) and "In(term" in plan(found)
    vectors = derived.vectors_of(view)
    assert vectors.count() == 2 and "content" not in plan(vectors)
    sketch = derived.sketches_of(batch_of(spark, SECOND).select("id", "content", F.array(F.lit("e")).alias("entity_ids"), "effective_at", F.lit(False).alias("deprecated"), F.lit(99).cast("long").alias("seq")), store.embedder)
    met = store._contradicted(view, view, derived.keys_of(sketch, 0.2), sketch, F.current_timestamp())
    assert [(r.old_id, r.new_id) for r in met.collect()] == [("a", "c")] and "facts/" not in plan(met)


def test_views_read_partitions_up_to_their_day(spark, store):
    rows = batch_of(spark, [(f"f{k}", f"unit {k} stands", []) for k in range(6)])
    rows = rows.withColumn("effective_at", F.expr("timestamp'2024-01-01 12:00:00' + make_dt_interval(pos)")).withColumn("created_at", F.expr("effective_at + make_dt_interval(if(pos = 5, -4, 1))"))
    store.remember_batch(rows, auto_resolve=False)
    early = store.active("2024-01-03 13:00:00")
    assert {r.id for r in early.collect()} == {"f0", "f1", "f2"}
    for df in (early, store.effective_between("2024-01-01", "2024-01-03"), store.knowledge_at("nobody", "2024-01-03")):
        assert "(since" in plan(df) and "<= 19725)" in plan(df)
    kept = store.catalog.facts(F.lit("2024-01-03 13:00:00").cast("timestamp"))
    assert {r.id for r in kept.collect()} == {"f0", "f1", "f2", "f5"}  # f5 was known by then


def test_signatures_find_neighbours(spark, monkeypatch):
    """Of the ten nearest vectors of every twentieth one, what a hundred candidates of 2,000 hold; and all of them among all."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding").withColumn("signature", derived.signature_of("embedding"))
    asked = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    rows = lambda df: {(r.query_id, r.doc_id, r.sim, r.rank) for r in df.collect()}
    exact, near = rows(retrieve.dense_candidates(v, asked, 10)), rows(retrieve.dense_candidates(v, asked, 10, candidates=100))
    assert len(exact) == 1000 and len({r[:3] for r in exact} & {r[:3] for r in near}) / len(exact) >= 0.93
    assert rows(retrieve.dense_candidates(v, asked, 10, candidates=2000)) == exact
    monkeypatch.setattr(retrieve, "BROADCAST_QUERIES", 5)
    assert rows(retrieve.nearby(v, asked, 10, 100)) == near


def test_the_store_searches_nearby(spark, store):
    store.remember_batch(batch_of(spark, FIRST + SECOND), auto_resolve=False)
    asked = spark.createDataFrame([(1, "bricks of the plant"), (2, "ripe bananas")], "query_id long, text string")
    rows = lambda **o: sorted((r.query_id, r.id, r.rank) for r in store.search(asked, 1, **o).collect())
    assert rows(candidates=4) == rows() == [(1, "d", 1), (2, "b", 1)]
