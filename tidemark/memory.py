"""The facade: one store of facts, entities and relations under a path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions.embed import hashing_embedder
from .functions.text import ascii_fold
from .operators import conflict, graph, retrieve, temporal
from .schema import EngineConfig
from .sources import derived
from .sources.store import Catalog, View, Write, from_json, from_records, latest, to_json, to_records


def new_id() -> str:
    return uuid.uuid4().hex


def _decoded(row) -> dict | None:
    """A row as a dictionary, its metadata read from JSON."""
    return None if row is None else {k: from_json(v) if k == "metadata" else v for k, v in row.asDict(True).items()}


def _named(entities: DataFrame, name: str):
    """The entity of a name, by ASCII case; None if there is none."""
    return entities.where(ascii_fold("name") == ascii_fold(F.lit(name))).orderBy("id").first()


class FactStore:
    """Writes go in batches; every read is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), embedder=None, judge=conflict.default_judge):
        self.spark, self.config, self.judge = spark, config, judge
        self.catalog = Catalog(spark, path)
        self.embedder = embedder or hashing_embedder(config.dim)

    def __enter__(self) -> FactStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open: every write is complete when it returns. The session is its owner's."""

    # -- writing

    def remember(self, content: str, entities: list[str] = (), relations: list[tuple[str, str, str]] = (), source: str = "", effective_at=None, created_at=None, metadata: dict | None = None, auto_resolve: bool | None = None) -> str:
        """One fact. Its names become entities, relations (source, target, type) edges; contradicted facts are replaced. All in one commit."""
        rows = self.spark.createDataFrame([(content, list(entities), source, to_json(metadata or {}))], "content string, entities array<string>, source string, metadata string")
        for name, at in (("effective_at", effective_at), ("created_at", created_at)):
            rows = rows.withColumn(name, F.lit(at).cast("timestamp") if at else F.current_timestamp())
        fact_id = new_id()
        rows = rows.withColumn("id", F.lit(fact_id)).withColumn("pos", F.lit(0))

        def build(write: Write) -> None:
            self._remember(write, rows, auto_resolve, None, known=False)
            for edge in relations:
                self._relate(write, *edge)

        self.catalog.write(build)
        return fact_id

    def remember_batch(self, rows: DataFrame, auto_resolve: bool | None = None, now=None, batch: tuple[str, int] | None = None) -> None:
        """Facts (id, content, entities, effective_at, created_at, source, metadata, pos), written in the order of pos, in one commit.

        One set-based pass finds what each write replaces, among stored facts and the batch itself; only
        keys and sketches of stored facts are read for it. A known id gets a new version. batch: the
        writer's name and the batch's number; one that the writer has committed before changes nothing.
        """
        self.catalog.write(lambda write: self._remember(write, rows, auto_resolve, now), batch)

    def _remember(self, write: Write, rows: DataFrame, auto_resolve: bool | None, now, known: bool = True) -> None:
        self._ensure_entities(write, rows.select(F.explode("entities").alias("name")))
        names = write.entities().select(ascii_fold("name").alias("folded"), F.col("id").alias("entity_id"))
        listed = rows.select("id", "pos", F.posexplode_outer("entities").alias("k", "name")).withColumn("folded", ascii_fold("name")).join(names, "folded", "left")
        ids = listed.groupBy("id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("entity_id").isNotNull(), F.struct("k", "entity_id")))), lambda x: x["entity_id"]).alias("entity_ids"))
        base = write.next_seq
        facts = rows.drop("entities").join(ids, ["id", "pos"]).withColumn("seq", F.lit(base) + F.col("pos")).withColumn("deprecated", F.lit(False)).withColumn("replaced_by", F.lit(None).cast("string")).drop("pos")
        before = write.before()
        if known:
            again = before.log("facts").select("id").join(rows.select("id").distinct(), "id", "left_semi").distinct()
            if not again.isEmpty():
                derived.bury(write, again, base - 1)
        stored, keys, sketches = derived.add_facts(write, latest(facts), self.embedder, self._least())
        write.take((stored.agg(F.max("seq")).first()[0] or base) - base + 1 if known else 1)
        if self.config.auto_resolve if auto_resolve is None else auto_resolve:
            moment = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
            found = self._contradicted(write, before, keys, sketches, moment)
            write.append("supersession", conflict.resolve(found).withColumn("manual", F.lit(False)).withColumn("score", F.lit(None).cast("double")))

    def add_records(self, records: list[dict]) -> None:
        """Facts as they are (dictionaries as records() gives them), in their order and in one commit: nothing is replaced, and a known id gets a new version."""
        made = [{"id": new_id()} | {k: v for k, v in r.items() if v is not None} for r in records]

        def build(write: Write) -> None:
            base = write.take(len(made))
            rows = from_records(self.spark, [r | {"seq": base + k} for k, r in enumerate(made)], "facts")
            again = write.log("facts").select("id").join(rows.select("id"), "id", "left_semi").distinct()
            if not again.isEmpty():
                derived.bury(write, again, base - 1)
            now = F.current_timestamp()
            derived.add_facts(write, latest(rows).withColumn("effective_at", F.coalesce("effective_at", now)).withColumn("created_at", F.coalesce("created_at", now)), self.embedder, self._least())

        self.catalog.write(build)

    def _least(self) -> float:
        """The Jaccard that blocking keys are chosen for: judges hardly score pairs below 0.2."""
        return min(0.2, self.config.related_jaccard)

    def _contradicted(self, write: View, before: View, keys: DataFrame, sketches: DataFrame, moment, unwritten: DataFrame | None = None) -> DataFrame:
        """What new facts (keys, sketches) contradict among themselves and among those that are active in `before`. unwritten: new facts that aren't stored."""
        met = derived.listed(before.log("keys"), "key", keys, "key").unionByName(keys)
        replaced = before.log("supersession").select(F.col("old_id").alias("id"), F.col("at_seq"))
        candidates = derived.listed(before.log("sketches"), "id", met, "id")
        active = write.live("sketches", candidates).join(replaced, (candidates.id == replaced.id) & (F.col("at_seq") >= F.col("seq")), "left_anti")
        new = sketches
        old = active.unionByName(new).where(~F.coalesce("deprecated", F.lit(False)) & (F.col("effective_at") <= moment))
        facts = None
        if isinstance(self.judge, conflict.PairJudge):
            facts = write.live("facts", derived.listed(write.log("facts"), "id", met, "id"))
            facts = facts if unwritten is None else facts.unionByName(unwritten, allowMissingColumns=True)
        return conflict.written(met, keys, old, new, self.config.conflict_threshold, self.config.related_jaccard, self.judge, facts)

    def ensure_entities(self, names: DataFrame) -> None:
        """Get or create: names are equal by ASCII case; the first spelling stays."""
        self.catalog.write(lambda write: self._ensure_entities(write, names))

    def _ensure_entities(self, write: Write, names: DataFrame) -> None:
        fresh = names.where("name is not null").groupBy(ascii_fold("name").alias("folded")).agg(F.min("name").alias("name"))
        known = write.entities().select(ascii_fold("name").alias("folded"))
        made = fresh.join(known, "folded", "left_anti").select(F.sha2("folded", 256).substr(1, 32).alias("id"), "name", F.lit("{}").alias("metadata"), F.lit(write.take()).alias("seq"))
        if not made.isEmpty():
            write.append("entities", made)

    def upsert_entity(self, entity_id: str, name: str, metadata: dict | None = None) -> None:
        """Adds an entity, or gives one of this id another name and other metadata."""
        self.catalog.write(lambda write: write.append("entities", self.spark.createDataFrame([(entity_id, name, to_json(metadata or {}), write.take())], schema.ENTITIES)))

    def add_entity(self, name: str, metadata: dict | None = None, entity_id: str | None = None) -> str:
        """A node of the graph; of a known name the one that there is."""
        known = self.entity_id(name)
        if known is None or entity_id is not None:
            known = entity_id or new_id()
            self.upsert_entity(known, name, metadata)
        return known

    def add_relation(self, source: str, target: str, kind: str, metadata: dict | None = None, relation_id: str | None = None) -> str:
        """An edge between two names, which become entities; one of a known id is replaced."""
        return self.catalog.write(lambda write: self._relate(write, source, target, kind, metadata, relation_id))

    def _relate(self, write: Write, source: str, target: str, kind: str, metadata: dict | None = None, relation_id: str | None = None) -> str:
        self._ensure_entities(write, self.spark.createDataFrame([(source,), (target,)], "name string"))
        made = relation_id or new_id()
        ends = [_named(write.entities(), n)["id"] for n in (source, target)]
        write.append("relations", self.spark.createDataFrame([(made, write.take(), *ends, kind, to_json(metadata or {}))], schema.RELATIONS))
        return made

    def update(self, fact_id: str, **changes) -> None:
        """A new version; nothing happens where the id is unknown. deprecated=False restores a replaced fact, unless replaced_by is given too."""
        if changes.get("deprecated") is False:
            changes = {"replaced_by": None} | changes

        def build(write: Write) -> None:
            found = write.facts().where(F.col("id") == fact_id)
            if found.isEmpty():
                return
            for name, value in changes.items():
                found = found.withColumn(name, F.lit(to_json(value) if name == "metadata" else value).cast(found.schema[name].dataType))
            seq = write.take()
            found = found.withColumn("seq", F.lit(seq))
            derived.bury(write, self.spark.createDataFrame([(fact_id,)], "id string"), seq - 1)
            derived.add_facts(write, found, self.embedder, self._least())

        self.catalog.write(build)

    def delete(self, fact_id: str, table: str = "facts") -> bool:
        """Whether there was something to delete, which is gone then."""
        one = self.spark.createDataFrame([(fact_id,)], "id string")

        def build(write: Write) -> bool:
            known = not getattr(write, table)().where(F.col("id") == fact_id).isEmpty()
            if known and table == "facts":
                derived.bury(write, one, write.take())
            elif known:
                write.append("tombstones", one.withColumn("seq", F.lit(write.take())))
            return known

        return self.catalog.write(build)

    def delete_relation(self, relation_id: str) -> bool:
        return self.delete(relation_id, "relations")

    def deprecate(self, fact_id: str, replaced_by: str | None = None) -> bool:
        def build(write: Write) -> bool:
            known = not write.facts().where(F.col("id") == fact_id).isEmpty()
            if known:
                write.append("supersession", self.spark.createDataFrame([(fact_id, replaced_by, write.take(), None, True)], schema.SUPERSESSION))
            return known

        return self.catalog.write(build)

    def compact(self) -> None:
        """Rewrites the tables of many small writes as few files, without what is dead."""
        self.catalog.compact()

    # -- reading

    def recall(self, fact_id: str) -> dict | None:
        """A fact as a dictionary, its metadata read; None where the id is unknown."""
        return _decoded(self.catalog.facts().where(F.col("id") == fact_id).first())

    def records(self, include_deprecated: bool = True):
        """All facts as dictionaries, one after another."""
        return to_records(self.list(include_deprecated).drop("seq"))

    def get_entity(self, entity_id: str) -> dict | None:
        return _decoded(self.catalog.entities().where(F.col("id") == entity_id).first())

    def find_entity(self, name: str) -> dict | None:
        return _decoded(_named(self.catalog.entities(), name))

    def list_entities(self) -> DataFrame:
        return self.catalog.entities().orderBy("name", "id")

    def list_relations(self) -> DataFrame:
        return self.catalog.relations()

    def entity_id(self, name: str) -> str | None:
        found = self.find_entity(name)
        return found["id"] if found else None

    def list(self, include_deprecated: bool = False) -> DataFrame:
        return temporal.list_facts(self.catalog.facts(), include_deprecated)

    def active(self, at=None) -> DataFrame:
        """Facts valid at a moment, from the partitions up to its day: later ones neither begin nor end anything by then."""
        moment = F.lit(at).cast("timestamp") if at else F.current_timestamp()
        return temporal.active_at(self.catalog.facts(moment), moment)

    def effective_between(self, start, end) -> DataFrame:
        start, end = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
        return temporal.effective_between(self.catalog.facts(end), start, end)

    def timeline(self, entity: str | None = None, limit: int = 50) -> DataFrame:
        """History of an entity's facts, or of all; an unknown name has none."""
        about = None if entity is None else F.array_contains("entity_ids", self.entity_id(entity) or "")
        return temporal.replay(self.catalog.facts(), about, limit)

    def knowledge_at(self, entity: str, at) -> DataFrame:
        moment = F.lit(at).cast("timestamp")
        return temporal.knowledge_at(self.catalog.facts(moment), moment, F.array_contains("entity_ids", self.entity_id(entity) or ""))

    def conflicts_for(self, content: str, entities: list[str] = ()) -> DataFrame:
        """Facts that a new one would replace, with their scores, by the same steps as a write."""
        view = self.catalog.view()
        known = [r["id"] for r in (_named(view.entities(), e) for e in entities) if r]
        now = F.current_timestamp()
        asked = self.spark.createDataFrame([("", 2**62, content, known, False)], "id string, seq long, content string, entity_ids array<string>, deprecated boolean").withColumn("effective_at", F.lit("2200-01-01").cast("timestamp"))
        sketch = derived.sketches_of(asked, self.embedder)
        found = self._contradicted(view, view, derived.keys_of(sketch, self._least()), sketch, now, asked).select(F.col("old_id").alias("id"), "score")
        return view.facts().join(found, "id").orderBy(F.desc("score"), "id")

    def search(self, questions: DataFrame, k: int = 5, at=None, now=None, entities: list[str] | None = None, min_score: float = 0.0, candidates: int | None = None) -> DataFrame:
        """The k best facts of each question (query_id, text): one plan for all of them, from stored postings and vectors.

        candidates: compare with so many vectors only, those of the nearest signatures; by default with all, which is exact.
        """
        view = self.catalog.view()
        sparse = derived.search_stored(view, questions, 3 * k)
        dense = retrieve.dense_candidates(derived.vectors_of(view), questions.select("query_id", self.embedder("text").alias("embedding")), max(3 * k, 10), candidates)
        moment = lambda t: F.lit(t).cast("timestamp") if t else F.current_timestamp()
        ids = None if entities is None else [r["id"] for r in (_named(view.entities(), e) for e in entities) if r]
        return retrieve.hybrid(retrieve.fuse(sparse, dense, self.config.rrf_k), view.facts(), k, self.config, at=moment(at) if at else None, now=moment(now), min_score=min_score, entities=ids)

    def query(self, question: str, k: int = 5, **options) -> list[dict]:
        asked = self.spark.createDataFrame([(0, question)], "query_id long, text string")
        return [_decoded(r) for r in self.search(asked, k, **options).orderBy("rank").collect()]

    def neighbors(self, name: str, depth: int = 1) -> DataFrame:
        start = self.spark.createDataFrame([(self.entity_id(name) or "",)], "id string")
        near = graph.neighbors(self.catalog.relations(), start, depth)
        return near.join(self.catalog.entities().select("id", "name"), "id").orderBy("id")

    def paths(self, source: str, target: str, max_depth: int = 5) -> DataFrame:
        one = lambda n: self.spark.createDataFrame([(self.entity_id(n) or "",)], "id string")
        return graph.paths(self.catalog.relations(), one(source), one(target), max_depth)

    def summary(self) -> dict:
        return graph.summary(self.catalog.entities(), self.catalog.relations()).first().asDict()
