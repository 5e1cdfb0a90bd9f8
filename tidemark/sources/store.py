"""Storage: immutable Parquet folders under one commit log, with the current state derived by joins.

Updates write a new version and a tombstone of the old one, deletions a tombstone, replacements
an event; a commit makes all that a write appended to any table visible at once. Facts lie in
partitions by the day since which they matter (the earlier of becoming true and of being
learned), sorted by effective_at, so that views of a moment read no later partition. Postings,
blocking keys and sketches (token sets and vectors) are written with the facts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.time import parse_time
from .commits import Commit, CommitLog
from .json_array import read_objects

TABLES = {
    "facts": schema.FACTS, "entities": schema.ENTITIES, "relations": schema.RELATIONS, "supersession": schema.SUPERSESSION, "tombstones": schema.TOMBSTONES,
    "postings": schema.POSTINGS, "keys": schema.KEYS, "sketches": schema.SKETCHES,
}
#: Tables whose folders are partitioned, by what; and how rows are sorted within a file, for the statistics that let readers skip.
PARTITIONS = {"facts": ("since", "int")}
SORTED = {"facts": ["since", "effective_at"], "postings": ["term", "id"], "keys": ["key", "id"], "sketches": ["id"], "entities": ["id"], "relations": ["id"]}
#: Tombstones up to this many are broadcast, 50 bytes each.
BROADCAST_TOMBSTONES = 200_000


def day_of(moment: Column) -> Column:
    """Days since 1970, whatever the session's time zone."""
    return F.floor(F.unix_seconds(moment.cast("timestamp")) / 86400).cast("int")


def latest(log: DataFrame, key: str = "id", version: str = "seq") -> DataFrame:
    """The last version of each key. Pre-aggregated in each task, so many versions of one key are no large group."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), version).alias("row")).select("row.*")


def without(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows that haven't been deleted since they were written."""
    gone = tombstones.groupBy(F.col("id").alias("gone_id")).agg(F.max("seq").alias("gone_seq"))
    return rows.join(gone, (rows.id == gone.gone_id) & (rows.seq <= gone.gone_seq), "left_anti")


def chosen(supersession: DataFrame) -> DataFrame:
    """old_id, new_id of the event that counts: of manual ones the last, else the first automatic one."""
    manual = F.max_by(F.struct("new_id"), F.when(F.col("manual"), F.col("at_seq")))
    first = F.min_by(F.struct("new_id"), F.when(~F.col("manual"), F.col("at_seq")))
    return supersession.groupBy("old_id").agg(manual.alias("m"), first.alias("f"), F.max("manual").alias("any")).select("old_id", F.when(F.col("any"), F.col("m.new_id")).otherwise(F.col("f.new_id")).alias("new_id"))


def apply_supersession(facts: DataFrame, supersession: DataFrame) -> DataFrame:
    """facts with deprecated and replaced_by as the events since their version was written say; earlier ones are part of it."""
    later = supersession.join(facts.select(F.col("id").alias("old_id"), "seq"), "old_id").where(F.col("at_seq") >= F.col("seq"))
    events = chosen(later).select("old_id", F.struct("new_id").alias("event"))
    joined = facts.select(F.struct("*").alias("fact"), "id").join(events, F.col("id") == F.col("old_id"), "left")
    own = lambda c: F.col("fact")[c]
    new = {"deprecated": F.coalesce(own("deprecated"), F.lit(False)) | F.col("event").isNotNull(), "replaced_by": F.when(F.col("event").isNotNull(), F.col("event.new_id")).otherwise(own("replaced_by"))}
    return joined.select(*[new.get(c, own(c)).alias(c) for c in facts.columns])


def upserted(known: DataFrame, incoming: DataFrame, key: str = "id", version: str = "seq") -> DataFrame:
    """The rows of both, of each key the last version: incoming ones replace known ones whose versions are earlier."""
    return latest(known.unionByName(incoming), key, version)


def to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def from_json(text: str | None) -> dict:
    """A JSON object; empty for anything that isn't one."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def to_records(rows: DataFrame):
    """Each row as a dictionary, one after another: metadata as an object, moments as ISO texts in UTC."""
    zoned = [F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias(c) if kind == "timestamp" else F.col(c) for c, kind in rows.dtypes]
    for row in rows.select(*zoned).toLocalIterator():
        yield {k: from_json(v) if k == "metadata" else v for k, v in row.asDict(True).items()}


def from_records(spark: SparkSession, records: list[dict], table: str) -> DataFrame:
    """Rows of a table from dictionaries as to_records gives them; what one leaves out is null, but for entity_ids (none), metadata (an empty object) and deprecated (false)."""
    wanted = spark.createDataFrame([], TABLES[table]).schema
    usual = {"entity_ids": [], "metadata": {}, "deprecated": False}
    said = lambda r, f: to_json(r.get(f, {}) or {}) if f == "metadata" else str(r[f]) if f in ("effective_at", "created_at") and r.get(f) is not None else r.get(f, usual.get(f))
    ddl = ", ".join(f"{f.name} {'string' if f.dataType.typeName() == 'timestamp' else f.dataType.simpleString()}" for f in wanted)
    rows = spark.createDataFrame([tuple(said(r, f.name) for f in wanted) for r in records], ddl)
    return rows.select(*[parse_time(f.name).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in wanted])


class View:
    """The tables as one commit has them. folders: of each table; counts: of live facts, and of their tokens."""

    def __init__(self, spark: SparkSession, base: str, folders: dict[str, list[str]], counts: dict[str, int] | None = None):
        self.spark, self.base, self.folders, self.counts = spark, base, folders, counts or {}

    def log(self, name: str) -> DataFrame:
        """All that was appended to a table, with the column that partitions it; empty before the first time."""
        ddl = TABLES[name] + (f", {' '.join(PARTITIONS[name])}" if name in PARTITIONS else "")
        held = [f"{self.base}/{folder}" for folder in self.folders.get(name, [])]
        if not held:
            return self.spark.createDataFrame([], ddl)
        read = self.spark.read.schema(ddl)
        return read.option("basePath", f"{self.base}/{name}").parquet(*held).drop("segment") if name in PARTITIONS else read.parquet(*held)

    def live(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        """The rows of a table, or those given of it, that belong to no deleted or replaced version."""
        gone = self.log("tombstones")
        if not self.folders.get("tombstones"):
            return self.log(name) if rows is None else rows
        return without(self.log(name) if rows is None else rows, F.broadcast(gone) if gone.limit(BROADCAST_TOMBSTONES + 1).count() <= BROADCAST_TOMBSTONES else gone)

    def facts(self, until: Column | None = None) -> DataFrame:
        """The facts; until: only those that are true or known by then, from the partitions up to its day."""
        log = self.log("facts")
        rows = self.live("facts", log if until is None else log.where(F.col("since") <= day_of(until))).drop("since")
        return apply_supersession(rows, self.log("supersession")) if self.folders.get("supersession") else rows

    def entities(self) -> DataFrame:
        return latest(self.log("entities"))

    def relations(self) -> DataFrame:
        return self.live("relations", latest(self.log("relations")))


class Write(View):
    """A write in the making: it sees what it has appended itself, besides the commit that it began with."""

    def __init__(self, catalog: Catalog, commit: Commit):
        super().__init__(catalog.spark, catalog.base, {t: list(f) for t, f in commit.live.items()}, dict(commit.counts))
        self.catalog, self.commit, self.next_seq = catalog, commit, commit.next_seq
        self.added: list[str] = []

    def take(self, n: int = 1) -> int:
        """The first of n numbers; versions, replacements and deletions follow one order."""
        self.next_seq += n
        return self.next_seq - n

    def before(self) -> View:
        """What this write sees now, and nothing that it appends later."""
        return View(self.spark, self.base, {t: list(f) for t, f in self.folders.items()}, dict(self.counts))

    def count(self, **more: int) -> None:
        for name, n in more.items():
            self.counts[name] = self.counts.get(name, 0) + n

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows as they are stored, in a folder of their own."""
        wanted = self.spark.createDataFrame([], TABLES[name]).schema
        extra = [F.col(PARTITIONS[name][0])] if name in PARTITIONS else []
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted], *extra)
        folder = f"{name}/{'segment=' * (name in PARTITIONS)}{uuid.uuid4().hex}"
        self.added.append(folder)
        by = PARTITIONS[name][0] if name in PARTITIONS else SORTED.get(name, [None])[0]
        if by:
            rows = rows.hint("rebalance", F.col(by))  # few files a partition, and parts of a large one in several tasks
        if name in SORTED:
            rows = rows.sortWithinPartitions(*SORTED[name])
        writer = rows.write.partitionBy(by) if name in PARTITIONS else rows.write
        writer.parquet(f"{self.base}/{folder}")
        self.folders.setdefault(name, []).append(folder)
        return View(self.spark, self.base, {name: [folder]}).log(name)


class Catalog:
    """The tables under base_path."""

    def __init__(self, spark: SparkSession, base_path: str):
        self.spark, self.base = spark, base_path.rstrip("/")
        self.commits = CommitLog(spark, self.base)

    def view(self) -> View:
        commit = self.commits.latest()
        return View(self.spark, self.base, commit.live, commit.counts)

    def write(self, build: Callable[[Write], object], batch: tuple[str, int] | None = None, tries: int = 5):
        """What build(write) returns, once all that it appended is committed; None without building where the batch (writer, number) or a later one of the writer was committed before.

        Another writer's commit in between makes it start again, from that commit.
        """
        for _ in range(tries):
            began = self.commits.latest()
            if batch and began.batches.get(batch[0], -1) >= batch[1]:
                return None
            write = Write(self, began)
            made = build(write)
            batches = began.batches | ({batch[0]: batch[1]} if batch else {})
            if self.commits.publish(Commit(began.version + 1, write.folders, write.next_seq, batches, write.counts)):
                return made
            self._remove(write.added)
        raise RuntimeError(f"{tries} times another writer was first")

    def _remove(self, folders: list[str]) -> None:
        fs = self.commits.files()
        for folder in folders:
            fs.delete(self.commits.place(f"{self.base}/{folder}"), True)

    def compact(self) -> None:
        """Rewrites the tables as few files without what is dead, in one commit. Readers of earlier commits keep their files until vacuum()."""

        def build(write: Write) -> None:
            before = write.before()
            rows = {"supersession": before.log("supersession")} if before.folders.get("supersession") else {}
            rows |= {"entities": before.entities()} if before.folders.get("entities") else {}
            rows |= {t: before.live(t) for t in ("facts", "postings", "keys", "sketches") if before.folders.get(t)}
            rows |= {"relations": before.relations()} if before.folders.get("relations") else {}
            write.folders.clear()
            for t, df in rows.items():
                write.append(t, df)

        self.write(build)

    def vacuum(self, keep: int = 10, age_hours: float = 24.0) -> int:
        """Deletes commits but the last `keep`, and folders that none of these names and that are older than age_hours: no reader of a kept commit and no write in the making loses any. How many folders went."""
        kept = self.commits.versions()[-keep:]
        if not kept:
            return 0
        named = {folder for v in kept for folders in self.commits.read(v).live.values() for folder in folders}
        self.commits.remove_before(kept[0])
        fs, oldest = self.commits.files(), self.spark._jvm.java.lang.System.currentTimeMillis() - age_hours * 3_600_000
        gone = []
        for t in TABLES:
            if fs.exists(self.commits.place(f"{self.base}/{t}")):
                found = fs.listStatus(self.commits.place(f"{self.base}/{t}"))
                gone += [f"{t}/{s.getPath().getName()}" for s in found if f"{t}/{s.getPath().getName()}" not in named and s.getModificationTime() <= oldest]
        self._remove(gone)
        return len(gone)

    def log(self, name: str) -> DataFrame:
        return self.view().log(name)

    def facts(self, until: Column | None = None) -> DataFrame:
        return self.view().facts(until)

    def entities(self) -> DataFrame:
        return self.view().entities()

    def relations(self) -> DataFrame:
        return self.view().relations()


def read_fact_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Facts and timed questions of a nested JSON file {topics: [{topic, facts, queries}]}."""
    topics = spark.read.json(path, multiLine=True).select(F.explode("topics").alias("t"))
    facts = topics.select("t.topic", F.posexplode("t.facts").alias("pos", "f")).select("topic", "pos", "f.content", F.col("f.entities").alias("entities"), parse_time("f.effective_at").alias("effective_at"), parse_time("f.created_at").alias("created_at"))
    questions = topics.select("t.topic", F.posexplode("t.queries").alias("pos", "q")).select("topic", "pos", "q.question", parse_time("q.at").alias("at"), "q.gold")
    return facts, questions


def read_scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes and probes of session files {suite, sessions: [{session_id, timestamp, writes, probes}]}, in the order of the file."""
    sessions = spark.read.json(path, multiLine=True).select("suite", F.posexplode("sessions").alias("session_pos", "s"))
    writes = sessions.select("suite", "session_pos", F.col("s.session_id"), parse_time("s.timestamp").alias("at"), F.posexplode("s.writes").alias("pos", "w")).select("suite", "session_pos", "session_id", "at", "pos", F.col("w.text").alias("content"))
    probes = sessions.select("suite", "session_pos", F.col("s.session_id"), F.explode("s.probes").alias("p")).select("suite", "session_pos", "session_id", F.col("p.id").alias("probe_id"), "p.question", "p.expected", F.col("p.must_not_contain").alias("banned"))
    return writes, probes


HAYSTACK = "haystack_session_ids array<string>, haystack_sessions array<array<struct<role: string, content: string>>>, answer_session_ids array<string>, question string, answer string"


def read_haystacks(spark: SparkSession, path: str, schema: str = HAYSTACK) -> DataFrame:
    """Conversation haystacks: a JSON array of samples, of which each split is read by a task of its own."""
    return read_objects(spark, path, schema)


def write_scenario(path: str, suite: str, sessions: list[tuple[str, list[str]]], probes: list[dict]) -> None:
    """A session file that read_scenarios reads: sessions (timestamp, texts) in order, all probes in the last one."""
    listed = [{"session_id": k, "timestamp": at, "writes": [{"text": t, "meta": {}} for t in texts], "probes": []} for k, (at, texts) in enumerate(sessions, 1)]
    if listed:
        listed[-1]["probes"] = probes
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"suite": suite, "sessions": listed}, f, ensure_ascii=False)


def _day(n: int) -> str:
    """A day of January 2024; after the 28th they begin again, so writing order isn't the order of time."""
    return f"2024-01-{n % 28 + 1:02d}T00:00:00"


def supersession_flood(path: str, topics: int = 10, earlier: int = 5) -> None:
    """Each topic's value is replaced again and again in the words of the question; a probe a topic asks for the last."""
    said = lambda k, value: f"The daily limit of unit {k} is {value}."
    sessions, probes = [], []
    for k in range(topics):
        values = [100 * k + 10 * v for v in range(earlier + 1)]
        sessions += [(_day(5 * k + v), [said(k, x)]) for v, x in enumerate(values)]
        probes.append({"id": f"sup-{k:02d}", "question": f"What is the daily limit of unit {k} now?", "expected": [said(k, values[-1])], "must_not_contain": [said(k, x) for x in values[:-1]], "supersedes": said(k, values[-2])})
    write_scenario(path, "supersession_flood", sessions, probes)


def entity_flood(path: str, names: int = 8, variants: tuple[str, ...] = ("north", "south", "spare", "trial")) -> None:
    """Near-miss variants of each name are written before the fact about the name itself; a probe a name asks for that."""
    said = lambda name, value: f"{name} listens on gate {value}."
    sessions, probes = [], []
    for k in range(names):
        others = [(f"station{k}-{v}", 1000 * (k + 1) + n) for n, v in enumerate(variants, 1)]
        sessions += [(_day(6 * k + n), [said(*o)]) for n, o in enumerate(others)] + [(_day(6 * k + 5), [said(f"station{k}", 1000 * (k + 1))])]
        probes.append({"id": f"ent-{k:02d}", "question": f"On what gate does station{k} listen?", "expected": [said(f"station{k}", 1000 * (k + 1))], "must_not_contain": [said(*o) for o in others], "supersedes": None})
    write_scenario(path, "entity_flood", sessions, probes)
