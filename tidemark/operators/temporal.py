"""Point-in-time, range, replay and knowledge views of facts.

facts: id, effective_at, created_at, deprecated, replaced_by (and what else is to be kept).
The end of validity is the successor's created_at, reached by one left self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def moment(at) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else F.lit(at)


def is_effective(at) -> Column:
    """The simple predicate: not deprecated, and begun."""
    return ~F.col("deprecated") & (F.col("effective_at") <= moment(at))


def with_successor(facts: DataFrame) -> DataFrame:
    """facts with successor_id and successor_created_at; null where there is none or it is gone."""
    own = facts.select(F.col("id").alias("successor_id"), F.col("created_at").alias("successor_created_at"))
    return facts.join(own, facts.replaced_by == own.successor_id, "left")


def _linked() -> Column:
    link = F.col("replaced_by").cast("string")
    return link.isNotNull() & (link != "")


def valid(at) -> Column:
    """The full predicate on with_successor(): a dangling link leaves a fact valid, a missing one doesn't."""
    ended = ~_linked() | (F.col("successor_created_at") <= moment(at))
    return (F.col("effective_at") <= moment(at)) & ~(F.col("deprecated") & F.coalesce(ended, F.lit(False)))


def active_at(facts: DataFrame, at) -> DataFrame:
    """Facts valid at a moment, last discovered first."""
    return with_successor(facts).where(valid(at)).orderBy(F.desc("created_at"), F.desc("id")).select(*facts.columns)


def list_facts(facts: DataFrame, include_deprecated: bool = False) -> DataFrame:
    kept = facts if include_deprecated else facts.where(~F.col("deprecated"))
    return kept.orderBy(F.desc("created_at"), F.desc("id"))


def effective_between(facts: DataFrame, start, end) -> DataFrame:
    """Facts that begin within [start, end], unless replaced by then; without a known successor they count as never replaced."""
    found = with_successor(facts).where(F.col("effective_at").between(moment(start), moment(end)))
    kept = ~F.col("deprecated") | F.coalesce(F.col("successor_created_at") > moment(start), F.lit(True))
    return found.where(kept).orderBy("effective_at", "id").select(*facts.columns)


def replay(facts: DataFrame, entity: Column | None = None, limit: int = 50) -> DataFrame:
    """The last `limit` discoveries, in the order of discovery, deprecated ones included; 0: all. entity: a condition."""
    found = facts if entity is None else facts.where(entity)
    if limit:
        found = found.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return found.orderBy("created_at", "id")


def knowledge_at(facts: DataFrame, at, entity: Column | None = None) -> DataFrame:
    """What was known at a moment, however it turned out."""
    found = facts if entity is None else facts.where(entity)
    return found.where(F.col("created_at") <= moment(at)).orderBy("created_at", "id")


def version_chain(facts: DataFrame, key: list[str]) -> DataFrame:
    """facts with the end of each version, the next one's created_at within its key."""
    order = Window.partitionBy(*key).orderBy("created_at", "id")
    return facts.withColumn("valid_to", F.lead("created_at").over(order)).withColumn("version", F.row_number().over(order).cast("long"))


def link_chains(facts: DataFrame) -> DataFrame:
    """id, latest, hops of each fact: where its replaced_by links lead in the end, and over how many of them; both null where they run in a circle.

    A link to no fact leads nowhere. Pointers double their reach in each round, so that the rounds grow
    with the logarithm of the longest chain, and end when a round reaches no further end.
    """
    known = facts.select(F.col("id").alias("known"))
    linked = facts.select("id", "replaced_by").join(known, F.col("replaced_by") == F.col("known"), "left")
    at = written(linked.select("id", F.coalesce("known", "id").alias("to"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("known").isNull().alias("ended")), "links")
    before = None
    while (open_ := at.where(~F.col("ended")).count()) and open_ != before:
        before = open_
        ahead = at.select(F.col("id").alias("next"), F.col("to").alias("further"), F.col("hops").alias("more"), F.col("ended").alias("done"))
        # A link to an end has met it already; every other one takes over the reach of where it leads.
        at = written(at.join(ahead, F.col("to") == F.col("next")).select("id", F.when(F.col("ended"), F.col("to")).otherwise(F.col("further")).alias("to"), F.when(F.col("ended"), F.col("hops")).otherwise(F.col("hops") + F.col("more")).alias("hops"), (F.col("ended") | F.col("done")).alias("ended")), "links")
    return at.select("id", F.when(F.col("ended"), F.col("to")).alias("latest"), F.when(F.col("ended"), F.col("hops")).alias("hops"))
