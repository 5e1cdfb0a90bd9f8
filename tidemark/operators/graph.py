"""Entities and relations: neighbourhoods, simple paths, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


#: Edges that one step can take, up to this many, are broadcast: two ids and a type each.
BROADCAST_LINKS = 200_000
#: An entity that more facts than this name is met by a broadcast.
HOT_FACTS = 100_000


def edges(relations: DataFrame) -> DataFrame:
    """One edge for each ordered pair, the last written (by seq)."""
    return relations.groupBy("source_id", "target_id").agg(F.max_by("type", "seq").alias("type"))


def neighbors(relations: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """start, id, hops of every node within `depth` undirected steps of each start (a column `id`); starts themselves are left out."""
    links = relations.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    seen = start.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("hops"))
    front = seen
    for step in range(1, depth + 1):
        reached = front.join(links, front.id == links.u).select("start", F.col("v").alias("id")).distinct()
        front = reached.join(seen, ["start", "id"], "left_anti").withColumn("hops", F.lit(step).cast("long"))
        seen = seen.unionByName(front)
    return seen.where("hops > 0")


def distances(links: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """node, left: over how many directed steps, `most` at most, each node reaches one of the targets (a column id)."""
    seen = targets.select(F.col("id").alias("node"), F.lit(0).alias("left")).distinct()
    front = seen
    for step in range(1, most + 1):
        front = links.join(front, links.target_id == front.node).select(F.col("source_id").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("left", F.lit(step))
        front = written(front, "front")
        seen = seen.unionByName(front)
    return written(seen, "distances")


def paths(relations: DataFrame, start: DataFrame, targets: DataFrame | None = None, max_depth: int = 5) -> DataFrame:
    """start, target, hops, path (array of nodes), types of every simple directed path of at most max_depth edges (none for 0); targets: a column `id`.

    With targets, a search backwards says first how far each node is from one; a path is carried on only
    to nodes that can still reach a target in the steps that are left. Each step meets only the edges
    from nodes at that distance; where these are few, as from some nodes that all paths come by, they are
    broadcast, so that no task gets all paths of a node.
    """
    links = written(edges(relations), "edges")
    left = None if targets is None else distances(links, targets, max_depth)
    front = start.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("path"), F.array().cast("array<string>").alias("types"))
    found = front.where("false").select("start", "at", "path", "types")
    nodes = start.select(F.col("id").alias("node")).distinct()
    for step in range(1, max_depth + 1):
        on = links.join(nodes, F.col("source_id") == F.col("node"), "left_semi")
        on = on if left is None else on.join(left.where(F.col("left") <= max_depth - step), F.col("target_id") == F.col("node"), "left_semi")
        on = written(on, "links")
        few = on.count()
        if not few:
            break
        nodes = on.select(F.col("target_id").alias("node")).distinct()
        front = front.join(F.broadcast(on) if few <= BROADCAST_LINKS else on, (front["at"] == on.source_id) & ~F.array_contains("path", F.col("target_id")))
        front = front.select("start", F.col("target_id").alias("at"), F.array_append("path", F.col("target_id")).alias("path"), F.array_append("types", F.col("type")).alias("types"))
        found = found.unionByName(front)
    found = found.select("start", F.col("at").alias("target"), F.size("types").cast("long").alias("hops"), "path", "types")
    return found if targets is None else found.join(targets.select(F.col("id").alias("target")), "target", "left_semi")


def summary(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """n_nodes (entities and ends of edges) and n_edges (distinct ordered pairs)."""
    nodes = entities.select("id").unionByName(relations.select(F.col("source_id").alias("id"))).unionByName(relations.select(F.col("target_id").alias("id"))).distinct()
    pairs = relations.select("source_id", "target_id").distinct()
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(pairs.agg(F.count("*").alias("n_edges")))


def entities_of(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """id, pos, entity_id, name of each fact's entities in the order of its list; unknown ids are dropped."""
    listed = facts.select("id", F.posexplode("entity_ids").alias("pos", "entity_id"))
    named = entities.select(F.col("id").alias("entity_id"), "name")
    # Facts of an entity that very many name, or that is unknown and dropped, don't all go to its task; there are few such ids.
    hot = F.broadcast(listed.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") > HOT_FACTS).select("entity_id"))
    rare = listed.join(hot, "entity_id", "left_anti").join(named, "entity_id")
    often = listed.join(F.broadcast(named.join(hot, "entity_id", "left_semi")), "entity_id")
    return rare.unionByName(often).select("id", F.col("pos").cast("long").alias("pos"), "entity_id", "name")
