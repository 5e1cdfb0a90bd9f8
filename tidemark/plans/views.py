"""Facts, a graph and questions derived from the standard tables; each view has its equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import bounded_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts: a later one of the same user and type replaces an earlier one; some end without successor, some dangle."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("seq"), "user_id", "event_type",
        F.concat(F.lit("user "), "user_id", F.lit(" "), "event_type", F.lit(" value "), F.round(F.col("value") * 100).cast("bigint")).alias("content"),
        F.array(F.concat(F.lit("u"), "user_id"), F.concat(F.lit("u"), "user_id", F.lit("/"), "event_type")).alias("entity_ids"),
        F.col("ts").alias("effective_at"), (F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 48).cast("int"))).alias("created_at"),
    )
    following = F.lead("id").over(Window.partitionBy("user_id", "event_type").orderBy("created_at", "id"))
    rows = rows.withColumn("next", following)
    link = F.when(F.col("id") % 97 == 0, F.lit(None).cast("bigint")).when(F.col("id") % 101 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("next"))
    return rows.withColumn("replaced_by", link).withColumn("deprecated", (F.col("id") % 97 == 0) | (F.col("id") % 101 == 0) | F.col("next").isNotNull()).drop("next")


FACTS = """
f0 as (select event_id as id, event_id as seq, user_id, event_type,
    concat('user ', user_id, ' ', event_type, ' value ', cast(round(value * 100) as bigint)) as content,
    ts as effective_at, ts + to_hours(cast(event_id % 48 as bigint)) as created_at from events),
f1 as (select *, lead(id) over (partition by user_id, event_type order by created_at, id) as nxt from f0),
facts as (select id, seq, user_id, event_type, content, effective_at, created_at,
    case when id % 97 = 0 then null when id % 101 = 0 then -1 else nxt end as replaced_by,
    id % 97 = 0 or id % 101 = 0 or nxt is not null as deprecated from f1)
"""
STATE = FACTS + ", state as (select f.*, r.created_at as ended from facts f left join facts r on f.replaced_by = r.id)"


def valid_sql(at: str) -> str:
    return f"(effective_at <= {at} and not (deprecated and coalesce(replaced_by is null or ended <= {at}, false)))"


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer and supplier -> nation -> region."""
    kind = lambda df, s, sp, t, tp, name: df.select(F.concat(F.lit(sp), s).alias("source_id"), F.concat(F.lit(tp), t).alias("target_id"), F.lit(name).alias("type"), F.lit(1).alias("seq"))
    c = kind(table(spark, sf_dir, "customer"), "c_custkey", "c", "c_nationkey", "n", "lives in")
    s = kind(table(spark, sf_dir, "supplier"), "s_suppkey", "s", "s_nationkey", "n", "sits in")
    return c.unionByName(s).unionByName(kind(table(spark, sf_dir, "nation"), "n_nationkey", "n", "n_regionkey", "r", "part of"))


RELATIONS = """
rel as (select concat('c', c_custkey) as s, concat('n', c_nationkey) as t, 'lives in' as type from customer
  union all select concat('s', s_suppkey), concat('n', s_nationkey), 'sits in' from supplier
  union all select concat('n', n_nationkey), concat('r', n_regionkey), 'part of' from nation)
"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda n, key, p, name: table(spark, sf_dir, n).select(F.concat(F.lit(p), key).alias("id"), F.col(name).alias("name"))
    return one("customer", "c_custkey", "c", "c_name").unionByName(one("supplier", "s_suppkey", "s", "s_name")).unionByName(one("nation", "n_nationkey", "n", "n_name")).unionByName(one("region", "r_regionkey", "r", "r_name"))


def all_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relations, and order -> customer and part -> supplier."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("source_id"), F.concat(F.lit("c"), "o_custkey").alias("target_id"), F.lit("placed by").alias("type"))
    p = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), F.lit("supplied by").alias("type")).distinct()
    return relations(spark, sf_dir).unionByName(o.unionByName(p).withColumn("seq", F.lit(1)))


ALL_RELATIONS = RELATIONS + """, arel as (select s, t from rel union all select concat('o', o_orderkey), concat('c', o_custkey) from orders
  union all select distinct concat('p', l_partkey), concat('s', l_suppkey) from lineitem),
ent as (select concat('c', c_custkey) as id from customer union all select concat('s', s_suppkey) from supplier union all select concat('n', n_nationkey) from nation
  union all select concat('r', r_regionkey) from region union all select concat('o', o_orderkey) from orders union all select concat('p', p_partkey) from part)
"""


def all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entities, orders and parts: a column id."""
    one = lambda n, key, p: table(spark, sf_dir, n).select(F.concat(F.lit(p), key).alias("id"))
    return entities(spark, sf_dir).select("id").unionByName(one("orders", "o_orderkey", "o")).unionByName(one("part", "p_partkey", "p"))
