"""Contradictions between facts, and their resolution."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embed import cosine, text_cosine
from ..functions.text import content_tokens, jaccard
from ..sources.scratch import dealt, written as stored

Judge = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class PairJudge:
    """A judge of both facts: score(old, new, sim, jac) takes two pandas DataFrames with `columns` of the facts of many related pairs, and their similarities, and returns their scores."""

    score: Callable
    columns: tuple[str, ...] = ("content", "entity_ids", "metadata", "source", "effective_at", "created_at")


def judged(pairs: DataFrame, judge: Judge | PairJudge, facts: DataFrame | None = None) -> DataFrame:
    """pairs (old_id, new_id, old_seq, new_seq, sim, jac) with score; facts (id, seq, ...): what a PairJudge looks at, read of the pairs' facts only."""
    if not isinstance(judge, PairJudge):
        return pairs.withColumn("score", judge(F.col("sim"), F.col("jac")))

    @F.pandas_udf("double")
    def score(old: pd.DataFrame, new: pd.DataFrame, sim: pd.Series, jac: pd.Series) -> pd.Series:
        return judge.score(old, new, sim, jac)

    side = lambda p: facts.select(F.col("id").alias(f"{p}_id"), F.col("seq").alias(f"{p}_seq"), F.struct(*judge.columns).alias(p))
    both = pairs.join(side("old"), ["old_id", "old_seq"]).join(side("new"), ["new_id", "new_seq"])
    return both.withColumn("score", score("old", "new", "sim", "jac")).drop("old", "new")


def default_judge(sim: Column, jac: Column) -> Column:
    """Similar texts on one topic; below a token overlap of 0.2 hardly anything is left."""
    return F.when(jac < 0.2, 0.1 * sim).otherwise(sim * (0.4 + 0.6 * F.least(2 * jac, F.lit(1.0))))


def semantic_judge(sim: Column, jac: Column) -> Column:
    """For model embeddings: near-identical wording restates, high similarity contradicts."""
    return F.when(jac >= 0.85, 0.1 * sim).when((jac >= 0.7) & (sim >= 0.8), sim).when(jac >= 0.2, sim * (0.4 + 0.6 * F.least(2 * jac, F.lit(1.0)))).otherwise(0.1 * sim)


def token_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token sets; 0 where one is empty."""
    norm = F.sqrt(F.size(a).cast("double") * F.size(b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / norm)


#: Rows and tokens of a block of token sets, about: two blocks meet in one task, BLOCK_TILE rows of one with all of the other at a time.
BLOCK_ROWS, BLOCK_TOKENS, BLOCK_TILE = 8_192, 1_000_000, 64
#: Pairs of a batch, about, that a task hands on.
BATCH_PAIRS = 100_000
#: Tokens that more than this share of a block's pairs have in common are counted by a matrix product, the others by their occurrences.
DENSE_SHARE = 0.004
#: Common tokens that a pair may lack in _close, against roundings; up to so many tokens of a set, these stay far below that in single precision.
SLACK, SINGLE = 0.05, 1 << 18


def _close(a: list[np.ndarray], m_a: np.ndarray, b: list[np.ndarray], m_b: np.ndarray, least: float):
    """Slice by slice of the rows of a: which rows of a and b, sets of m_a and m_b tokens of which these are the codes, have a Jaccard of `least` or hardly less, and how many codes in common."""
    flat = lambda rows: (np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows))
    (row_a, code_a), (row_b, code_b) = flat(a), flat(b)
    codes = np.intersect1d(code_a, code_b)
    kept = lambda row, code: (row[(has := np.isin(code, codes))], np.searchsorted(codes, code[has]))
    (row_a, code_a), (row_b, code_b) = kept(row_a, code_a), kept(row_b, code_b)
    df_b = np.bincount(code_b, minlength=len(codes))
    often = np.flatnonzero(np.bincount(code_a, minlength=len(codes)) * df_b > DENSE_SHARE * len(a) * len(b))
    column = np.full(len(codes), -1)
    column[often] = np.arange(len(often))
    # A Jaccard of `least` takes share * (m_a + m_b) common tokens: two more columns take these off in the product.
    share = least / (1 + least)
    kind = np.float32 if max(m_a.max(), m_b.max()) < SINGLE else np.float64

    def matrix(row, code, needs, own):
        m = np.ones((len(needs), len(often) + 2), kind)
        m[:, :-2] = 0
        m[:, own] = -needs
        dense = column[code] >= 0
        m[row[dense], column[code[dense]]] = 1
        return m, row[~dense], code[~dense]

    dense_a, row_a, code_a = matrix(row_a, code_a, m_a * share, -1)
    dense_b, rare_b, rare_code_b = matrix(row_b, code_b, m_b * share, -2)
    rare_b = rare_b[np.argsort(rare_code_b, kind="stable")]
    df = np.bincount(rare_code_b, minlength=len(codes))
    begin = np.cumsum(df) - df
    for at in range(0, len(a), BLOCK_TILE):
        part = slice(at, at + BLOCK_TILE)
        own = slice(*np.searchsorted(row_a, [at, at + BLOCK_TILE]))
        over = (dense_a[part] @ dense_b.T).ravel()
        rows, rare = row_a[own] - at, code_a[own]
        many = df[rare]
        meets = rare_b[np.repeat(begin[rare] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        np.add.at(over, np.repeat(rows * len(b), many) + meets, kind(1))
        found = np.flatnonzero(over >= -SLACK)
        i, j = np.divmod(found, len(b))
        i += at
        common = np.rint(over[found] + share * (m_a[i] + m_b[j])).astype(np.int64)
        some = common > 0
        yield i[some], j[some], common[some]


def _met(least: float):
    """For mapInArrow: rows (same, one, two) of two blocks, or one and the same, of sets (id, seq, m, codes); the pairs of a Jaccard of `least` or hardly less."""

    def columns(block):
        codes = block.field("codes")
        m = block.field("m").to_numpy(zero_copy_only=False)
        return block.field("id"), block.field("seq").to_numpy(zero_copy_only=False), m, np.split(codes.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False))[:-1])

    def pairs(same, one, two):
        (id_a, seq_a, m_a, a), (id_b, seq_b, m_b, b) = columns(one), columns(two)
        ids, seq, m = pa.concat_arrays([id_a, id_b]), np.concatenate([seq_a, seq_b]), np.concatenate([m_a, m_b])
        held = []

        def batch():
            i, j, common = (np.concatenate(x) for x in zip(*held))
            held.clear()
            j += len(a)
            swap = seq[i] > seq[j]
            # A block meets itself both ways. Those to swap come last, so that the ids of one side stay in runs, which take little room.
            keep = np.concatenate([np.flatnonzero(seq[i] < seq[j]), np.flatnonzero(swap & (not same))])
            i, j, swap = i[keep], j[keep], swap[keep]
            old, new = np.where(swap, j, i), np.where(swap, i, j)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(old)), pa.array(seq[old]), ids.take(pa.array(new)), pa.array(seq[new]), pa.array(m[old]), pa.array(m[new]), pa.array(common[keep])], names=PAIR)

        for found in _close(a, m_a, b, m_b, least):
            held.append(found)
            if sum(len(i) for i, *_ in held) >= BATCH_PAIRS:
                yield batch()
        if held:
            yield batch()

    def run(batches):
        for batch in batches:
            for same, one, two in zip(*batch.select(["same", "one", "two"]).columns):
                yield from pairs(same.as_py(), one.values, two.values)

    return run


PAIR = ["old_id", "old_seq", "new_id", "new_seq", "old_m", "new_m", "common"]


def token_pairs(facts: DataFrame, least: float) -> DataFrame:
    """PAIR of facts (id, seq, content) whose tokens' Jaccard is at least `least` (over 0): the numbers of their tokens, and of those in common.

    At a low Jaccard nearly all pairs share one of their rarest tokens, so that keys spare nothing: blocks
    of token sets meet each other, and count what all their pairs have in common at once. A block is one
    stored row, and the join of all blocks reads each where it meets others: nothing that is shuffled, or
    written but the pairs, grows faster than the facts.
    """
    spark = facts.sparkSession
    rows = facts.select("id", F.col("seq").cast("long").alias("seq"), content_tokens("content").alias("tokens"))
    known = dealt(rows).where("seq is not null").where(F.size("tokens") > 0)
    sets = stored(known.withColumn("row", F.monotonically_increasing_id()), "token-sets")  # two facts may have one id
    tokens = sets.select("row", "id", "seq", F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")  # a token of one fact is common to none
    shared = stored(shared.select("token", F.monotonically_increasing_id().alias("code")), "tokens")
    coded = stored(tokens.join(shared, "token").groupBy("row", "id", "seq", "m").agg(F.collect_list("code").alias("codes")), "coded-sets")
    size = coded.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("codes")), F.lit(0)).alias("tokens")).first()
    busy = min(-(-size.rows // 256), math.isqrt(4 * spark.sparkContext.defaultParallelism) + 1)
    n = max(1, busy, -(-size.rows // BLOCK_ROWS), -(-size.tokens // BLOCK_TOKENS))
    block = F.pmod(F.xxhash64("row"), F.lit(n)).alias("block")
    dealt_out = coded.select(block, F.struct("id", "seq", F.col("m").cast("long").alias("m"), "codes").alias("set")).repartition(n, "block")
    blocks = stored(dealt_out.groupBy("block").agg(F.collect_list("set").alias("sets")), "blocks", "block")
    side = lambda name: blocks.select(F.col("block").alias(f"block_{name}"), F.col("sets").alias(name))
    # Each block meets itself and the half of the others that follow it, all in a ring: so all tasks of the join have work.
    ahead = F.pmod(F.col("block_two") - F.col("block_one"), F.lit(n))
    met = side("one").join(side("two").hint("shuffle_replicate_nl"), (2 * ahead < n) | ((2 * ahead == n) & F.expr("block_one < block_two")))
    kind = dict(facts.dtypes)["id"]
    schema = f"old_id {kind}, old_seq long, new_id {kind}, new_seq long, old_m long, new_m long, common long"
    found = met.select(F.expr("block_one = block_two").alias("same"), "one", "two").mapInArrow(_met(least), schema)
    return found.where(_jaccard() >= least)


def entity_pairs(facts: DataFrame, carried: Column | None = None) -> DataFrame:
    """PAIR of facts (id, seq, content, entity_ids) that share an entity, once each; carried: a column of both facts, as old_carried and new_carried.

    Facts go to their entities with all that is looked at; the pairs themselves aren't shuffled, as each is made at the least entity that both share.
    """
    known = facts.select("id", F.col("seq").cast("long").alias("seq"), content_tokens("content").alias("tokens"), F.array_distinct("entity_ids").alias("entities"), *([] if carried is None else [carried.alias("carried")]))
    keyed = known.withColumn("key", F.explode("entities"))
    side = lambda p: keyed.select("key", *[F.col(c).alias(f"{p}_{c}") for c in keyed.columns if c != "key"])
    one = (F.size("old_entities") == 1) | (F.size("new_entities") == 1)
    met = side("old").hint("merge").join(side("new"), "key").where("old_seq < new_seq").where(one | (F.col("key") == F.array_min(F.array_intersect("old_entities", "new_entities"))))
    size = lambda c: F.size(c).cast("long")
    # Exploded, as Spark would else count the common tokens anew wherever the number is looked at, and in the join those of pairs in the wrong order too.
    return met.select("old_id", "old_seq", "new_id", "new_seq", size("old_tokens").alias("old_m"), size("new_tokens").alias("new_m"), F.explode(F.array(size(F.array_intersect("old_tokens", "new_tokens")))).alias("common"), *([] if carried is None else ["old_carried", "new_carried"]))


def _jaccard() -> Column:
    union = F.col("old_m") + F.col("new_m") - F.col("common")
    return F.when(union == 0, F.lit(0.0)).otherwise(F.col("common") / union)


def _cosine() -> Column:
    """token_cosine of a pair."""
    norm = F.sqrt(F.col("old_m").cast("double") * F.col("new_m"))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.col("common") / norm)


def _with_both(pairs: DataFrame, facts: DataFrame, c: Column, name: str) -> DataFrame:
    """Pairs with a column of both facts, as old_ and new_ name. Sizes of what is computed are unknown to Spark: no broadcast."""
    for p in ("old", "new"):
        own = facts.select(F.col("id").alias(f"{p}_id"), F.col("seq").cast("long").alias(f"{p}_seq"), c.alias(f"{p}_{name}"))
        pairs = pairs.join(own.hint("merge"), [f"{p}_id", f"{p}_seq"])
    return pairs


def related_pairs(facts: DataFrame, related: float = 0.25, by: str = "both", least: float = 0.2, since: int | None = None, carried: Column | None = None) -> DataFrame:
    """PAIR and jac, old written before new, of facts (id, seq, content, entity_ids) that share an entity (by 'entities') or whose tokens' Jaccard is at least `related` (by 'tokens'), or both.

    By tokens alone, pairs of a Jaccard of `least` that share an entity count too. since: only pairs whose
    new fact has this seq or a later one. carried: a column of both facts, as old_carried and new_carried.
    """
    if by == "entities":
        pairs = entity_pairs(facts, carried)
    else:
        pairs = token_pairs(facts, related if by == "both" else min(least, related))
        if by == "both":
            pairs = pairs.unionByName(entity_pairs(facts)).distinct()
        elif least < related:
            pairs = _with_both(pairs, facts, F.col("entity_ids"), "entities").where((_jaccard() >= related) | F.arrays_overlap("old_entities", "new_entities")).drop("old_entities", "new_entities")
        pairs = pairs if carried is None else _with_both(pairs, facts, carried, "carried")
    pairs = pairs.withColumn("jac", _jaccard())
    return pairs if since is None else pairs.where(F.col("new_seq") >= since)


def conflicts(facts: DataFrame, threshold: float = 0.55, related: float = 0.25, judge: Judge = default_judge, similarity: Judge | None = token_cosine, by: str = "both", embedder=None, since: int | None = None) -> DataFrame:
    """old_id, new_id, score, old_seq, new_seq of contradicting facts.

    similarity takes the two facts' tokens; with an embedder, it is the cosine of their contents' vectors.
    One that can embed texts outside a plan (see Embedder) does so where the pairs are, so that no vector is shuffled.
    """
    if embedder is None and similarity is token_cosine:
        pairs = related_pairs(facts, related, by, since=since).withColumn("sim", _cosine())
    elif embedder is None:
        pairs = related_pairs(facts, related, by, since=since, carried=content_tokens("content")).withColumn("sim", similarity(F.col("old_carried"), F.col("new_carried")))
    elif hasattr(embedder, "vectors"):
        pairs = related_pairs(facts, related, by, since=since, carried=embedder.prepared("content")).withColumn("sim", text_cosine(embedder, "old_carried", "new_carried"))
    else:
        pairs = _with_both(related_pairs(facts, related, by, since=since), facts, embedder("content"), "v").withColumn("sim", cosine("old_v", "new_v"))
    return judged(pairs.select("old_id", "new_id", "old_seq", "new_seq", "sim", "jac"), judge, facts).where(F.col("score") >= threshold).select("old_id", "new_id", "score", "old_seq", "new_seq")


def resolve(found: DataFrame) -> DataFrame:
    """old_id, new_id: each old fact is replaced by the first later write that contradicts it.

    Whether that write is replaced itself makes no difference, as it was active when it was
    written; so one aggregation does what a sequential load does.
    """
    return found.groupBy("old_id").agg(F.min_by("new_id", "new_seq").alias("new_id"), F.min("new_seq").alias("at_seq"))


def written(keys: DataFrame, new_keys: DataFrame, old: DataFrame, new: DataFrame, threshold: float = 0.55, related: float = 0.25, judge: Judge | PairJudge = default_judge, facts: DataFrame | None = None) -> DataFrame:
    """old_id, new_id, score, old_seq, new_seq of what new facts contradict, from stored blocking keys and sketches alone but for a PairJudge, which gets facts.

    keys: key, id, seq of what new keys may meet, the new ones included; old and new: sketches (id, seq,
    tokens, entity_ids, v) of facts that may be replaced, and of the new ones.
    """
    side = lambda rows, p, *cs: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in cs])
    met = keys.select("key", F.col("id").alias("old_id"), F.col("seq").alias("old_seq"))
    pairs = met.join(new_keys.select("key", F.col("id").alias("new_id"), F.col("seq").alias("new_seq")), "key").where("old_seq < new_seq").drop("key").distinct()
    columns = ("id", "seq", "tokens", "entity_ids", "v")
    found = pairs.join(side(old, "old", *columns), ["old_id", "old_seq"]).join(side(new, "new", *columns), ["new_id", "new_seq"]).withColumn("jac", jaccard("old_tokens", "new_tokens"))
    found = found.where(F.coalesce(F.arrays_overlap("old_entity_ids", "new_entity_ids"), F.lit(False)) | (F.col("jac") >= related))
    scored = judged(found.select("old_id", "new_id", "old_seq", "new_seq", cosine("old_v", "new_v").alias("sim"), "jac"), judge, facts)
    return scored.where(F.col("score") >= threshold).select("old_id", "new_id", "score", "old_seq", "new_seq")


def preview(content: str, entity_ids: list[str], facts: DataFrame, threshold: float = 0.55, related: float = 0.25, judge: Judge = default_judge, similarity: Judge | None = token_cosine, embedder=None) -> DataFrame:
    """Facts that a new one would contradict, with the score that conflicts() would give them, without writing; the new fact is a literal, so the scan is one pass."""
    own = facts.columns
    tokens = content_tokens(F.lit(content))
    scored = facts.select(F.struct("*").alias("fact"), content_tokens("content").alias("tokens"), *([embedder("content").alias("a"), embedder(F.lit(content)).alias("b")] if embedder else []))
    scored = scored.withColumn("jac", jaccard("tokens", tokens))
    scored = scored.withColumn("score", judge(cosine("a", "b") if embedder else similarity(F.col("tokens"), tokens), F.col("jac")))
    entities = F.array(*[F.lit(e) for e in entity_ids]).cast("array<string>")
    found = scored.where((F.arrays_overlap("fact.entity_ids", entities) | (F.col("jac") >= related)) & (F.col("score") >= threshold))
    return found.select(*[F.col("fact")[c].alias(c) for c in own if c != "score"], "score").orderBy(F.desc("score"), "id")
