"""Retrieval-quality metrics from ranked results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substring import containing


def first_hits(results: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, first (null: none) for each query of gold (query_id, doc_id): the rank of the first right result."""
    hits = results.join(gold, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return gold.select("query_id").distinct().join(hits, "query_id", "left")


#: The ranks at which recall is measured; results beyond the last one don't count.
KS = (1, 2, 3, 5, 8, 10)


def recall_and_mrr(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row: recall_at_k for each k, mrr and acc_at_1, over the results up to the largest k."""
    first = first_hits(results.where(F.col("rank") <= max(ks)), gold)
    share = lambda c, name: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6).alias(name)
    return first.agg(*[share(F.col("first") <= k, f"recall_at_{k}") for k in ks], F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), share(F.col("first") == 1, "acc_at_1"))


def compare(strategies: dict[str, DataFrame], gold: DataFrame, topic_of: DataFrame, ks: tuple[int, ...] = KS, stale_at: int = 5) -> DataFrame:
    """A row for each strategy's results (query_id, doc_id, rank): its name, recall_and_mrr and the mean anachronism.

    gold: query_id, topic, doc_id; topic_of: doc_id, topic. Questions without results count as misses and as free of anachronisms.
    """
    rows = None
    questions = gold.select("query_id").distinct()
    for name, results in strategies.items():
        stale = questions.join(anachronism(results, topic_of, gold, stale_at), "query_id", "left").agg(F.round(F.avg(F.coalesce("anachronism", F.lit(0.0))), 6).alias(f"anachronism_at_{stale_at}"))
        row = recall_and_mrr(results, gold.select("query_id", "doc_id"), ks).crossJoin(F.broadcast(stale)).select(F.lit(name).alias("strategy"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def report(compared: DataFrame, columns: tuple[str, ...] = ("mrr", "acc_at_1", "anachronism_at_5")) -> str:
    """The table of compare() as text, a strategy a line; as many lines as there are strategies."""
    lines = [f"{'strategy':28s}" + "".join(f"{c:>18s}" for c in columns)]
    return "\n".join(lines + [f"{r['strategy']:28s}" + "".join(f"{r[c]:18.3f}" for c in columns) for r in compared.collect()])


def session_hits(results: DataFrame, sessions: DataFrame, answers: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """recall_and_mrr of sessions: results (query_id, rank, text) are led back to the sessions (query_id, session_id, pos, text, openings) that they come from; answers: query_id, session_id.

    A result is of the first session by pos whose text it equals, else of the first one of which it
    contains an opening, the first 80 characters of a turn. Both are equi joins.
    """
    found = results.select("query_id", "rank", F.col("text").alias("found"))
    same = found.join(sessions.select("query_id", "session_id", "pos", F.col("text").alias("found")), ["query_id", "found"]).select("query_id", "rank", "session_id", F.lit(False).alias("part"), "pos")
    openings = sessions.select("query_id", F.struct("session_id", "pos").alias("passage_id"), F.explode("openings").alias("passage"))
    parts = containing(found.select("query_id", F.col("rank").alias("id"), F.col("found").alias("text")), openings, ["query_id"])
    parts = parts.select("query_id", F.col("id").alias("rank"), "passage_id.session_id", F.lit(True).alias("part"), "passage_id.pos")
    placed = same.unionByName(parts).groupBy("query_id", "rank").agg(F.min_by("session_id", F.struct("part", "pos")).alias("doc_id"))
    return recall_and_mrr(placed, answers.select("query_id", F.col("session_id").alias("doc_id")), ks)


def misses(results: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Queries without a right result among the first k."""
    hit = results.where(F.col("rank") <= k).join(gold, ["query_id", "doc_id"]).select("query_id")
    return gold.select("query_id").distinct().join(hit, "query_id", "left_anti")


def anachronism(results: DataFrame, topic_of: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """query_id, share of its first k results that are on the query's topic but not gold. topic_of: doc_id, topic; gold: query_id, topic, doc_id."""
    asked = gold.select("query_id", F.col("topic").alias("asked")).distinct()
    right = gold.select("query_id", "doc_id", F.lit(True).alias("right"))
    shown = results.where(F.col("rank") <= k).join(topic_of, "doc_id", "left").join(asked, "query_id").join(right, ["query_id", "doc_id"], "left")
    wrong = (F.col("topic") == F.col("asked")) & F.col("right").isNull()
    return shown.groupBy("query_id").agg(F.avg(F.when(wrong, 1.0).otherwise(0.0)).alias("anachronism"))


def grade(probes: DataFrame) -> DataFrame:
    """probes (probe_id, suite, texts, expected, banned) with hit, hit_at_1, precision, stale_at_1, leaked, tokens.

    stale_at_1 and leaked are null without results or without banned strings.
    """
    low = lambda c: F.transform(c, F.lower)
    has = lambda text, needles: F.exists(needles, lambda n: F.contains(text, n))
    expected, banned = low("expected"), low("banned")
    staged = probes.select("probe_id", "suite", low("texts").alias("said"), expected.alias("right"), banned.alias("wrong"))
    answered = F.size("said") > 0
    judged = answered & (F.size("wrong") > 0)
    top = F.get("said", 0)
    return staged.select(
        "probe_id", "suite",
        F.exists("said", lambda t: has(t, F.col("right"))).cast("int").alias("hit"),
        F.coalesce(has(top, F.col("right")), F.lit(False)).cast("int").alias("hit_at_1"),
        answered.cast("int").alias("answered"),
        F.when(answered, F.size(F.filter("said", lambda t: has(t, F.col("right")))) / F.size("said")).otherwise(0.0).alias("precision"),
        F.when(judged, (has(top, F.col("wrong")) & ~has(top, F.col("right"))).cast("int")).alias("stale_at_1"),
        F.when(judged, F.exists("said", lambda t: has(t, F.col("wrong"))).cast("int")).alias("leaked"),
        F.aggregate("said", F.lit(0), lambda n, t: n + F.floor(F.length(t) / 4).cast("int")).cast("long").alias("tokens"),
    )


def roll_up(graded: DataFrame) -> DataFrame:
    """Metrics by suite, and over all probes (suite null)."""
    mean = lambda c, name: F.round(F.avg(c), 3).alias(name)
    return graded.rollup("suite").agg(mean("hit", "recall"), mean("hit_at_1", "recall_at_1"), mean("precision", "precision"), mean("stale_at_1", "staleness_at_1"), mean("leaked", "leak_rate"), F.round(1 - F.avg("answered"), 3).alias("abstention"), F.count("*").alias("n"))


def session_text(turns: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A text for each session: 'role: content' lines in order, blank ones left out, content stripped, the role by default assistant."""
    kept = turns.where(F.trim("text") != "").select(F.col(session), F.struct(F.col(turn).alias("turn"), F.concat(F.coalesce("role", F.lit("assistant")), F.lit(": "), F.trim("text")).alias("line")).alias("t"))
    return kept.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "\n").alias("text"))


def suite_report(strategies: dict[str, Callable[[], DataFrame]]) -> str:
    """A table as text: for each suite and over all probes, each strategy's recall and staleness at 1.

    strategies: of each name what gives its graded probes. One that fails, as for want of a model, has
    its reason in the last lines and leaves the others' figures alone. The driver gets a row a suite.
    """
    figures, failed = {}, []
    for name, graded in strategies.items():
        try:
            figures[name] = {r.suite: r for r in roll_up(graded()).collect()}
        except Exception as reason:  # whatever a strategy's own code may raise
            failed.append(f"{name} failed: {str(reason).strip().splitlines()[0] if str(reason).strip() else type(reason).__name__}")
    suites = sorted({s for f in figures.values() for s in f if s is not None})
    cell = lambda r: "-" if r is None else f"{r.recall:.3f} | " + ("-" if r.staleness_at_1 is None else f"{r.staleness_at_1:.3f}")
    lines = [f"{'suite':28s}" + "".join(f"{name:>20s}" for name in figures)]
    lines += [f"{s or 'all probes':28s}" + "".join(f"{cell(f.get(s)):>20s}" for f in figures.values()) for s in [*suites, None]]
    return "\n".join(lines + failed)
