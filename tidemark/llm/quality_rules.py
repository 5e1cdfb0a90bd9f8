"""Quality rules with host-level evidence, in DataFrame functions only.

Each document gets base counts. Softer rules fail a document only where its host's documents
fail that rule often: failures are aggregated by host, the rates are shrunk by a beta prior
fitted to all hosts, and the hosts' verdicts are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

SPACES = " \t\n\x0b\x0c\r"
#: Softer rules: name, and the SQL condition under which a document fails it.
SOFT_RULES = {
    "symbols": "n_symbols > 0.1D * n_words",
    "dup_lines": "n_dup_lines >= 5 and n_dup_lines * 10 > n_lines * 3",
    "word_length": "word_chars > 12D * n_words or word_chars < 2D * n_words",
    "few_words": "n_words < 40",  # documents that fail a base rule fail these too, so that they count against their host
    "repeats": "100 * n_repeat_words > 15 * n_words",
}
#: Documents that a prior may weigh, at least and at most: of hosts that are all alike, every one has the common rate.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6
#: Hosts up to this many, each a name and a few flags, may be broadcast.
BROADCAST_HOSTS = 20_000


def split_words(text: Column) -> Column:
    """Runs of anything but space and \\t to \\r. One-character splits are cheap in the JVM, so other white space becomes a space first."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of every whole text.

    Words are runs of anything but space and \\t to \\r. Null texts have none. The expressions are
    staged so that each array is computed once: a later stage names it more than once, which keeps
    the optimizer from putting its definition in place.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    docs = docs.drop(*made)
    own = docs.columns
    words_, lines_, h_, h8_, repeats_, s_, same_, at_ = fresh(docs, "words", "lines", "hashes", "windows", "repeats", "sorted", "same", "at")
    t = F.coalesce(F.col(text), F.lit(""))
    staged = docs.withColumns({
        words_: split_words(t),
        lines_: F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long"),
    })
    staged = staged.select(
        *own, "n_symbols",
        F.size(words_).cast("long").alias("n_words"),
        F.length(F.array_join(words_, "")).cast("long").alias("word_chars"),
        F.size(lines_).cast("long").alias("n_lines"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        F.transform(words_, lambda w: F.xxhash64(w)).alias(h_),
    )
    shifted = lambda c, by: F.slice(c, by + 1, F.greatest(F.size(c) - by, F.lit(0)))
    windows = F.transform(F.slice(h_, 1, F.greatest(F.size(h_) - 7, F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(h_, i + k) for k in range(1, 8)]))
    staged = staged.withColumn(h8_, windows).drop(h_)
    staged = staged.withColumn(repeats_, F.size(F.array_distinct(h8_)) < F.size(h8_))
    # Only texts with a repeated window are looked at further: positions whose hash equals that of a neighbour in sorted order.
    sorted_windows = F.array_sort(F.transform(h8_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    staged = staged.withColumn(s_, F.when(F.col(repeats_), sorted_windows)).drop(h8_)
    same = F.zip_with(s_, shifted(s_, 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    staged = staged.withColumn(same_, F.when(F.col(s_).isNotNull() & (F.size(s_) > 0), same))
    # _same[i]: window i equals window i + 1; a window is repeated if either it or the one before says so.
    before = F.concat(F.array(F.lit(False)), F.slice(same_, 1, F.greatest(F.size(same_) - 1, F.lit(0))))
    either = F.zip_with(same_, before, lambda a, b: a | b)
    at = F.zip_with(s_, either, lambda s, e: F.when(e, s["i"]))
    staged = staged.withColumn(at_, F.when(F.col(same_).isNotNull() & (F.size(same_) > 0), F.sort_array(F.filter(at, lambda i: i.isNotNull())))).drop(s_, same_)
    # Words covered: each window adds 8, or what lies before the next one's start.
    covered = F.aggregate(F.zip_with(at_, shifted(at_, 1), lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8)))), F.lit(0), lambda x, y: x + y)
    staged = staged.withColumn("n_repeat_words", F.when(F.size(at_) > 0, covered).otherwise(0).cast("long"))
    return staged.select(*own, *made)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def host_rates(counted: DataFrame, host: str) -> DataFrame:
    """host, n (documents) and for each soft rule f_ (failures) and r_ (their shrunken rate) of every host.

    The prior of a rule is the beta distribution fitted to the hosts' rates by the method of moments: its
    mean is the rate of all documents, its variance that of the hosts' rates less what chance alone gives
    hosts of their sizes; it weighs as many documents as follows from both, within LEAST_WEIGHT and
    MOST_WEIGHT. A null host is a host of its own.
    """
    hosts = counted.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *[F.sum(F.expr(f"cast({c} as int)")).alias(f"f_{r}") for r, c in SOFT_RULES.items()])
    pooled = [(F.sum(f"f_{r}") / F.sum("n")).alias(f"m_{r}") for r in SOFT_RULES]
    spread = [F.var_pop(F.col(f"f_{r}") / F.col("n")).alias(f"v_{r}") for r in SOFT_RULES]
    prior = hosts.agg(F.avg(1 / F.col("n")).alias("chance"), *pooled, *spread)
    judged = hosts.crossJoin(F.broadcast(prior))  # one row
    rates = []
    for r in SOFT_RULES:
        m, n = F.col(f"m_{r}"), F.col("n")
        between = F.col(f"v_{r}") - m * (1 - m) * F.col("chance")
        weight = F.least(F.greatest(F.when(between > 0, m * (1 - m) / between - 1).otherwise(F.lit(MOST_WEIGHT)), F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))
        rates.append(((F.col(f"f_{r}") + m * weight) / (n + weight)).alias(f"r_{r}"))
    return judged.select("host", "n", *[f"f_{r}" for r in SOFT_RULES], *rates)


def host_verdicts(counted: DataFrame, host: str, least_rate: float = 0.5) -> DataFrame:
    """host and, for each soft rule, whether it binds there: its shrunken failure rate is at least least_rate."""
    return host_rates(counted, host).select("host", *[(F.col(f"r_{r}") >= F.lit(least_rate)).alias(f"binds_{r}") for r in SOFT_RULES])


def judge(counted: DataFrame, host: str = "source", **options) -> DataFrame:
    """counted (a table that is cheap to read twice) with base_failed and kept.

    Only hosts where some rule binds are joined. They are broadcast while they are fewer than
    BROADCAST_HOSTS; beyond that, an ordinary join follows, which Spark can split where a host is hot.
    """
    bad = materialise(host_verdicts(counted, host, **options).where(" or ".join(f"binds_{r}" for r in SOFT_RULES)), "hosts")
    few = bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    own = [c for c in counted.columns if c not in ("base_failed", "kept")]
    at, *flags = fresh(counted, "host", *[f"binds_{r}" for r in SOFT_RULES])
    bad = bad.toDF(at, *flags)
    joined = counted.join(F.broadcast(bad) if few else bad, counted[host].eqNullSafe(F.col(at)), "left")
    failed = F.lit(False)
    for flag, c in zip(flags, SOFT_RULES.values()):
        failed = failed | F.coalesce(F.col(flag) & F.expr(c), F.lit(False))
    return joined.select(*own, base_failed().alias("base_failed"), (~base_failed() & ~failed).alias("kept"))


def quality_rules(docs: DataFrame, host: str = "source", keep_text: bool = False, **options) -> DataFrame:
    """Every row of docs with its counts, base_failed and kept; its text only with keep_text.

    Null and empty texts have no words and fail. Repeated rows count each; an empty table gives no rows;
    a rate that equals the bound binds. Columns of docs with the names of counts or verdicts are replaced,
    all others stay. A text, however long, stays in its row. docs is read once: the counted rows are
    written to the shared folder, as they are needed for the hosts and for the result.
    """
    counted = with_counts(docs)
    return judge(materialise(counted if keep_text else counted.drop("text"), "counted"), host, **options)


#: DuckDB SQL of the same rows for the documents table: doc_id and the contract's columns.
SQL = """
with t as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from {docs}
), w as (
  select rid, doc_id, source, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\v\\f\\r]')) as lines from t
), win as (
  select rid, i, string_agg(words[i + k], ' ' order by k) as g
  from (select rid, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8), (select unnest(range(8)) as k) group by rid, i
), rep as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c > 1
), cov as (
  select rid, count(distinct i + k) as n from rep, (select unnest(range(8)) as k) group by rid
), m as (
  select w.rid, doc_id, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
  from w left join cov using (rid)
), f as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, n_symbols > 0.1e0 * n_words as s1,
    n_dup_lines >= 5 and n_dup_lines * 10 > n_lines * 3 as s2, word_chars > 12e0 * n_words or word_chars < 2e0 * n_words as s3,
    n_words < 40 as s4, 100 * n_repeat_words > 15 * n_words as s5 from m
), h as (
  select source, count(*) as n, sum(s1::int)::double as f1, sum(s2::int)::double as f2, sum(s3::int)::double as f3,
    sum(s4::int)::double as f4, sum(s5::int)::double as f5 from f group by source
), u as (
  select source, n, rule, f from h, lateral (values (1, f1), (2, f2), (3, f3), (4, f4), (5, f5)) as x(rule, f)
), p as (
  select rule, sum(f) / sum(n) as m, var_pop(f / n) - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * avg(1e0 / n) as v from u group by rule
), q as (
  select rule, m, least(greatest(case when v > 0 then m * (1 - m) / v - 1 else 1e6 end, 1e0), 1e6) as w from p
), b as (
  select source, bool_or(rule = 1 and rate >= 0.5e0) as b1, bool_or(rule = 2 and rate >= 0.5e0) as b2, bool_or(rule = 3 and rate >= 0.5e0) as b3,
    bool_or(rule = 4 and rate >= 0.5e0) as b4, bool_or(rule = 5 and rate >= 0.5e0) as b5
  from (select source, rule, (f + m * w) / (n + w) as rate from u join q using (rule)) group by source
)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (s1 and b1) and not (s2 and b2) and not (s3 and b3) and not (s4 and b4) and not (s5 and b5) as kept
from f join b on f.source is not distinct from b.source
"""
