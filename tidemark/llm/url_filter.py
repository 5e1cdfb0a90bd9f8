"""URL filters: host and path rules, and gradient-boosted trees on lexical features.

Rules decide first. Where none fits, boosted trees judge the url from its length, depth,
digit ratio, entropy, parameter counts and the blocking rate of its host's suffixes. They
are trained here, from a table of labelled urls; where there is none, from the urls that
the rules decide.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn

#: (host/path, verdict)
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url column; both empty for null or where '://' is missing."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def best_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


FEATURES = ["length", "host_length", "path_length", "depth", "host_dots", "hyphens", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "parameter_length", "suffix_top", "suffix_part", "suffix_chars"]


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(host: str) -> tuple[str, str, str]:
    """The last label; what follows the last hyphen of the registrable name; that name's last four characters."""
    labels = host.partition(":")[0].split(".")
    name = max(labels[-3:-1], key=len, default=labels[0])
    return labels[-1], name.rpartition("-")[2] if "-" in name else "", name[-4:]


def lexical(url: str | None, rates: list[dict[str, float]], prior: float) -> list[float]:
    url = url or ""
    rest = url.partition("://")[2]
    before, _, query = rest.partition("#")[0].partition("?")
    host, _, path = before.partition("/")
    host = host.lower()
    digits = lambda s: sum(c.isdigit() for c in s) / max(1, len(s))
    tails = suffixes(host)
    return [len(rest), len(host), len(path), path.count("/") + bool(path), host.count("."), host.count("-"), digits(rest), digits(host), entropy(rest), entropy(host), query.count("=") if query else 0, len(query), *(r.get(t, prior) for r, t in zip(rates, tails))]


class UrlTrees:
    """Gradient-boosted regression trees for log loss, on binned features. Without labelled urls, nothing is blocked; of one class, all labels count as half a label of the other too."""

    def __init__(self, urls: list[str], blocked: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, smoothing: float = 4.0, folds: int = 5):
        y = np.asarray(blocked, float)
        self.prior = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
        hosts = [u.partition("://")[2].partition("/")[0].lower() for u in urls]
        tails = [suffixes(h) for h in hosts]
        self.rates = self._rates(tails, y, smoothing)
        self.trees: list = []
        if not len(y):
            return
        x = np.array([lexical(u, self.rates, self.prior) for u in urls])
        # A url's suffix rates are those of other hosts, as they will be for new ones: its own label mustn't show in them.
        fold = np.array([zlib.crc32(h.encode("utf-8", "surrogatepass")) % folds for h in hosts])
        for k in range(folds):
            own = np.flatnonzero(fold == k)
            others = np.flatnonzero(fold != k)
            rates = self._rates([tails[i] for i in others], y[others], smoothing)
            for i in own:
                x[i, -3:] = [r.get(t, self.prior) for r, t in zip(rates, tails[i])]
        self.base, self.rate = math.log(self.prior / (1 - self.prior)), rate
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
        score = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list[tuple[int, float, int, int, float]] = []  # feature, at most, left, right, value
            self._grow(tree, binned, edges, y - p, p * (1 - p), np.arange(len(y)), depth, bins)
            self.trees.append(tree)
            score += rate * self._values(tree, x)

    def _rates(self, tails: list[tuple[str, str, str]], y: np.ndarray, smoothing: float) -> list[dict[str, float]]:
        """The smoothed blocking rate of each suffix, by kind."""
        counts: list[dict[str, list[float]]] = [{}, {}, {}]
        for own, label in zip(tails, y):
            for seen, tail in zip(counts, own):
                pair = seen.setdefault(tail, [0.0, 0.0])
                pair[0] += label
                pair[1] += 1
        return [{t: (a + smoothing * self.prior) / (n + smoothing) for t, (a, n) in seen.items()} for seen in counts]

    def _grow(self, tree, binned, edges, grad, hess, rows, depth, bins) -> int:
        g, h, best = grad[rows].sum(), hess[rows].sum(), (1e-6, -1, -1)
        for f in range(binned.shape[1]) if depth else ():
            gs = np.bincount(binned[rows, f], grad[rows], bins + 1).cumsum()[:-1]
            hs = np.bincount(binned[rows, f], hess[rows], bins + 1).cumsum()[:-1]
            gain = np.where((hs > 1) & (h - hs > 1), gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
            k = int(gain.argmax())
            if gain[k] > best[0] and k < len(edges[f]):
                best = (gain[k], f, k)
        me = len(tree)
        tree.append((-1, 0.0, -1, -1, float(g / (h + 1))))
        if best[1] >= 0:
            _, f, k = best
            left = rows[binned[rows, f] <= k]
            right = rows[binned[rows, f] > k]
            a, b = self._grow(tree, binned, edges, grad, hess, left, depth - 1, bins), self._grow(tree, binned, edges, grad, hess, right, depth - 1, bins)
            tree[me] = (f, float(edges[f][k]), a, b, 0.0)
        return me

    def _values(self, tree, x: np.ndarray) -> np.ndarray:
        f, cut, left, right, value = map(np.array, zip(*tree))
        at = np.zeros(len(x), int)
        while (inner := f[at] >= 0).any():
            low = x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        return value[at]

    def probability(self, urls: list[str | None]) -> np.ndarray:
        """Probability that each url is to be blocked."""
        if not urls or not self.trees:
            return np.zeros(len(urls))
        x = np.array([lexical(u, self.rates, self.prior) for u in urls])
        score = self.base + self.rate * sum(self._values(t, x) for t in self.trees)
        return 1 / (1 + np.exp(-score))


def learn(labelled: DataFrame, rows: int = 4000) -> UrlTrees:
    """Trees from a table of labelled urls (url, label: 'block' or 'allow'; rows without either are left out).

    The sample is bounded: of each label, the `rows` urls first by a hash, whatever files they lie in; a url
    that is repeated with one label counts once.
    """
    urls: dict[tuple[str, str], None] = {}
    for label in ("allow", "block"):
        urls.update(((u, label), None) for u in drawn(labelled.where(F.col("label") == label), "url", rows))
    return UrlTrees([u for u, _ in urls], [int(label == "block") for _, label in urls])


def ruled(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """url and label of the pages that a rule decides."""
    host, path = host_and_path("url")
    split = pages.select("url", host.alias("host"), path.alias("path"))
    return split.select("url", best_rule(F.col("host"), F.col("path"), rules)[1].alias("label")).where("label is not null")


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, labelled: DataFrame | None = None, block_at: float = 0.5, sample_rows: int = 4000) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for every row of pages; only page_id and url are read.

    labelled: urls with labels from which the trees learn (see learn, sample_rows of each label); by
    default the pages that a rule decides. Null or malformed urls have an empty host and path, fit no
    rule and are allowed. Of rules equally long, the last in alphabetical order wins. Repeated rows each
    give a row, an empty table gives none, very long urls are judged whole.
    """
    trees = learn(ruled(pages, rules) if labelled is None else labelled, sample_rows)

    @F.pandas_udf("double")
    def p_block(urls):
        import pandas as pd

        distinct = urls.fillna("").unique()
        known = dict(zip(distinct, trees.probability(list(distinct))))
        return pd.Series([known[u] if "://" in u else 0.0 for u in urls.fillna("")], dtype=float)

    host, path = host_and_path("url")
    split = pages.select("page_id", host.alias("host"), path.alias("path"), p_block("url").alias("p_block"))
    rule, decided = best_rule(F.col("host"), F.col("path"), rules)
    judged = F.coalesce(decided, F.when(F.col("p_block") >= block_at, "block").otherwise("allow"))
    return split.select("page_id", "host", "path", rule.alias("rule"), judged.alias("verdict"), "p_block")


#: DuckDB SQL of host, path, rule and the rule's verdict of every page.
RULED_SQL = """
with s as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from {pages}
), h as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from s
), u as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h
), r(rule, own, start, verdict) as (
  values ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
    ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path,
  (select arg_max(rule, length(rule)) from r where (u.host = own or ends_with(u.host, '.' || own)) and starts_with(u.path, start)) as rule,
  (select arg_max(verdict, length(rule)) from r where (u.host = own or ends_with(u.host, '.' || own)) and starts_with(u.path, start)) as verdict
from u
"""
