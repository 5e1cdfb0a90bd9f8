"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built per language. A text is parsed greedily into
the longest phrases that occur in that language's text; the language that needs the fewest
bits, phrases times log2 of its text's length, wins. Parsing runs in lock-step over many
blocks of text and all languages with one probe of a sparse table a letter, so that scripts of
many letters are told apart as well as small alphabets.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns, slices

FIELDS = "lang_pred string, score double, phrase_rate double"
#: Characters of a document that may be learned, and that texts are judged in slices of.
LEARNED_CHARS, JUDGED_CHARS = 4_000, 1_000_000


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton that accepts every substring; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class SparseTables:
    """The transitions of an automaton in one array: the edge of state s by symbol c lies at address[s] + c, and is known as its by `check`.

    Addresses are drawn at random until no two edges share a place, states of many edges first, so a look-up is one probe.
    """

    def __init__(self, states: list[dict[int, int]], symbols: int):
        rng = np.random.default_rng(len(states))
        degree = np.array([len(e) for e in states])
        edge_at = np.concatenate([[0], np.cumsum(degree)])
        symbol = np.fromiter((c for e in states for c in e), np.int64, edge_at[-1])
        to = np.fromiter((t for e in states for t in e.values()), np.int64, edge_at[-1])
        room = max(64, 3 * int(edge_at[-1]), 2 * len(states))
        self.size = room + symbols
        taken, used, address = np.zeros(self.size, bool), np.zeros(room, bool), np.zeros(len(states), np.int64)
        bounds = [1 << 30, 32, 16, 8, 4, 2, 1, 0, -1]
        for most, least in zip(bounds, bounds[1:]):
            left = np.flatnonzero((degree > least) & (degree <= most))
            while len(left):
                base = rng.integers(0, room, len(left))
                n = degree[left]
                ends = np.cumsum(n)
                edges = np.repeat(edge_at[left] - (ends - n), n) + np.arange(int(ends[-1]))
                owner = np.repeat(np.arange(len(left)), n)
                place = base[owner] + symbol[edges]
                good = ~used[base]
                good &= np.isin(np.arange(len(left)), np.unique(base, return_index=True)[1])
                bad = taken[place]
                bad |= ~np.isin(np.arange(len(place)), np.unique(place, return_index=True)[1])
                good[owner[bad]] = False
                address[left[good]] = base[good]
                used[base[good]] = True
                taken[place[good[owner]]] = True
                left = left[~good]
        self.check, self.target = np.full(self.size, -1, np.int32), np.zeros(self.size, np.int32)
        place = np.repeat(address, degree) + symbol
        self.check[place], self.target[place] = np.repeat(address, degree), address[to]
        self.root = int(address[0])
        self.first = np.full(symbols, -1, np.int32)  # where the root goes
        self.first[list(states[0])] = address[list(states[0].values())]


class CrossParser:
    """Judges texts against labelled text of each language. letters: learned of each language, an equal share of each text; block: letters parsed from the root at a time."""

    def __init__(self, labelled: dict[str, list[str]], letters: int = 32_000, block: int = 1024):
        self.langs, self.block = sorted(labelled), block
        met = Counter(c for texts in labelled.values() for c in "".join(texts).lower() if c.isalpha())
        known = sorted(sorted(met, key=lambda c: (-met[c], c))[: 2**16 - 2])  # of more letters than symbols, the commonest
        # 0: anything but a letter; 1: a letter that no labelled text has.
        self.symbol = np.fromiter((chr(k).isalpha() for k in range(0x110000)), np.uint16, 0x110000)
        self.symbol[[ord(c) for c in known]] = np.arange(2, 2 + len(known))
        tables, bits, at = [], [], 0
        for lang in self.langs:
            texts = self.symbols(labelled[lang])
            learned = np.concatenate([t[: self.share([len(t) for t in texts], letters)] for t in texts])[: letters + len(texts)]
            one = SparseTables(suffix_automaton(learned.tolist()), 2 + len(known))
            tables.append((one, at))
            at += one.size
            bits.append(np.log2(len(learned) + 2))
        if at >= 2**31:
            raise ValueError("too many languages for the letters kept of each")
        none = np.zeros(0, np.int32)
        self.check = np.concatenate([none, *[np.where(t.check >= 0, t.check + at, -1).astype(np.int32) for t, at in tables]])
        self.target = np.concatenate([none, *[(t.target + at).astype(np.int32) for t, at in tables]])
        self.first = np.array([np.where(t.first >= 0, t.first + at, -1) for t, at in tables], np.int32).reshape(len(tables), 2 + len(known))
        self.roots, self.bits = np.array([t.root + at for t, at in tables], np.int32), np.array(bits)

    @staticmethod
    def share(sizes: list[int], letters: int) -> int:
        """What each text may give, so that all together give about `letters`: short texts leave their rest to the others."""
        left, n = letters, len(sizes)
        for size in sorted(sizes):
            if size * n > left:
                break
            left, n = left - size, n - 1
        return -(-left // n) if n else letters

    def symbols(self, texts: list[str]) -> list[np.ndarray]:
        """Symbols of each text: lower-cased letters, with one separator for each run of anything else."""
        joined = "\n".join([*(t.lower() for t in texts), ""])
        flat = self.symbol[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = flat > 0
        keep[1:] |= keep[:-1]  # the first separator after a letter
        ends = np.cumsum([len(t.lower()) + 1 for t in texts])
        before = np.concatenate([[0], np.cumsum(keep)])
        flat = flat[keep]
        return [flat[before[a] : before[b]] for a, b in zip([0, *ends[:-1]], ends)]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and each text's number of symbols."""
        parsed = self.symbols(texts)
        sizes = np.array([len(p) for p in parsed])
        pieces = [(k, a) for k, p in enumerate(parsed) for a in range(0, len(p), self.block)]
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        if not pieces or not self.langs:
            return total, sizes
        size = np.array([min(self.block, sizes[k] - a) for k, a in pieces])
        order = np.argsort(-size, kind="stable")
        lanes = np.zeros((self.block, len(pieces)), np.uint16)
        for lane, j in enumerate(order):
            k, a = pieces[j]
            lanes[: size[j], lane] = parsed[k][a : a + size[j]]
        alive = len(pieces) - np.searchsorted(size[order][::-1], np.arange(1, size.max() + 1), side="left")
        root = self.roots[:, None]
        at = np.repeat(root, len(pieces), 1)
        ended = np.zeros(at.shape, np.int32)
        for t, n in enumerate(alive):
            now, symbol = at[:, :n], lanes[t, :n]
            place = now + symbol
            missing = self.check[place] != now
            first = self.first[:, symbol]
            # Without a way on, a phrase ends, and the symbol starts the next; where no phrase starts with it, it is one of its own.
            unknown = missing & (first < 0)
            ended[:, :n] += missing
            ended[:, :n] += unknown & (now != root)
            at[:, :n] = np.where(missing, np.where(unknown, root, first), self.target[place])
        ended += at != root  # the last phrase
        np.add.at(total, np.array([k for k, _ in pieces])[order], ended.T)
        return total, sizes

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and phrases a letter of each text."""
        texts = [t or "" for t in texts]
        count, sizes = self.phrases(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
        cost = count * self.bits / np.maximum(sizes, 1)[:, None]
        best = cost.argmin(1)
        ranked = np.sort(cost, 1)
        some = sizes > 0
        least = ranked[:, 0]
        rival = ranked[:, 1] if len(self.langs) > 1 else np.broadcast_to(self.bits, cost.shape)[:, 0]
        score = np.where(some, np.clip(1 - least / np.maximum(rival, 1e-9), 0, 1), 0.0)
        rate = np.where(some, count[np.arange(len(texts)), best] / np.maximum(sizes, 1), 1.0)
        return [self.langs[b] if s else "und" for b, s in zip(best, some)], score, rate


def learn(docs: DataFrame, rows: int = 64, letters: int = 32_000, most_languages: int = 500) -> CrossParser:
    """A parser learned from documents that have a language and a letter and aren't held out.

    The sample is bounded: of each language the `rows` texts first by a hash of their id (then by id and
    a hash of the text; repeated rows count once), LEARNED_CHARS characters of each, and `letters` letters
    in all, an equal share of each text. Of more than `most_languages` languages the commonest are learned
    (of equally common ones the first by name), as every worker holds them; a text of another one gets the
    nearest of these. Of more than 65,534 distinct letters in the sample the commonest are told apart.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    usable = usable.select("lang", "doc_id", F.substring("text", 1, LEARNED_CHARS).alias("text"), F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    first = usable.select("lang", "doc_id", "h").withColumn("k", F.dense_rank().over(order)).where(F.col("k") <= rows)
    picked = first.select("lang", "doc_id", "h").distinct().limit(rows * most_languages + 1).collect()
    if len({r.lang for r in picked}) > most_languages or len(picked) > rows * most_languages:
        common = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
        return learn(docs.where(F.col("lang").isin([r.lang for r in common])), rows, letters, most_languages)
    if not picked:
        return CrossParser({})
    chosen = usable.where(F.col("doc_id").isin(sorted({r.doc_id for r in picked})) & F.col("h").isin(sorted({r.h for r in picked})))
    texts = chosen.groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text")).collect()
    labelled: dict[str, list[str]] = {}
    known = {tuple(r) for r in picked}
    for r in sorted(texts, key=lambda r: (r.lang, r.doc_id, r.h)):
        if (r.lang, r.doc_id, r.h) in known:
            labelled.setdefault(r.lang, []).append(r.text)
    return CrossParser({lang: t for lang, t in labelled.items() if any(c.isalpha() for x in t for c in x)}, letters)


def identify(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """docs with lang_pred, score and phrase_rate of every whole text.

    Null, empty and letterless texts are `und` with score 0; ties go to the language first by
    name; repeated rows are judged each; columns of docs with these names are replaced. A text is
    judged whole, however long; short ones together, JUDGED_CHARS characters at a time.
    """
    spread = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batch):
        texts = batch.column("text").to_pylist()
        langs, scores, rates = [], [], []
        for a, b in slices([t or "" for t in texts], JUDGED_CHARS):
            one = spread.value.judge(texts[a:b])
            langs += one[0]
            scores.append(one[1])
            rates.append(one[2])
        join = lambda x: np.concatenate(x) if x else np.zeros(0)
        return [pa.array(langs, pa.string()), pa.array(join(scores), pa.float64()), pa.array(join(rates), pa.float64())]

    return append_columns(docs, FIELDS, run)
