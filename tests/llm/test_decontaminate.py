"""Winnowing against brute force: whole tables, short items, repeated and odd rows, and the way without broadcasts."""

import hashlib
import random
import re

import duckdb
import pytest

from tidemark.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, length=10):
    """Every window of every document against every window of every item."""
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - length, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + length]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, held = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s : s + n]))
                if found is not None:
                    hit |= set(range(s, s + n))
                    held |= found
        named = ",".join(sorted(str(i) for i in held if i is not None))
        out.append((d, len(w), len(hit), len(held - {None}), hashlib.sha256(named.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = rows(queries.QUERIES["op13_decontaminate"](spark, SF))
    assert got == sorted(con.sql(queries.ORACLE_SQL["op13_decontaminate"]).fetchall(), key=str) and any(r[-1] for r in got)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "日本", "x_y", "7"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([1, 3, 5, 7, 9, 10, 11, 25, 40]))) for k in range(25)]
    items += [(100, None), (101, ""), (102, " .,- "), (103, items[5][1]), (104, items[9][1].upper()), (None, say(12)), (0, say(14)), (105, "same " * 30)]
    docs = [(k, say(60)) for k in range(30)]
    for k in range(30):
        t = words(rng.choice(items)[1])
        a = rng.randrange(len(t) or 1)
        docs.append((1000 + k, f"{say(rng.randrange(20))}, {'-'.join(t[a : a + rng.randrange(1, 20)])}. {say(rng.randrange(20))}"))
    docs += [(2000, None), (2001, ""), (2002, "!?"), (2003, "same " * 5000), (2004, items[-3][1]), (2005, items[-2][1]), (2005, items[-2][1]), (None, items[-2][1]), (2006, "\n" + items[8][1] + "\n")]
    return docs, items


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("longest", [0, 9])
def test_planted_spans(spark, cases, monkeypatch, broadcast, longest):
    """longest: without items of fewer words than that, so that few and many documents are hit."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    docs, items = cases[0], [i for i in cases[1] if not words(i[1]) or len(words(i[1])) > longest]
    d = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in docs], "doc_id long, text string, key string, fp long, window int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    assert rows(decontaminate.decontaminate(d, b)) == plain(docs, items)


def test_empty_tables(spark, cases):
    d = spark.createDataFrame(cases[0], "doc_id long, text string")
    b = spark.createDataFrame(cases[1], "item_id long, text string")
    assert rows(decontaminate.decontaminate(d, b.limit(0))) == plain(cases[0], [])
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0


def test_fingerprints_are_the_least_grams(spark):
    """Each window's fingerprint is the minimum over its own k-grams, and what it keeps is sparse."""
    rng = random.Random(1)
    text = " ".join(f"v{rng.randrange(500)}" for _ in range(2000))
    df = spark.createDataFrame([(text,)], "text string").select(decontaminate.word_list("text").alias("words"))
    row = decontaminate.with_fingerprints(df, [10]).select("fps").first().fps
    grams = [r.g for r in spark.createDataFrame([(text.split()[i : i + 5],) for i in range(1996)], "w array<string>").selectExpr("xxhash64(w[0], w[1], w[2], w[3], w[4]) as g").collect()]
    assert row == [min(grams[i : i + 6]) for i in range(1991)] and len(set(row)) < 0.4 * len(row)
