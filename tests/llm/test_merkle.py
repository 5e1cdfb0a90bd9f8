"""The manifest against a plain tree, over sources of many sizes, odd and repeated rows, and with blocks of few rows."""

import hashlib
import zlib

import duckdb
import pytest

from tidemark.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The root, and for each node the siblings before and after on its way there."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, way in enumerate(ways):
            run, j = divmod(at[k], 3)
            way.append(("".join(nodes[3 * run : 3 * run + j]), "".join(nodes[3 * run + j + 1 : 3 * run + 3])))
            at[k] = run
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return (nodes or [None])[0], ways


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[name] = tree([leaf(r) for r in groups[name]])
    root, tops = tree([built[name][0] for name in names])
    out = []
    for name, top in zip(names, tops):
        for r, way in zip(groups[name], built[name][1]):
            h = leaf(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                h = leaf([*r[:4], r[4].replace("\n", "")])
            for before, after in way + top:
                h = sha(before + h + after)
            out.append((r[0], leaf(r), built[name][0], root, sha("".join(b + a for b, a in way + top)), h, h == root))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = rows(queries.QUERIES["op12_merkle"](spark, SF))
    assert got == sorted(con.sql(queries.ORACLE_SQL["op12_merkle"]).fetchall(), key=str) and {r[-1] for r in got} == {True, False}


ODD = [(None, "a", None, None, "null\nid"), (None, "a", "en", 3, "two\n"), (1, None, None, None, None), (2, None, "", 0, ""), (3, "", "en", 1, "empty\nsource"), (4, "é€", "fr", 2, "é\n\n"), (4, "é€", "fr", 2, "other\n"), (5, "lone", "en", 9, "x\n" * 200_000)]


@pytest.mark.parametrize("levels, chunk", [(1, 4), (2, 10), (6, 20_000)])
def test_trees_of_all_sizes(spark, monkeypatch, levels, chunk):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    data = [*ODD, ODD[5], ODD[5], *[(100 + k, "hot", "en", k, f"line {k}\nmore") for k in range(95)]]
    for n in (1, 2, 3, 4, 9, 10, 28):
        data += [(1000 * n + k, f"s{n}", "de", None, f"{n}\n{k}") for k in range(n)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int").repartition(5)
    got = rows(merkle.manifest(df))
    assert got == plain(data)
    assert all(r[-1] for r in got if r[0] is None or zlib.crc32(str(r[0]).encode()) % 2) and not all(r[-1] for r in got)


def test_few_rows(spark):
    df = spark.createDataFrame([(7, "s", None, None, "one")], "doc_id long, source string, lang string, n_chars long, text string")
    assert rows(merkle.manifest(df)) == plain([(7, "s", None, None, "one")])
    assert merkle.manifest(df.limit(0)).count() == 0
