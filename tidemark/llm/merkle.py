"""A Merkle manifest of a dataset: a tree of radix 3 over the rows of each source, and one over the sources' roots.

Rows are ranked within their source by one range-partitioned sort, so that blocks of 3 ** LEVELS
neighbours are whole subtrees, whatever share of the rows a source has. Each task takes many
blocks as Arrow tables and raises them in DuckDB, a level at a time: ordered string_agg, then
sha256. Spark combines the blocks' roots by the same steps until each source has one root and
the sources have one, and then hands the outer siblings of each block down. The last pass raises
the blocks of rows again, so that inner siblings never leave the task, and folds every row's
leaf to the root.

Ties: rows of one source and doc_id are ordered by leaf; rows equal in all columns are
interchangeable. Null doc_ids come first, and are never tampered with; null sources are one
source, the first. An empty table has no rows. Texts of any length are hashed in the JVM where
they are read. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

RADIX, LEVELS = 3, 6
BLOCK = RADIX**LEVELS
#: Rows that a task holds at a time, and the runs of ranks up to which their starts are broadcast (100 bytes each).
CHUNK, BROADCAST_RUNS = 20_000, 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(values: list[Column]) -> Column:
    """sha256 over the values, each its length in bytes and itself, or a dash if null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def tampered_text() -> Column:
    """The text without line feeds where 2 divides the doc_id's crc32; null where nothing changes."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even & F.contains("text", F.lit("\n")), F.replace("text", F.lit("\n"), F.lit("")))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) with rank, from 0 in each tree by `order`, and n, the tree's rows. No task holds more than a range of the sorted rows."""
    placed = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("part", F.shiftright("at", 33)), "sorted")
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    tree = Window.partitionBy("tree")  # a row for each task that has rows of the tree
    before = F.coalesce(F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("size").over(tree).alias("n"))
    if runs.count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    return placed.join(runs, ["tree", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def in_blocks(nodes: DataFrame, *extra: str) -> DataFrame:
    """nodes (tree, rank, n, h) by block, each with its place p in it and the levels that the block is to be raised by: all, or as many as leave one node of a whole tree."""
    levels = sum((F.when(F.col("n") > RADIX**i, 1).otherwise(0) for i in range(LEVELS)), F.lit(0))
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    return nodes.select("tree", block.alias("block"), F.lit(1).alias("kind"), (F.col("rank") - block * BLOCK).alias("p"), levels.alias("levels"), "n", "h", *extra)


def whole_blocks(batches, most: int = CHUNK):
    """Arrow tables of about `most` rows that hold whole blocks, whose numbers are their column b; the rows come sorted by block."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def numbered(t):
        codes = t["tree"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        block = t["block"].to_numpy()
        return t.append_column("b", pa.array(np.cumsum(np.concatenate([[False], (codes[1:] != codes[:-1]) | (block[1:] != block[:-1])]))[: len(t)].astype(np.int64)))

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            t = pa.Table.from_batches(held)
            own = pc.and_(pc.equal(t["tree"], t["tree"][-1]), pc.equal(t["block"], t["block"][-1]))
            cut = n - pc.sum(own).as_py()
            if cut:
                yield numbered(t.slice(0, cut))
                held, n = t.slice(cut).to_batches(), n - cut
    if n:
        yield numbered(pa.Table.from_batches(held))


class Blocks:
    """A task's database: the chunk's nodes of all levels, and their siblings."""

    def __init__(self):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})

    def load(self, chunk) -> None:
        self.con.register("chunk", chunk)
        self.con.execute("create or replace temp table node as select 0 as l, b, p, levels, h from chunk where kind = 1")
        for l in range(LEVELS):
            self.con.execute(f"insert into node select {l + 1}, b, p // {RADIX}, any_value(levels), sha256(string_agg(h, '' order by p)) from node where l = {l} and levels > {l} group by b, p // {RADIX}")

    def find_siblings(self) -> None:
        over = lambda frame: f"coalesce(string_agg(h, '') over (partition by l, b, p // {RADIX} order by p rows between {frame}), '')"
        self.con.execute(f"create or replace temp table sibling as select l, b, p, {over('unbounded preceding and 1 preceding')} as before, {over('1 following and unbounded following')} as after from node where l < levels")

    def roots(self):
        """tree, rank, n, h of each block's root."""
        return self.con.sql("select any_value(tree) as tree, any_value(block) as rank, any_value((n + size - 1) // size)::bigint as n, any_value(node.h) as h from (select *, " + str(BLOCK) + " as size from chunk where p = 0 and kind = 1) c join node using (b) where node.l = node.levels group by b").to_arrow_table()

    def paths(self):
        """tree, rank, subroot, steps of each node: its siblings before and after, level by level, then those of its block's root."""
        powers = [RADIX**i for i in range(LEVELS)]
        return self.con.sql(f"""with own as (select node.b, node.p, list(s.before order by s.l) as before, list(s.after order by s.l) as after
            from node join sibling s on s.b = node.b and s.p = node.p // ({powers})[s.l + 1] where node.l = 0 group by all)
            select c.tree, c.block * {BLOCK} + c.p as rank, top.subroot, list_concat(coalesce(flatten(list_transform(list_zip(own.before, own.after), lambda x: [x[1], x[2]])), []), top.steps) as steps
            from chunk c left join own using (b, p) join (select b, subroot, steps from chunk where kind = 0) top using (b) where c.kind = 1""").to_arrow_table()

    def folded(self):
        """doc_id, leaf, subroot, proof_sha256, folded_root of each leaf."""
        con = self.con
        con.execute("create or replace temp table cur as select b, p, coalesce(changed, h) as h, '' as proof from chunk where kind = 1")
        con.execute("create or replace temp table above as select b, unnest(range(len(steps) // 2)) as k, unnest(list_filter(steps, lambda x, i: i % 2 = 1)) as before, unnest(list_filter(steps, lambda x, i: i % 2 = 0)) as after from chunk where kind = 0")
        fold = "create or replace temp table cur as select cur.b, cur.p, if(s.b is null, cur.h, sha256(s.before || cur.h || s.after)) as h, if(s.b is null, proof, proof || s.before || s.after) as proof from cur left join {} on s.b = cur.b and {}"
        for l in range(LEVELS):
            con.execute(fold.format("sibling s", f"s.l = {l} and s.p = cur.p // {RADIX**l}"))
        for k in range(con.execute("select coalesce(max(k) + 1, 0) from above").fetchall()[0][0]):
            con.execute(fold.format("above s", f"s.k = {k}"))
        return con.sql("select c.doc_id, c.h as leaf, top.subroot, sha256(cur.proof) as proof_sha256, cur.h as folded_root from chunk c join cur using (b, p) join (select b, subroot from chunk where kind = 0) top using (b) where c.kind = 1").to_arrow_table()


def by_block(rows: DataFrame, schema: str, result: str, siblings: bool = True) -> DataFrame:
    """What the method `result` of Blocks says of rows, dealt by block."""
    def run(batches):
        blocks = Blocks()
        for chunk in whole_blocks(batches):
            blocks.load(chunk)
            if siblings:
                blocks.find_siblings()
            yield from getattr(blocks, result)().to_batches()

    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "p").mapInArrow(run, schema)


def climb(nodes: DataFrame) -> list[DataFrame]:
    """nodes (tree, rank, n, h), the roots of their blocks, the roots of those and so on: in the last table each tree has one."""
    rounds = [nodes]
    while True:
        up = materialise(by_block(in_blocks(rounds[-1]), "tree string, rank long, n long, h string", "roots", siblings=False), "roots")
        rounds.append(up)
        if (up.agg(F.max("n")).first()[0] or 1) == 1:
            return rounds


def with_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes in blocks, and a row for each block with what leads from its root upwards (tree, rank, subroot, steps)."""
    return in_blocks(nodes, *[c for c in nodes.columns if c not in ("tree", "rank", "n", "h")]).unionByName(above.select("tree", F.col("rank").alias("block"), F.lit(0).alias("kind"), "subroot", "steps"), allowMissingColumns=True)


def descend(rounds: list[DataFrame], above: DataFrame, to: int) -> DataFrame:
    """tree, rank, subroot, steps of the nodes of the table `to`, from those of the last one."""
    for nodes in rounds[-2 : to - 1 if to else None : -1]:
        above = materialise(by_block(with_paths(nodes.select("tree", "rank", "n", "h"), above), "tree string, rank long, subroot string, steps array<string>", "paths"), "paths")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs (doc_id, source, lang, n_chars, text)."""
    values = [F.col(c) for c in FIELDS]
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # nulls first, then by bytes
    changed = tampered_text()
    leaves = docs.select("doc_id", tree.alias("tree"), leaf_of(values).alias("leaf"), F.when(changed.isNotNull(), leaf_of([*values[:-1], changed])).alias("changed"))
    leaves = materialise(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")  # `row` tells equal rows apart for the sort
    rows = materialise(ranked(leaves, ["doc_id", "leaf", "row"]).select("tree", "rank", "n", F.col("leaf").alias("h"), "doc_id", "changed"), "ranked")
    rounds = climb(rows.select("tree", "rank", "n", "h"))
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h")
    tops = materialise(ranked(subroots, ["name"]), "subroots")
    top_rounds = climb(tops.select("tree", "rank", "n", "h"))
    root = top_rounds[-1].first()
    nothing = F.array().cast("array<string>").alias("steps")
    paths = descend(top_rounds, top_rounds[-1].select("tree", "rank", F.lit(None).cast("string").alias("subroot"), nothing), 0)
    above = tops.join(paths.select("rank", "steps"), "rank").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("rank"), F.col("h").alias("subroot"), "steps")
    above = descend(rounds, materialise(above, "paths"), 1)
    found = by_block(with_paths(rows, above), "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string", "folded")
    whole = F.lit(root.h if root else None).cast("string")
    return found.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))


def sql(docs: str, levels: int = 12) -> str:
    """The same for up to 3 ** levels rows a source and as many sources, doc_ids being distinct in a source."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in [*FIELDS[:-1], text]) + ")"
    crc = "list_reduce(list_prepend(4294967295, list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384)))"
    other = "if(even, replace(text, chr(10), ''), text)"
    parts = [
        f"r as (select *, (4294967295 - {crc}) % 2 = 0 as even from {docs})",
        f"d as materialized (select doc_id, coalesce('=' || source, '') as s, {leaf('text')} as leaf, {leaf(other)} as other from r)",
    ]

    def tree(n: str, first: str) -> None:
        parts.append(f"{n}0 as materialized ({first})")
        for k in range(levels):
            counted = f"(select *, count(*) over (partition by s) as c from {n}{k})"
            over = lambda frame: f"coalesce(string_agg(h, '') over (partition by s, p // 3 order by p rows between {frame}), '')"  # noqa: E731,B023
            parts.append(f"{n}{k}s as materialized (select s, p, {over('unbounded preceding and 1 preceding')} as b, {over('1 following and unbounded following')} as a from {counted} where c > 1)")
            parts.append(f"{n}{k + 1} as materialized (select s, p // 3 as p, if(c > 1, sha256(string_agg(h, '' order by p)), any_value(h)) as h from {counted} group by s, p // 3, c)")

    tree("n", "select s, row_number() over (partition by s order by doc_id nulls first, leaf) - 1 as p, leaf as h from d")
    tree("t", f"select '' as s, row_number() over (order by s) - 1 as p, h, s as name from n{levels}")
    parts.append(f"f0 as materialized (select d.*, row_number() over (partition by d.s order by doc_id nulls first, leaf) - 1 as p, t0.p as q, t0.h as subroot, other as h, '' as proof from d join t0 on t0.name = d.s)")
    steps = [(f"n{k}s", f"x.s = f.s and x.p = f.p // {3**k}") for k in range(levels)] + [(f"t{k}s", f"x.p = f.q // {3**k}") for k in range(levels)]
    for k, (table, on) in enumerate(steps):
        parts.append(f"f{k + 1} as materialized (select f.doc_id, f.s, f.leaf, f.p, f.q, f.subroot, if(x.p is null, f.h, sha256(x.b || f.h || x.a)) as h, f.proof || coalesce(x.b || x.a, '') as proof from f{k} f left join {table} x on {on})")
    return "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, t.h as root, sha256(proof) as proof_sha256, f.h as folded_root, f.h = t.h as verified from f{2 * levels} f, t{levels} t"
