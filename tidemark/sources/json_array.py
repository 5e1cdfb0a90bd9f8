"""Files that are one JSON array of objects, read in as many tasks as they have splits.

Spark's text reader cuts the files behind every closing brace, so a task gets its split's pieces in
order without knowing what comes before. A first pass says for each split how quotes and depth
change, were it to begin within a string or not; folding these, one row a split, tells where each
split stands. The second pass emits the objects that lie in a split, and the ends and beginnings
that neighbouring splits share, which a window over splits puts together.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ESCAPED = re.compile(r"\\.", re.S)
SPLIT = "file string, block long"


def after(piece: str, quoted: bool) -> tuple[bool, int]:
    """Whether a piece ends within a string, and by how much it changes the depth, its closing brace left out."""
    parts = ESCAPED.sub("", piece).split('"')
    open_ = "".join(parts[int(quoted) :: 2])
    return quoted ^ (len(parts) % 2 == 0), open_.count("{") + open_.count("[") - open_.count("]")


def by_split(batches):
    """The pieces of each split of a task: its file and block, and an iterator over them."""
    from itertools import chain, groupby

    rows = chain.from_iterable(zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))) for batch in batches)
    for (file, block), pieces in groupby(rows, key=lambda r: r[:2]):
        yield file, block, (p[2] for p in pieces)


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def starts(pieces: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """Of each split, whether it begins within a string and at what depth; the driver gets a row a split."""
    import pyarrow as pa

    def run(batches):
        for file, block, values in by_split(batches):
            ends = [[quoted, 0] for quoted in (False, True)]
            for value in values:
                for end in ends:
                    end[0], change = after(value, end[0])
                    end[1] += change - (not end[0])
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "q0": ends[0][0], "d0": ends[0][1], "q1": ends[1][0], "d1": ends[1][1]}])

    found, at = {}, ("", (False, 0))
    for r in sorted(pieces.mapInArrow(run, f"{SPLIT}, q0 boolean, d0 long, q1 boolean, d1 long").collect(), key=lambda r: (r.file, r.block)):
        quoted, depth = at[1] if at[0] == r.file else (False, 0)
        found[r.file, r.block] = (quoted, depth)
        at = (r.file, (r.q1, depth + r.d1) if quoted else (r.q0, depth + r.d0))
    return found


def objects(spark: SparkSession, path: str) -> DataFrame:
    """value: the text of each object of the arrays in path (a file, a folder or a pattern)."""
    import pyarrow as pa

    pieces = pieces_of(spark, path)
    known = starts(pieces)

    def run(batches):
        for file, block, values in by_split(batches):
            quoted, depth = known[file, block]
            held, first, out = [], True, []
            for value in values:
                quoted, change = after(value, quoted)
                depth += change
                held.append(value)
                if quoted or depth <= 1:  # a brace in a string, or the end of the file
                    held.append("}" if quoted else "")
                    continue
                depth -= 1
                held.append("}")
                if depth == 1:
                    out.append({"file": file, "block": block, "kind": "first" if first else "whole", "value": "".join(held)})
                    held, first = [], False
            out.append({"file": file, "block": block, "kind": "through" if first else "rest", "value": "".join(held)})
            yield pa.RecordBatch.from_pylist(out)

    found = pieces.mapInArrow(run, f"{SPLIT}, kind string, value string")
    # An object over several splits: what is left of one, whole ones between, and the first end of another.
    parts = found.where("kind <> 'whole'").withColumn("order", F.when(F.col("kind") == "rest", 1).otherwise(0))
    begun = F.sum("order").over(Window.partitionBy("file").orderBy("block", "order").rowsBetween(Window.unboundedPreceding, 0))
    joined = parts.withColumn("object", begun).groupBy("file", "object").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "order", "value"))), lambda x: x["value"]), "").alias("value"))
    texts = found.where("kind = 'whole'").select("value").unionByName(joined.select("value"))
    return texts.select(F.regexp_replace("value", r"^[\s,\[\]]+|[\s\]]+$", "").alias("value")).where(F.col("value").startswith("{"))


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects as rows of `schema`; what isn't a column of it is left out."""
    return objects(spark, path).select(F.from_json("value", schema).alias("row")).select("row.*")
