"""Which texts contain which passages, by an equi join of hashes instead of comparing all with all.

Of each run of WIDTH neighbouring GRAM-byte windows of a text the least hash is an anchor; a
passage of REACH bytes or more has such a run inside, so its first run's least hash is an anchor
of every text that contains it. Shorter passages are hashed whole and meet all windows of their
length. What meets is compared in full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..sources.scratch import dealt

GRAM, WIDTH = 8, 24
REACH = GRAM + WIDTH - 1
#: Candidate pairs, or passages' hashes, up to this many are broadcast: two ids or an id and a number each.
BROADCAST_ROWS = 200_000


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` bytes."""
    n = len(data) - size + 1
    h = np.full(max(n, 0), size, np.uint64)
    for k in range(size if n > 0 else 0):
        h = (h ^ data[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def run_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` neighbours."""
    have, out = 1, h
    while have < width and len(out):
        step = min(have, width - have)
        out = np.minimum(out[: max(len(out) - step, 0)], out[step:])
        have += step
    return out


def anchors(text: str, sizes: list[int]) -> np.ndarray:
    """The distinct hashes that a text shares with any passage in it; sizes: the lengths of short passages."""
    data = np.frombuffer(text.encode(), np.uint8)
    found = [np.unique(run_minima(window_hashes(data, GRAM), WIDTH))] + [np.unique(window_hashes(data, s)) for s in sizes]
    return np.concatenate(found).view(np.int64)


#: Characters whose anchors are held at a time.
SLICE_CHARS = 250_000


def sliced(texts: list[str]):
    """Where a slice of about SLICE_CHARS begins, and its texts."""
    begin, chars = 0, 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= SLICE_CHARS or k == len(texts) - 1:
            yield begin, texts[begin : k + 1]
            begin, chars = k + 1, 0


def passage_hash(passage: str) -> int:
    data = np.frombuffer(passage.encode(), np.uint8)
    h = window_hashes(data, len(data)) if len(data) < REACH else run_minima(window_hashes(data[:REACH], GRAM), WIDTH)
    return int(h.view(np.int64)[0])


def containing(texts: DataFrame, passages: DataFrame, within: list[str] | None = None) -> DataFrame:
    """id, passage_id of each text (id, text) and passage (passage_id, passage) that is a part of it. Null and empty texts and passages are part of nothing.

    within: columns of both that must be equal too, as those of a question.
    """
    import pyarrow as pa

    own = within or []
    asked = passages.where("passage <> ''")
    hashed = asked.select(*own, "passage_id", F.udf(passage_hash, "long")("passage").alias("anchor"))
    size = F.octet_length("passage")
    short = [r.n for r in asked.where(size < REACH).select(size.alias("n")).distinct().collect()]  # fewer than REACH lengths

    known = hashed.select("anchor").distinct().limit(BROADCAST_ROWS + 1).toPandas()["anchor"].to_numpy(np.int64)
    known = np.sort(known) if len(known) <= BROADCAST_ROWS else None  # the anchors of passages: only these leave a text

    def run(batches):
        for batch in batches:
            for at, rows in sliced(batch.column("text").to_pylist()):
                found = [anchors(t, short) for t in rows]
                found = found if known is None else [f[np.isin(f, known)] for f in found]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(rows)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))], names=["id", "anchors"])

    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    schema = texts.select(F.struct("id", *own).alias("id")).schema.add("anchors", ArrayType(LongType()))
    met = dealt(texts.where("text <> ''").select(F.struct("id", *own).alias("id"), "text")).mapInArrow(run, schema).select("id.*", F.explode("anchors").alias("anchor"))
    pairs = met.join(few(hashed), ["anchor", *own]).select("id", "passage_id", *own).distinct()
    return texts.join(few(pairs), ["id", *own]).join(asked, ["passage_id", *own]).where(F.contains("text", "passage")).select("id", "passage_id", *own)
