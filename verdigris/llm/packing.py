"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. A window of ``size`` tokens credits each queue with its quantum,
size * (tokens of the queue) / (all tokens); queues are visited in a fixed order, each serves the
whole tokens of its credit, and what is left of a token passes on to the next queue of the ring, so
that the window is full to the last token. The deficit (credit less service) stays within one token
and is carried on.

With c the tokens of a queue and all queues before it, the ring has served floor(w * size * c / T)
of T tokens from these after w windows. So the state at any window follows from its number alone,
and partitions cut their documents at window borders without waiting for each other: the deficits
that they start from are those that the windows before have left. Only the last window is short.

The closed form needs at least a token of each queue in a window. Sources with less have one queue
together, whose documents are laid by fractional rank: the share of its source's tokens that lie
before a document's middle. So these sources advance side by side there, each within a document of
its share, whatever their number, and there are ``size`` queues at most, which bounds what is
broadcast. Ranks are found in two levels (ranges of the rank, then places within one).

Every window takes from every queue, so a document has a piece in each window that its tokens last
for: with many sources pieces are short (README.md has a measure).

Defined results: a null or empty text has the end id only; very long texts are packed whole; a null
source is a source; null ids, repeated rows and ids are packed like others; an empty table gives no
pieces; columns other than the id, source and text are ignored, whatever their names. Pieces of a
document cover its ids once and in order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import map_batches
from verdigris.llm.tokenized import tokenized

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"
#: Ranges of the fractional rank.
RANGES = 4096


def _queues(tokens: DataFrame, size: int) -> tuple[list[tuple[str | None, int]], int]:
    """Sources with a queue of their own, at most ``size``, and the tokens of the queue that the rest shares."""
    sums = tokens.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    own = sorted(((r.source, r.n) for r in sums.where(F.col("n") * size >= total).collect()), key=lambda x: (x[1], x[0] or ""))
    rest = total - sum(n for _, n in own)
    while own and 0 < rest * size < total:
        rest += own.pop(0)[1]
    return sorted(own, key=lambda x: (x[0] is not None, x[0] or "")), rest


def served(w: int, c: int, size: int, total: int) -> int:
    """Tokens from the queues up to a cumulative size c that w windows have."""
    return min(c, w * size * c // total)


def pieces_of(a: int, n: int, low: int, high: int, size: int, total: int) -> list[tuple[int, int, int, int]]:
    """(start, length, window, offset) of a document of n tokens that begins at token a of the queue over (low, high]."""
    w = a * total // ((high - low) * size)
    count = lambda w: served(w, high, size, total) - served(w, low, size, total)
    while count(w) > a:
        w -= 1
    out, at = [], a
    while at < a + n:
        while (upto := count(w + 1)) <= at:
            w += 1
        end = min(a + n, upto)
        offset = served(w + 1, low, size, total) - served(w, low, size, total) + at - count(w)
        out.append((at - a, end - at, w, offset))
        at = end
    return out


def _before(*by: str):
    """The sum of n over the rows before, by the last column within the others."""
    window = Window.partitionBy(*by[:-1]) if by[1:] else Window.partitionBy(F.lit(0))
    return F.coalesce(F.sum("n").over(window.orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _ranked(tokens: DataFrame) -> DataFrame:
    """(part, place, a) of documents that share a queue: its tokens before each, in the order of fractional ranks."""
    shares = tokens.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    shares = shares.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), _before("source", "part").alias("begin"), F.sum("n").over(Window.partitionBy("source")).alias("of"))
    rank = (F.col("begin") + F.col("local_start") + F.col("n_tokens") / 2) / F.col("of")
    rows = tokens.join(shares, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part"))).select("part", "place", F.col("n_tokens").alias("n"), rank.alias("rank"))
    rows = rows.withColumn("range", F.floor(F.col("rank") * RANGES))
    bases = rows.groupBy("range").agg(F.sum("n").alias("n")).select("range", _before("range").alias("base"))  # RANGES rows at most
    inside = Window.partitionBy("range").orderBy("rank", "part", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(bases), "range")
    return placed.select(F.col("part").alias("b_part"), F.col("place").alias("b_place"), (F.col("base") + F.col("inner")).alias("a"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, width: str = "<u2", **columns: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    _, tokens = tokenized(docs, tokenizer, end_id, width, **columns)
    spark = docs.sparkSession
    own, rest = _queues(tokens, size)
    ends = np.cumsum([0, *[n for _, n in own], rest]).tolist()
    total = ends[-1]
    if not total:
        return spark.createDataFrame([], SCHEMA)
    queues = F.broadcast(spark.createDataFrame([(source, ends[k], ends[k + 1]) for k, (source, _) in enumerate(own)], "q_source string, low bigint, high bigint"))
    of_queue = F.col("source").eqNullSafe(F.col("q_source"))
    shares = tokens.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")).join(queues, of_queue)
    begun = shares.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), _before("source", "part").alias("begin"), "low", "high")
    laid = tokens.join(begun, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part"))).select("doc_id", (F.col("begin") + F.col("local_start")).alias("a"), "n_tokens", "low", "high", "ids")
    if rest:
        others = tokens.join(queues, of_queue, "left_anti")
        there = (F.col("part") == F.col("b_part")) & (F.col("place") == F.col("b_place"))
        laid = laid.union(others.join(_ranked(others), there).select("doc_id", "a", "n_tokens", F.lit(total - rest).alias("low"), F.lit(total).alias("high"), "ids"))

    def work(batches):
        step = np.dtype(width).itemsize
        for batch in batches:
            out = []
            for doc, a, n, low, high, ids in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                whole = ids if step == 4 else np.frombuffer(ids, width).astype("<u4").tobytes()
                for start, length, window, offset in pieces_of(a, n, low, high, size, total):
                    out.append((doc, start, length, zlib.crc32(whole[4 * start : 4 * (start + length)]), n, window, offset))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return map_batches(laid, work, T._parse_datatype_string(SCHEMA))
