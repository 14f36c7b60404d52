"""Token ids in files: static range asymmetric numeral systems over one shared frequency table.

A file set is a folder: ``table`` holds the frequency table, ``blocks`` a row for each block. Nothing
else is needed to read it. A block holds whole documents in ascending order of their ids and can be
decoded by itself:

    magic "VRA1", counts of tokens, lanes, steps, checkpoints and documents, digest of the table
    document ids, whether they are null, token counts
    for each checkpoint the place in the stream, the state of every lane and a crc32 of its tokens
    the stream of 32-bit words
    crc32 of all before

Tokens are dealt over lanes that are coded side by side: token t is coded by lane t mod lanes at
step t div lanes. States are 64 bits wide, frequencies sum to 2 ** SCALE_BITS. Every STEPS steps
the state of all lanes and the place in the stream are kept: from there, ``decode`` runs all
segments of a block side by side, ``decode_segment`` any one alone, and each is held against its
checksum.

Defined results: a null or empty text is its end id; null document ids come first; documents with
equal ids stand side by side, ordered by a hash of their text; an empty table makes no blocks.
A document longer than a block is a block of its own, so very long texts are coded whole. Columns
other than the id, source and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import Scratch, map_batches, shared_dir
from verdigris.llm.tokenized import COUNTS, tokenized

SCALE_BITS = 20
LOW = np.uint64(1 << 32)
#: Tokens that close a block, and steps between checkpoints.
BLOCK_TOKENS, STEPS = 1 << 20, 256
#: Tokens of a task that encodes, about.
PART_TOKENS = 1 << 24
_HEAD = struct.Struct("<4sQIIIQ16s")


class Table:
    """Frequencies that sum to 2 ** SCALE_BITS, at least 1 for each id that occurs."""

    def __init__(self, frequencies: np.ndarray):
        self.frequencies = frequencies.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(np.uint64)
        self.digest = hashlib.sha256(frequencies.astype("<u4").tobytes()).digest()[:16]
        self._symbols = None

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        counts = np.asarray(counts, np.float64)
        if np.count_nonzero(counts) < 2:  # a frequency of the whole scale would not fit
            counts = counts.copy()
            counts[np.flatnonzero(counts == 0)[:2]] += 1e-9
        used, room = counts > 0, 1 << SCALE_BITS
        if used.sum() > room // 2:
            raise ValueError("the vocabulary in use is too large for the scale")
        share = counts / counts.sum() * (room - used.sum())
        out = np.where(used, 1 + np.floor(share), 0).astype(np.int64)
        for k in np.argsort(-(share - np.floor(share)), kind="stable")[: room - out.sum()]:
            out[k] += 1
        return cls(out)

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.frequencies), dtype=np.uint32), self.frequencies.astype(np.int64))
        return self._symbols


def lanes_for(n: int) -> int:
    """A power of two, 1024 at most."""
    return 1 << max(0, min(10, n.bit_length() - 8))


def encode(ids: np.ndarray, table: Table) -> bytes:
    """Lanes, checkpoints and stream of a sequence of ids."""
    n, lanes = len(ids), lanes_for(len(ids))
    steps = -(-n // lanes)
    filler = ids[-1] if n else 0
    grid = np.concatenate([ids, np.full(steps * lanes - n, filler, ids.dtype)]).reshape(steps, lanes)
    state = np.full(lanes, LOW, np.uint64)
    bits, back, mask32 = np.uint64(SCALE_BITS), np.uint64(32), np.uint64(0xFFFFFFFF)
    limit = np.uint64(64 - SCALE_BITS)
    parts: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    written = 0
    for t in range(steps - 1, -1, -1):
        f, s = table.frequencies[grid[t]], table.starts[grid[t]]
        full = state >= (f << limit)
        if full.any():
            parts.append((state[full] & mask32).astype("<u4"))
            written += len(parts[-1])
            state[full] >>= back
        q = state // f
        state = (q << bits) + (state - q * f) + s
        if t % STEPS == 0:
            marks.append((written, state.astype("<u8").tobytes()))
    marks.reverse()
    flat = grid.reshape(-1)[:n].astype("<u4")
    head = [struct.pack("<QI", written - place, zlib.crc32(flat[k * STEPS * lanes : (k + 1) * STEPS * lanes].tobytes())) + states for k, (place, states) in enumerate(marks)]
    return struct.pack("<II", lanes, len(marks)) + b"".join(head) + b"".join(p.tobytes() for p in reversed(parts))


def decode(data: bytes, n: int, table: Table) -> np.ndarray:
    """All ids of an encoded sequence, its segments side by side."""
    lanes, count = struct.unpack_from("<II", data, 0)
    if not count:
        return np.zeros(0, np.uint32)
    marks = np.frombuffer(data, np.dtype([("place", "<u8"), ("crc", "<u4"), ("state", "<u8", (lanes,))]), count, 8)
    stream = np.frombuffer(data, "<u4", offset=8 + marks.nbytes)
    place, state = marks["place"].astype(np.int64), marks["state"].astype(np.uint64)
    last = -(-n // lanes) - (count - 1) * STEPS  # steps of the last segment
    out = np.zeros((count, STEPS if count > 1 else last, lanes), np.uint32)
    bits, back, slot_mask = np.uint64(SCALE_BITS), np.uint64(32), np.uint64((1 << SCALE_BITS) - 1)
    for t in range(out.shape[1]):
        some = slice(0, count if t < last else count - 1)
        own = state[some]
        slot = own & slot_mask
        symbol = table.symbols[slot]
        out[some, t] = symbol
        own = table.frequencies[symbol] * (own >> bits) + slot - table.starts[symbol]
        low = own < LOW
        used = np.cumsum(low, axis=1)
        at = (place[some, None] + used - 1)[low]
        own[low] = (own[low] << back) | stream[at]
        state[some] = own
        place[some] += used[:, -1]
    flat = out.reshape(-1)[:n]
    for k, crc in enumerate(marks["crc"].tolist()):
        if zlib.crc32(flat[k * STEPS * lanes : (k + 1) * STEPS * lanes].astype("<u4").tobytes()) != crc:
            raise ValueError(f"checksum of segment {k} does not match")
    return flat


def decode_segment(data: bytes, n: int, table: Table, k: int) -> np.ndarray:
    """The ids from checkpoint k to the next; needs nothing of the other segments."""
    lanes, count = struct.unpack_from("<II", data, 0)
    each = 12 + 8 * lanes
    place, crc = struct.unpack_from("<QI", data, 8 + k * each)
    state = np.frombuffer(data, "<u8", lanes, 8 + k * each + 12).astype(np.uint64)
    stream = np.frombuffer(data, "<u4", offset=8 + count * each)
    steps = min(STEPS, -(-n // lanes) - k * STEPS)
    out = np.empty((steps, lanes), np.uint32)
    bits, back, slot_mask = np.uint64(SCALE_BITS), np.uint64(32), np.uint64((1 << SCALE_BITS) - 1)
    for t in range(steps):
        slot = state & slot_mask
        symbol = table.symbols[slot]
        out[t] = symbol
        state = table.frequencies[symbol] * (state >> bits) + slot - table.starts[symbol]
        low = np.flatnonzero(state < LOW)
        if len(low):
            state[low] = (state[low] << back) | stream[place : place + len(low)]
            place += len(low)
    ids = out.reshape(-1)[: n - k * STEPS * lanes]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError(f"checksum of segment {k} does not match")
    return ids


def write_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, table: Table) -> bytes:
    body = encode(ids, table)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = _HEAD.pack(b"VRA1", len(ids), lanes_for(len(ids)), STEPS, SCALE_BITS, len(doc_ids), table.digest)
    data = head + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + known.tobytes() + np.array(lengths, "<u8").tobytes() + body
    return data + struct.pack("<I", zlib.crc32(data))


def read_block(data: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and all ids of a block."""
    if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("checksum of the block does not match")
    magic, n, _, steps, bits, docs, digest = _HEAD.unpack_from(data, 0)
    if magic != b"VRA1" or steps != STEPS or bits != SCALE_BITS or digest != table.digest:
        raise ValueError("not a block of this format and table")
    at = _HEAD.size
    ids = np.frombuffer(data, "<i8", docs, at).tolist()
    known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    return [i if k else None for i, k in zip(ids, known, strict=True)], lengths, decode(data[at + 17 * docs : -4], n, table)


def frequencies(counts: DataFrame, vocabulary: int) -> tuple[Table, int]:
    """The table and number of all ids of the corpus, from the counts (ids) of its parts; what comes to the driver has a row for each id of the vocabulary at most."""

    def add(batches):
        sums = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for own in batch.column("ids").to_pylist():
                sums += np.frombuffer(own, "<i8")
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen], pa.int64())], ["id", "n"])

    rows = map_batches(counts.select("ids"), add, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(vocabulary, np.int64)
    for r in rows:
        sums[r.id] = r.n
    return Table.of(sums), int(sums.sum())


def write(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, path: str | None = None, width: str = "<u2", block_tokens: int = BLOCK_TOKENS, **columns: str) -> str:
    """Writes a file set and returns its folder (by default one in the shared folder).

    blocks: part, block, n_tokens, data, in ascending order of document ids by part and block.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    scratch = Scratch(spark)
    both = scratch.hold(tokenized(docs, tokenizer, end_id, width, counted=vocabulary, **columns))
    tokens = both.where(F.col("place") != COUNTS)
    table, total = frequencies(both.where(F.col("place") == COUNTS), vocabulary)
    spark.createDataFrame([(SCALE_BITS, bytearray(table.frequencies.astype("<u4").tobytes()))], "scale_bits int, frequencies binary").coalesce(1).write.parquet(f"{path}/table")
    # ranges of about PART_TOKENS, however many the session's shuffles have
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PART_TOKENS))
    dealt = tokens.select("doc_id", F.xxhash64("ids").alias("tie"), "ids").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "ids")

    def work(batches):
        part, block = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        total = 0

        def close():
            data = write_block(names, [len(x) for x in held], np.concatenate(held), table)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], ["part", "block", "n_tokens", "data"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                own = np.frombuffer(ids, width)
                if held and total + len(own) > block_tokens:
                    yield close()
                    block, names, held, total = block + 1, [], [], 0
                names.append(doc)
                held.append(own)
                total += len(own)
        if held:
            yield close()

    map_batches(dealt, work, "part bigint, block bigint, n_tokens bigint, data binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    scratch.clear()
    return path


def read_table(spark: SparkSession, path: str) -> Table:
    told = spark.read.parquet(f"{path}/table").first()
    if told.scale_bits != SCALE_BITS:
        raise ValueError("not a table of this format")
    return Table(np.frombuffer(told.frequencies, "<u4"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a file set: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    table, blocks = read_table(spark, path), spark.read.parquet(f"{path}/blocks")
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each task that wrote
    bases = sums.select("part", F.coalesce(F.sum("n").over(upto(F.lit(0), "part")), F.lit(0)).alias("part_base"))
    places = blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(upto("part", "block")), F.lit(0)).alias("inner"))
    begun = places.join(bases, "part").select("part", "block", (F.col("part_base") + F.col("inner")).alias("base"))
    placed = blocks.join(begun, ["part", "block"]).select("base", "data")

    def work(batches):
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("data").to_pylist(), strict=True):
                docs, lengths, ids = read_block(data, table)
                ends = np.cumsum(lengths)
                flat = ids.astype("<u4")
                for k in range(0, len(docs), 256):
                    some = slice(k, k + 256)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[some], pa.int64()),
                            pa.array(base + (ends - lengths)[some], pa.int64()),
                            pa.array(lengths[some], pa.int64()),
                            pa.array([flat[e - n : e].tobytes() for e, n in zip(ends[some], lengths[some], strict=True)], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return map_batches(placed, work, T._parse_datatype_string("doc_id bigint, start bigint, n_tokens bigint, ids binary"))
