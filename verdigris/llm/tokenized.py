"""A saved table of token ids, from which packing and the binary format start.

Each document becomes one row: part and place (where its task was and which row in it: together
they name the row, even where ids repeat), doc_id, source, n_tokens, local_start (tokens of the
same source before it in its part) and ids (two bytes each where the vocabulary allows, else four).
If counts are asked for, each part ends with a row at place COUNTS whose ids are how often it has each
id of the vocabulary (eight bytes each).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import map_batches, write_table
from verdigris.llm.tokens import encoder

COUNTS = -1
SCHEMA = "part bigint, place bigint, doc_id bigint, source string, n_tokens bigint, local_start bigint, ids binary"

_NAMES = ["part", "place", "doc_id", "source", "n_tokens", "local_start", "ids"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def width_of(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 65_536 else "<u4"


def tokenized(docs: DataFrame, path: str, end_id: int, width: str = "<u2", text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", counted: int = 0) -> tuple[str, DataFrame]:
    """Every text (null: empty) as ids with the end id behind; saved, so that nothing is encoded twice: where, and the table."""

    def work(batches):
        part, place, before, made = TaskContext.get().partitionId(), 0, defaultdict(int), encoder(path, width)
        end = np.array([end_id], width).tobytes()
        sums = np.zeros(counted, np.int64)
        for batch in batches:
            ids, counts, starts = [], [], []
            sources = batch.column("source").to_pylist()
            for own, source in zip(made.encode_all(batch.column("text").to_pylist()), sources, strict=True):
                own += end
                n = len(own) // len(end)
                ids.append(own)
                counts.append(n)
                starts.append(before[source])
                before[source] += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(ids), pa.int64()),
                    pa.array(range(place, place + len(ids)), pa.int64()),
                    batch.column("doc_id"),
                    batch.column("source"),
                    pa.array(counts, pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                _NAMES,
            )
            place += len(ids)
            if counted:
                sums += np.bincount(np.frombuffer(b"".join(ids), width), minlength=counted)
        if place and counted:
            last = ([part], [COUNTS], [None], [None], [0], [0], [sums.astype("<i8").tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(last, _TYPES, strict=True)], _NAMES)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    made = map_batches(narrow, work, SCHEMA)
    return (at := write_table(made, "tokens")), docs.sparkSession.read.schema(made.schema).parquet(at)
