import os
import struct
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdigris.llm import rans

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(0, 5))
def test_round_trip_and_independent_segments(ids, hot):
    ids = np.array(ids * (1 + hot), np.uint16)
    table = rans.Table.of(np.bincount(ids, minlength=301))
    data = rans.encode(ids, table)
    assert rans.decode(data, len(ids), table).tolist() == ids.tolist()
    lanes, count = struct.unpack_from("<II", data, 0)
    for k in reversed(range(count)):
        at = k * rans.STEPS * lanes
        assert rans.decode_segment(data, len(ids), table, k).tolist() == ids[at : at + rans.STEPS * lanes].tolist()


def test_many_segments_near_the_entropy():
    rng = np.random.default_rng(3)
    p = 1 / np.arange(1, 50_001)
    ids = rng.choice(50_000, 1_500_000, p=p / p.sum()).astype(np.uint16)
    counts = np.bincount(ids, minlength=50_257)
    table = rans.Table.of(counts)
    data = rans.encode(ids, table)
    assert (rans.decode(data, len(ids), table) == ids).all()
    q = counts[counts > 0] / len(ids)
    assert len(data) * 8 < len(ids) * -(q * np.log2(q)).sum() * 1.06


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint16) % 97
    table = rans.Table.of(np.bincount(ids))
    block = rans.write_block([None, 7], [2000, 3000], ids, table)
    docs, lengths, got = rans.read_block(block, table)
    assert docs == [None, 7] and lengths.tolist() == [2000, 3000] and got.tolist() == ids.tolist()
    for at in (5, len(block) // 2, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            rans.read_block(bytes(broken), table)


def test_files_against_the_library(spark):
    rows = [(k * 7 % 101, f"s{k % 3}", f"Token {k}, of a text.\n" * (k % 23)) for k in range(101)]
    rows += [(None, None, None), (5, "x", ""), (5, "x", "twice"), (5, "x", "twice"), (-3, None, "before all")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(4)
    docs = docs.withColumn("part", F.lit("clash")).withColumn("n_tokens", F.lit(None))
    path = rans.write(docs, BYTES, end_id=0, vocabulary=50_257, block_tokens=700)
    assert spark.read.parquet(f"{path}/blocks").count() > 4
    library, at = Tokenizer.from_file(BYTES), 0
    got = sorted(rans.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    texts = {}
    for doc, _, text in rows:
        texts.setdefault(doc, []).append(np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
        texts[r.doc_id].remove(bytes(r.ids))
    assert not any(texts.values())


READER = """
import sys, zlib
import pyarrow.parquet as pq
from verdigris.llm import rans
table = rans.Table(rans.np.frombuffer(pq.read_table(sys.argv[1] + "/table").column("frequencies")[0].as_py(), "<u4"))
for block in pq.read_table(sys.argv[1] + "/blocks").to_pylist():
    docs, lengths, ids = rans.read_block(block["data"], table)
    print(block["part"], block["block"], len(docs), len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
"""


def test_another_process_reads_the_files_with_nothing_but_their_path(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(330_000))  # more tokens than a block has
    docs = spark.createDataFrame([(1, "a", "first text"), (2, "a", long), (3, None, None)], "doc_id bigint, source string, text string").coalesce(1)
    path = rans.write(docs, BYTES, end_id=0, vocabulary=50_257, path=f"{tmp_path}/files")
    told = subprocess.run([sys.executable, "-c", READER, path], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split()
    ids = [np.array(Tokenizer.from_file(BYTES).encode(x, add_special_tokens=False).ids + [0], "<u4") for x in ("first text", long, "")]
    parts = [ids[0], ids[1], ids[2]] if len(told) == 15 else [np.concatenate(ids)]
    assert sorted(told[4::5]) == sorted(str(zlib.crc32(x.tobytes())) for x in parts)
    assert sum(map(int, told[3::5])) == sum(map(len, ids)) > rans.BLOCK_TOKENS


def test_no_documents(spark):
    path = rans.write(spark.createDataFrame([], "doc_id bigint, source string, text string"), BYTES, 0, 50_257)
    assert rans.read(spark, path).count() == 0
    assert zlib.crc32(b"") == 0
