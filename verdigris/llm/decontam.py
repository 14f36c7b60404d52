"""Benchmark decontamination: Aho-Corasick over word windows of the benchmark items.

Items are normalised (A-Z lowered, words are runs of ASCII letters, digits and non-ASCII
characters) and cut into windows of ten consecutive words; an item with fewer is one window. All
windows go into one automaton over word numbers, through which each text passes once. Hits are
word ranges, mapped back to code point offsets of the original text.

The automaton is sent to the executors as words. Items are cut into pieces of PIECE_WORDS words that
overlap by a window less one, so each window is in one piece, and the driver and workers hold
BLOCK_WORDS words of pieces at a time. One block, and so one automaton and one scan, is the rule; a
larger benchmark passes over all documents a block after another, each read and let go in its turn.

Defined results: a null or empty text has no words and no hits; items without words match nothing;
repeated item ids count once; repeated documents are scanned each; with no items, nothing is hit;
further columns of the documents stay as they are, but for those with the name of a result, which
``scan`` replaces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import kept_rows, map_batches, saved, without

WINDOW = 10
#: A worker takes about 500 bytes for a word of its automaton.
PIECE_WORDS, BLOCK_WORDS = 1000, 400_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if words:
        yield from (tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


class Scanner:
    """The automaton of (item id, text). Pieces of an item that is not short are windows and more."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        import ahocorasick

        found: dict[tuple[int, ...], set[str]] = {}
        self.numbers: dict[bytes, int] = {}
        for item, text in items:
            for window in windows_of(words_of(text), width):
                key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window)
                found.setdefault(key, set()).add(item)
        self.machine = None
        if found:
            self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, ids in found.items():
                self.machine.add_word(key, (len(key), tuple(sorted(ids))))
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges inside occurrences of windows, merged and in order, and the items."""
        if self.machine is None or not words:
            return [], set()
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, (length, ids) in self.machine.iter(tuple(map(self.numbers.get, words, repeat(0)))):
            ranges.append((end + 1 - length, end + 1))
            items.update(ids)
        return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def offsets_of(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point ranges of the original text for word ranges."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def _pieces(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, words, n): the items' words in pieces; windows of an item are those of its pieces."""

    def work(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for k in range(0, max(1, len(words) - width + 1) if words else 0, PIECE_WORDS):
                    piece = words[k : k + PIECE_WORDS + width - 1]
                    out.append((item, b" ".join(piece).decode("utf-8", "replace"), len(piece)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["id", "words", "n"])

    clean = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(clean, work, "id string, words string, n bigint").distinct()


def _blocks(items: DataFrame, id_col: str, text_col: str, width: int, most: int) -> tuple[int, Callable[[int], list[tuple[str, str]]]]:
    """How many blocks of at most about ``most`` words the items make, and what reads one."""
    pieces = saved(_pieces(items, id_col, text_col, width), "decontam-items")
    n = -(-(pieces.agg(F.sum("n")).first()[0] or 1) // most)
    dealt = pieces.withColumn("b", F.pmod(F.xxhash64("id", "words"), F.lit(n)))
    return n, lambda k: [(r.id, r.words) for r in dealt.where(F.col("b") == k).select("id", "words").collect()]


def scan(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", text_col: str = "text", width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with n_words, n_hit, hit_items (sorted ids), hit_spans (code points) and contaminated."""
    docs = without(docs, "n_words", "n_hit", "hit_items", "hit_spans", "contaminated", "_items", "_ranges")
    n, block = _blocks(items, item_id, item_text, width, block_words)
    sc = docs.sparkSession.sparkContext
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("n_words bigint, n_hit bigint, hit_items array<string>, hit_spans array<bigint>, contaminated boolean").fields])
    if n == 1:
        return map_batches(docs, _single(sc.broadcast(block(0)), width, text_col), schema)
    base = docs.select("*", F.lit(None).cast("array<string>").alias("_items"), F.lit(None).cast("array<bigint>").alias("_ranges"))
    for k in range(n):
        sent = sc.broadcast(block(k))
        base = saved(map_batches(base, _pass(sent, width, text_col), base.schema), "decontam")
        sent.destroy()
    return map_batches(base, _finish(text_col), schema)


def _append(batch: pa.RecordBatch, n_docs_columns: int, texts: list[str], n_words: list[int], ranges: list[list[tuple[int, int]]], items: list[list[str]]) -> pa.RecordBatch:
    more = {
        "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array([sum(b - a for a, b in r) for r in ranges], pa.int64()),
        "hit_items": pa.array(items, pa.list_(pa.string())),
        "hit_spans": pa.array([[x for s in offsets_of(t, r) for x in s] for t, r in zip(texts, ranges, strict=True)], pa.list_(pa.int64())),
        "contaminated": pa.array([bool(r) for r in ranges], pa.bool_()),
    }
    names = batch.schema.names[:n_docs_columns]
    return pa.RecordBatch.from_arrays([*batch.columns[:n_docs_columns], *more.values()], [*names, *more])


def _single(sent, width, text_col):
    def work(batches):
        scanner = Scanner(sent.value, width)
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            n_words, ranges, items = [], [], []
            for text in texts:
                words = words_of(text)
                r, found = scanner.scan(words)
                n_words.append(len(words))
                ranges.append(r)
                items.append(sorted(found))
            yield _append(batch, batch.num_columns, texts, n_words, ranges, items)

    return work


def _pass(sent, width, text_col):
    def work(batches):
        scanner = Scanner(sent.value, width)
        for batch in batches:
            ranges, items = [], []
            for text, old_items, old in zip(batch.column(text_col).to_pylist(), batch.column("_items").to_pylist(), batch.column("_ranges").to_pylist(), strict=True):
                r, found = scanner.scan(words_of(text))
                r += list(zip((old or [])[::2], (old or [])[1::2], strict=True))
                ranges.append([x for s in merged(r) for x in s])
                items.append(sorted(found | set(old_items or [])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(items, pa.list_(pa.string())), pa.array(ranges, pa.list_(pa.int64()))], batch.schema.names)

    return work


def _finish(text_col):
    def work(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            ranges = [list(zip(r[::2], r[1::2], strict=True)) for r in batch.column("_ranges").to_pylist()]
            yield _append(batch, batch.num_columns - 2, texts, [len(words_of(t)) for t in texts], ranges, batch.column("_items").to_pylist())

    return work


def items_digest(items: list[str] | None) -> str:
    return hashlib.sha256(",".join(sorted(items or [])).encode()).hexdigest()


def clean(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", text_col: str = "text", width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    n, block = _blocks(items, item_id, item_text, width, block_words)
    for k in range(n):
        sent = docs.sparkSession.sparkContext.broadcast(block(k))

        def keep(sent=sent):
            scanner = Scanner(sent.value, width)
            return lambda text: not scanner.scan(words_of(text))[0]

        docs = kept_rows(docs, keep, text_col)
        if n > 1:
            docs = saved(docs, "decontam")
            sent.destroy()
    return docs
