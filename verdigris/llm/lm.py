"""Language-model scores: the marginal probability of a text over all its subword segmentations.

The pieces are those of an existing subword vocabulary. A text is lower-cased (A-Z), split on ASCII
white space and closed by an end token; a word with the space mark before it is generated piece by
piece, so its probability is the sum over all segmentations of the product of the pieces'
probabilities. Pieces never reach over a space mark, so the lattice of a text falls apart into
those of its words, whose log-space forward sums add up. A character without a piece of its own is
spelled in byte pieces.

The unigram scores of the pieces are fitted to the training texts by expectation maximisation:
forward-backward over every distinct training word, weighted by its count. Words are counted in a
shuffle that grows with the corpus; only sums by piece (a bounded vocabulary) come to the driver.

The words of texts that are not learned from are listed with them, so that each distinct word of the
corpus is scored once, whatever the number of workers and texts. Words with at least one in HEAVY of
all training tokens are HEAVY at most and sent to every worker with their counts and scores; those of
all others, none of which is frequent, are joined by word.

Defined results: a null or empty text is its end token alone; a word may have any length; repeated
rows are scored each; without training texts all counts are 0 and the pieces have equal scores; a
null flag of learning is no; columns other than the id, text and flag are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import map_batches, saved

#: Words that are sent to every worker at most (about 100 MB there).
HEAVY = 600_000
#: Rounds of expectation maximisation, and what a piece counts besides its expectation.
ROUNDS, PRIOR = 3, 0.01
#: Words of a worker's table that counts, before it is passed on.
COUNTED = 200_000
_MARK = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.uint64(64 - 20)


def words_of(text: str | None) -> list[bytes]:
    """Words, A-Z lowered: ``bytes`` methods know ASCII only."""
    return (text or "").encode("utf-8", "replace").lower().split()


def vocabulary_of(path: str) -> list[str]:
    """The ordinary and byte pieces of a sentencepiece file; a byte piece is named <0xNN>."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]


class Lattice:
    """Pieces and their natural log probabilities."""

    def __init__(self, pieces: list[str], logs: np.ndarray):
        self.pieces, self.logs = pieces, logs
        byte = {p: k for k, p in enumerate(pieces) if len(p) == 6 and p.startswith("<0x") and p.endswith(">")}
        self.bytes = [byte.get(f"<0x{b:02X}>") for b in range(256)]
        if None in self.bytes:
            raise ValueError("the vocabulary has no piece for every byte")
        taken = set(byte.values())
        self.number = {p: k for k, p in enumerate(pieces) if k not in taken}
        self.longest = max(map(len, self.number), default=1)
        starts = {p[:k]: -1 for p in self.number for k in range(1, len(p))} | self.number  # what begins a piece, -1 unless it is one
        keys = np.array([self._hash(p) for p in starts], np.uint64)
        order = np.argsort(keys)
        self._keys, self._ids = keys[order], np.array(list(starts.values()))[order]
        if (self._keys[1:] == self._keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        slots = (self._keys >> _SLOT).astype(np.int64)
        self._first = np.zeros(1 << (64 - int(_SLOT)), np.int32)
        self._first[slots[::-1]] = np.arange(len(slots) - 1, -1, -1)
        self._crowded = np.bincount(slots, minlength=len(self._first)) > 1

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes among the keys, and which are there: by a table of slots, by search where keys share one."""
        slots = (h >> _SLOT).astype(np.int64)
        at = self._first[slots]
        there = self._keys[at] == h
        rest = np.flatnonzero(self._crowded[slots] & ~there)
        if len(rest):
            at[rest] = np.minimum(np.searchsorted(self._keys, h[rest]), len(self._keys) - 1)
            there[rest] = self._keys[at[rest]] == h[rest]
        return at, there

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _spelled(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()]

    def _edges(self, chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(from, to, rows, their piece ids, log probabilities) for words of one length; id -1: spelled in bytes."""
        width = chars.shape[1]
        for i in range(width):
            rows, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
            for j in range(i + 1, min(width, i + self.longest) + 1):
                h = h * _P + chars[rows, j - 1] + np.uint64(1)
                at, begun = self._find(h)
                ids = np.where(begun, self._ids[at], -1)
                if j == i + 1 and (ids < 0).any():
                    odd = rows[ids < 0]
                    spelled = {c: self.logs[self._spelled(chr(c))].sum() for c in set(chars[odd, i].tolist())}
                    yield i, j, odd, np.full(len(odd), -1), np.array([spelled[c] for c in chars[odd, i].tolist()])
                whole = ids >= 0
                if whole.any():
                    yield i, j, rows[whole], ids[whole], self.logs[ids[whole]]
                rows, h = rows[begun], h[begun]
                if not len(rows):
                    break

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word over all its segmentations."""
        out = np.empty(len(words))
        for at, chars in _by_length(words):
            if chars is None:
                out[at] = self._long(_MARK + words[at].decode())
                continue
            alpha = np.full((chars.shape[1] + 1, len(chars)), -np.inf)
            alpha[0] = 0
            for i, j, rows, _, logs in self._edges(chars):
                alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + logs)
            out[at] = alpha[-1]
        return out

    def _long(self, word: str) -> float:
        alpha = [0.0] + [-math.inf] * len(word)
        for j in range(1, len(word) + 1):
            terms = [alpha[i] + self.logs[k] for i in range(max(0, j - self.longest), j) if (k := self.number.get(word[i:j])) is not None]
            if word[j - 1] not in self.number:
                terms.append(alpha[j - 1] + self.logs[self._spelled(word[j - 1])].sum())
            top = max(terms)
            alpha[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        return alpha[-1]

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, each taken as often as it counts."""
        out = np.zeros(len(self.pieces))
        for at, chars in _by_length(words, split_long=True):
            width, rows = chars.shape[1], len(chars)
            edges = list(self._edges(chars))
            alpha, beta = np.full((width + 1, rows), -np.inf), np.full((width + 1, rows), -np.inf)
            alpha[0] = beta[-1] = 0
            for i, j, at_rows, _, logs in edges:
                alpha[j, at_rows] = np.logaddexp(alpha[j, at_rows], alpha[i, at_rows] + logs)
            for i, j, at_rows, _, logs in reversed(edges):
                beta[i, at_rows] = np.logaddexp(beta[i, at_rows], beta[j, at_rows] + logs)
            weight = counts[at]
            for i, j, at_rows, ids, logs in edges:
                use = np.exp(alpha[i, at_rows] + logs + beta[j, at_rows] - alpha[-1, at_rows]) * weight[at_rows]
                if ids[0] >= 0:
                    out += np.bincount(ids, use, len(out))
                else:
                    for c, u in zip(chars[at_rows, i].tolist(), use.tolist(), strict=True):
                        np.add.at(out, self._spelled(chr(c)), u)
        return out


def _by_length(words: list[bytes], most: int = 64, rows: int = 4096, split_long: bool = False):
    """Words of one length as arrays of code points, the space mark first. Longer words come alone with None, or as what they are if split_long."""
    groups: dict[int, list[tuple[int, str]]] = {}
    for k, word in enumerate(words):
        said = _MARK + word.decode()
        if len(said) > most and not split_long:
            yield k, None
        else:
            groups.setdefault(len(said), []).append((k, said))
    for length, members in groups.items():
        for some in (members[k : k + rows] for k in range(0, len(members), rows)):
            yield np.array([k for k, _ in some]), np.frombuffer("".join(s for _, s in some).encode("utf-32-le"), "<u4").reshape(-1, length).astype(np.uint64)


@dataclass
class Model:
    pieces: list[str]
    logs: np.ndarray
    log_end: float

    @cached_property
    def lattice(self) -> Lattice:
        return Lattice(self.pieces, self.logs)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lattice"}

    def score(self, text: str | None) -> float:
        """log10 of the text's marginal probability."""
        return float((self.lattice.marginals(words_of(text)).sum() + self.log_end) / math.log(10))


def count_words(docs: DataFrame, train: Column | None = None, text_col: str = "text") -> DataFrame:
    """Saved counts by word: w binary, c bigint, 0 for words that only texts outside of train have."""

    def count(batches):
        seen, others = Counter(), set()

        def out():
            others.difference_update(seen)
            return pa.RecordBatch.from_arrays([pa.array([*seen, *others], pa.binary()), pa.array([*seen.values(), *[0] * len(others)], pa.int64())], ["w", "n"])

        for batch in batches:
            for text, learn in zip(batch.column("text").to_pylist(), batch.column("learn").to_pylist(), strict=True):
                (seen if learn else others).update(words_of(text))
            if len(seen) + len(others) > COUNTED:
                yield out()
                seen.clear()
                others.clear()
        if seen or others:
            yield out()

    narrow = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(train if train is not None else F.lit(True), F.lit(False)).alias("learn"))
    return saved(map_batches(narrow, count, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("c")), "words")


def _word_batches(counts: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` over words, which are short: larger batches than texts have."""
    spark = counts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    return counts.mapInArrow(work, schema)


def _scored(counts: DataFrame, model: Model) -> DataFrame:
    """Saved: w, c, and the natural log probability p of each word."""
    sent = counts.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        lattice = sent.value.lattice
        for batch in batches:
            yield batch.append_column("p", pa.array(lattice.marginals(batch.column("w").to_pylist())))

    try:
        return saved(_word_batches(counts.select("w", "c"), work, "w binary, c bigint, p double"), "word-scores")
    finally:
        counts.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def fit(counts: DataFrame, n_docs: int, pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Scores of the pieces by expectation maximisation over all counted words."""
    counts = counts.where("c > 0")
    sc = counts.sparkSession.sparkContext
    logs = np.full(len(pieces), -math.log(len(pieces)))
    end = -math.log(len(pieces))
    for _ in range(rounds):
        sent = sc.broadcast((pieces, logs))

        def expect(batches, sent=sent):
            lattice, sums = Lattice(*sent.value), np.zeros(len(sent.value[0]))
            for batch in batches:
                sums += lattice.expected(batch.column("w").to_pylist(), batch.column("c").to_numpy().astype(np.float64))
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used])], ["piece", "n"])

        try:
            rows = _word_batches(counts, expect, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        finally:
            counts.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        use = np.full(len(pieces), PRIOR)
        for r in rows:
            use[r.piece] += r.n
        total = use.sum() + max(n_docs, PRIOR)
        logs, end = np.log(use / total), math.log(max(n_docs, PRIOR) / total)
    return Model(pieces, logs, end)


def score(docs: DataFrame, train: Column, vocabulary: str, text_col: str = "text", id_col: str = "doc_id", heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score. train: which documents are learned from."""
    sc = docs.sparkSession.sparkContext
    counts = count_words(docs, train, text_col)
    n_docs = docs.where(train).count()
    sums = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    tokens, distinct = (sums[0] or 0) + n_docs, sums[1] + (n_docs > 0)
    model = fit(counts, n_docs, vocabulary_of(vocabulary))
    words = _scored(counts, model)
    is_heavy = F.col("c") * heavy >= max(tokens, 1)
    listed = words.where(is_heavy).toPandas()  # ``heavy`` rows at most
    sent = sc.broadcast((b" ".join(map(bytes, listed.w)), listed.c.to_numpy(np.int64), listed.p.to_numpy(np.float64)))
    whole, end_log = math.log10(tokens + distinct + 1), model.log_end
    end_base = math.log10(n_docs + 1) - whole

    def work(batches):
        names, c, logs = sent.value
        number = {w: k for k, w in enumerate(names.split())}
        base = np.log10(c + 1.0) - whole
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, lengths, known, bases, scores = [], [], [], [], []
            tail_row, tail_word, tail_n = [], [], []
            for text in batch.column("text").to_pylist():
                own = words_of(text)
                at = np.fromiter(map(number.get, own, repeat(-1)), np.int64, len(own))
                tail = Counter([own[k] for k in np.flatnonzero(at < 0).tolist()])
                at = at[at >= 0]
                row = (part << 33) + place + len(ids)
                ids.append(row)
                lengths.append(len(own) + 1)
                known.append(len(at) + (n_docs > 0))
                bases.append(float(base[at].sum()) + end_base)
                scores.append(float(logs[at].sum()) + end_log)
                tail_row += [row] * len(tail)
                tail_word += tail
                tail_n += tail.values()
            place += len(ids)
            n, m = len(ids), len(tail_row)
            columns = [
                pa.array(ids + tail_row, pa.int64()),
                pa.concat_arrays([batch.column("doc_id"), pa.nulls(m, pa.int64())]),
                pa.array(lengths + [None] * m, pa.int64()),
                pa.array(known + [None] * m, pa.int64()),
                pa.array(bases + [None] * m, pa.float64()),
                pa.array(scores + [None] * m, pa.float64()),
                pa.array([None] * n + tail_word, pa.binary()),
                pa.array([None] * n + tail_n, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "known", "base", "score", "w", "n"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = saved(map_batches(narrow, work, "row bigint, doc_id bigint, n_tokens bigint, known bigint, base double, score double, w binary, n bigint"), "scores")
    rare = both.where("w is not null").select("row", "w", "n").join(words.where(~is_heavy), "w")
    more = [F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * (F.log10(F.col("c") + 1.0) - F.lit(whole))).alias("rest"), F.sum(F.col("n") * F.col("p")).alias("said")]
    told = both.where("w is null").select("row", "doc_id", "n_tokens", "known", "base", "score").join(rare.groupBy("row").agg(*more), "row", "left")
    return told.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        ((F.col("score") + F.coalesce("said", F.lit(0.0))) / math.log(10)).alias("score"),
    )
