"""Near duplicates by a chosen-path set similarity join.

A document's set holds its distinct shingles of five words (A-Z lowered, split on ASCII white space),
as 64-bit hashes. Documents with equal sets are one class; the join runs over classes:

* every class has SIGNATURE minwise tokens. A tree's node picks one of them or two (one over the
  threshold on average), and a class goes on to the child that its token names, so similar classes
  stay together more often than not while others part. TREES independent trees give the recall:
  a pair at the threshold stays together in a tree with probability 0.81, 0.69, 0.60 ... at depths
  1, 2, 3 ..., so all ten trees miss it with probability 6e-8, 8e-6, 1e-4 ...;
* a node of at most LEAF classes is compared exhaustively. A larger one branches, unless it has kept
  most of its parent: then its classes are alike and no branching would part them. Such a dense
  node is compared in chunks, each together with the node's most central classes; classes that stay
  apart from the node's largest component are then compared with all its chunks;
* comparing has two steps. Sketches (the least token of each of BINS ranges of hashes) tell which
  classes of a node have a partner that may be similar (all but one in 400,000 that are) and is not
  known to be in the same component. Only these bring their full sets into the node's task, which
  counts intersections exactly and returns a spanning forest of the links, never the pairs.

The first tree is compared first; what it links is one component from then on, and what it has told
apart is not compared again, so the other trees have little left to do.

A link can be missed only by all trees at once or by the sketches, with the probabilities above;
README.md has the recall measured on large groups. No link is made without an exact count.

Components grow by minimum labels with pointer jumping. No step holds a group whole: nodes are
counted before they are gathered, chunks are bounded in classes and tasks in tokens (of a pair of
blocks, TASK_TOKENS, or of two texts that are longer), and everything else is a shuffle. Tables in
between are deleted as soon as the last reader has ended.

Defined results: a text without words, or null, has the empty set and is linked with nothing; with
fewer than five words the whole sequence is the one shingle; repeated rows are copies; a component
is named by its smallest document id (null only if it has no other); an empty table gives an empty
result; very long texts are read whole; further columns are ignored, and pass through
``deduplicated``.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import Scratch, map_batches, rows_of, saved

WORDS, SIGNATURE, TREES = 5, 64, 10
LEAF, CHUNK, CENTRAL = 4000, 2000, 200
#: Trees are at most this deep; a node this deep counts as dense, as does one that keeps so many hundredths of its parent.
DEPTH, KEPT = 8, 90
#: Bins of the sketch by which pairs are chosen for confirmation, and those that are looked at first.
BINS, FIRST = 256, 64
#: Bits that name the documents whose sets are made anew: SLOT_BITS for each, in 2 ** SLOTS_LEAST to 2 ** SLOTS_MOST (32 MB).
#: Beyond, other documents' sets are shuffled, too, and the join leaves them out.
SLOT_BITS, SLOTS_LEAST, SLOTS_MOST = 64, 22, 28
#: Tokens in half a task that counts intersections; tokens gathered at once there.
TASK_TOKENS, GATHERED = 1 << 22, 1 << 21
#: Sets of the first tree that a class remembers having been compared in, and names of sets that a task remembers having passed on.
SEEN, PASSED = 8, 100_000
#: Rows (of at most 130 bytes) of a side that is broadcast after it has been counted; a larger one is shuffled.
BROADCAST_ROWS = 1 << 18
REMEMBERED = 300_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_A = np.random.default_rng(20_240).integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _Q
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of a text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * _P + w[k : len(w) - width + 1 + k]
    return np.unique(_mix(h))


def signature(tokens: np.ndarray) -> np.ndarray:
    """Minwise tokens: the least of each of SIGNATURE hashes."""
    out = np.full(SIGNATURE, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(tokens), 2048):
        out = np.minimum(out, ((tokens[k : k + 2048, None] * _A) >> np.uint64(32)).min(0))
    return out.astype("<u4")


def sketch(tokens: np.ndarray) -> np.ndarray:
    """For each range of hashes a byte of the least token in it, 0 where there is none."""
    out = np.zeros(BINS, np.uint8)
    bins = (tokens >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]]) if len(bins) else bins
    out[bins[first]] = tokens[first] % np.uint64(255) + np.uint64(1)
    return out


def likely(one: np.ndarray, n: int, others: np.ndarray, ns: np.ndarray) -> np.ndarray:
    """Which sketches may belong to a similarity of 0.75 to one's: within 4.6 deviations, for a sample without replacement of the union.

    Most pairs are ruled out by their FIRST bins, at 5.5 deviations.
    """
    some = np.flatnonzero(4 * np.minimum(n, ns) >= 3 * np.maximum(n, ns))
    first = others[some, :FIRST]
    equal, union = ((first == one[:FIRST]) & (first != 0)).sum(1), np.count_nonzero(first | one[:FIRST], axis=1)
    some = some[equal >= (0.74 - 5.5 * np.sqrt(0.1875 / np.maximum(union, 1))) * union]
    rest, ns = others[some], ns[some]
    equal, union = ((rest == one) & (rest != 0)).sum(1), np.count_nonzero(rest | one, axis=1)
    whole = np.maximum((n + ns) / 1.75, union)
    room = 4.6 * np.sqrt(0.1875 / union * np.maximum(1 - union / whole, 0.02))
    return some[equal / union >= 0.75 - room - 0.005]


def _features(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """row, doc_id, text_hash, n, fp (what names the set), sig and sketch."""

    def work(batches):
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            n, names, sigs, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text)
                n.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(signature(s).tobytes())
                sketches.append(sketch(s).tobytes())
            rows = pa.array(range((part << 33) + place, (part << 33) + place + len(n)), pa.int64())
            place += len(n)
            columns = [rows, batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "text_hash", "n", "fp", "sig", "sketch"])

    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return map_batches(narrow, work, "row bigint, doc_id bigint, text_hash bigint, n bigint, fp binary, sig binary, sketch binary")


def children(nodes: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for rows of nodes and signatures: each node picks one or two minwise tokens."""
    rows, out = [], []
    first = (_mix(nodes + _P) % np.uint64(SIGNATURE)).astype(np.int64)
    second = (first + 1 + (_mix(nodes + _Q) % np.uint64(SIGNATURE - 1)).astype(np.int64)) % SIGNATURE
    for at, which in ((first, np.arange(len(nodes))), (second, np.flatnonzero(_mix(nodes ^ _P) % np.uint64(3) == 0))):
        rows.append(which)
        token = sigs[which, at[which]].astype(np.uint64)
        out.append(_mix(_mix(nodes[which] * _P + at[which].astype(np.uint64)) + token * _Q))
    return np.concatenate(rows), np.concatenate(out)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SIGNATURE)


def _planted(classes: DataFrame) -> DataFrame:
    """The first level of every tree. Trees pick different tokens here."""

    def work(batches):
        for batch in batches:
            sigs, cids = _matrix(batch.column("sig")), batch.column("cid").to_numpy()
            for tree in range(TREES):
                for k in range(2 if tree % 3 == 0 else 1):
                    at = (2 * tree + k) % SIGNATURE
                    node = _mix(_mix(np.uint64([tree]) * _P + np.uint64(at)) + sigs[:, at].astype(np.uint64) * _Q)
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(cids), pa.nulls(len(cids), pa.int64()), pa.array([tree == 0] * len(cids))], ["node", "cid", "parent", "first"])

    return map_batches(classes.select("cid", "sig"), work, "node bigint, cid bigint, parent bigint, first boolean")


def _branched(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The next level under rows (node, cid, size, first)."""

    def work(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy().view(np.uint64)
            which, child = children(nodes, _matrix(batch.column("sig")))
            at = pa.array(which)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(batch.column(c).take(at) for c in ("cid", "size", "first"))], ["node", "cid", "parent", "first"])

    return map_batches(rows.join(classes.select("cid", "sig"), "cid").select("node", "cid", "size", "first", "sig"), work, "node bigint, cid bigint, parent bigint, first boolean")


def _small(df: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _grown(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Saved small nodes (members: sorted array, first: whether of the first tree), and rows (node, cid, size, first) of dense nodes."""
    level, small, dense = scratch.saved(_planted(classes), "neardup-level"), None, []
    for depth in range(1, DEPTH + 1):
        sizes = scratch.saved(level.groupBy("node").agg(F.count("*").alias("size"), F.max("parent").alias("parent")).where("size > 1"), "neardup-sizes")
        rows = scratch.saved(level.drop("parent").join(_small(sizes), "node"), "neardup-rows")
        scratch.drop(level, sizes)
        leaves = rows.where(F.col("size") <= LEAF).groupBy("node", "first").agg(F.array_sort(F.collect_list("cid")).alias("members")).groupBy("members").agg(F.max("first").alias("first"))
        leaves = scratch.saved(leaves, "neardup-leaves")
        small = leaves if small is None else small.unionByName(leaves)
        large = rows.where(F.col("size") > LEAF)
        if not large.take(1):
            break
        kept = F.coalesce(F.col("size") * 100 >= F.col("parent") * KEPT, F.lit(False)) | F.lit(depth == DEPTH)
        dense.append(scratch.saved(large.where(kept).drop("parent"), "neardup-dense"))
        level = scratch.saved(_branched(large.where(~kept), classes), "neardup-level")
        scratch.drop(rows)
    out = dense[0] if dense else None
    for rows in dense[1:]:
        out = out.unionByName(rows)
    return small, out if out is not None and out.take(1) else None


def _chunks(rows: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Saved rows of dense nodes: node, cid, chunk, chunks, central, first."""
    tokens = [F.conv(F.hex(F.substring("sig", 4 * k + 1, 4)), 16, 10).cast("long") for k in range(0, SIGNATURE, 4)]
    rows = rows.join(classes.select("cid", F.array(*tokens).alias("tokens")), "cid")
    common = rows.groupBy("node").agg(F.array(*[F.mode(F.col("tokens")[k]) for k in range(len(tokens))]).alias("common"))
    agree = F.aggregate(F.zip_with("tokens", "common", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
    rows = rows.join(common, "node").select("node", "cid", "first", F.ceil(F.col("size") / CHUNK).cast("long").alias("chunks"), agree.alias("agree"))
    rows = scratch.saved(rows.withColumn("chunk", F.pmod(F.xxhash64("cid", "node"), F.col("chunks"))), "neardup-dense")
    nearest = Window.partitionBy("node").orderBy(F.desc("agree"), "cid")
    central = rows.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= CENTRAL)
    return scratch.saved(
        rows.select("node", "cid", "first", "chunk", "chunks", F.lit(False).alias("central")).unionByName(central.select("node", "cid", "first", F.lit(-1).cast("long").alias("chunk"), "chunks", F.lit(True).alias("central"))), "neardup-chunks"
    )


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("cid"))
    return rows.join(_small(labels.withColumnRenamed("v", "cid")), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _seen_matrix(seen: list[list[int] | None]) -> np.ndarray:
    out = np.zeros((len(seen), SEEN), np.int64)
    for k, keys in enumerate(seen):
        if keys:
            out[k, : len(keys)] = keys
    return out


def _apart(k: int, label: np.ndarray, seen: np.ndarray | None) -> np.ndarray:
    """Later members of other components than member k's that no earlier set has held together with it."""
    out = np.flatnonzero(label[k + 1 :] != label[k]) + k + 1
    if seen is not None and len(out):
        own = seen[k][seen[k] != 0]
        if len(own):
            out = out[~np.isin(seen[out], own).any(1)]
    return out


def _hard(sets: DataFrame, sketches: DataFrame, labels: DataFrame | None, seen: DataFrame | None) -> DataFrame:
    """Rows (key, cid, label, seen) of sets (key, cid): the classes with a partner in their set that may be similar and is not known to be linked."""
    rows = sets
    if labels is not None:
        rows = _labelled(rows, labels)
        rows = rows.join(rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key"), "key", "left_semi")
    else:
        rows = _labelled(rows, None)
    rows = rows.join(_small(seen), "cid", "left") if seen is not None else rows.withColumn("seen", F.lit(None).cast("array<bigint>"))
    rows = rows.join(sketches, "cid")

    def work(batches):
        for key, group in groupby(rows_of(batches, "key", "cid", "n", "sketch", "label", "seen"), key=lambda r: r[0]):
            members = list({r[1]: r for r in group}.values())
            if len(members) < 2:
                continue
            n, label = (np.array([m[k] for m in members], np.int64) for k in (2, 4))
            sketched = np.frombuffer(b"".join(m[3] for m in members), np.uint8).reshape(-1, BINS)
            met = _seen_matrix([m[5] for m in members]) if any(m[5] for m in members) else None
            hard = np.zeros(len(members), bool)
            for k in range(len(members) - 1):
                others = _apart(k, label, met)
                good = others[likely(sketched[k], n[k], sketched[others], n[others])]
                if len(good):
                    hard[k] = hard[good] = True
            chosen = np.flatnonzero(hard)
            if not len(chosen):
                continue
            for name, some in _blocked(key, chosen, n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some), pa.int64()), pa.array([members[k][1] for k in some], pa.int64()), pa.array(label[some]), pa.array([members[k][5] for k in some], pa.list_(pa.int64()))], ["key", "cid", "label", "seen"]
                )

    # each set lies in one task: the exchange by key is the last step before
    dealt = rows.select("key", "cid", "n", "sketch", "label", "seen").repartition("key").sortWithinPartitions("key", "cid")
    return map_batches(dealt, work, "key bigint, cid bigint, label bigint, seen array<bigint>")


def _blocked(key: int, chosen: np.ndarray, n: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The chosen members under their set's key; where they have many tokens, every two blocks of them under a key of their own."""
    block = (np.cumsum(n[chosen]) - 1) // TASK_TOKENS
    names = np.unique(block)
    if len(names) < 3:
        return [(key, chosen)]
    made = lambda a, b: int(_mix(np.uint64([key & 0xFFFFFFFFFFFFFFFF]) * _P + np.uint64([a]) * _Q + np.uint64([b])).view(np.int64)[0])
    return [(made(a, b), chosen[(block == a) | (block == b)]) for i, a in enumerate(names.tolist()) for b in names[i + 1 :].tolist()]


def forest(sets: list[np.ndarray], label: np.ndarray, seen: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (j, k) between sets of different labels, counted exactly: a spanning forest of what is linked."""
    size = np.array([len(s) for s in sets], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(sets)
    names, flat = np.unique(flat, return_inverse=True)
    flag = np.zeros(len(names), bool)
    sketched = np.array([sketch(s) for s in sets])
    label, out = label.copy(), []
    for k in range(len(sets) - 1):
        others = _apart(k, label, seen)
        if not len(others):
            continue
        others = others[likely(sketched[k], size[k], sketched[others], size[others])]
        flag[flat[at[k] : at[k + 1]]] = True
        while len(others):
            some = others[: max(1, np.searchsorted(np.cumsum(size[others]), GATHERED))]
            others = others[len(some) :]
            common = np.add.reduceat(flag[np.concatenate([flat[at[j] : at[j + 1]] for j in some])].astype(np.int64), np.concatenate([[0], np.cumsum(size[some])[:-1]]))
            for j in some[100 * common >= 75 * (size[k] + size[some] - common)].tolist():
                if label[j] != label[k]:
                    out.append((k, j))
                    label[label == label[j]] = label[k]
        flag[flat[at[k] : at[k + 1]]] = False
    return out


def _full_sets(hard: DataFrame, docs: DataFrame, classes: DataFrame, text_col: str, id_col: str, scratch: Scratch) -> DataFrame:
    """Hard rows with their full sets (tokens), made anew from whole texts. A row may come twice."""
    named = scratch.saved(classes.select("cid", "fp", "low").join(_small(hard), "cid"), "neardup-named")
    # a bitmap of the ids' hashes leaves most other texts out, so that none is shuffled; which set is wanted, the join says
    bits = min(max((named.count() * SLOT_BITS).bit_length(), SLOTS_LEAST), SLOTS_MOST)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = named.select(slot("low").alias("s")).groupBy(F.shiftright("s", 12).alias("page")).agg(F.collect_set((F.col("s") % 4096).cast("int")).alias("on"))

    def page(batches):  # 512 bytes for each, so that the driver gets the bitmap and no rows of its bits
        for batch in batches:
            packed = []
            for on in batch.column("on").to_pylist():
                flags = np.zeros(4096, np.uint8)
                flags[on] = 1
                packed.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(packed, pa.binary())], ["page", "bits"])

    wanted = bytearray(1 << bits >> 3)
    for r in map_batches(words, page, "page bigint, bits binary").collect():  # 32 MB at most
        wanted[r.page * 512 : r.page * 512 + 512] = r.bits
    sent = docs.sparkSession.sparkContext.broadcast(bytes(wanted))
    texts = docs.select(slot(F.col(id_col).cast("long")).alias("slot"), F.col(text_col).cast("string").alias("text"))

    def work(batches):
        wanted, passed = np.frombuffer(sent.value, np.uint8), set()
        for batch in batches:
            at = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((wanted[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            sets = {}
            for text in batch.column("text").to_pylist():
                tokens = shingles(text).tobytes()
                sets[hashlib.blake2b(tokens, digest_size=16).digest()] = tokens
            new = [name for name in sets if name not in passed]
            if len(passed) < PASSED:
                passed.update(new)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array([sets[name] for name in new], pa.binary())], ["fp", "tokens"])

    return map_batches(texts, work, "fp binary, tokens binary").join(_small(named), "fp").select("key", "cid", "tokens", "label", "seen")


def _linked(full: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of each set of hard rows with their tokens."""

    def work(batches):
        for _, group in groupby(rows_of(batches, "key", "cid", "tokens", "label", "seen"), key=lambda r: r[0]):
            members = list({r[1]: r for r in group}.values())
            met = _seen_matrix([m[4] for m in members]) if any(m[4] for m in members) else None
            links = forest([np.frombuffer(m[2], np.uint64) for m in members], np.array([m[3] for m in members], np.int64), met)
            if links:
                a, b = (np.array([members[k][1] for k in side], np.int64) for side in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    # each set lies in one task: the exchange by key is the last step before
    return map_batches(full.repartition("key").sortWithinPartitions("key", "cid"), work, "a bigint, b bigint")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Saved (v, label) for every end of a link (a, b): the smallest end of its component."""
    edges = scratch.saved(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "neardup-edges")
    labels = scratch.saved(edges.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("label")), "neardup-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("label").alias("other"))
        nearer = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("onward"))
        moved = scratch.saved(nearer.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("onward", "label")).alias("label")), "neardup-labels")
        scratch.drop(labels)
        labels = moved
        if not moved.where("old <> label").take(1):
            scratch.drop(edges)
            return labels.select("v", "label")


def _leftover(chunks: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Sets (key, cid) that hold each class outside its dense node's largest component together with every chunk."""
    rows = _labelled(chunks.where("not central"), labels)
    largest = rows.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most"))
    blocks = F.ceil((F.col("size") - F.col("most")) / CHUNK).cast("long")
    rows = rows.join(largest.where("size > most").select("node", "main", blocks.alias("blocks")), "node")
    block = F.pmod(F.xxhash64("cid", F.lit("block")), F.col("blocks"))
    apart = rows.where("label <> main").select("node", "cid", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    others = rows.select("node", "cid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "chunk")
    return apart.unionByName(others).select(F.xxhash64("node", "block", "chunk", F.lit("x")).alias("key"), "cid")


def link(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Saved, one row per document: doc_id, text_hash, n_shingles, component_id, kept, fp (names its set), head (fp of the set that stands for the component)."""
    scratch = Scratch(docs.sparkSession)
    features = scratch.saved(_features(docs, text_col, id_col), "neardup-features")
    some = features.where("n > 0")
    classes = some.groupBy("fp").agg(F.min("row").alias("cid"), F.min("doc_id").alias("low"), F.min(F.struct("n", "sig", "sketch")).alias("s")).select("fp", "cid", "low", "s.n", "s.sig", "s.sketch")
    classes = scratch.saved(classes, "neardup-classes")

    leaves, dense = _grown(classes, scratch)
    sets = leaves.select(F.xxhash64("members").alias("key"), F.explode("members").alias("cid"), "first")
    chunks = None
    if dense is not None:
        chunks = _chunks(dense, classes, scratch)
        plain = chunks.where("not central").select(F.xxhash64("node", "chunk").alias("key"), "cid", "first")
        central = chunks.where("central").select("node", "cid", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).select(F.xxhash64("node", "chunk").alias("key"), "cid", "first")
        sets = sets.union(plain).union(central)
    sets = scratch.saved(sets, "neardup-members")
    sketches = scratch.saved(classes.select("cid", "n", "sketch").join(_small(scratch.saved(sets.select("cid").distinct(), "neardup-cids")), "cid", "left_semi"), "neardup-sketches")

    links = labels = seen = None
    waves = [lambda: sets.where("first").drop("first"), lambda: sets.where("not first").drop("first")]
    if chunks is not None:
        waves.append(lambda: _leftover(chunks, labels))
    for k, wave in enumerate(waves):
        hard = scratch.saved(_hard(wave(), sketches, labels, seen), "neardup-hard")
        if hard.take(1):
            found = scratch.saved(_linked(_full_sets(hard, docs, classes, text_col, id_col, scratch)), "neardup-links")
            links = found if links is None else links.union(found)
            labels = components(links, scratch)
        if k == 0:
            seen = scratch.saved(hard.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list("key")), 1, SEEN).alias("seen")), "neardup-seen")
        scratch.drop(hard)

    named = _labelled(classes.select("fp", "low", "cid"), labels)
    heads = named.groupBy("label").agg(F.min(F.when(F.col("low").isNotNull(), F.struct("low", "fp"))).alias("head"), F.min("fp").alias("any"))
    heads = named.join(heads, "label").select("fp", F.col("head.low").alias("component"), F.coalesce("head.fp", "any").alias("head"))
    told = features.select("doc_id", "text_hash", "n", "fp").join(heads, "fp", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = saved(told.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "fp", "head"), "neardup")
    scratch.clear()
    return out


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents of which one stands for each group, with their own columns; texts without words all stay.

    Of rows with one id and sets that are equal, the one whose text has the least hash stays. Texts are
    shuffled once, to meet the names of those that stay.
    """
    told = link(docs, text_col, id_col).where("kept and (n_shingles = 0 or fp = head)").withColumn("empty", F.col("n_shingles") == 0)
    rows = told.groupBy("doc_id", "fp", "empty", "text_hash").agg(F.count("*").alias("times"))
    single = rows.where("not empty").groupBy("doc_id", "fp").agg(F.min(F.struct("text_hash", "times")).alias("s")).select("doc_id", "s.text_hash", "s.times")
    names = saved(single.union(rows.where("empty").select("doc_id", "text_hash", F.lit(1).alias("times"))).toDF("__neardup_id", "__neardup_hash", "__neardup_times"), "neardup-heads")
    own = [f"`{c}`" for c in docs.columns]
    met = F.col(id_col).cast("long").eqNullSafe(F.col("__neardup_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__neardup_hash"))
    out = docs.join(names.where("__neardup_times = 1"), met, "left_semi").select(*own)
    repeated = names.where("__neardup_times > 1")
    if repeated.take(1):
        out = out.unionByName(docs.join(repeated, met, "left_semi").dropDuplicates([id_col, text_col]).select(*own))
    return out
