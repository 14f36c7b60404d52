import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from verdigris.llm import neardup, registry


def brute_force(rows):
    """Every pair with a common shingle, on the sets of words themselves."""
    sets, at = [], defaultdict(list)
    for k, (_, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.append(s)
        for g in s:
            at[g].append(k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in at[g]:
                if j < k:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                root[find(k)] = find(j)
    low = {}
    for k, (doc, _) in enumerate(rows):
        r = find(k)
        low[r] = min((x for x in (low.get(r), doc) if x is not None), default=None)
    return sorted(((doc, len(sets[k]), low[find(k)]) for k, (doc, _) in enumerate(rows)), key=repr)


def told(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.link(df).collect()), key=repr)


def test_links_are_counted_exactly():
    """A forest over sets whose components are known by counting every pair."""
    rng = random.Random(2)
    for gathered in (neardup.GATHERED, 50):
        neardup_gathered, neardup.GATHERED = neardup.GATHERED, gathered
        sets = []
        for _ in range(6):
            core = [rng.getrandbits(64) for _ in range(rng.choice((20, 90)))]
            for _ in range(8):
                own = core[rng.randrange(3) :] + [rng.getrandbits(64) for _ in range(rng.randrange(len(core) // 3))]
                sets.append(np.unique(np.array(own, np.uint64)))
        plain = [set(s.tolist()) for s in sets]
        want, got = (list(range(len(sets))) for _ in range(2))

        def join(labels, a, b):
            labels[:] = [labels[a] if x == labels[b] else x for x in labels]

        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(plain[a] & plain[b]) >= 75 * len(plain[a] | plain[b]):
                    join(want, a, b)
        links = neardup.forest(sets, np.arange(len(sets)))
        for a, b in links:
            join(got, a, b)
        neardup.GATHERED = neardup_gathered
        parts = lambda labels: {frozenset(k for k, x in enumerate(labels) if x == y) for y in labels}
        assert parts(got) == parts(want) and len(links) == len(sets) - len(set(want))


def test_documents(spark):
    docs = registry.documents(spark, "/root/testdata/sf0.01")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert told(docs) == brute_force(rows)


def test_groups_passages_and_odd_rows(spark, monkeypatch):
    """Small limits, so that nodes branch, are dense, and leave classes over."""
    for name, value in (("LEAF", 12), ("CHUNK", 6), ("CENTRAL", 3), ("TASK_TOKENS", 1000)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage, rows = draw(400), draw(60), []
    for k in range(150):  # near copies around one text: most are linked with it, fewer with each other
        w = list(base)
        for _ in range(rng.choice((2, 5, 9, 11, 14))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((1000 + k, " ".join(w)))
    rows.append((1, " ".join(base)))
    rows += [(2000 + k, " ".join(draw(80) + passage + draw(80))) for k in range(120)]  # a passage is not enough
    chain = draw(200)
    for k in range(12):  # each like the next, the ends unlike
        rows.append((3000 + k, " ".join(chain)))
        chain = chain[12:] + draw(12)
    rows += [(k % 5 + 4000, "the same text in many copies here") for k in range(60)]
    rows += [(10, None), (11, ""), (12, " \t\n"), (13, "one two"), (14, "ONE two"), (None, "one two"), (None, "quite alone in the world of texts"), (15, "one two three"), (16, "a b c d e"), (17, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("clash")).withColumn("fp", F.lit(1)).repartition(5)
    assert told(df) == brute_force(rows)


def test_recall_in_a_group_larger_than_a_leaf(spark):
    """The real constants: near copies of one text fill every tree's nodes beyond LEAF; every link is counted by brute force."""
    rng, size = np.random.default_rng(11), neardup.LEAF + 500
    base = rng.integers(0, 1 << 30, 70)
    rows = []
    for k in range(size):  # a few changed words each: many pairs lie close to the threshold, on both sides
        w = base.copy()
        w[rng.choice(70, rng.choice((0, 1, 2, 3)), replace=False)] = rng.integers(0, 1 << 30)
        rows.append((k, " ".join(map(str, w.tolist() + [k % 3000]))))
    sets = [neardup.shingles(t) for _, t in rows]
    flat, at = np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum([0, *map(len, sets)])
    n, flag, links = np.diff(at), np.zeros(flat.max() + 1, bool), 0
    got = {r.doc_id: r.component_id for r in neardup.link(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    found = np.array([got[k] for k in range(size)])
    kept = 0
    for k in range(size - 1):
        flag[flat[at[k] : at[k + 1]]] = True
        common = np.add.reduceat(flag[flat[at[k + 1] :]].astype(np.int64), at[k + 1 : -1] - at[k + 1])
        flag[flat[at[k] : at[k + 1]]] = False
        near = np.flatnonzero(100 * common >= 75 * (n[k] + n[k + 1 :] - common)) + k + 1
        links += len(near)
        kept += int((found[near] == found[k]).sum())
    print(f"links {links}, inside a component {kept}")
    assert links > 100_000 and kept >= 0.9999 * links


def test_blocks_hold_every_pair():
    n = np.array([3, 1, 1, 2, 5, 1, 1, 4, 2])
    old, neardup.TASK_TOKENS = neardup.TASK_TOKENS, 4
    try:
        blocks = neardup._blocked(7, np.arange(9), n)
    finally:
        neardup.TASK_TOKENS = old
    assert len({name for name, _ in blocks}) == len(blocks) > 3
    assert {(a, b) for _, some in blocks for a in some.tolist() for b in some.tolist() if a < b} == {(a, b) for b in range(9) for a in range(b)}


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "the quick brown fox jumps over"), (1, "The quick brown fox jumps over"), (1, "the quick brown fox jumps over"), (2, "another text that is not like it"), (7, None), (8, ""), (2, "words of a repeated id but another text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit("x")).repartition(3)
    got = neardup.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[:7].lower()) for r in got.collect()) == [(1, "the qui"), (2, "another"), (2, "words o"), (7, ""), (8, "")]
    assert neardup.link(df.limit(0)).count() == 0 and neardup.deduplicated(df.limit(0)).count() == 0
