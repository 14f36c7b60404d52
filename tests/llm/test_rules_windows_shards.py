"""Quality rules, decontamination and sharding on odd rows, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from verdigris.llm import decontam, quality, sharding

ODD = ["", None, " \t\n", "one", "a b c a b c", "x x x x", "#hash *star* <b>&", "line\nline\n\nother\nline", "Ü é ß\x0bz\x0cq", "w " * 5000 + "end", "a b c d " * 30, "tic tac toe " * 2 + "tic tac"]


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {k + d for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "one"), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' as n_words", "1 as words")
    got = quality.judged(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.judged(df.limit(0)).count() == 0


def test_no_python_in_the_rules(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    assert "Python" not in quality.judged(df)._jdf.queryExecution().toString()


def test_rule_table(spark):
    df = spark.createDataFrame([(10, 100), (0, 0), (20, 100)], "a bigint, b bigint")
    rule = quality.compile_rules((quality.Rule("a", "b", low=5, high=15),))
    assert [r.ok for r in df.select(rule.alias("ok")).collect()] == [True, True, False]


ITEMS = [(1, "the quick brown fox jumps over the lazy dog today and then sleeps"), (2, "Two Words"), (3, ""), (4, None), (5, "two words"), (6, "!!! ..."), (7, "naïve café 7")]


def test_windows_in_one_block_and_in_many(spark):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(1, "Said: THE quick brown fox, jumps over the lazy dog -- today (and) then sleeps!"), (2, "only two words here, two-words"), (3, None), (4, ""), (5, "quick brown fox jumps over the lazy dog today"), (6, "NAÏVE naïve café 7"), (7, "x " * 30_000 + "two words"), (2, "only two words here, two-words"), (None, "nothing")]
    windows = defaultdict(set)
    for item, text in ITEMS:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(item))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n_hit", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for block_words in (1, 250_000):
        got = decontam.scan(df, items, block_words=block_words).collect()
        assert len(got) == len(docs)
        for r in got:
            w = words(r.text)
            hit, ids = set(), set()
            for length in {len(x) for x in windows}:
                for k in range(len(w) - length + 1):
                    if found := windows.get(tuple(w[k : k + length])):
                        hit |= set(range(k, k + length))
                        ids |= found
            assert (r.n_words, r.n_hit, list(r.hit_items), r.contaminated) == (len(w), len(hit), sorted(ids), bool(hit))
            for a, b in zip(r.hit_spans[::2], r.hit_spans[1::2], strict=True):
                assert words(r.text[a:b]) and r.text[a] not in " ,:(" and r.text[b - 1] not in " ,:("
        clean = decontam.clean(df, items, block_words=block_words)
        assert sorted(r.text or "" for r in clean.collect()) == sorted(r.text or "" for r in got if not r.contaminated) and clean.columns == df.columns
    assert decontam.scan(df, items.limit(0)).where("contaminated").count() == 0 and decontam.scan(df.limit(0), items).count() == 0
    assert decontam.items_digest(["b", "a"]) == hashlib.sha256(b"a,b").hexdigest()


def test_shards_keep_the_mixture(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 50}", f"text {k}") for k in range(3000)] + [(None, None, None), (None, None, None), (7, "hot", "text 7"), (1, "lone", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("size", F.lit("clash")).withColumn("slot", F.lit(1)).repartition(5)
    got = sharding.interleave(df, shards=16).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d, s) for d, s, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(16)) and {len(x) for x in by.values()} <= {len(rows) // 16, len(rows) // 16 + 1}
    hot = sum(s == "hot" for _, s, _ in rows) / len(rows)
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
        assert abs(sum(r.source == "hot" for r in x) - hot * len(x)) <= 6
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len(t or "") + 1, zlib.crc32((t or "").encode())) for d, _, t in rows)
    assert sharding.interleave(df.limit(0)).count() == 0


def test_pieces_of_a_long_item_have_its_windows(spark):
    text = " ".join(f"w{k % 1700}" for k in range(3500))
    items = spark.createDataFrame([(1, text), (2, "short one"), (3, " ".join(f"v{k}" for k in range(1009)))], "item_id bigint, text string")
    pieces = decontam._pieces(items, "item_id", "text", 10).collect()
    assert max(r.n for r in pieces) == decontam.PIECE_WORDS + 9
    for item, whole in ((r.item_id, r.text) for r in items.collect()):
        own = {w for r in pieces if r.id == str(item) for w in decontam.windows_of(r.words.encode().split())}
        assert own == set(decontam.windows_of(whole.encode().split()))
    docs = spark.createDataFrame([(1, "x " + text[8000:8400] + " y")], "doc_id bigint, text string")
    assert decontam.scan(docs, items).first().hit_items == ["1"]


def test_written_shards_hold_every_document_in_slot_order(spark, tmp_path):
    rows = [(k, f"s{k % 3}", f"text {k} " * (k % 50)) for k in range(200)] + [(900, "s1", "very long " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    placed = sharding.interleave(docs, shards=4)
    sharding.write_shards(placed, docs, f"{tmp_path}/shards")
    got = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted((r.doc_id, r.source, r.text) for r in got) == sorted(rows)
    want = {(r.doc_id, r.shard, r.slot) for r in placed.collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in got} == want
