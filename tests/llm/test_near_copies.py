import random

import corpus_pipeline
from pyspark.sql import functions as F

from mailposture.llm import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def survivors(rows):
    """Brute force: the smallest (id, set) of every component of pairs at similarity 0.8 or above."""
    nodes = sorted({(i, tuple(sorted(shingles(t)))) for i, t in rows})
    sets = [set(s) for _, s in nodes]
    parent = list(range(len(nodes)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return sorted(nodes[k][0] for k in range(len(nodes)) if top(k) == k)


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"z{rng.randrange(99)}"
    return " ".join(words)


def test_stage_against_brute_force_jaccard(spark, docs):
    rng = random.Random(3)
    line = " ".join(f"common{k}" for k in range(15))
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120, 300]))) for _ in range(40)]
    texts = [f"{t} {line}" for t in base] + [edited(rng, t, e) for t in base for e in (1, 2, 4, 6, 9)] + base[:9] + [None, "", " "]
    rng.shuffle(texts)
    frame = docs(texts)
    got = corpus_pipeline.drop_near_copies(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted(r.doc_id for r in got.collect()) == survivors(list(enumerate(texts)))


def test_large_group_of_near_copies_is_not_compared_in_pairs(spark, docs):
    rng = random.Random(4)
    text = " ".join(f"w{k}" for k in range(200))
    frame = docs([edited(rng, text, 2) for _ in range(300)])
    assert near_copies.keep_one(frame).count() == 1
    assert near_copies.keep_one(frame.limit(0)).count() == 0


def test_different_texts_under_one_id_are_judged_each_on_its_own(docs):
    frame = docs(["one two three four", "a text of its own", "one two three four", "a text of its own", "a text of its own"], [1, 2, 2, 2, None])
    assert sorted((str(r.doc_id), r.text) for r in near_copies.keep_one(frame).collect()) == [
        ("1", "one two three four"), ("2", "a text of its own"), ("None", "a text of its own")
    ]


def test_query_data(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    assert sorted(r.doc_id for r in near_copies.keep_one(table).collect()) == survivors(rows)


def test_a_column_with_the_name_of_a_helper_stays_as_it_is(spark):
    rows = [(1, "one two three four five six", 77, 1), (2, "one two three four five six", 78, 2), (3, None, 79, 3)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, _hash bigint, hash int")
    assert sorted(tuple(r) for r in near_copies.keep_one(frame).collect()) == [rows[0], rows[2]]


def test_simhash_proposes_links_that_are_verified(spark, docs):
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(999)}" for _ in range(400))
    frame = docs([text, f"{text} end", text.upper() + " End", "alpha beta gamma", "alpha  beta gamma", " ".join(reversed(text.split()))])
    texts = frame.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    sets = near_copies.named(texts).dropDuplicates(["key"])
    pairs = near_copies.proposed(texts, sets).collect()
    key = {r.id: r.key for r in near_copies.named(texts).collect()}
    assert {(r.a, r.b) for r in pairs} == {(min(key[0], key[1]), max(key[0], key[1]))}
    assert key[1] == key[2] and key[3] == key[4]
    assert sorted(r.doc_id for r in near_copies.keep_one(frame).collect()) == [0, 3, 5]


def test_crowd_below_the_bound_does_not_become_rows(spark, docs):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(390)]
    texts = []
    for i in range(40):
        words = list(base)
        for k in rng.sample(range(380), 6):
            words[k] = f"x{i}_{k}"
        texts.append(" ".join(words))
    frame = docs(texts)
    rows = frame.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    sets = near_copies.named(rows).select("key", "n", "prefix", "parity", "id", "hash")
    places = near_copies.meeting_places(sets, sets.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0))
    odds = [(r.key, [int(x) for x in near_copies.parity(near_copies.shingle_set(texts[r.id].encode()), near_copies.CROWD_BITS)]) for r in sets.collect()]
    few, crowds = near_copies.by_crowd(places)
    wide = crowds.join(spark.createDataFrame(odds, "key bigint, odds array<bigint>"), "key")
    columns = ("key", "n", "at", "root", "parity")
    narrow, close = near_copies.meetings(crowds, columns).count(), near_copies.meetings(wide, (*columns, "odds")).count()
    assert few.count() + crowds.count() == places.count() and crowds.groupBy("shingle").count().filter(f"count <= {near_copies.CROWD}").isEmpty()
    assert 10 * close < narrow
    assert sorted(r.doc_id for r in near_copies.keep_one(frame).collect()) == survivors(list(enumerate(texts)))


def test_small_hashes_are_dealt_out_evenly():
    import numpy as np
    import pyarrow as pa

    from mailposture.llm.suffix_dedup import pack

    shingles = np.sort(np.random.default_rng(3).integers(0, 1 << 60, 8000).astype(np.uint64))  # as prefixes have them: of small hash
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 8001, 100), pa.int32()), pa.array(shingles.view(np.int64)))
    sets = pa.RecordBatch.from_arrays([pa.array(np.arange(80)), pa.array(np.full(80, 100)), lists], ["key", "n", "prefix"])
    ask = near_copies._questions(pack(sets), 16)[3]
    assert len(ask.keys) == 8000 and np.diff(ask.bounds).max() < 700
