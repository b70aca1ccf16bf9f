import random
import re

import xxhash
from pyspark.sql import functions as F

from mailposture.llm import graph, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints):
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[top(i)] = top(j)
    least = {}
    for i in range(len(ids)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [least[top(i)] for i in range(len(ids))]


def expected(ids, texts):
    prints = [fingerprint(t) for t in texts]
    return sorted((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, classes(ids, prints)))


def test_odd_texts(docs, odd, rows):
    texts = odd + ["w%d" % (k % 700) + " " for k in range(3)] + ["Shared words in many places of a text " * 300]
    assert rows(simhash.near_duplicates(docs(texts))) == sorted(expected(range(len(texts)), texts), key=lambda r: tuple(map(str, r)))


def test_near_copies_and_chains(docs):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(30)]
    texts = list(base)
    for t in base[:10]:
        for _ in range(25):
            words = t.split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(9)}"
            t2 = " ".join(words)
            texts += [t2] * rng.choice([1, 1, 3])
    rng.shuffle(texts)
    ids = [k * 3 + 5 for k in range(len(texts))]
    got = simhash.near_duplicates(docs(texts, ids)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == expected(ids, texts)


def test_links_of_random_fingerprints(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)}
    prints |= {rng.getrandbits(64) for _ in range(50)} | {0, 1, 3, 7, 1 << 63, 2**64 - 1}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "bits bigint")
    got = simhash.links(frame).collect()
    assert len(got) == len(set(got)) and all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in got)
    roots = {r.node: r.root for r in graph.components(simhash.links(frame)).collect()}
    want = classes(signed, [s & (2**64 - 1) for s in signed])
    assert [roots.get(s, s) for s in signed] == want


def test_components_of_paths_stars_and_nothing(spark):
    path = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 60)] + [(159, 90)]
    edges = spark.createDataFrame(path + star + [(7, 7), (1, 0), (None, 3)], "a bigint, b bigint")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots == {**{k: 0 for k in range(41)}, **{100 + k: 90 for k in range(60)}, 90: 90}
    assert graph.components(edges.limit(0)).count() == 0


def test_keep_one_and_missing_ids(spark, docs):
    frame = docs(["one two three four", "one two three four", "other words stand here", None, None, "x y"], [4, 2, 9, 7, None, 2])
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "7", "9", "None"]
    assert simhash.near_duplicates(frame).count() == 6
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_query_over_documents(spark, rows):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = queries.RUN["op1_simhash"](spark, sf).select(F.col("doc_id"), "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect())) == expected([r.doc_id for r in table], [r.text for r in table])


def test_a_rising_path_takes_few_rounds(spark, monkeypatch):
    from mailposture.llm import graph

    stored = []
    monkeypatch.setattr(graph, "store", lambda df, keep=graph.store: stored.append(1) or keep(df))
    edges = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in graph.components(edges).collect()} == {(k, 0) for k in range(1001)}
    assert len(stored) < 3 * 25
