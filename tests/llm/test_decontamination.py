import random

from pyspark.sql import functions as F

from mailposture.llm import decontamination, queries

SF = "/root/testdata/sf0.1"


def brute(item, text, least):
    """Greedy tiling by trying all pairs of starts."""
    im, tm, tiles = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not im[i + n] and not tm[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        for k in range(n):
            im[i + k] = tm[j + k] = True
        tiles.append((i, j, n))


def test_tiles_against_all_pairs():
    rng = random.Random(8)
    for _ in range(300):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(30))]
        text = [rng.randrange(1, 5) for _ in range(rng.randrange(40))]
        for k in range(0, 20, 10):
            text[k : k + 5] = item[k : k + 5]
        got = decontamination.tile(item, text, 3)
        want = brute(item, text, 3)
        assert sorted(t.length for t in got) == sorted(n for _, _, n in want), (item, text, got, want)
        for i, j, n in got:
            assert item[i : i + n] == text[j : j + n]


def test_reordered_partial_and_absent(docs, spark):
    words = [f"w{k}" for k in range(40)]
    item = " ".join(words)
    reordered = " ".join(["before"] + words[20:] + ["between"] + words[:20]) + " after"
    half, less = " ".join(words[:21]), " ".join(words[:15])
    texts = ["x " + item.upper() + " y", reordered, half, less, None, "", " ".join(reversed(words)), "q " * 1000, ("z " * 30_000) + item]
    benchmark = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (10, "")], "item_id bigint, text string")
    for block_seeds in (10, 1 << 20):
        got = sorted((r.doc_id, r.item_id, r.n_covered, r.n_tiles) for r in decontamination.contained(docs(texts), benchmark, block_seeds=block_seeds).collect())
        assert got == [(0, 7, 40, 1), (1, 7, 40, 2), (2, 7, 21, 1), (8, 7, 40, 1)]
    left = decontamination.clean(docs(texts), benchmark)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7] and left.columns == docs(texts).columns
    assert decontamination.contained(docs(texts), benchmark.limit(0)).count() == 0
    assert decontamination.contained(docs(texts).limit(0), benchmark).count() == 0
    assert [r.doc_id for r in decontamination.clean(docs([item, item, None], [None, 1, None]), benchmark, block_seeds=10).collect()] == [None]


def test_short_items_and_scripts_without_blanks(docs, spark):
    chinese = "谁在一九九八年写了这本关于河流的书"
    items = [(1, "Who wrote this book?"), (2, chinese), (3, "ok"), (4, "ใครเขียนหนังสือเล่มนี้"), (5, "who wrote"), (6, "...")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [f"前言。{chinese}。后记", "and who wrote THIS book then; who wrote this book", "who wrote this", "x ใครเขียนหนังสือเล่มนี้ y", "OK", "okay", chinese[:9], None]
    for block_seeds in (10, 1 << 20):
        got = sorted((r.doc_id, r.item_id, r.n_covered, r.coverage) for r in decontamination.contained(docs(texts), benchmark, block_seeds=block_seeds).collect())
        thai = len(decontamination.tokens(items[3][1]))
        assert got == [(0, 2, 17, 1.0), (1, 1, 4, 1.0), (1, 5, 2, 1.0), (2, 5, 2, 1.0), (3, 4, thai, 1.0), (4, 3, 1, 1.0), (6, 2, 9, 9 / 17)]
    assert sorted(r.doc_id for r in decontamination.clean(docs(texts), benchmark).collect()) == [1, 2, 4, 5, 7]
    assert sorted(r.doc_id for r in decontamination.clean(docs(texts), benchmark, min_item=4).collect()) == [2, 4, 5, 7]


def test_tokens_are_bounded_by_their_column(spark):
    texts = ["a b_c 12é", "日本語 text ไทย", "", "\u00aa ß_ x̱y", "가나 다", "".join(map(chr, range(1, 0xD800, 7)))]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", decontamination.token_bound(F.col("text")).alias("n"))
    assert all(len(decontamination.tokens(r.text)) <= r.n for r in frame.collect())


def test_items_with_one_beginning(docs, spark):
    head = " ".join(f"h{k}" for k in range(8))
    benchmark = spark.createDataFrame([(k, f"{head} " + " ".join(f"i{k}x{j}" for j in range(12))) for k in range(30)], "item_id bigint, text string")
    texts = [head, f"{head} " + " ".join(f"i3x{j}" for j in range(12))]
    assert [(r.doc_id, r.item_id) for r in decontamination.contained(docs(texts), benchmark).collect()] == [(1, 3)]


def test_query_finds_every_contained_item(spark):
    got = {(r.doc_id, r.item_id): r.coverage for r in queries.RUN["op9_decontamination"](spark, SF).collect()}
    items = [(r.item_id, decontamination.tokens(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seeds = {}
    for i, words in items:
        for k in range(len(words) - 4):
            seeds.setdefault(tuple(words[k : k + 5]), []).append((i, k))
    size = {i: len(w) for i, w in items}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words, covered = decontamination.tokens(r.text), {}
        for j in range(len(words) - 4):
            for i, k in seeds.get(tuple(words[j : j + 5]), ()):
                covered.setdefault(i, set()).update(range(k, k + 5))
        want |= {(r.doc_id, i) for i, c in covered.items() if len(c) >= 0.5 * size[i]}
    assert set(got) <= want and len(got) >= 0.98 * len(want) and min(got.values()) >= 0.5
