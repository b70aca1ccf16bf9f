import random
import re

from pyspark.sql import functions as F

from mailposture.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_measures_against_brute_force(docs, odd):
    rng = random.Random(3)
    texts = odd + ["# a\n# a\n\n \n# a\r\nb|c", "\n\n", "|", "a b c a b c", "a a a a", "a b c d a b c", "x\n y\nx \nx"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d", "\t", "#", " é"]) for _ in range(rng.randrange(200))) for _ in range(150)]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in quality.assess(docs(texts)).collect()}
    assert got == {k: base(t) for k, t in enumerate(texts)}


def test_estimate_finds_accuracies():
    rng = random.Random(1)
    accuracy, counts = [0.95, 0.8, 0.6], {}
    for _ in range(20000):
        y = 1 if rng.random() < 0.8 else -1
        pattern = tuple(0 if rng.random() < 0.2 else (y if rng.random() < a else -y) for a in accuracy)
        counts[pattern] = counts.get(pattern, 0) + 1
    prior, table = quality.estimate(counts, rounds=200)
    assert abs(prior - 0.8) < 0.05
    for j, a in enumerate(accuracy[:2]):
        assert abs(table[j][1][1] / 0.8 - a) < 0.06
    assert quality.estimate({})[0] == 0.5


def test_empty_table_and_repeated_rows(docs):
    frame = docs(["word " * 60, "word " * 60, None], [1, 1, None])
    assert quality.assess(frame).count() == 3
    assert quality.assess(frame.limit(0)).count() == 0


def test_query_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.RUN["op10_quality"](spark, sf)
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for r in got.join(table, "doc_id").collect():
        if r.n_words < 3000:
            assert tuple(r[c] for c in COLUMNS) == base(r.text), r.doc_id
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    share = got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in share}
    assert share[0] < 0.2 and share[1] > 0.8, share
