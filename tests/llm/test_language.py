import numpy as np
from pyspark.sql import functions as F

from mailposture.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = language.codewords(n).astype(int)
        apart = (code[:, None] != code[None]).sum(2) + 10**6 * np.eye(n, dtype=int)
        assert apart.min() >= max(1, code.shape[1] // 4), (n, apart.min())
    assert language.codewords(1).shape == (1, 0) and language.codewords(0).shape == (0, 0)


def test_odd_texts(docs, odd):
    model = language.fit(docs(["the cat and the dog", "der Hund und die Katze"]).withColumn("lang", F.when(F.col("doc_id") == 0, "en").otherwise("de")))
    got = {r.doc_id: r for r in language.predict(docs([*odd, "12 34 !!", "die Katze", "the dog", "the cat and the dog " * 100_000]), model).collect()}
    n = len(odd)
    assert [got[k].lang_pred for k in (0, 1, 2, n)] == ["und"] * 4 and got[n].score == 0
    assert (got[n + 1].lang_pred, got[n + 2].lang_pred, got[n + 3].lang_pred) == ("de", "en", "en")
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn(docs):
    empty = docs(["a b"]).withColumn("lang", F.lit(None).cast("string"))
    assert language.predict(docs(["a b"]), language.fit(empty)).first().lang_pred == "und"
    one = language.fit(docs(["a b"]))
    assert language.predict(docs(["a b", None]), one).orderBy("doc_id").first().lang_pred == "en"
    assert language.predict(docs(["x"]).limit(0), one).count() == 0


def test_one_language_out_of_many(docs):
    texts = [f"{a}{b} " * 30 for a in "abcdefghijkl" for b in "xyz"]
    frame = docs(texts).withColumn("lang", F.substring("text", 1, 1))
    model = language.fit(frame)
    got = language.predict(frame, model).join(frame.select("doc_id", "lang"), "doc_id")
    assert got.filter(F.col("lang") == F.col("lang_pred")).count() == len(texts)


def test_held_out_accuracy(spark):
    got = queries.RUN["op2_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.count() == 1000
    right = {r.held_out: r.right for r in got.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()}
    assert right[True] > 0.97 and right[False] > 0.97, right
