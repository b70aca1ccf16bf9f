import base64

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_near_copies import survivors
from test_suffix_dedup import expected

from mailposture.llm import decontamination, toxicity

SF = "/root/testdata/sf0.001"


def encoding():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, toxicity.train_rows(spark.read.parquet(f"{SF}/labels.parquet")))
    clean = {r.doc_id for r in toxicity.score(docs, model).filter(F.col("score") < 0.7).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in clean)
    stay = set(survivors(rows))
    rows = [r for r in rows if r[0] in stay]
    cut = expected([i for i, _ in rows], [t for _, t in rows])
    rows = [(i, kept.decode("utf-8", "ignore")) for i, _, spans, kept in cut if not spans or kept]
    items = [decontamination.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def covered(item, words):
        seeds = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        return len({k + j for k in range(len(item) - 4) if tuple(item[k : k + 5]) in seeds for j in range(5)})

    rows = [(i, t) for i, t in rows if not any(covered(item, decontamination.tokens(t)) >= 0.5 * len(item) for item in items)]
    coder = encoding()
    want = sorted((i, coder.encode_ordinary(t)) for i, t in rows)
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and 50 < len(want) < 200


def test_stages_keep_the_columns_of_documents(spark, docs, odd):
    rows = docs([*odd, "clean words of a text", "clean words of a text"], [None, *range(1, len(odd) + 2)]).withColumn("n_chars", F.length("text").cast("bigint"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns, name
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in rows.collect()}
        assert stage(spark, rows.limit(0), SF).count() == 0
    assert corpus_pipeline.encode(spark, rows, SF).count() == rows.count()
