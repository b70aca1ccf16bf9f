import math
import random

import numpy as np
from pyspark.sql import functions as F

from mailposture.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def labelled(spark, docs):
    """Clean texts, and texts with an insult in different places."""
    plain = "the people of the town went to the river and then they saw a boat near the old bridge in the early morning".split()
    texts, labels = [], []
    for k in range(200):
        words = [plain[(k * 7 + i * (3 + k % 5)) % len(plain)] for i in range(20)]
        if k % 4 == 0:
            words.insert(k % 19, ["idiot", "stupid"][k // 4 % 2])
        texts.append(" ".join(words))
        labels.append((k, int(k % 4 == 0)))
    return docs(texts), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_restores_disguised_words(spark, docs):
    frame, labels = labelled(spark, docs)
    model = toxicity.fit(frame, labels)
    assert {"idiot", "stupid"} <= set(model.weights)
    decoder = toxicity.Decoder(model.trigrams, model.weights)
    assert [toxicity.restored(w, decoder) for w in ("1d10t", "st*pid", "$tup1d", "i.d.i.o.t", "stuuuupid", "idiot!!", "river", "(boat)", "1990")] == [
        "idiot", "stupid", "stupid", "idiot", "stupid", "idiot", "river", "boat", "1990"
    ]
    assert "idiot" in toxicity._words("you i d i o t there", decoder, {})
    texts = ["you 1d10t there", "s t u p i d people", "the river near the town", "IDIOT", None, "", "x" * 200_000, "1 2 3 4 5 6"]
    got = [r.score for r in toxicity.score(docs(texts), model).orderBy("doc_id").collect()]
    assert all(s >= 0.7 for s in (got[0], got[1], got[3])) and all(s < 0.3 for s in (got[2], *got[4:])), got
    assert got[4] == got[5]


def test_insults_anywhere_in_spaced_and_joined_letters(spark, docs):
    frame, labels = labelled(spark, docs)
    model = toxicity.fit(frame, labels)
    plain = "the people of the town went to the river and then they saw a boat near the old bridge"
    assert len(plain.replace(" ", "")) > 60
    late = f"{plain} stupid people of the town"
    texts = ["then a s t u p i d man", " ".join(late.replace(" ", "")), " ".join("theyareidiot"), ".".join(late.replace(" ", "")), " ".join("they saw 1d10t near the town".replace(" ", ""))]
    clean = [" ".join(plain.replace(" ", "")), ".".join(plain.replace(" ", "")), "1 2 3 4 5 6 7 8", "x.y " * 50_000, "x." * 50_000]
    got = [r.score for r in toxicity.score(docs(texts + clean), model).orderBy("doc_id").collect()]
    assert all(s >= 0.7 for s in got[: len(texts)]) and all(s < 0.3 for s in got[len(texts) :]), got


def test_heavily_disguised_words(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    weights = {"loser": 5.0, "ass": 5.0}
    decoder = toxicity.Decoder(toxicity.trigram_model(table), weights)
    assert [toxicity.restored(w, decoder) for w in ("1053r", "10$3r", "loser!", "1,053", "$100", "1990")] == ["loser", "loser", "loser", "1,053", "$100", "1990"]
    decoder = toxicity.Decoder(toxicity.trigram_model(docs(["an ass on the grass", "a class as such"] * 50)), weights)
    assert [toxicity.restored(w, decoder) for w in ("a55", "a$$", "a$$.", "@$$")] == ["ass"] * 4


def test_disguises_at_ends_in_pieces_and_in_other_scripts(spark):
    trigrams = toxicity.trigram_model(spark.read.parquet(f"{SF}/documents.parquet"))
    decoder = toxicity.Decoder(trigrams, {"idiot": 5.0, "clown": 5.0, "loser": 5.0, "ass": 5.0, "idio*": 4.0})
    words = "the-idio+ an-idio+ *diot #diot (lown <lown iidiioott іdiot ídiot ｉｄｉｏｔ a$$ a$$. 7#*n!n*ng river! looser 1,053 $100 café".split()
    assert [toxicity.restored(w, decoder) for w in words] == [
        "the idiot", "an idiot", "idiot", "idiot", "clown", "clown", "idiot", "idiot", "idiot", "idiot", "ass", "ass", toxicity.Decoder(trigrams).restore("7#*n!n*ng"),
        "river", "looser", "1,053", "$100", "café",
    ]
    for text in ("a s s", "i  d  i  o  t", "i d i ot", "so id iot then", "i\nd\ni\no\nt", "y o u i d i o t s"):
        assert any(toxicity.weight_of(w, decoder.weights) for w in toxicity._words(text, decoder, {})), text
    for text in ("p a s s a g e", "the river i think", "c l a s s", "as 5 s"):
        assert not any(toxicity.weight_of(w, decoder.weights) for w in toxicity._words(text, decoder, {})), text


def all_paths(decoder, observed):
    """Least cost over all paths of the lattice, each spelt out, for texts that begin with a word."""
    paths = {"": 0.0}
    for moves in decoder.lattice(observed):
        longer = {}
        for text, cost in paths.items():
            for letter, price in moves:
                more = text if letter == " " and (not text or text.endswith(" ")) else text + letter
                longer[more] = min(longer.get(more, math.inf), cost + price)
        paths = longer

    def whole(text, cost):
        total = cost + decoder.price(text.strip() + " ")
        for word in text.split():
            node = decoder.START
            for letter in word:
                total -= decoder.stems.get(node, 0.0)
                node = decoder._next(node, letter)
            total -= decoder.ends.get(node, 0.0)
        return total

    return min(((whole(t, c), t.strip()) for t, c in paths.items() if t.strip()), default=(math.inf, ""))


def test_search_is_exact():
    rng = np.random.default_rng(5)
    trigrams = rng.normal(-4.0, 2.0, (toxicity.SIZE,) * 3)
    decoder = toxicity.Decoder(trigrams, {"idiot": 5.0, "as*": 3.0, "lil": 2.0, "e": 2.0})
    draw = random.Random(5)
    for _ in range(400):
        observed = "".join(draw.choice("aidotsl01!*$.- éa") for _ in range(draw.randint(1, 9))).strip()
        want, got = all_paths(decoder, observed), decoder.best(observed)
        assert (math.isinf(want[0]) and math.isinf(got[0])) or math.isclose(want[0], got[0], rel_tol=1e-9), (observed, want, got)
        assert decoder.known(got[1]) <= decoder.reaches(observed), observed


def test_copies_of_a_toxic_text_are_not_evidence(spark, docs):
    frame, labels = labelled(spark, docs)
    more = docs(["a rare word of one text idiot"] * 50, list(range(1000, 1050)))
    model = toxicity.fit(frame.union(more), labels.union(spark.createDataFrame([(k, 1) for k in range(1000, 1050)], "doc_id bigint, toxic int")))
    assert not {"rare", "text", "word"} & set(model.weights)


def test_nothing_to_learn(spark, docs, odd):
    frame, labels = labelled(spark, docs)
    for part in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.fit(frame, part)
        assert model.weights == {} and all(r.score < 0.7 for r in toxicity.score(docs(odd), model).collect())
    assert toxicity.score(frame.limit(0), toxicity.fit(frame.limit(0), labels)).count() == 0


def test_held_out_documents(spark):
    got = queries.RUN["op4_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    cells = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert cells[1, 1] / (cells[1, 1] + cells[1, 0]) > 0.85 and cells.get((0, 1), 0) / (cells[0, 0] + cells.get((0, 1), 0)) < 0.01, cells
